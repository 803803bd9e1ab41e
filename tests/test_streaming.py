from threadloom.streaming import cases


def test_sessions_close_by_watermark(spark, tmp_path):
    rows = [("a", "customer", "it skips", "2024-01-01 10:00:00"), ("a", "support", "restart?", "2024-01-01 10:05:00"), ("a", "customer", "no luck", "2024-01-01 10:10:00"), ("a", "support", "ok", "2024-01-01 10:11:00"), ("b", "customer", "hi", "2024-01-01 11:00:00"), ("z", "customer", "far later", "2024-01-03 00:00:00")]
    df = spark.createDataFrame(rows, "conversation_id string, role string, text string, ts string").selectExpr("conversation_id", "role", "text", "cast(ts as timestamp) as ts")
    for i in range(2):
        df.filter(f"(conversation_id = 'z') = ({i} = 1)").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = cases.start(cases.open_cases(stream), str(tmp_path / "out"), str(tmp_path / "ck"))
    q.awaitTermination(120)
    got = {r["conversation_id"]: r for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert set(got) == {"a", "b"} and got["a"]["multi_turn"] and got["a"]["failures"] == 1 and got["a"]["failure_marker_flag"] and not got["b"]["multi_turn"]

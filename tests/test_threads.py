import pytest
from pyspark.sql import functions as F

from threadloom.operators import profile, threads
from threadloom.sources import tables as src

SCHEMA = "id string, author_id string, role string, text string, parent string, response string, created_at string"


def graph(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def chain(n, company="co"):
    rows = []
    for i in range(n):
        rows.append((f"m{i:03d}", "cust" if i % 2 == 0 else company, "customer" if i % 2 == 0 else "support", f"text {i}", f"m{i - 1:03d}" if i else "", f"m{i + 1:03d}" if i < n - 1 else "", f"{i:04d}"))
    return rows


def collect(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


def test_branching_and_account_filter(spark):
    m = graph(spark, [*chain(3), ("x1", "co", "support", "other branch", "m000", "", "0009"), ("y0", "c2", "customer", "q", "", "y1", "1"), ("y1", "rival", "support", "a", "y0", "", "2")])
    assert collect(threads.roots(m), "root", "company") == [("m000", "co"), ("y0", "rival")]
    assert collect(threads.roots(m, "co"), "root") == [("m000",)]
    t = threads.threads(m, threads.roots(m))
    assert collect(t, "root", "id", "depth") == [("m000", "m000", 0), ("m000", "m001", 1), ("m000", "m002", 2), ("m000", "x1", 1), ("y0", "y0", 0), ("y0", "y1", 1)]
    assert collect(threads.threads(m, threads.roots(m), rounds_by_join=True), "root", "id", "depth") == collect(t, "root", "id", "depth")


def test_chain_longer_than_the_limit_is_partial(spark):
    m = graph(spark, chain(103))
    with threads.recursion(spark):
        t = threads.threads(m, threads.roots(m))
        assert t.count() == 101
        assert t.agg(F.max("depth")).first()[0] == 100
        status = threads.reconstruction_status(t, m).first()
    assert status["status"] == "partial" and "depth_limit" in status["reasons"]


def test_status_of_missing_and_one_sided_links(spark):
    lost_reply = [("a0", "c", "customer", "q", "", "a1", "1"), ("a1", "co", "support", "r", "a0", "gone", "2")]
    one_sided = [("b0", "c", "customer", "q", "", "b1", "1"), ("b1", "co", "support", "r", "b0", "", "2"), ("b2", "co", "support", "again", "b0", "", "3")]
    fine = [("d0", "c", "customer", "q", "", "d1", "1"), ("d1", "co", "support", "r", "d0", "", "2")]
    m = graph(spark, lost_reply + one_sided + fine)
    t = threads.threads(m, threads.roots(m))
    got = {r["root"]: (r["status"], r["reasons"]) for r in threads.reconstruction_status(t, m).collect()}
    assert got == {"a0": ("partial", ["missing_response_target"]), "b0": ("uncertain", ["non_reciprocal_link"]), "d0": ("complete", [])}


def test_links_and_or_join(spark):
    m = graph(spark, [("a0", "c", "customer", "q", "", "a1", "1"), ("a1", "co", "support", "r", "a0", "gone", "2"), ("a2", "co", "support", "r", "a0", "", "3")])
    one = threads.link_quality(m).first().asDict()
    assert one == {"response_populated": 2, "response_resolvable": 1, "response_reciprocal": 1, "parent_populated": 2, "parent_resolvable": 2, "parent_reciprocal": 1}
    assert collect(threads.linked_to(m), "author_id", "linked") == [("co", 1)]


def test_assembly_orders_and_signs(spark):
    m = graph(spark, chain(4))
    j = threads.assemble(threads.threads(m, threads.roots(m)), m)
    row = j.first()
    assert [x["id"] for x in row["messages"]] == ["m000", "m001", "m002", "m003"]
    assert row["multi_turn"] and row["customer_turns"] == 2
    assert threads.journey_violations(j).isEmpty()


def test_profile_counts_blanks(spark):
    df = spark.createDataFrame([("a", None), (" ", "x")], "p string, q string")
    assert collect(profile.missing_by_column(df, ("p", "q")), "field", "missing") == [("p", 1), ("q", 1)]


def test_csv_with_mark_quotes_and_breaks(spark, tmp_path):
    f = tmp_path / "m.csv"
    f.write_bytes(b"\xef\xbb\xbf" + ",".join(src.RAW_FIELDS).encode() + b'\n1,u,True,Mon Oct 23 17:40:17 +0000 2017,"a ""b""\nc",2,\n2,co,False,nonsense,ok \xff,,1\n')
    rows = {r["tweet_id"]: r for r in src.typed_messages(src.read_messages(spark, str(f))).collect()}
    assert rows["1"]["text"] == 'a "b"\nc' and rows["1"]["role"] == "customer" and str(rows["1"]["created_ts"]) == "2017-10-23 17:40:17"
    assert rows["2"]["created_ts"] is None and rows["2"]["text"].endswith("�") and rows["1"]["in_response_to_tweet_id"] == ""


def test_upsert_and_records(spark, tmp_path):
    old = spark.createDataFrame([("a", 1), ("b", 1)], "k string, v int")
    new = spark.createDataFrame([("b", 2), ("c", 2)], "k string, v int")
    held = src.upsert(old, new, "k")
    assert collect(held, "k", "v") == [("a", 1), ("b", 2), ("c", 2)]
    src.write_records(held, str(tmp_path / "out"), single=True)
    assert src.written_as_given(held, str(tmp_path / "out"))
    (tmp_path / "bad.jsonl").write_text('{"k":"a"}\n\nnot json\n{"v":1}\n')
    assert collect(src.bad_lines(spark, str(tmp_path / "bad.jsonl"), "k string", "k"), "error") == [("missing k",), ("not JSON",)]


def test_rounds_end_in_a_cycle(spark):
    rows = [("a", "x", "customer", "", "", "b"), ("b", "s", "support", "", "a", "c"), ("c", "x", "customer", "", "b", "b"), ("b", "s", "support", "", "c", "")]
    m = spark.createDataFrame(rows, "id string, author_id string, role string, text string, parent string, response string")
    start = spark.createDataFrame([("a",)], "root string")
    got = threads.threads(m, start, 20, rounds_by_join=True, guard=True).collect()
    assert sorted((r["id"], r["depth"]) for r in got) == [("a", 0), ("b", 1), ("c", 2)]


def test_store_replaces_looks_up_and_sorts_keys(spark, tmp_path):
    df = spark.createDataFrame([(1, ("y", [(2, 1)])), (2, None)], "id int, z struct<b:string,a:array<struct<d:int,c:int>>>")
    path = f"{tmp_path}/store"
    for rows in (df, df.filter("id = 1")):
        src.replace_records(rows, path)
    lines = [r[0] for r in src.raw_lines(spark, path).collect()]
    assert lines == ['{"id":1,"z":{"a":[{"c":1,"d":2}],"b":"y"}}'] and [p.name for p in tmp_path.iterdir()] == ["store"]
    assert src.lookup(df, "id", 2).first()["id"] == 2 and src.lookup(df, "id").first()["id"] == 1
    with pytest.raises(KeyError):
        src.lookup(df, "id", 3)
    fresh = spark.createDataFrame([(1, 7, 1), (1, 8, 2), (3, 9, 1)], "k int, v int, at int")
    got = src.upsert(spark.createDataFrame([(1, 0), (2, 0)], "k int, v int"), fresh, "k", "at")
    assert sorted(map(tuple, got.collect())) == [(1, 8), (2, 0), (3, 9)]

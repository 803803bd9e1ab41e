"""The pipeline's stages on a small table, each judged on its own input."""

import glob
import os
import random

import corpus_pipeline
from threadloom.llm import jaccard
from threadloom.llm import licenses
from threadloom.llm.common import materialize


def test_stages(spark, tmp_path):
    good = [" ".join(f"word{(i * 7 + j * j) % 997}{'.' if j % 9 == 8 else ''}" for j in range(120)) + "." for i in range(8)]
    quoted = " ".join(f"benchmark{i}" for i in range(20))
    rows = [(i, t, "en", "s", len(t or "")) for i, t in enumerate([*good, good[0], "spam " * 100, "short", None, f"{good[5][::-1]} {quoted}", good[7][::-1] + " call +1 (217) 555-0123."])]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(0, quoted)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs, ids = spark.read.parquet(str(tmp_path / "documents.parquet")), []
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = materialize(stage(spark, docs, str(tmp_path)), name.replace(" ", "-"))
        assert docs.columns == columns
        ids.append({r["doc_id"] for r in docs.select("doc_id").collect()})
    assert ids[0] == {*range(9), 12, 13} and ids[1] == {*range(8), 12, 13} and ids[2] == ids[3] == {*range(8), 13}
    assert "555-0123" not in docs.filter("doc_id = 13").first()["text"]
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert {r["doc_id"] for r in out.select("doc_id").distinct().collect()} == ids[3] and out.filter("length & (length - 1) <> 0").count() == 0


def test_own_columns_stay_as_they_are(spark, tmp_path):
    text = " ".join(f"word{(i * i) % 997}" for i in range(120)) + ". Mail me at someone@example.com."
    schema = "doc_id long, text string, `a.b` string, n_pii long, pii_kinds string, row int, f string, v string, `kept` boolean, _mark string, _p string, sum double"
    rows = [(1, text, "x", 777, "mine", 5, "f", "v", False, "m", "p", 0.5), (2, None, None, None, None, None, None, None, None, None, None, None), (None, text, "y", 1, "", 1, "", "", True, "", "", 1.0), (None, text, "y", 1, "", 1, "", "", True, "", "", 1.0)]
    spark.createDataFrame([(0, "not in any of them, but long enough to be looked up here and there")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = spark.createDataFrame(rows, schema)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = materialize(stage(spark, docs, str(tmp_path)), name.replace(" ", "-"))
        assert docs.columns == spark.createDataFrame([], schema).columns
    got = sorted((tuple(r) for r in docs.collect()), key=repr)
    assert len(got) == 3 and [r[2:] for r in got] == sorted((r[2:] for r in rows if r[1]), key=repr) and all("example.com" not in r[1] for r in got)
    assert licenses.scan(docs).filter("n_words > 100").select("`a.b`", "row").count() == 3


def test_empty_tables_pass_through(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    spark.createDataFrame([], schema).write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).isEmpty()
    text = " ".join(f"word{(i * i) % 997}" for i in range(120))
    spark.createDataFrame([(i, text, "en", "s", len(text)) for i in (4, 2, 2)], schema).write.parquet(str(tmp_path / "full/documents.parquet"))
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "full/benchmark.parquet"))
    assert {r["doc_id"] for r in corpus_pipeline.run(spark, str(tmp_path / "full")).collect()} == {2}


def test_only_rows_that_may_go_are_shuffled_whole(spark):
    """Rows that stay for certain pass by the shuffle of whole rows: the union has them as a branch without one."""
    words = lambda i: " ".join(f"w{i}x{j}" for j in range(30))
    rows = [(i, words(i)) for i in range(60)] + [(100 + i, words(i)) for i in range(5)] + [(7, words(7)), (8, words(9000)), (None, words(1))]
    out = jaccard.keep_one(spark.createDataFrame(rows, "doc_id long, text string"))
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "Join LeftSemi" in plan.split("Filter NOT")[-1] and "Filter NOT" in plan
    want = [(i, words(i)) for i in range(60)] + [(8, words(9000)), (None, words(1))]
    assert sorted(map(tuple, out.collect()), key=str) == sorted(want, key=str)


def test_near_duplicates_leave_little_behind(spark, tmp_path, monkeypatch):
    """Of what the stage writes only the rows to keep stay, and queries that are written remove their shuffle files."""
    from threadloom.llm import common

    monkeypatch.setattr(common, "shared_dir", lambda spark, name: f"{tmp_path}/scratch/{name}-{len(os.listdir(tmp_path / 'scratch'))}-{os.urandom(4).hex()}")
    (tmp_path / "scratch").mkdir()
    words = lambda i, cut=40: " ".join(f"w{i}x{j}" for j in range(cut))
    rows = [(i, words(i)) for i in range(30)] + [(100 + i, words(i, 39)) for i in range(9)] + [(7, words(7)), (None, words(1))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for block in (2000, 2):
        out = jaccard.keep_one(docs, block_sets=block)
        left = {os.path.basename(x).split("-")[0] for x in glob.glob(f"{tmp_path}/scratch/*")}
        assert left == {"keep"} and spark.conf.get(common.CLEANUP, None) is None
        assert sorted(map(tuple, out.collect()), key=str) == sorted([*rows[:30], (None, words(1))], key=str)


def test_quality_rules_write_no_copy_of_the_rows(spark, tmp_path, monkeypatch):
    """The stage keeps what ``judge`` keeps and leaves nothing in the shared folder."""
    from threadloom.llm import common, quality

    monkeypatch.setattr(common, "shared_dir", lambda spark, name: f"{tmp_path}/{name}-{os.urandom(4).hex()}")
    words = lambda i, n: " ".join(f"word{(i * 7 + j * j) % 997}{'.' if j % 9 == 8 else ''}" for j in range(n))
    texts = [None, "", "short", "spam " * 100, *(words(i, 40 + 3 * i) for i in range(20)), *(words(i, 90) + " # $ %" * (4 * i) for i in range(9)), "\n".join([words(1, 30)] * 4), words(3, 80).upper() + "!" * 60]
    docs = spark.createDataFrame(list(enumerate(texts)) + [(5, words(0, 200)), (None, words(2, 200))], "`a.b` long, text string")
    out = corpus_pipeline.quality_rules(spark, docs, "")
    assert out.columns == docs.columns and not os.listdir(tmp_path)
    want = quality.judge(docs).filter("kept").select("row.*").collect()
    assert 5 < len(want) < len(texts) and sorted(map(tuple, out.collect()), key=str) == sorted(map(tuple, want), key=str)


def test_sets_of_a_large_family_are_not_copied_for_every_block(spark, monkeypatch):
    """A family held together by common passages falls apart before its sets are dealt; near copies meet in waves. Classes are those of all pairs."""
    rng, dealt, linked = random.Random(3), [], jaccard._linked
    monkeypatch.setattr(jaccard, "_linked", lambda rows, t: (dealt.append(rows.count()), linked(rows, t))[1])
    monkeypatch.setattr(jaccard, "CROWD", 7)
    monkeypatch.setattr(jaccard, "TIES_AT_ONCE", 1 << 14)
    passages = [" ".join(f"p{i}x{j}" for j in range(12)) for i in range(16)]
    texts = [" ".join(rng.sample(passages, 4)) for _ in range(150)]
    base = [f"w{j}" for j in range(60)]
    texts += [" ".join(base[:a] + base[a + 1 :]) for a in range(60)] + [" ".join([*t.split(), "more"]) for t in texts[:9]]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in jaccard.similarity_classes(docs, 5, 80, 100, block_sets=6).collect()}
    sets = [{tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)} for t in texts]
    own = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]) and own[i] != own[j]:
                a, b = sorted((own[i], own[j]))
                own = [a if x == b else x for x in own]
    assert [got[i] for i in range(len(texts))] == own and own.count(150) == 60
    assert len(dealt) > 1 and max(dealt) <= 4 * 90  # of 219 sets in 37 blocks, each to 36 others

"""Stores, staged links, numbered lines, pointer doubling, running patterns and seeded order against plain versions."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from threadloom.functions import running
from threadloom.functions.vocab import STATE_PATTERNS
from threadloom.operators import duplicates, sampling, state, threads, transitions
from threadloom.sources import staging
from threadloom.sources import tables as src
from threadloom.sources.store import Conflict, Store

SCHEMA = "id string, author_id string, role string, text string, parent string, response string, created_at string"


def rows(df, *cols):
    return sorted((tuple(r) for r in (df.select(*cols) if cols else df).collect()), key=repr)


def chain(n):
    return [(f"m{i:03d}", "cust" if i % 2 == 0 else "co", "customer" if i % 2 == 0 else "support", f"text {i}", f"m{i - 1:03d}" if i else "", f"m{i + 1:03d}" if i < n - 1 else "", f"{i:04d}") for i in range(n)]


# ---- pointer doubling

def test_doubling_equals_the_recursive_forms(spark):
    side = [("x1", "co", "support", "branch", "m004", "", "9"), ("x2", "c", "customer", "branch", "x1", "", "9"), ("lost", "c", "customer", "q", "gone", "", "9")]
    loop = [("l1", "c", "customer", "a", "l3", "", "1"), ("l2", "c", "customer", "b", "l1", "", "1"), ("l3", "c", "customer", "c", "l2", "", "1"), ("l4", "c", "customer", "into", "l3", "", "1"), ("self", "c", "customer", "s", "self", "", "1")]
    m = spark.createDataFrame([*chain(100), *side, *loop], SCHEMA)
    start = threads.roots(m)
    with threads.recursion(spark):
        want = rows(threads.threads(m, start))
    assert rows(threads.threads_by_doubling(m, start)) == want and len(want) == 102
    few = spark.createDataFrame([*chain(9), *side, *loop], SCHEMA)
    assert rows(threads.threads_by_doubling(few, start)) == rows(threads.threads(few, start, rounds_by_join=True, guard=True))
    assert threads.pointers(m, start, 7).filter("depth = 99 AND rest").count() == 1
    assert [r[0] for r in rows(threads.in_cycles(m, start))] == ["l1", "l2", "l3", "l4", "self"]
    assert threads.threads_by_doubling(m, start, 3).agg(F.max("depth")).first()[0] == 3
    assert threads.threads_by_doubling(m.limit(0), start.limit(0)).isEmpty()


def test_two_recursive_results_do_not_mix(spark):
    a, b = spark.createDataFrame(chain(4), SCHEMA), spark.createDataFrame([(f"z{r[0]}", *r[1:4], f"z{r[4]}" if r[4] else "", f"z{r[5]}" if r[5] else "", r[6]) for r in chain(3)], SCHEMA)
    with threads.recursion(spark):
        first, second = threads.threads(a, threads.roots(a)), threads.threads(b, threads.roots(b))
        assert first.count() == 4 and second.count() == 3 and not [t for t in spark.catalog.listTables() if t.name.startswith("_thread")]


# ---- staged links

def test_staged_joins_shuffle_nothing(spark):
    m = spark.createDataFrame([*chain(9), ("b0", "c", "customer", "q", "", "b1", "1"), ("b1", "co", "support", "r", "b0", "", "2"), ("b2", "co", "support", "r", "b0", "nowhere", "2"), ("n0", "c", "customer", "q", None, None, "3")], SCHEMA)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    links = staging.stage(m, 4)
    try:
        for df in (staging.roots(links), staging.resolved(links, "parent"), staging.resolved(links, "response")):
            plan = df._jdf.queryExecution().executedPlan().toString()
            assert "Join" in plan and "Exchange" not in plan
        moved = staging.link_status(links)._jdf.queryExecution().executedPlan().toString()
        assert moved.count("SortMergeJoin") == 3 and moved.count("Exchange") == 1  # the faults alone
        found = threads.threads_by_doubling(m, threads.roots(m))
        chained = staging.thread_stats(links, spark.createDataFrame(found.collect(), found.schema))
        assert chained._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning(id") == 1
        assert rows(staging.link_quality(links)) == rows(threads.link_quality(m.fillna("", ["parent", "response"])))
        assert rows(staging.roots(links, "co"), "root", "company") == rows(threads.roots(m, "co"), "root", "company")
        assert rows(staging.linked_to(links)) == rows(threads.linked_to(m))
        assert rows(chained) == rows(threads.thread_stats(found, m))
        assert ("b2", False, True, True) in rows(staging.link_status(links)) and staging.link_status(links).count() == m.count()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
        links.drop()


# ---- the store

def test_readers_see_whole_versions(spark, tmp_path):
    df = lambda pairs: spark.createDataFrame(pairs, "k long, v string")
    store = Store(spark, f"file://{tmp_path}/s", "k", df([]).schema)
    assert store.read().isEmpty() and store.latest().number == 0
    first = store.upsert(df([(1, "a"), (2, "b")]))
    held = store.read(first)
    folder = store._write(df([(1, "new"), (3, "c")]))  # written, not yet published: nobody sees it
    assert rows(store.read()) == [(1, "a"), (2, "b")]
    second = store.publish(first, (*first.folders, folder))
    assert rows(held) == rows(store.read(first)) == [(1, "a"), (2, "b")] and rows(store.read()) == [(1, "new"), (2, "b"), (3, "c")]
    third = store.compact()
    assert third.number == 3 and len(third.folders) == 1 and rows(store.read()) == rows(store.read(second))
    assert len(store.vacuum(1)) == 2 and rows(store.read()) == [(1, "new"), (2, "b"), (3, "c")] and store.versions() == [3]
    for bad in ([(1, "x"), (1, "y")],):
        with pytest.raises(ValueError, match="twice"):
            store.upsert(df(bad))
    with pytest.raises(Exception, match="without a key"):
        store.upsert(df([(None, "x")]))
    assert store.latest().number == 3


def test_of_two_writers_one_wins_and_one_starts_again(spark, tmp_path):
    df = lambda pairs: spark.createDataFrame(pairs, "k long, v long")
    store, other = (Store(spark, str(tmp_path / "s"), "k", df([]).schema) for _ in range(2))
    base = store.upsert(df([(1, 1)]))
    store.publish(base, (*base.folders, store._write(df([(2, 2)]))))
    with pytest.raises(Conflict):
        other.publish(base, (*base.folders, other._write(df([(3, 3)]))))
    calls = []

    def add(held):
        calls.append(1)
        if len(calls) == 1:  # meanwhile another writer commits
            other.upsert(df([(1, 100)]))
        return held.withColumn("v", F.col("v") + 1)

    store.update(add)
    assert len(calls) == 2 and rows(store.read()) == [(1, 101), (2, 3)]


def test_last_per_key_keeps_clashing_columns(spark):
    df = spark.createDataFrame([(1, 1, "a", 5), (1, 2, "b", 6), (2, 1, "c", 7)], "k long, t long, _n string, `a.b` long")
    assert rows(src.last_per_key(df, "k", "t")) == [(1, 2, "b", 6), (2, 1, "c", 7)]


# ---- lines

def test_lines_are_numbered_over_splits(spark, tmp_path):
    rng, files = random.Random(1), {}
    for name in ("a", "b", "c"):
        files[name] = ["" if rng.random() < 0.1 else '{"k": "x"' if rng.random() < 0.05 else '{"v": 1}' if rng.random() < 0.05 else '{"k": "%s"}' % ("y" * rng.randrange(60)) for _ in range(rng.randrange(200, 900))]
        (tmp_path / f"{name}.json").write_text("\n".join(files[name]) + ("\n" if name != "b" else ""))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        held = src.numbered_lines(spark, str(tmp_path))
        assert held.rdd.getNumPartitions() > 6
        got = sorted((r["file"][-6], r["line"], r["value"]) for r in held.collect())
        assert got == [(n, i, v) for n, lines in files.items() for i, v in enumerate(lines, 1)]
        bad = sorted((r["file"][-6], r["line"], r["error"]) for r in src.bad_lines(spark, str(tmp_path), "k string, v int", "k").collect())
        assert bad == [(n, i, "not JSON" if v.endswith('"x"') else "missing k") for n, lines in files.items() for i, v in enumerate(lines, 1) if v.endswith('"x"') or v.startswith('{"v"') or v == '{"k": ""}']
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


# ---- running patterns

WORDS = ["developer", "technical", "team", "investi", "gat", "passed", "feedback", "to", "dm", "direct", "message", "private", "user", "name", "acc", "ount", "device", "operating", "system", "io", "s", "android", "error", "try", "clear", "cache", "log", "in", "phone", "won't", "work", "\n", "no", "luck", "song link", "x"]


def talk(rng, n):
    out = []
    for c in range(n):
        for p in range(rng.randrange(1, 14)):
            t = rng.choice(["", " "]).join(rng.choice(WORDS) for _ in range(rng.randrange(0, 5)))
            out.append((str(c), p, rng.choice(["customer", "support"]), rng.choice([" feedback", "passed", "passed ", "passed a", "fee", "dback", " \nfeedback"]) if rng.random() < 0.1 else t))
    return out


@pytest.mark.parametrize("p", [STATE_PATTERNS, {**STATE_PATTERNS, "investigation": r"a.*b|to.*dm\b|\bio.*s", "platform": r"\bx\b|[a|b]c", "diagnostic": r"\be\w{0,3}r\b|k\s{1,3}d"}])
def test_running_states_equal_those_of_whole_texts(spark, p):
    m = spark.createDataFrame(talk(random.Random(3), 150), "conversation_id string, pos int, role string, text string")
    assert rows(state.at_every_customer_message(m, p)) == rows(state.from_running_texts(m, p))


def test_running_state_of_a_very_long_conversation(spark):
    text = lambda i: "nothing to see" if i not in (15_001, 18_003) else "passed this on" if i == 15_001 else "as feedback"
    m = spark.createDataFrame([("z", i, "support" if i % 2 else "customer", text(i)) for i in range(20_000)], "conversation_id string, pos int, role string, text string")
    got = Counter(r["state"] for r in state.at_every_customer_message(m).filter("pos > 18003").collect())
    assert got == {"SPECIALIST_OR_PRODUCT_INVESTIGATION": 998}
    assert state.at_every_customer_message(m).filter("pos < 18003 AND state = 'SPECIALIST_OR_PRODUCT_INVESTIGATION'").isEmpty()


def test_patterns_without_a_bound_are_refused():
    assert running.split("a|b.*c|(d|e)") == (["a", "(d|e)"], [("b", "c")]) and running.width(r"\b(dm|direct message)\b") == 14
    for p in (r"a+", r"^a", r"a(?=b)", r"(a)\1", "x.*y.*z"):
        with pytest.raises(ValueError):
            [running.width(a) for a in running.split(p)[0]]


# ---- duplicates, evidence and order

def test_copies_and_components_keep_null_keys(spark):
    df = spark.createDataFrame([(1, "a", "x"), (2, "a", "y"), (3, None, "x"), (4, None, None)], "id long, _key string, s string")
    got = duplicates.with_copies(df, F.col("_key"))
    assert rows(got) == [(1, "a", "x", 2), (2, "a", "y", 2), (3, None, "x", 2), (4, None, None, 2)] and got.columns == ["id", "_key", "s", "copies"]
    assert rows(duplicates.components(df, "id", "_key")) == [(1, 1), (2, 1), (3, 3), (4, 4)]
    assert rows(duplicates.components(df, "id", "_key", "s")) == [(1, 1), (2, 1), (3, 1), (4, 4)]
    assert duplicates.with_copies(df.limit(0), F.col("s")).isEmpty() and duplicates.components(df.limit(0), "id", "s").isEmpty()


def test_a_hot_key_is_dealt(spark):
    df = spark.range(6000).select(F.col("id"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("k"), F.concat(F.lit("c"), F.shiftright("id", 1)).alias("k2"))
    got = duplicates.with_copies(df, F.col("k"))
    assert got.filter("k = 'hot'").agg(F.count("*"), F.min("copies"), F.max("copies")).first() == (2000, 2000, 2000) and got.count() == 6000
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            parent[x] = x = parent[parent[x]]
        return x

    for i in range(6000):
        for s in ("hot" if i % 3 == 0 else f"o{i}", f"c{i >> 1}"):
            parent[find(s)] = find(i)
    least = {}
    for i in range(6000):
        least[find(i)] = min(least.get(find(i), i), i)
    assert {r["id"]: r["group"] for r in duplicates.components(df, "id", "k", "k2").collect()} == {i: least[find(i)] for i in range(6000)}


def test_components_along_a_chain(spark):
    df = spark.range(40).select("id", F.shiftright("id", 1).cast("string").alias("a"), F.shiftright(F.col("id") + 1, 1).cast("string").alias("b"))
    assert {r["group"] for r in duplicates.components(df, "id", "a", "b").collect()} == {0}


def test_first_seen_lists_are_bounded_and_ordered(spark):
    rng, plain = random.Random(7), {}
    seen = [(rng.randrange(40), i, rng.choice(["s", None]), rng.choice("ab"), rng.choice(["failed", "resolved", "unknown"])) for i in range(600)]
    for c, i, s, a, _ in sorted(seen):
        plain.setdefault((s, a), {}).setdefault(c, i)
    got = transitions.aggregate(spark.createDataFrame(seen, "conversation_id long, item long, state string, action string, result string"), order=("item", "conversation_id"), most=5)
    for r in got.collect():
        want = [c for c, i in sorted(plain[r["state"], r["action"]].items(), key=lambda x: x[1])]
        assert r["conversation_ids"] == want[:5] and r["conversations"] == len(want)


def test_seeded_order_is_that_of_a_shuffled_list(spark):
    keys = [f"k{i * 7919 % 1000:04d}" for i in range(1000)]
    df = spark.createDataFrame([(k, i) for i, k in enumerate(keys)], "k string, n long").repartition(7)
    assert [r["rank"] for r in sampling.dense_ranks(df, "k").orderBy("k").collect()] == list(range(1000))
    want = sorted(keys)
    random.Random(42).shuffle(want)
    assert [r["k"] for r in sampling.seeded_order(df, "k", 42).orderBy("place").collect()] == want
    with pytest.raises(ValueError):
        sampling.permutation(spark, 11, 1, most=10)


@pytest.mark.parametrize("share", [0.2, 0.0, 0.5])
def test_shuffled_split_equals_a_plain_one(spark, share):
    rng = random.Random(8)
    member = {i: f"g{rng.randrange(60):02d}" for i in range(150)}
    groups = {}
    for i, g in member.items():
        groups.setdefault(g, []).append(i)
    order = sorted(groups.items())
    random.Random(5).shuffle(order)
    taken, target = set(), round(len(member) * share)
    for _, ids in order:
        if len(taken) >= target and taken:
            break
        taken.update(ids)
    df = spark.createDataFrame(list(member.items()), "id long, group string")
    got = {r["id"]: r["split"] for r in duplicates.shuffled_split(df, "id", 5, share).collect()}
    assert got == {i: "reserved" if i in taken else "development" for i in member}

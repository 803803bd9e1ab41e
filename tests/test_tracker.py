"""The case tracker: a replay in shuffled micro-batches gives the batch operators' rows at every point."""

import random
from datetime import datetime, timedelta

from threadloom.functions.vocab import STATE_PATTERNS
from threadloom.operators import ledger, state
from threadloom.streaming import tracker

WORDS = ["restart", "the", "app", "log", "out", "still", "not", "working", "reinstall", "fixed", "device", "error", "passed", "this", "feedback", "account", "email", "dm", "no", "luck", "try", "browser", "clear", "cache", "phone", "now", "works", "i", "tried"]
START = datetime(2024, 1, 1)


def talks(rng, n):
    rows = []
    for c in range(n):
        at = START + timedelta(minutes=rng.randrange(0, 30))
        for p in range(rng.randrange(1, 10)):
            at += timedelta(seconds=rng.randrange(5, 200))
            rows.append((f"c{c}", p, f"m{p}", rng.choice(["customer", "support"]), " ".join(rng.choice(WORDS) for _ in range(rng.randrange(0, 9))), at))
    return rows


def test_steps_equal_the_batch_operators(spark):
    rows = talks(random.Random(1), 120)
    m = spark.createDataFrame([r[:5] for r in rows], "conversation_id string, pos int, message_id string, role string, text string")
    p, got = tracker.Patterns(STATE_PATTERNS, ledger.action_patterns(), tracker.RESULT_PATTERNS, tracker.OWN_ATTEMPT), []
    held = {}
    for c, _, i, role, text, _ in rows:
        got += [{"conversation_id": c, **r} for r in tracker.step(held.setdefault(c, tracker.fresh()), p, i, role, text)]
    got += [{"conversation_id": c, **r, "kind": "item", "result": "unknown"} for c, h in held.items() for r in h["waiting"]]
    want = {(r["conversation_id"], r["pos"], r["state"]) for r in state.at_every_customer_message(m).collect()}
    assert {(r["conversation_id"], r["pos"], r["state"]) for r in got if r["kind"] == "state"} == want and len({s for _, _, s in want}) > 4
    items = {tuple(r) for r in ledger.attempts(m).select("conversation_id", "item", "action", "message_id", "explicitness", "result").collect()}
    assert {tuple(r[k] for k in ("conversation_id", "item", "action", "message_id", "explicitness", "result")) for r in got if r["kind"] == "item"} == items and len(items) > 50


def test_replay_in_shuffled_batches(spark, tmp_path):
    rng = random.Random(2)
    rows = talks(rng, 25)
    m = spark.createDataFrame([r[:5] for r in rows], "conversation_id string, pos int, message_id string, role string, text string")
    schema = "conversation_id string, message_id string, role string, text string, ts timestamp"
    # by time, but each message up to eight minutes late; two stand twice
    order = sorted([*rows, rows[3], rows[40]], key=lambda r: r[5] + timedelta(seconds=rng.randrange(0, 480)))
    size = -(-len(order) // 6)
    parts = [order[i : i + size] for i in range(0, len(order), size)] + [[("end", 0, "e", "customer", "far", START + timedelta(days=1))], [("end", 1, "f", "customer", "farther", START + timedelta(days=2))]]
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
    for k, part in enumerate(parts):
        spark.createDataFrame([(r[0], r[2], r[3], r[4], r[5]) for r in part], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        q = tracker.track(stream).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
        assert q.awaitTermination(200), f"batch {k} did not end"
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass") if before is None else spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    got = [r for r in spark.read.parquet(str(tmp_path / "out")).collect() if r["conversation_id"] != "end"]
    want = {(r["conversation_id"], r["pos"], r["state"]) for r in state.at_every_customer_message(m).collect()}
    states = [(r["conversation_id"], r["pos"], r["state"]) for r in got if r["kind"] == "state"]
    assert len(states) == len(set(states)) and set(states) == want
    items = sorted(tuple(r) for r in ledger.attempts(m).select("conversation_id", "item", "action", "message_id", "explicitness", "result").collect())
    assert sorted((r["conversation_id"], r["item"], r["action"], r["message_id"], r["explicitness"], r["result"]) for r in got if r["kind"] == "item") == items
    n = {}
    for r in rows:
        n[r[0]] = n.get(r[0], 0) + 1
    assert {r["conversation_id"]: r["messages"] for r in got if r["kind"] == "closed"} == n

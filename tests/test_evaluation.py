import hashlib
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from threadloom.functions import text as tx
from threadloom.operators import duplicates, evaluation, sampling
from threadloom.sources import tables as src


def pairs(spark, a, b):
    return spark.createDataFrame(list(zip(a, b, strict=True)), "t string, p string")


def test_metric_vectors(spark):
    r = evaluation.classification_metrics(pairs(spark, "aab", "abb"), "t", "p").first()
    assert round(r["accuracy"], 4) == 0.6667 and round(r["macro_f1"], 4) == 0.6667
    r = evaluation.binary_metrics(pairs(spark, ["yes", "no", "yes"], ["yes", "yes", "no"]), "t", "p").first()
    assert (r["precision"], r["recall"]) == (0.5, 0.5)
    assert round(evaluation.cohens_kappa(pairs(spark, "aba", "abb"), "t", "p").first()["kappa"], 4) == 0.4
    assert evaluation.cohens_kappa(pairs(spark, "aa", "aa"), "t", "p").first()["kappa"] == 1.0
    assert evaluation.cohens_kappa(pairs(spark, "", ""), "t", "p").first()["kappa"] is None
    j = spark.createDataFrame([(["A", "B"], ["B", "C"]), ([], [])], "l array<string>, r array<string>").select(evaluation.jaccard(F.col("l"), F.col("r")).alias("j")).collect()
    assert [round(x["j"], 4) for x in j] == [0.3333, 1.0]


def test_operational_and_signals(spark):
    t = spark.createDataFrame(
        [("a", "X", ["X"], [(0.5,)], [("X", 2)], [], 0.9, 0.9, "AUTO_HANDLE"), ("b", "Y", [], [(0.5,)], [("Y", 1)], [], 0.2, 0.9, "ESCALATE")],
        "conversation_id string, selected string, rejected array<string>, hits array<struct<score:double>>, evidence array<struct<action:string,support_count:bigint>>, warnings array<string>, intent_confidence double, state_confidence double, decision string",
    )
    r = evaluation.operational_metrics(t).first()
    assert (r["repeated_failed_action_rate"], r["evidence_coverage"], r["transition_consistency"], r["response_groundedness"]) == (0.5, 1.0, 1.0, 1.0)
    s = {x["conversation_id"]: x["signals"] for x in evaluation.failure_signals(t).collect()}
    assert s == {"a": ["REPEATED_FAILED_ACTION_SELECTED"], "b": ["LOW_INTENT_CONFIDENCE", "ESCALATION_REVIEW"]}
    assert evaluation.signal_summary(t).first()["suspected_signal_count"] == 2


def annotation(i, **over):
    base = {"annotation_id": f"a{i}", "journey_id": f"j{i}", "root_tweet_id": f"r{i}", "annotator_id": "p", "intent": "", "current_state": "", "intent_status": "labelled", "state_status": "labelled", "observed_next_action": "UNKNOWN", "ideal_next_action": "", "outcome": "resolved", "escalation_eligible": "no", "evidence_visibility": "visible", "confidence": "high", "missing_information": [], "attempted_actions": [], "exclude_from_golden": "no", "escalation_reason_codes": ["A"]}
    return base | over


SCHEMA = "annotation_id string, journey_id string, root_tweet_id string, annotator_id string, intent string, current_state string, intent_status string, state_status string, observed_next_action string, ideal_next_action string, outcome string, escalation_eligible string, evidence_visibility string, confidence string, missing_information array<struct<requirement:string,status:string>>, attempted_actions array<struct<action:string,explicitness:string,result:string>>, exclude_from_golden string, escalation_reason_codes array<string>"


def test_annotation_rules_and_freeze(spark):
    a = spark.createDataFrame([annotation(1), annotation(2, exclude_from_golden="yes")], SCHEMA)
    c = spark.createDataFrame([("j1", "r1"), ("j2", "r2")], "journey_id string, root_tweet_id string")
    d = spark.createDataFrame([("z",)], "journey_id string")
    assert evaluation.annotation_errors(a, c, d).isEmpty()
    assert evaluation.freeze(a, c, d, least=1).count() == 1
    assert evaluation.freeze_manifest(a).first()["journey_ids"] == ["j1"]
    with pytest.raises(ValueError):
        evaluation.freeze(a, c, d, least=2)
    bad = spark.createDataFrame([annotation(1, root_tweet_id="x", outcome="?"), annotation(9, missing_information=[{"requirement": "no", "status": "missing"}])], SCHEMA)
    got = {(r["journey_id"], r["error"]) for r in evaluation.annotation_errors(bad, c, spark.createDataFrame([("j1",)], "journey_id string")).collect()}
    assert ("j1", "root_tweet_id does not match candidate") in got and ("j1", "golden journey appears in development data") in got and ("j9", "invalid missing-information item") in got and ("j9", "journey_id is not a golden annotation candidate") in got


def test_agreement(spark):
    one = spark.createDataFrame([annotation(1, intent="a"), annotation(2, intent="a")], SCHEMA)
    two = spark.createDataFrame([annotation(1, intent="a"), annotation(2, intent="b")], SCHEMA)
    r = {x["metric"]: x["value"] for x in evaluation.agreement(one, two).collect()}
    assert r["adjudication_rate"] == 0.5 and r["reason_jaccard"] == 1.0


def test_majority_takes_first_seen(spark):
    df = spark.createDataFrame([(1, "b"), (2, "a"), (3, "a"), (4, "b")], "i int, v string")
    assert evaluation.majority(df, "v", "i").first()["value"] == "b"


def test_groups_and_split(spark):
    d = spark.createDataFrame([(1, "x", "p"), (2, "x", "q"), (3, "y", "q"), (4, "z", "r"), (5, "w", "s")], "id long, a string, b string")
    g = {r["id"]: r["group"] for r in duplicates.components(d, "id", "a", "b").collect()}
    assert g == {1: 1, 2: 1, 3: 1, 4: 4, 5: 5}
    split = duplicates.group_split(duplicates.components(d, "id", "a", "b"), "id", "s", 0.4)
    assert {r["violations"] for r in duplicates.split_violations(split, d, "id").collect()} == {0}
    assert split.filter("split = 'reserved'").count() >= 2


def test_greedy_sample_meets_quotas(spark):
    rows = [(f"j{i}", "single_turn" if i % 2 else "long_multi_turn", "complete" if i % 3 else "partial", f"word{i} common") for i in range(20)]
    pool = spark.createDataFrame(rows, "id string, length_bucket string, reconstruction_status string, text string")
    s = sampling.greedy_sample(pool, "id", "1", {"single_turn": 3, "long_multi_turn": 2}, {"reconstruction_status": {"partial": 2}}).join(pool, "id")
    assert {r["length_bucket"]: r["count"] for r in s.groupBy("length_bucket").count().collect()} == {"single_turn": 3, "long_multi_turn": 2}
    assert s.filter("reconstruction_status = 'partial'").count() >= 2


def test_greedy_sample_matches_plain(spark):
    """Brute force: every pick anew the best of all open rows by coverage, new tokens, completeness and hash."""
    rng = random.Random(3)
    goals, second = {"single_turn": 4, "long_multi_turn": 5}, {"reconstruction_status": {"partial": 3, "complete": 4}, "failure_marker": {"true": 3}}
    rows = [(f"j{i:02d}", rng.choice(["single_turn", "long_multi_turn", "short_multi_turn"]), rng.choice(["complete", "partial"]), rng.choice(["true", "false"]), " ".join(rng.choices("ab cd ef gh ij kl mn op".split(), k=rng.randrange(0, 6)))) for i in range(40)]
    pool = spark.createDataFrame(rows, "id string, length_bucket string, reconstruction_status string, failure_marker string, text string")
    got, *others = ([r["id"] for r in sampling.greedy_sample(pool, "id", "9", goals, second, ahead=n).orderBy("pick").collect()] for n in (256, 2, 1))
    assert others == [got, got]
    df = Counter(t for r in rows for t in set(r[4].split()))
    tie = lambda r: int(hashlib.sha256(f"9:{r[0]}".encode()).hexdigest()[:16], 16)
    left, picked, open_, seen = list(rows), [], dict(goals), set()
    while able := [r for r in left if open_.get(r[1], 0) > 0]:

        def worth(r):
            have = lambda at, v: sum(p[at] == v for p in picked)
            cover = sum(10 + (goal - n) / goal for at, d in ((2, "reconstruction_status"), (3, "failure_marker")) if (goal := second[d].get(r[at], 0)) and (n := have(at, r[at])) < goal)
            return cover, round(sum(1 / df[t] for t in set(r[4].split()) - seen), 9), r[2] == "complete", tie(r)

        best = max(able, key=worth)
        picked.append(best)
        left.remove(best)
        open_[best[1]] -= 1
        seen |= set(best[4].split())
    assert got == [r[0] for r in picked]


def test_full_norm(spark):
    df = spark.createDataFrame([("  Straße ﬁne\n\tX",)], "t string")
    assert df.select(tx.full_norm("t").alias("n")).first()["n"] == "strasse fine x"


def test_provider_and_judge(spark):
    df = spark.createDataFrame([("p",)], "prompt string")
    assert evaluation.judged(src.with_provider(df, "prompt")).first()["judge_status"] == "NOT_AVAILABLE"
    good = {"scores": dict.fromkeys(evaluation.V.JUDGE_DIMENSIONS, 4), "rationale": "ok"}
    assert evaluation.judged(src.with_provider(df, "prompt", lambda p: good)).first()["judge_status"] == "MEASURED"
    assert evaluation.judged(src.with_provider(df, "prompt", lambda p: {"scores": {"clarity": 9}})).first()["judge_status"] == "INVALID"

"""Constraints, observed writes and the provider's answers."""

import pytest
from pyspark.sql import functions as F

from threadloom.functions import vocab as V
from threadloom.operators import constraints, evaluation, retrieval
from threadloom.sources import provider


def test_every_case_rule_finds_its_own_fault(spark):
    item = {"requirement": V.REQUIREMENTS[0], "status": "missing", "safely_requestable": "yes", "candidate_actions": [V.ACTIONS[0]]}
    act = {"action": V.ACTIONS[0], "explicitness": "explicit", "result": "failed", "order": 1}
    hit = {"rank": 1, "conversation_id": "x", "evidence_strength": "weak", "split": "development"}
    sound = {"conversation_id": "c", "current_role": "customer", "intent": None, "state": V.STATES[0], "selected": None, "evidence_strength": "strong", "risk": "low", "decision": None, "intent_confidence": 1.0, "state_confidence": None, "failed_actions": [V.ACTIONS[0]], "successful_actions": None, "missing": [item], "attempted": [act], "hits": [hit]}
    faults = [
        {"current_role": None}, {"intent": "Weather"}, {"state": ""}, {"selected": "DANCE"}, {"evidence_strength": None}, {"risk": "none"}, {"decision": "LATER"}, {"intent_confidence": 1.01}, {"state_confidence": -0.5}, {"successful_actions": ["DANCE"]},
        *({"missing": [item, {**item, k: v}]} for k, v in (("requirement", None), ("status", "gone"), ("safely_requestable", None), ("candidate_actions", ["DANCE"]))),
        *({"attempted": [{**act, k: v}]} for k, v in (("action", None), ("explicitness", ""), ("result", "odd"), ("order", 0))),
        {"hits": [{**hit, "rank": 0}]}, {"hits": [{**hit, "evidence_strength": None}]}, {"hits": [{**hit, "split": "golden"}]},
    ]
    schema = "conversation_id string, current_role string, intent string, state string, selected string, evidence_strength string, risk string, decision string, intent_confidence double, state_confidence double, failed_actions array<string>, successful_actions array<string>, missing array<struct<requirement:string,status:string,safely_requestable:string,candidate_actions:array<string>>>, attempted array<struct<action:string,explicitness:string,result:string,order:int>>, hits array<struct<rank:int,conversation_id:string,evidence_strength:string,split:string>>"
    rules = constraints.case_rules()
    df = spark.createDataFrame([{**sound, **f, "conversation_id": str(i)} for i, f in enumerate([*faults, {}, {"missing": None, "attempted": [], "hits": None}])], schema)
    got = {r["conversation_id"]: r["rule"] for r in constraints.violations(df, rules).collect()}
    assert got == {str(i): name for i, name in enumerate(rules)} and len(faults) == len(rules)
    assert {r["rule"]: r["violations"] for r in constraints.self_test(df, rules).collect()} == dict.fromkeys(rules, 1)


def test_message_rules(spark):
    m = "conversation_id string, reconstruction_status string, messages array<struct<message_id:string,role:string>>"
    rows = [("a", "complete", [("1", "customer")]), ("", "complete", [("1", "customer")]), ("b", None, None), ("c", "partial", [("", "customer"), ("2", "bot")])]
    got = sorted((r["conversation_id"], r["rule"]) for r in constraints.violations(spark.createDataFrame(rows, m), constraints.message_rules()).collect())
    assert got == [("", "conversation without an id"), ("b", "conversation without messages"), ("b", "reconstruction status"), ("c", "message role"), ("c", "message without an id")]


def test_counts_are_observed_while_writing(spark, tmp_path):
    df, rules = spark.range(100).repartition(5), {"odd": F.col("id") % 2 == 1, "large": F.col("id") > 1000}
    assert constraints.write_observed(df, str(tmp_path / "a"), rules, {"total": F.col("id")}) == {"rows": 100, "odd": 50, "large": 0, "total": 4950, "read_back": 100}
    assert constraints.write_sound(df, str(tmp_path / "b"), {"large": rules["large"]})["rows"] == 100
    with pytest.raises(ValueError, match="odd"):
        constraints.write_sound(df, str(tmp_path / "c"), rules)
    assert not (tmp_path / "c").exists()
    assert constraints.write_observed(df.limit(0), str(tmp_path / "d"), rules) == {"rows": 0, "odd": 0, "large": 0, "read_back": 0}


def test_answers_by_batches_and_tries():
    calls = []

    def call(prompts):
        calls.append(list(prompts))
        if len(calls) == 1:
            return [{"v": 1}, provider.Passing(), "text", KeyError("x"), provider.Passing()]
        return [{"v": 2}, provider.Passing()] if len(calls) == 2 else [provider.Passing()]

    got = provider.answered(call, list("abcde"), provider.Limits(pause=0.0))
    assert [(s, n) for s, _, n in got] == [("OK", 1), ("OK", 2), ("INVALID", 1), ("ERROR", 1), ("ERROR", 3)] and calls == [list("abcde"), list("be"), ["e"]]
    assert [s for s, _, _ in provider.answered(lambda p: [], ["a", "b"], provider.Limits(pause=0.0))] == ["ERROR", "ERROR"]
    assert provider.answered(lambda p: 1 / 0, ["a"], provider.Limits())[0][0] == "ERROR"


def test_each_prompt_is_asked_once_and_kept(spark, tmp_path):
    log = tmp_path / "log"
    log.mkdir()

    def call(prompts):
        import uuid

        (log / uuid.uuid4().hex).write_text("\n".join(prompts))
        return [{"scores": dict.fromkeys(V.JUDGE_DIMENSIONS, 4), "rationale": p} if p != "bad" else RuntimeError() for p in prompts]

    asked = lambda: sorted(p for f in log.iterdir() for p in f.read_text().split("\n"))
    df = spark.createDataFrame([(i, p) for i, p in enumerate(["x", "y", "x", None, "bad", ""] * 5)], "id int, prompt string")
    store = provider.answer_store(spark, str(tmp_path / "answers"))
    assert {r["status"] for r in provider.ask(df, "prompt", None, store).collect()} == {"NOT_AVAILABLE"}
    out = evaluation.judged(provider.ask(df, "prompt", call, store, limits=provider.Limits(batch=2, tasks=2))).collect()
    assert len(out) == 30 and {(r["prompt"], r["status"], r["judge_status"]) for r in out} == {("x", "OK", "MEASURED"), ("y", "OK", "MEASURED"), (None, "OK", "MEASURED"), ("", "OK", "MEASURED"), ("bad", "ERROR", "ERROR")}
    assert asked() == ["", "bad", "x", "y"]
    provider.ask(df, "prompt", call, store).collect()
    assert asked() == ["", "bad", "bad", "x", "y"]
    assert {r["status"] for r in provider.ask(df, "prompt", None, store).collect()} == {"OK", "NOT_AVAILABLE"}
    provider.ask(df, "prompt", call, store, model="other").collect()
    assert asked().count("x") == 2


def test_blank_queries_are_refused_and_exclusions_kept(spark):
    docs = spark.createDataFrame([("a", "red blue"), ("b", "red"), ("c", "green")], "conversation_id string, text string")
    for blank in (None, "", " \n\t"):
        with pytest.raises(ValueError, match="empty"):
            retrieval.search(spark.createDataFrame([("q", "red"), ("r", blank)], "query_id string, text string"), docs)
    q = spark.createDataFrame([("q", "red")], "query_id string, text string")
    out = spark.createDataFrame([("q", "b")], "query_id string, conversation_id string")
    assert [r["conversation_id"] for r in retrieval.search(q, docs, 3, exclude=out).orderBy("rank").collect()] == ["a", "c"]


def test_agreement_takes_the_last_record(spark):
    schema = "journey_id string, intent string, current_state string, ideal_next_action string, escalation_eligible string, escalation_reason_codes array<string>, exclude_from_golden string"
    row = lambda k, i: (k, i, "s", "a", "yes", ["x"], "no")
    a = spark.createDataFrame([row("1", "old"), row("1", "new"), row("2", "p")], schema).coalesce(1)
    b = spark.createDataFrame([row("1", "new"), row("2", "p")], schema)
    got = {r["metric"]: (r["value"], r["count"]) for r in evaluation.agreement(a, b).collect()}
    assert got["kappa.intent"] == (1.0, 2) and got["adjudication_rate"] == (0.0, 2)

"""Constraints of nested case records, and counts of broken ones that are observed while rows are written.

A rule is a named boolean column that is true where a record breaks it; null never passes as
sound. Rules come in one dictionary, so the same ones list the offenders, count them, or
refuse a write.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from threadloom.functions import vocab as V

# The vocabularies of a case record.
LEVELS, DECISIONS, REQUESTABLE, SIDES = ("low", "medium", "high"), ("AUTO_HANDLE", "ESCALATE"), ("yes", "no", "unknown"), ("customer", "support")


def _blank(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit("")) == ""


def _outside(c: Column, allowed: tuple[str, ...]) -> Column:
    return ~F.coalesce(c.isin(*allowed), F.lit(False))


def _optional(c: Column, allowed: tuple[str, ...]) -> Column:
    return c.isNotNull() & _outside(c, allowed)


def _any(items: Column, bad) -> Column:
    """Is there an item that ``bad`` holds for? A null list has none."""
    return F.coalesce(F.exists(items, bad), F.lit(False))


def message_rules(messages: str = "messages") -> dict[str, Column]:
    """Of a conversation with its messages nested."""
    return {
        "conversation without an id": _blank(F.col("conversation_id")),
        "conversation without messages": F.coalesce(F.size(messages), F.lit(0)) < 1,
        "reconstruction status": _outside(F.col("reconstruction_status"), V.RECONSTRUCTION_STATUSES),
        "message without an id": _any(F.col(messages), lambda m: _blank(m["message_id"])),
        "message role": _any(F.col(messages), lambda m: _outside(m["role"], SIDES)),
    }


def case_rules() -> dict[str, Column]:
    """Of a case: its point, labels and scores, missing information, attempted actions and retrieved conversations."""
    c = F.col
    score = lambda name: c(name).isNotNull() & ~c(name).between(0, 1)
    return {
        "current message not by the customer": _outside(c("current_role"), ("customer",)),
        "intent": _optional(c("intent"), V.INTENTS),
        "state": _optional(c("state"), V.STATES),
        "selected action": _optional(c("selected"), V.ACTIONS),
        "evidence strength": _outside(c("evidence_strength"), V.EVIDENCE_STRENGTHS),
        "escalation risk": _outside(c("risk"), LEVELS),
        "automation decision": _optional(c("decision"), DECISIONS),
        "intent confidence": score("intent_confidence"),
        "state confidence": score("state_confidence"),
        "ledger entry": _any(c("failed_actions"), lambda a: _outside(a, V.ACTIONS)) | _any(c("successful_actions"), lambda a: _outside(a, V.ACTIONS)),
        "missing requirement": _any(c("missing"), lambda m: _outside(m["requirement"], V.REQUIREMENTS)),
        "requirement status": _any(c("missing"), lambda m: _outside(m["status"], V.REQUIREMENT_STATUSES)),
        "safely requestable": _any(c("missing"), lambda m: _outside(m["safely_requestable"], REQUESTABLE)),
        "candidate action": _any(c("missing"), lambda m: _any(m["candidate_actions"], lambda a: _outside(a, V.ACTIONS))),
        "attempted action": _any(c("attempted"), lambda a: _outside(a["action"], V.ACTIONS)),
        "explicitness": _any(c("attempted"), lambda a: _outside(a["explicitness"], V.EXPLICITNESS)),
        "action result": _any(c("attempted"), lambda a: _outside(a["result"], V.ACTION_RESULTS)),
        "action order under 1": _any(c("attempted"), lambda a: ~F.coalesce(a["order"] >= 1, F.lit(False))),
        "hit without rank or id": _any(c("hits"), lambda h: ~F.coalesce(h["rank"] >= 1, F.lit(False)) | _blank(h["conversation_id"])),
        "hit's evidence strength": _any(c("hits"), lambda h: _outside(h["evidence_strength"], V.EVIDENCE_STRENGTHS)),
        "golden hit": _any(c("hits"), lambda h: F.coalesce(h["split"] == "golden", F.lit(False))),
    }


def violations(df: DataFrame, rules: dict[str, Column], key: str = "conversation_id") -> DataFrame:
    """(key, rule) of every broken rule, from one pass."""
    broken = F.array_compact(F.array(*(F.when(c, F.lit(name)) for name, c in rules.items())))
    return df.select(key, F.explode(broken).alias("rule"))


def self_test(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """(rule, violations) of every rule, kept ones with zero."""
    one = df.agg(*(F.count_if(c).alias(name) for name, c in rules.items()))
    return one.unpivot([], [F.col(f"`{name}`") for name in rules], "rule", "violations")


def write_observed(df: DataFrame, path: str, rules: dict[str, Column] | None = None, statistics: dict[str, Column] | None = None) -> dict[str, int]:
    """Write ``df`` as Parquet and return its number of rows, how often each rule is broken, and the named sums, all counted while it is written.

    The counts cost no second pass over the rows. Afterwards the written rows are counted again and compared.
    """
    seen = Observation()
    sums = {"rows": F.count(F.lit(1)), **{name: F.count_if(c) for name, c in (rules or {}).items()}, **{name: F.coalesce(F.sum(c.cast("long")), F.lit(0)) for name, c in (statistics or {}).items()}}
    df.observe(seen, *(c.alias(name) for name, c in sums.items())).write.mode("errorifexists").parquet(path)
    counts = {name: int(n) for name, n in seen.get.items()}
    counts["read_back"] = df.sparkSession.read.schema(df.schema).parquet(path).count()
    if counts["read_back"] != counts["rows"]:
        raise ValueError(f"{counts['rows']} rows were written to {path}, {counts['read_back']} are there")
    return counts


def write_sound(df: DataFrame, path: str, rules: dict[str, Column]) -> dict[str, int]:
    """``write_observed`` that removes what it wrote and fails if a rule is broken."""
    counts = write_observed(df, path, rules)
    if bad := {name: counts[name] for name in rules if counts[name]}:
        spark = df.sparkSession
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
        raise ValueError(f"rules are broken: {bad}")
    return counts


def journey_statistics(journeys: DataFrame) -> dict[str, Column]:
    """The sums that describe assembled journeys: by status, messages, turns of either side, journeys of several turns."""
    status = {f"{s}_journeys": F.col("reconstruction_status") == s for s in V.RECONSTRUCTION_STATUSES}
    return {**status, "message_count": F.size("messages"), "customer_turn_count": F.col("customer_turns"), "support_turn_count": F.col("support_turns"), "multi_turn_journeys": F.col("multi_turn")}

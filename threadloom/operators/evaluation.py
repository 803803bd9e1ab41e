"""Evaluation: metrics, agreement, annotation checks, quality control, freezing, failure signals, judge payloads.

Values come unrounded; rounding belongs to presentation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadloom.functions import vocab as V
from threadloom.functions.text import one_of, present


def ratio(a: Column, b: Column) -> Column:
    """a / b, 0 where b is 0."""
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def classification_metrics(pairs: DataFrame, truth: str, pred: str) -> DataFrame:
    """One row: accuracy, macro-F1 over the labels that occur in the truth, count; nulls for no rows."""
    confusion = pairs.groupBy(F.col(truth).alias("t"), F.col(pred).alias("p")).agg(F.count("*").alias("n"))
    hit = F.col("t").eqNullSafe(F.col("p"))
    by_true = confusion.groupBy("t").agg(F.sum("n").alias("actual"), F.sum(F.when(hit, F.col("n")).otherwise(0)).alias("tp"))
    by_pred = confusion.groupBy("p").agg(F.sum("n").alias("predicted"))
    f1 = ratio(2 * F.col("tp"), F.col("actual") + F.coalesce("predicted", F.lit(0)))
    per = by_true.join(by_pred, F.col("t").eqNullSafe(F.col("p")), "left").select("actual", "tp", f1.alias("f1"))
    return per.agg(F.try_divide(F.sum("tp").cast("double"), F.sum("actual").cast("double")).alias("accuracy"), F.avg("f1").alias("macro_f1"), F.coalesce(F.sum("actual"), F.lit(0)).alias("count"))


def binary_metrics(pairs: DataFrame, truth: str, pred: str, positive: str = "yes") -> DataFrame:
    """One row: precision, recall, F1 and count."""
    t, p = F.coalesce(F.col(truth) == positive, F.lit(False)), F.coalesce(F.col(pred) == positive, F.lit(False))
    one = pairs.agg(F.count_if(t & p).alias("tp"), F.count_if(~t & p).alias("fp"), F.count_if(t & ~p).alias("fn"), F.count("*").alias("count"))
    measured = one.select("count", ratio(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision"), ratio(F.col("tp"), F.col("tp") + F.col("fn")).alias("recall"))
    return measured.select("precision", "recall", ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")).alias("f1"), "count")


def operational_metrics(traces: DataFrame) -> DataFrame:
    """One row of rates: repeated failed action, evidence coverage, transition consistency, groundedness, count.

    Traces have selected, rejected (array), hits (array), evidence (array of action and support_count) and warnings (array).
    """
    support = lambda rows: F.aggregate(rows, F.lit(0).cast("long"), lambda a, e: a + e.support_count)
    same = F.filter("evidence", lambda e: e.action == F.col("selected"))
    as_rate = lambda c: F.avg(c.cast("double"))
    return traces.agg(
        as_rate(F.array_contains("rejected", F.col("selected"))).alias("repeated_failed_action_rate"),
        as_rate((F.size("hits") > 0) & (F.size("evidence") > 0)).alias("evidence_coverage"),
        F.avg(ratio(support(same), support(F.col("evidence")))).alias("transition_consistency"),
        as_rate(F.size("warnings") == 0).alias("response_groundedness"),
        F.count("*").alias("count"),
    )


def evaluate_predictions(gold: DataFrame, predictions: DataFrame, traces: DataFrame | None = None, key: str = "journey_id") -> DataFrame:
    """(metric, value, count) over gold records that have a prediction; unlabelled intents and states don't count."""
    p = predictions.select(key, F.col("intent").alias("p_intent"), F.col("state").alias("p_state"), F.col("action").alias("p_action"), F.col("escalation").alias("p_escalation"))
    held = gold.join(p, key)
    action = F.when(F.coalesce("ideal_next_action", F.lit("")) != "", F.col("ideal_next_action")).otherwise(F.col("observed_next_action"))
    held = held.withColumn("t_action", action).withColumn("p_yes", F.when(F.col("p_escalation") == "ESCALATE", "yes").otherwise("no"))
    parts = []
    for name, truth, pred in (("intent", "intent", "p_intent"), ("state", "current_state", "p_state"), ("next_action", "t_action", "p_action")):
        rows = held if name == "next_action" else held.filter(F.coalesce(truth, F.lit("")) != "")
        parts.append((name, classification_metrics(rows, truth, pred)))
    parts.append(("escalation", binary_metrics(held, "escalation_eligible", "p_yes")))
    if traces is not None:
        parts.append(("operational", operational_metrics(traces)))
    out = None
    for name, one in parts:
        long = one.select("count", *(F.col(c).cast("double").alias(c) for c in one.columns if c != "count")).unpivot(["count"], [c for c in one.columns if c != "count"], "m", "value")
        long = long.select(F.concat(F.lit(f"{name}."), "m").alias("metric"), "value", "count")
        out = long if out is None else out.unionByName(long)
    return out


def cohens_kappa(pairs: DataFrame, left: str, right: str) -> DataFrame:
    """One row: kappa (null without rows, 1 where chance agreement is whole), observed, expected, count."""
    n = pairs.select(F.col(left).alias("l"), F.col(right).alias("r"))
    whole = n.agg(F.count("*").alias("count"), F.count_if(F.col("l").eqNullSafe(F.col("r"))).alias("same"))
    marginal = lambda c: n.groupBy(F.col(c).alias("v")).agg(F.count("*").alias(f"n_{c}"))
    a, b = marginal("l"), marginal("r").withColumnRenamed("v", "w")
    both = a.join(b, a["v"].eqNullSafe(b["w"])).agg(F.coalesce(F.sum(F.col("n_l") * F.col("n_r")), F.lit(0)).alias("chance"))
    one = whole.crossJoin(both)  # one row each
    observed, expected = F.try_divide(F.col("same"), F.col("count").cast("double")), F.try_divide(F.col("chance"), F.col("count").cast("double") * F.col("count"))
    kappa = F.when(F.col("count") == 0, None).when(F.col("chance") == F.col("count") * F.col("count"), 1.0).otherwise(F.try_divide(observed - expected, 1 - expected))
    return one.select(kappa.alias("kappa"), observed.alias("observed"), expected.alias("expected"), "count")


def jaccard(left: Column, right: Column) -> Column:
    """Overlap of two code sets; 1 where both are empty."""
    union = F.size(F.array_union(left, right))
    return F.when(union == 0, 1.0).otherwise(F.size(F.array_intersect(left, right)) / F.greatest(union, F.lit(1)).cast("double"))


def agreement(first: DataFrame, second: DataFrame, fields: tuple[str, ...] = ("intent", "current_state", "ideal_next_action", "escalation_eligible"), key: str = "journey_id", order: str | None = None) -> DataFrame:
    """(metric, value, count): kappa per field, mean Jaccard of reason codes, adjudication and exclusion rates over shared ids (last record of each).

    The last record is the one of greatest ``order``, or else the last in the order in which Spark reads them.
    """
    from threadloom.sources.tables import last_per_key

    a, b = (last_per_key(x, key, order) if order else last_per_key(x.withColumn("_at", F.monotonically_increasing_id()), key, "_at").drop("_at") for x in (first, second))
    code = lambda c: F.coalesce(F.col(c), F.array().cast("array<string>"))
    blank = lambda c: F.coalesce(F.col(c), F.lit(""))
    names = (*fields, "escalation_reason_codes", "exclude_from_golden")
    held = a.select(key, *(F.col(c).alias(f"l_{c}") for c in names)).join(b.select(key, *(F.col(c).alias(f"r_{c}") for c in names)), key)
    held = held.select("*", *(blank(f"{s}_{f}").alias(f"{s}{f}") for s in "lr" for f in fields))
    out = None
    for f in fields:
        one = cohens_kappa(held, f"l{f}", f"r{f}").select(F.lit(f"kappa.{f}").alias("metric"), F.col("kappa").alias("value"), "count")
        out = one if out is None else out.unionByName(one)
    differ = F.lit(False)
    for f in fields:
        differ = differ | (F.col(f"l{f}") != F.col(f"r{f}"))
    excluded = (blank("l_exclude_from_golden") == "yes") | (blank("r_exclude_from_golden") == "yes")
    rest = held.agg(F.avg(jaccard(code("l_escalation_reason_codes"), code("r_escalation_reason_codes"))).alias("reason_jaccard"), F.avg(differ.cast("double")).alias("adjudication_rate"), F.avg(excluded.cast("double")).alias("exclusion_rate"), F.count("*").alias("count"))
    return out.unionByName(rest.unpivot(["count"], ["reason_jaccard", "adjudication_rate", "exclusion_rate"], "metric", "value").select("metric", "value", "count"))


CHOICES = {
    "intent": (V.INTENTS, True),
    "current_state": (V.STATES, True),
    "intent_status": (V.LABEL_STATUSES, False),
    "state_status": (V.LABEL_STATUSES, False),
    "observed_next_action": ((*V.ACTIONS, "UNKNOWN", "UNLABELLED"), False),
    "ideal_next_action": (V.ACTIONS, True),
    "outcome": (V.OUTCOMES, False),
    "escalation_eligible": (V.ELIGIBILITY, False),
    "evidence_visibility": (V.VISIBILITY, False),
    "confidence": (V.CONFIDENCE, False),
}


def _outside(items: Column, **fields: tuple[str, ...]) -> Column:
    def bad(item: Column) -> Column:
        out = F.lit(False)
        for name, allowed in fields.items():
            out = out | ~F.coalesce(item[name].isin(*allowed), F.lit(False))
        return out

    return F.coalesce(F.exists(items, bad), F.lit(False))


def annotation_errors(annotations: DataFrame, candidates: DataFrame, development: DataFrame, annotator: str | None = None, online: bool = False) -> DataFrame:
    """(annotation_id, journey_id, error): every rule that a record breaks; nothing is repaired.

    ``online`` adds the rules of an annotation form: reasons for doubt, and observed actions.
    """
    blank = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    c = candidates.groupBy("journey_id").agg(F.collect_set("root_tweet_id").alias("c_roots"), F.lit(True).alias("known"))
    d = development.select("journey_id", F.lit(True).alias("leaks")).distinct()
    held = annotations
    for k, name in (("annotation_id", "dup_a"), ("journey_id", "dup_j")):  # blank ids, which may be many, are errors by themselves and aren't counted
        twice = annotations.filter(~blank(k)).groupBy(k).agg(F.count("*").alias("n")).filter("n > 1").select(k, F.lit(True).alias(name))
        held = held.join(twice, k, "left").withColumn(name, F.coalesce(name, F.lit(False)))
    held = held.join(c, "journey_id", "left").join(d, "journey_id", "left")
    known = F.coalesce("known", F.lit(False))
    checks = [
        (blank("annotation_id"), "annotation_id is required"),
        (~blank("annotation_id") & F.col("dup_a"), "duplicate annotation_id"),
        (blank("journey_id") | F.col("dup_j"), "missing or duplicate journey_id"),
        (~known, "journey_id is not a golden annotation candidate"),
        (known & ~F.coalesce(F.array_contains("c_roots", F.col("root_tweet_id")), F.col("root_tweet_id").isNull() & (F.size("c_roots") == 0)), "root_tweet_id does not match candidate"),
        (F.coalesce("leaks", F.lit(False)), "golden journey appears in development data"),
        (blank("annotator_id"), "annotator_id is required"),
        *((~one_of(F.col(f), allowed, optional), f"{f} is missing or outside the frozen vocabulary") for f, (allowed, optional) in CHOICES.items()),
        (F.col("missing_information").isNull(), "missing_information must be a list"),
        (F.col("attempted_actions").isNull(), "attempted_actions must be a list"),
        (_outside(F.col("missing_information"), requirement=V.REQUIREMENTS, status=V.REQUIREMENT_STATUSES), "invalid missing-information item"),
        (_outside(F.col("attempted_actions"), action=V.ACTIONS, explicitness=V.EXPLICITNESS, result=V.ACTION_RESULTS), "invalid attempted-action item"),
    ]
    if annotator is not None:
        checks.append((~F.col("annotator_id").eqNullSafe(F.lit(annotator)), "annotator_id does not match requested annotator"))
    if online:
        reason = lambda c: F.trim(F.coalesce(F.col(c), F.lit(""))) if c in annotations.columns else F.lit("")
        flag = F.coalesce(F.col("ambiguity_flag").cast("boolean"), F.lit(False)) if "ambiguity_flag" in annotations.columns else F.lit(False)
        checks.append((flag & (reason("ambiguity_reason") == ""), "ambiguity_reason is required when ambiguity is enabled"))
        doubt = (reason("ambiguity_reason") == "") & (reason("insufficient_evidence_reason") == "")
        checks.append(((F.col("confidence") == "low") & doubt, "low confidence requires an ambiguity or insufficient-evidence reason"))
        if "observed_next_actions" in annotations.columns:
            checks.append((F.coalesce(F.exists("observed_next_actions", lambda a: ~a.isin(*V.ACTIONS)), F.lit(False)), "observed_next_actions contains an invalid action"))
    return held.select("annotation_id", "journey_id", F.explode(present(*checks)).alias("error"))


def included(annotations: DataFrame) -> DataFrame:
    """Records not excluded from the reserved set; a missing mark counts as included."""
    return annotations.filter(F.coalesce("exclude_from_golden", F.lit("")) != "yes")


def golden_report(annotations: DataFrame, candidates: DataFrame, development: DataFrame) -> DataFrame:
    """One row: records, included, repeated ids, non-candidates, ids also in development data."""
    repeated = annotations.groupBy("journey_id").count().filter("count > 1").agg(F.count("*").alias("repeated_ids"))
    foreign = annotations.join(candidates.select("journey_id"), "journey_id", "left_anti").agg(F.count("*").alias("non_candidates"))
    leaked = annotations.join(development.select("journey_id"), "journey_id", "left_semi").agg(F.count("*").alias("in_development"))
    return annotations.agg(F.count("*").alias("records")).crossJoin(included(annotations).agg(F.count("*").alias("included"))).crossJoin(repeated).crossJoin(foreign).crossJoin(leaked)  # one row each


def freeze(annotations: DataFrame, candidates: DataFrame, development: DataFrame, least: int = 150) -> DataFrame:
    """Records of the frozen set; fails where a record breaks a rule, an id leaks, or too few are left."""
    if not annotation_errors(annotations, candidates, development).isEmpty():
        raise ValueError("annotations are not valid")
    held = included(annotations)
    if not held.join(development.select("journey_id"), "journey_id", "left_semi").isEmpty():
        raise ValueError("reserved journeys appear in development data")
    if (n := held.count()) < least:
        raise ValueError(f"{n} records, fewer than {least}")
    return held


def freeze_manifest(annotations: DataFrame) -> DataFrame:
    """One row: count, sorted ids and annotators of the frozen set, which is small by its nature."""
    held = included(annotations)
    return held.agg(F.count("*").alias("count"), F.array_sort(F.collect_set("journey_id")).alias("journey_ids"), F.array_sort(F.collect_set("annotator_id")).alias("annotators"))


def failure_signals(traces: DataFrame) -> DataFrame:
    """(conversation_id, signals): reasons to look at a case, not confirmed failures."""
    best = F.array_max(F.transform("hits", lambda h: h.score))
    signals = present(
        (F.coalesce("intent_confidence", F.lit(1.0)) < 0.5, "LOW_INTENT_CONFIDENCE"),
        (F.coalesce("state_confidence", F.lit(1.0)) < 0.5, "LOW_STATE_CONFIDENCE"),
        (F.coalesce(best, F.lit(0.0)) < 0.1, "LOW_RETRIEVAL_SIMILARITY"),
        (F.coalesce(F.size("evidence"), F.lit(0)) <= 0, "NO_HISTORICAL_TRANSITION_EVIDENCE"),
        (F.coalesce(F.array_contains("rejected", F.col("selected")), F.lit(False)), "REPEATED_FAILED_ACTION_SELECTED"),
        (F.coalesce(F.col("decision") == "ESCALATE", F.lit(False)), "ESCALATION_REVIEW"),
        (F.coalesce(F.size("warnings"), F.lit(0)) > 0, "RESPONSE_GROUNDING_WARNING"),
    )
    return traces.select("conversation_id", signals.alias("signals"))


def signal_summary(traces: DataFrame) -> DataFrame:
    return failure_signals(traces).agg(F.count("*").alias("trace_count"), F.count_if(F.size("signals") > 0).alias("suspected_signal_count"))


def majority(df: DataFrame, value: str, order: str, allowed: tuple[str, ...] | None = None) -> DataFrame:
    """One row: the most frequent value, the first seen among equals. Values outside the vocabulary don't count."""
    held = df if allowed is None else df.filter(F.col(value).isin(*allowed))
    per = held.filter(F.col(value).isNotNull()).groupBy(value).agg(F.count("*").alias("n"), F.min(order).alias("first"))
    return per.orderBy(F.col("n").desc(), "first").limit(1).select(F.col(value).alias("value"), "n")


def majority_baseline(records: DataFrame, order: str, reserved: DataFrame | None = None) -> DataFrame:
    """One row: majority intent, action and escalation decision; fails on reserved records or missing labels."""
    if reserved is not None and not records.join(reserved.select("journey_id"), "journey_id", "left_semi").isEmpty():
        raise ValueError("golden journeys cannot be used to fit a baseline")
    parts = [majority(records, c, order, a).select(F.col("value").alias(n)) for n, c, a in (("intent", "intent", V.INTENTS), ("action", "observed_next_action", V.ACTIONS), ("escalation", "escalation_eligible", V.ELIGIBILITY))]
    if any(p.isEmpty() for p in parts):
        raise ValueError("records hold no complete labels")
    one = parts[0].crossJoin(parts[1]).crossJoin(parts[2])  # one row each
    return one.withColumn("decision", F.when(F.col("escalation") == "yes", "ESCALATE").otherwise("AUTO_HANDLE"))


def judged(df: DataFrame, status: str = "status", value: str = "value") -> DataFrame:
    """``df`` with judge_status and scores, from a provider's status and JSON answer."""
    answer = F.from_json(F.col(value), "struct<scores:map<string,string>,rationale:string>")
    scores = F.create_map(*(x for d in V.JUDGE_DIMENSIONS for x in (F.lit(d), F.try_element_at(answer.scores, F.lit(d)).try_cast("int"))))
    given = F.forall(F.array(*map(F.lit, V.JUDGE_DIMENSIONS)), lambda d: F.coalesce(F.map_contains_key(answer.scores, d), F.lit(False)))
    whole = F.forall(F.map_values(scores), lambda s: F.coalesce(s.between(1, 5), F.lit(False)))
    return df.withColumn("judge_status", F.when(F.col(status) != "OK", F.col(status)).when(~given | ~whole, "INVALID").otherwise("MEASURED")).withColumn("scores", F.when(given & whole, scores))

"""Further registered queries: validations, reports and stores, each with its SQL.

Inputs are broken on purpose where a check would otherwise find nothing.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from threadloom.functions import text as tx
from threadloom.functions import vocab as V
from threadloom.operators import cases, duplicates, evaluation, policy, retrieval, sampling, state, threads
from threadloom.registry import CASES, CTX, EVENTS, GROUPS, LEX_STATE, PARTS, RUNNING, SPLIT, WITH, WITHR, _candidates, _list, chat, chat_cases, default_context, event_annotations, event_scores, event_traces, group_split, oracle_sql, query, signed, table, word
from threadloom.sources import tables as src

CONV = "CAST(conversation_id AS BIGINT)"


# ---- reply graphs and cases

@query(f"{WITHR} SELECT root, id, CAST(depth AS INT) AS depth FROM chain")
def threads_by_rounds(spark, sf_dir):
    """The threads of ``recursive_threads``, one join for each depth, guarded against cycles."""
    m = chat(spark, sf_dir)
    return threads.threads(m, threads.roots(m), rounds_by_join=True, guard=True)


@query(f"{WITHR} SELECT DISTINCT root FROM chain JOIN msg e ON e.parent = chain.id WHERE chain.depth = 3")
def threads_cut_at_depth(spark, sf_dir):
    """Threads that go on below a depth limit of three."""
    m = chat(spark, sf_dir)
    with threads.recursion(spark):
        return threads.at_depth_limit(threads.threads(m, threads.roots(m), 3), m, 3)


@query(f"{WITH} SELECT conversation_id, CAST(pos AS INT) AS pos, 'message_id' AS rule FROM cm WHERE pos % 7 = 3 UNION ALL SELECT conversation_id, CAST(pos AS INT), 'role' FROM cm WHERE pos % 5 = 4")
def message_violations(spark, sf_dir):
    m = chat_cases(spark, sf_dir)
    return cases.message_violations(m.withColumns({"message_id": F.when(F.col("pos") % 7 == 3, "").otherwise(F.col("message_id")), "role": F.when(F.col("pos") % 5 == 4, "bot").otherwise(F.col("role"))}))


@query(f"{WITH}, {CTX}, f AS (SELECT conversation_id, min(message_id) FILTER (pos = 0) AS first, max(role) FILTER (pos = 0) AS role FROM cm GROUP BY 1), l AS (SELECT conversation_id, message_id AS last FROM cm JOIN pt USING (conversation_id) WHERE pos = point_pos) SELECT conversation_id, CASE WHEN {CONV} % 3 = 0 THEN first ELSE 'none' END AS point_id, CASE WHEN {CONV} % 3 = 0 THEN 'not a customer message' ELSE 'no such message' END AS rule FROM f JOIN l USING (conversation_id) WHERE {CONV} % 3 = 1 OR ({CONV} % 3 = 0 AND role <> 'customer')")
def point_violations(spark, sf_dir):
    """Points of which one in three doesn't exist and one in three is the first message, whoever wrote it."""
    m = chat_cases(spark, sf_dir)
    first = m.groupBy("conversation_id").agg(F.min_by("message_id", "pos").alias("first"))
    c = F.col("conversation_id").cast("long")
    points = cases.default_points(m).join(first, "conversation_id").select("conversation_id", F.when(c % 3 == 0, F.col("first")).when(c % 3 == 1, "none").otherwise(F.col("point_id")).alias("point_id"))
    return cases.point_violations(m, points)


def _hit(key: str, c: str) -> str:
    return word(LEX_STATE[key].replace("\\b", ""), f"lower({c})")


@query(f"""{WITH}, {RUNNING}, l AS (SELECT conversation_id, max(pos) AS pos FROM run WHERE role = 'customer' GROUP BY 1) SELECT conversation_id, CASE WHEN {_hit('investigation', 's')} THEN '' WHEN {_hit('private_channel', 's')} AND {_hit('account_word', 's')} THEN 'SECURE_ACCOUNT_CONTEXT' WHEN {_hit('access_risk', 'cur')} THEN 'SECURE_ACCOUNT_CONTEXT'
WHEN {_hit('resolved', 'cur')} OR {_hit('improving', 'cur')} OR f >= 1 OR {_hit('result', 'cur')} OR {_hit('proposal', 's')} THEN ''
ELSE concat_ws(',', CASE WHEN NOT {_hit('platform', 'c')} THEN 'PLATFORM_CONTEXT' END, CASE WHEN NOT {_hit('symptom', 'c')} THEN 'SYMPTOM_EVIDENCE' END) END AS missing FROM run JOIN l USING (conversation_id, pos)""")
def missing_requirements(spark, sf_dir):
    return state.detect(default_context(spark, sf_dir), None, LEX_STATE).select("conversation_id", F.array_join("missing", ",").alias("missing"))


_names = ", ".join(f"CASE WHEN {p} > 0 THEN '{p.replace('_', ' ')}' END" for p in policy.PARTS)


@query(f"""WITH {EVENTS}, {CASES}, {PARTS}, av AS (SELECT conversation_id, string_agg(action, ', ' ORDER BY action) AS avoided FROM fl GROUP BY 1)
SELECT rk.conversation_id, 'Selected ' || rk.action || ' from ' || CASE WHEN concat_ws(', ', {_names}) = '' THEN 'the available safe actions' ELSE concat_ws(', ', {_names}) END || '; '
|| CASE WHEN coalesce(support, 0) > 0 THEN support || ' historical transition observations' ELSE 'no direct historical transition evidence' END || coalesce('; avoided ' || avoided || ' after reported failure', '') || '.' AS action_reason
FROM rk LEFT JOIN sup ON sup.conversation_id = rk.conversation_id AND sup.action = rk.action LEFT JOIN av ON av.conversation_id = rk.conversation_id WHERE k = 1""")
def action_reasons(spark, sf_dir):
    return policy.select_action(event_scores(spark, sf_dir)).select("conversation_id", "action_reason")


# ---- duplicates, splits, samples

@query(f'WITH {GROUPS} SELECT doc_id, grp AS "group" FROM g')
def components_of_two_signatures(spark, sf_dir):
    """Rows tied by an exact or a normalized signature: labels over the graph of rows and signatures."""
    return duplicates.components(signed(spark, sf_dir), "doc_id", "exact", "norm")


@query("SELECT sha256(trim(regexp_replace(replace(lower(text), 'ß', 'ss'), '\\s+', ' ', 'g'))) AS hash, count(*) AS copies FROM documents WHERE text IS NOT NULL GROUP BY 1 HAVING count(*) > 1")
def full_norm_families(spark, sf_dir):
    """Families by the full normal form: NFKC, case folding, collapsed white space."""
    d = table(spark, sf_dir, "documents").filter("text is not null").select(tx.full_norm(F.col("text")).alias("norm"))
    return duplicates.families(d, F.sha2("norm", 256))


@query(f"{SPLIT} SELECT doc_id FROM g JOIN c USING (grp) WHERE NOT taken")
def development_ids(spark, sf_dir):
    return group_split(spark, sf_dir).filter("split = 'development'").select("doc_id")


@query(f"""{SPLIT}, n AS (SELECT count(*) FILTER (taken) AS r, count(*) FILTER (NOT taken) AS d, count(DISTINCT grp) AS k FROM g JOIN c USING (grp)) SELECT '{{"counts":{{"development":' || d || ',"reserved":' || r || '}},"groups":' || k || ',"seed":"seed-1"}}' AS manifest FROM n""")
def split_manifest(spark, sf_dir):
    """The split's manifest as one JSON line, keys sorted at every depth."""
    side = lambda name: F.count_if(F.col("split") == name).alias(name)
    one = group_split(spark, sf_dir).agg(side("reserved"), side("development"), F.countDistinct("group").alias("groups"))
    whole = one.select(src.manifest(seed=F.lit("seed-1"), groups=F.col("groups"), counts=F.struct("reserved", "development")).alias("m"))
    return whole.select(F.to_json(src.in_key_order(F.col("m"), whole.schema["m"].dataType)).alias("manifest"))


@query("SELECT doc_id FROM documents INTERSECT SELECT item_id FROM benchmark")
def overlapping_ids(spark, sf_dir):
    return duplicates.overlap(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark").withColumnRenamed("item_id", "doc_id"), "doc_id")


@query("SELECT side, n AS rows FROM (SELECT unnest(['left', 'right']) AS side, count(*) FILTER (doc_id % 50 = 7) AS n FROM documents) WHERE n > 0")
def differing_rows(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return duplicates.differences(d, d.withColumn("source", F.when(F.col("doc_id") % 50 == 7, "elsewhere").otherwise(F.col("source"))))


FLAGS = {"failure_marker": "from", "question_marker": "with", "diagnostic_context_marker": "to"}
_pool = f"p AS (SELECT conversation_id, count(*) AS n, count(*) FILTER (role = 'customer') >= 2 AND count(*) FILTER (role = 'support') >= 2 AS multi_turn, CASE {CONV} % 3 WHEN 0 THEN 'partial' ELSE 'complete' END AS status, {', '.join(f'bool_or({word(w)}) AS {f}' for f, w in FLAGS.items())} FROM cm GROUP BY 1)"


def _journey_pool(spark, sf_dir):
    role = lambda r: F.count_if(F.col("role") == r) >= 2
    m = chat_cases(spark, sf_dir).groupBy("conversation_id").agg(F.count("*").alias("n"), (role("customer") & role("support")).alias("multi_turn"), *(F.bool_or(tx.has(F.col("text"), rf"\b{w}\b")).alias(f) for f, w in FLAGS.items()))
    return m.withColumn("reconstruction_status", F.when(F.col("conversation_id").cast("long") % 3 == 0, "partial").otherwise("complete")).withColumn("length_bucket", sampling.length_bucket(F.col("n")))


@query(f"{WITH}, {_pool} SELECT 'multi_turn_journeys' AS name, count(*) FILTER (multi_turn) AS count FROM p UNION ALL SELECT 'single_or_short_journeys', count(*) FILTER (NOT multi_turn) FROM p UNION ALL SELECT 'status.' || status, count(*) FROM p GROUP BY 1 {' '.join(f'''UNION ALL SELECT '{f}', count(*) FILTER ({f}) FROM p''' for f in FLAGS)}")
def pool_statistics(spark, sf_dir):
    return duplicates.pool_statistics(_journey_pool(spark, sf_dir), tuple(FLAGS))


_bucket = "CASE WHEN n <= 2 THEN 'single_turn' WHEN n <= 4 THEN 'short_multi_turn' WHEN n <= 8 THEN 'medium_multi_turn' ELSE 'long_multi_turn' END"


@query(f"{WITH}, {_pool} SELECT 'length_bucket' AS dimension, {_bucket} AS value, count(*) AS count FROM p GROUP BY 2 UNION ALL SELECT 'reconstruction_status', status, count(*) FROM p GROUP BY 2 {' '.join(f'''UNION ALL SELECT '{f}', CAST({f} AS VARCHAR), count(*) FROM p GROUP BY 2''' for f in FLAGS)}")
def journey_strata(spark, sf_dir):
    """Strata over the observable dimensions: length, status and markers."""
    return sampling.stratum_counts(_journey_pool(spark, sf_dir), ("length_bucket", "reconstruction_status", *FLAGS))


@query("WITH s AS (SELECT doc_id FROM documents ORDER BY sha256('s:' || doc_id) DESC, doc_id LIMIT 50), x AS (SELECT doc_id FROM s UNION ALL SELECT doc_id FROM s WHERE doc_id IN (SELECT doc_id FROM labels)) SELECT 'outside the pool' AS rule, count(*) AS violations FROM x WHERE doc_id NOT IN (SELECT doc_id FROM documents WHERE lang = 'en') UNION ALL SELECT 'picked twice', count(*) FROM s WHERE doc_id IN (SELECT doc_id FROM labels) UNION ALL SELECT 'also elsewhere', count(*) FROM x WHERE doc_id IN (SELECT item_id FROM benchmark)")
def sample_violations(spark, sf_dir):
    """A sample that was broken on purpose: labelled picks stand twice, and the pool is one language's."""
    d = table(spark, sf_dir, "documents")
    s = sampling.stable_top(d, "doc_id", "s", 50).select("doc_id")
    twice = s.join(table(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_semi")
    return sampling.sample_violations(s.unionByName(twice), d.filter("lang = 'en'"), table(spark, sf_dir, "benchmark").withColumnRenamed("item_id", "doc_id"), "doc_id")


# ---- stores and scalar rules

@query("SELECT * FROM documents WHERE doc_id = 42")
def point_lookup(spark, sf_dir):
    return src.lookup(table(spark, sf_dir, "documents"), "doc_id", 42)


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT item_id FROM benchmark)")
def searchable_index(spark, sf_dir):
    """The documents left for search once reserved ids are out."""
    return retrieval.index(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("doc_id")), "doc_id").select("doc_id")


@query("SELECT doc_id, CASE WHEN toxic = 1 THEN 9 ELSE quality END AS quality, toxic FROM labels")
def upserted_records(spark, sf_dir):
    """A keyed upsert of records that stand twice: the last one wins."""
    store = table(spark, sf_dir, "labels")
    fresh = store.filter("toxic = 1")
    passes = [fresh.withColumn("quality", F.lit(v).cast(store.schema["quality"].dataType)).withColumn("at", F.lit(at)) for at, v in ((1, 5), (2, 9))]
    return src.upsert(store, passes[0].unionByName(passes[1]), "doc_id", "at").select("doc_id", "quality", "toxic")


@query("SELECT sha256(string_agg(item_id || ':' || text, chr(10) ORDER BY item_id)) AS digest FROM benchmark")
def benchmark_digest(spark, sf_dir):
    return src.whole_digest(table(spark, sf_dir, "benchmark").select("item_id", F.concat_ws(":", "item_id", "text").alias("line")), "line", "item_id")


@query("SELECT doc_id, regexp_matches(source, '^[A-Za-z0-9_.-]{1,80}$') AS source_is_safe, regexp_matches(text, '^[A-Za-z0-9_.-]{1,80}$') AS text_is_safe FROM documents")
def safe_ids(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", tx.safe_id(F.col("source")).alias("source_is_safe"), tx.safe_id(F.col("text")).alias("text_is_safe"))


@query("SELECT event_id, CASE WHEN event_type <> 'error' THEN strftime(ts, '%Y-%m-%d %H:%M:%S') END AS at FROM events")
def parsed_times(spark, sf_dir):
    """Raw message times, written as the source has them and parsed; errors hold no time."""
    written = F.concat(F.date_format("ts", "EEE MMM dd HH:mm:ss"), F.lit(" +0000 "), F.date_format("ts", "yyyy"))
    raw = F.when(F.col("event_type") == "error", "not a time").otherwise(written)
    return table(spark, sf_dir, "events").select("event_id", F.date_format(tx.parsed_time(raw), "yyyy-MM-dd HH:mm:ss").alias("at"))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, '{\"k\":' || json_extract_string(props, '$.k') || '}' AS again FROM events")
def json_round_trip(spark, sf_dir):
    parsed = F.from_json("props", "struct<k:bigint>")
    return table(spark, sf_dir, "events").select("event_id", parsed.k.alias("k"), F.to_json(parsed).alias("again"))


# ---- evaluation reports

_ids = "CASE WHEN doc_id % 17 = 0 THEN '' ELSE 'a' || doc_id END AS annotation_id, CAST(doc_id AS VARCHAR) AS journey_id"


@query(f"{oracle_sql()['annotation_errors']} UNION ALL SELECT {_ids}, 'ambiguity_reason is required when ambiguity is enabled' FROM labels WHERE toxic = 1 AND quality <> 1 UNION ALL SELECT {_ids}, 'low confidence requires an ambiguity or insufficient-evidence reason' FROM labels WHERE quality <> 1 UNION ALL SELECT {_ids}, 'observed_next_actions contains an invalid action' FROM labels WHERE toxic = 1")
def online_annotation_errors(spark, sf_dir):
    """The form's rules too: reasons for doubt, and observed actions of the vocabulary."""
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").cast("string").alias("journey_id"), "quality", "toxic")
    held = event_annotations(spark, sf_dir).drop("confidence").join(labels, "journey_id")
    held = held.withColumns({
        "ambiguity_flag": F.col("toxic") == 1, "ambiguity_reason": F.when(F.col("quality") == 1, "unclear").otherwise(" "), "confidence": F.when(F.col("quality") == 1, "high").otherwise("low"),
        "observed_next_actions": F.array(F.lit(V.ACTIONS[0]), F.when(F.col("toxic") == 1, "NOPE").otherwise(V.ACTIONS[1])),
    })
    return evaluation.annotation_errors(held, *_candidates(spark, sf_dir), online=True)


def _pick(values, i):
    return F.element_at(F.array(*map(F.lit, values)), (i + 1).cast("int"))


def _classified(name: str, t: str, p: str, rows: str) -> str:
    return f"""SELECT unnest(['{name}.accuracy', '{name}.macro_f1']) AS metric, unnest([sum(tp) / sum(a)::DOUBLE, avg(2 * tp / (a + coalesce(q, 0))::DOUBLE)]) AS value, CAST(sum(a) AS BIGINT) AS count
FROM (SELECT {t} AS t, count(*) AS a, count(*) FILTER ({t} = {p}) AS tp FROM {rows} GROUP BY 1) LEFT JOIN (SELECT {p} AS p, count(*) AS q FROM {rows} GROUP BY 1) ON p = t"""


_gold = f"""h AS (SELECT quality + 1 AS ti, 1 AS ts, CASE WHEN toxic = 1 THEN 3 ELSE quality + 1 END AS ta, toxic, CASE WHEN lang = 'en' THEN 2 ELSE 1 END AS p, lang = 'de' AS e FROM labels JOIN documents USING (doc_id))"""


@query(f"""WITH {_gold}, s AS (SELECT * FROM h WHERE toxic <> 1), b AS (SELECT count(*) FILTER (toxic = 1 AND e) AS tp, count(*) FILTER (toxic <> 1 AND e) AS fp, count(*) FILTER (toxic = 1 AND NOT e) AS fn, count(*) AS n FROM h),
r AS (SELECT n, coalesce(tp / nullif(tp + fp, 0)::DOUBLE, 0) AS pr, coalesce(tp / nullif(tp + fn, 0)::DOUBLE, 0) AS re FROM b)
{_classified('intent', 'ti', 'p', 'h')} UNION ALL {_classified('state', 'ts', 'p', 's')} UNION ALL {_classified('next_action', 'ta', 'p', 'h')}
UNION ALL SELECT unnest(['escalation.precision', 'escalation.recall', 'escalation.f1']), unnest([pr, re, coalesce(2 * pr * re / nullif(pr + re, 0), 0)]), n FROM r""")
def evaluation_report(spark, sf_dir):
    """All metrics of predictions made from the language against records made from labels; unlabelled states don't count."""
    q, toxic = F.col("quality"), F.col("toxic") == 1
    gold = table(spark, sf_dir, "labels").select("doc_id", _pick(V.INTENTS, q).alias("intent"), F.when(toxic, "").otherwise(V.STATES[0]).alias("current_state"), F.when(toxic, V.ACTIONS[2]).otherwise("").alias("ideal_next_action"), _pick(V.ACTIONS, q).alias("observed_next_action"), F.when(toxic, "yes").otherwise("no").alias("escalation_eligible"))
    p = F.when(F.col("lang") == "en", 1).otherwise(0)
    predicted = table(spark, sf_dir, "documents").select("doc_id", _pick(V.INTENTS, p).alias("intent"), _pick(V.STATES, p).alias("state"), _pick(V.ACTIONS, p).alias("action"), F.when(F.col("lang") == "de", "ESCALATE").otherwise("AUTO_HANDLE").alias("escalation"))
    return evaluation.evaluate_predictions(gold, predicted, key="doc_id")


def _kappa(name: str, a: str, b: str) -> str:
    return f"""SELECT 'kappa.{name}' AS metric, CASE WHEN c = n * n THEN 1.0 ELSE (s / n::DOUBLE - c / (n * n)::DOUBLE) / (1 - c / (n * n)::DOUBLE) END AS value, n AS count
FROM (SELECT count(*) AS n, count(*) FILTER ({a} = {b}) AS s FROM x), (SELECT coalesce(sum(u * w), 0) AS c FROM (SELECT {a} AS v, count(*) AS u FROM x GROUP BY 1) JOIN (SELECT {b} AS v, count(*) AS w FROM x GROUP BY 1) USING (v))"""


@query(f"""WITH x AS (SELECT quality AS a, toxic AS b, CAST(lang = 'en' AS INT) AS c, CAST(lang = 'de' AS INT) AS d FROM labels JOIN documents USING (doc_id)), j AS (SELECT [x for x in [CASE WHEN a = 1 THEN 'A' END, CASE WHEN b = 1 THEN 'B' END] if x IS NOT NULL] AS l, [x for x in [CASE WHEN c = 1 THEN 'A' END, CASE WHEN d = 1 THEN 'B' END] if x IS NOT NULL] AS r FROM x)
{_kappa('intent', 'a', 'c')} UNION ALL {_kappa('current_state', 'b', 'd')} UNION ALL {_kappa('ideal_next_action', 'a', 'd')} UNION ALL {_kappa('escalation_eligible', 'b', 'c')}
UNION ALL SELECT 'reason_jaccard', avg(CASE WHEN len(l) + len(r) = 0 THEN 1.0 ELSE len(list_intersect(l, r)) / len(list_distinct(list_concat(l, r)))::DOUBLE END), count(*) FROM j
UNION ALL SELECT 'adjudication_rate', avg(CAST(a <> c OR b <> d OR a <> d OR b <> c AS DOUBLE)), count(*) FROM x UNION ALL SELECT 'exclusion_rate', avg(CAST(b = 1 OR d = 1 AS DOUBLE)), count(*) FROM x""")
def agreement_report(spark, sf_dir):
    """Agreement of an annotator made from labels with one made from languages, over the documents both have."""

    def records(df, a, b, ideal, eligible):
        yes = lambda c: F.when(c == 1, "yes").otherwise("no")
        codes = F.array_compact(F.array(F.when(a == 1, "A"), F.when(b == 1, "B")))
        return df.select(F.col("doc_id").alias("journey_id"), _pick(V.INTENTS, a).alias("intent"), _pick(V.STATES, b).alias("current_state"), _pick(V.ACTIONS, ideal).alias("ideal_next_action"), yes(eligible).alias("escalation_eligible"), codes.alias("escalation_reason_codes"), yes(b).alias("exclude_from_golden"))

    en, de = ((F.col("lang") == x).cast("int") for x in ("en", "de"))
    q, t = F.col("quality").cast("int"), F.col("toxic").cast("int")
    return evaluation.agreement(records(table(spark, sf_dir, "labels"), q, t, q, t), records(table(spark, sf_dir, "documents"), en, de, de, en))


@query("SELECT count(*) AS count, string_agg(DISTINCT CAST(doc_id AS VARCHAR), ',' ORDER BY CAST(doc_id AS VARCHAR)) AS journey_ids, 'ann' AS annotators FROM labels WHERE toxic <> 1")
def freeze_manifest(spark, sf_dir):
    return evaluation.freeze_manifest(event_annotations(spark, sf_dir)).select("count", *(F.array_join(c, ",").alias(c) for c in ("journey_ids", "annotators")))


@query(f"WITH n AS (SELECT quality, count(*) AS c, min(doc_id) AS f FROM labels GROUP BY 1), t AS (SELECT toxic, count(*) AS c, min(doc_id) AS f FROM labels GROUP BY 1) SELECT ({_list(V.INTENTS)})[q + 1] AS intent, ({_list(V.ACTIONS)})[x + 1] AS action, CASE WHEN x = 1 THEN 'yes' ELSE 'no' END AS escalation, CASE WHEN x = 1 THEN 'ESCALATE' ELSE 'AUTO_HANDLE' END AS decision FROM (SELECT quality AS q FROM n ORDER BY c DESC, f LIMIT 1), (SELECT toxic AS x FROM t ORDER BY c DESC, f LIMIT 1)")
def majority_baseline(spark, sf_dir):
    records = table(spark, sf_dir, "labels").select("doc_id", F.col("doc_id").cast("string").alias("journey_id"), _pick(V.INTENTS, F.col("quality")).alias("intent"), _pick(V.ACTIONS, F.col("toxic")).alias("observed_next_action"), F.when(F.col("toxic") == 1, "yes").otherwise("no").alias("escalation_eligible"))
    reserved = table(spark, sf_dir, "documents").join(records, "doc_id", "left_anti").select(F.col("doc_id").cast("string").alias("journey_id"))
    return evaluation.majority_baseline(records, "doc_id", reserved)


@query(f"SELECT count(*) AS trace_count, count(*) FILTER (signals <> '') AS suspected_signal_count FROM ({oracle_sql()['failure_signals']})")
def signal_summary(spark, sf_dir):
    return evaluation.signal_summary(event_traces(spark, sf_dir))

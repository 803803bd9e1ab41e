"""All registered queries of the analytics engine on the test tables, each with the SQL that checks it.

The tables' words are invented, so lexical operators run with rule tables of words that occur
in them; the domain's own tables are tested on literal cases.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from threadloom.functions import text as tx
from threadloom.functions import vocab as V
from threadloom.operators import cases, duplicates, escalation, evaluation, intent, ledger, policy, profile, retrieval, sampling, state, threads, transitions
from threadloom.plans import pipeline
from threadloom.sources import tables as src

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return src.chat_messages(table(spark, sf_dir, "conversations"))


def chat_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chats as canonical messages."""
    c = table(spark, sf_dir, "conversations").filter("role <> 'system'")
    pos = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")) - 1
    return c.select(F.col("conv_id").cast("string").alias("conversation_id"), pos.alias("pos"), F.concat_ws("-", "conv_id", "turn").alias("message_id"), F.when(F.col("role") == "user", "customer").otherwise("support").alias("role"), F.coalesce("text", F.lit("")).alias("text"))


def broken_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The reply graph with some links leading to messages that aren't there; no message is left out."""
    gone = lambda c, broken: F.when(broken & (F.col(c) != ""), F.concat(F.lit("gone-"), c)).otherwise(F.col(c))
    return chat(spark, sf_dir).withColumns({"response": gone("response", F.col("turn") % 5 == 3), "parent": gone("parent", F.col("turn") % 7 == 5)})


def threads_of(messages: DataFrame) -> DataFrame:
    with threads.recursion(messages.sparkSession):
        out = threads.threads(messages, threads.roots(messages))
        out.sparkSession.sparkContext  # the plan is analysed under the limits
    return out


MSG = """
msg AS (SELECT conv_id, turn, conv_id || '-' || turn AS id, CAST(conv_id AS VARCHAR) AS author_id,
               CASE WHEN role = 'user' THEN 'customer' ELSE 'support' END AS role, coalesce(text, '') AS text,
               coalesce(lag(conv_id || '-' || turn) OVER w, '') AS parent, coalesce(lead(conv_id || '-' || turn) OVER w, '') AS response
        FROM conversations WHERE role <> 'system' WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
cm AS (SELECT author_id AS conversation_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS pos, id AS message_id, role, text FROM msg)"""
ROOTS = "roots AS (SELECT m.id AS root, r.author_id AS company FROM msg m JOIN msg r ON m.response = r.id WHERE m.parent = '' AND m.role = 'customer' AND r.role = 'support')"
CHAIN = "chain AS (SELECT root, root AS id, 0 AS depth FROM roots UNION ALL SELECT c.root, e.id, c.depth + 1 FROM chain c JOIN msg e ON e.parent = c.id WHERE c.depth < 100)"
WITH, WITHR = f"WITH {MSG}", f"WITH RECURSIVE {MSG}, {ROOTS}, {CHAIN}"
CTX = "pt AS (SELECT conversation_id, max(pos) AS point_pos FROM cm WHERE role = 'customer' GROUP BY 1), ctx AS (SELECT cm.*, point_pos FROM cm JOIN pt USING (conversation_id) WHERE pos <= point_pos)"


def word(w: str, c: str = "lower(text)") -> str:
    """SQL for a whole word in any script."""
    return f"regexp_matches({c}, '(^|[^\\p{{L}}\\p{{N}}_]){w}($|[^\\p{{L}}\\p{{N}}_])')"


# ---- profiles and reply graphs

@query(f"{WITH} SELECT role, count(*) AS messages, count(DISTINCT author_id) AS authors FROM msg GROUP BY role")
def role_profile(spark, sf_dir):
    return profile.role_profile(chat(spark, sf_dir))


@query("WITH c AS (SELECT conv_id, turn, role, CASE WHEN turn = 0 THEN NULL ELSE text END AS text FROM conversations) SELECT field, CAST(missing AS BIGINT) AS missing FROM (SELECT 'conv_id' AS field, count(*) FILTER (trim(coalesce(CAST(conv_id AS VARCHAR), '')) = '') AS missing FROM c UNION ALL SELECT 'turn', count(*) FILTER (turn IS NULL) FROM c UNION ALL SELECT 'role', count(*) FILTER (trim(coalesce(role, '')) = '') FROM c UNION ALL SELECT 'text', count(*) FILTER (trim(coalesce(text, '')) = '') FROM c)")
def missing_by_column(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").withColumn("text", F.when(F.col("turn") != 0, F.col("text")))
    return profile.missing_by_column(c, ("conv_id", "turn", "role", "text"))


@query("SELECT count(*) AS row_count, count(*) FILTER (ts IS NULL) AS without_time, min(ts) AS first, max(ts) AS last FROM events")
def time_range(spark, sf_dir):
    return profile.time_range(table(spark, sf_dir, "events"), "ts")


@query(f"{WITH} SELECT author_id, count(*) AS outbound FROM msg WHERE role = 'support' GROUP BY 1")
def outbound_volume(spark, sf_dir):
    return profile.outbound_volume(chat(spark, sf_dir))


LINKS = """{w}, m AS (SELECT * REPLACE (CASE WHEN turn % 5 = 3 AND response <> '' THEN 'gone-' || response ELSE response END AS response, CASE WHEN turn % 7 = 5 AND parent <> '' THEN 'gone-' || parent ELSE parent END AS parent) FROM msg), ids AS (SELECT id AS i, parent AS p, response AS r FROM m),
a AS (SELECT count(*) AS response_populated, count(i) AS response_resolvable, count(*) FILTER (p = id) AS response_reciprocal FROM (SELECT * FROM m WHERE response <> '') x LEFT JOIN ids ON i = x.response),
b AS (SELECT count(*) AS parent_populated, count(i) AS parent_resolvable, count(*) FILTER (r = id) AS parent_reciprocal FROM (SELECT * FROM m WHERE parent <> '') x LEFT JOIN ids ON i = x.parent)
SELECT * FROM a, b"""


@query(LINKS.format(w=WITH))
def link_quality(spark, sf_dir):
    return threads.link_quality(broken_chat(spark, sf_dir))


@query(f"{WITH} SELECT s.author_id, count(DISTINCT c.id) AS linked FROM msg s JOIN msg c ON c.role = 'customer' AND ((c.response = s.id AND c.response <> '') OR (s.parent = c.id AND s.parent <> '')) WHERE s.role = 'support' GROUP BY 1")
def direct_linked_or_join(spark, sf_dir):
    return threads.linked_to(chat(spark, sf_dir))


@query(f"{WITH}, {ROOTS} SELECT root, company FROM roots")
def roots(spark, sf_dir):
    return threads.roots(chat(spark, sf_dir))


@query(f"{WITHR} SELECT root, id, CAST(depth AS INT) AS depth FROM chain")
def recursive_threads(spark, sf_dir):
    return threads_of(chat(spark, sf_dir))


@query(f"{WITHR} SELECT root, count(*) AS messages, count(*) FILTER (role = 'customer') AS customer, count(*) FILTER (role = 'support') AS support, count(*) FILTER (role = 'customer') >= 2 AND count(*) FILTER (role = 'support') >= 2 AS multi_turn FROM chain JOIN msg USING (id) GROUP BY root")
def thread_stats_by_conv(spark, sf_dir):
    m = chat(spark, sf_dir)
    return threads.thread_stats(threads_of(m), m)


@query(f"""{WITHR}, t AS (SELECT root, count(*) AS messages, count(*) FILTER (role = 'customer') >= 2 AND count(*) FILTER (role = 'support') >= 2 AS multi FROM chain JOIN msg USING (id) GROUP BY root),
p AS (SELECT company, count(*) AS threads, CAST(sum(messages) AS BIGINT) AS messages, avg(messages) AS avg_messages, 100 * avg(CAST(multi AS INT)) AS multi_turn_pct FROM t JOIN roots USING (root) GROUP BY company),
v AS (SELECT author_id, count(*) AS outbound FROM msg WHERE role = 'support' GROUP BY 1),
l AS (SELECT s.author_id, count(DISTINCT c.id) AS linked FROM msg s JOIN msg c ON c.role = 'customer' AND (c.response = s.id OR s.parent = c.id) WHERE s.role = 'support' GROUP BY 1)
SELECT company, threads, messages, avg_messages, multi_turn_pct, coalesce(outbound, 0) AS outbound, coalesce(linked, 0) AS linked,
CASE WHEN multi_turn_pct >= 20 AND threads >= 1000 THEN 'strong' WHEN threads >= 1000 THEN 'moderate' ELSE 'limited' END AS suitability
FROM p LEFT JOIN v ON v.author_id = company LEFT JOIN l ON l.author_id = company ORDER BY threads DESC, messages DESC, company LIMIT 20""")
def top_thread_companies(spark, sf_dir):
    m = chat(spark, sf_dir)
    t = threads.thread_stats(threads_of(m), m).join(threads.roots(m), "root")
    return profile.top(profile.company_stats(t, profile.outbound_volume(m), threads.linked_to(m)), 20, F.col("threads").desc(), F.col("messages").desc(), F.col("company"))


@query("SELECT n_name AS nation, count(*) AS orders, sum(CAST(o_totalprice AS DECIMAL(18, 2))) AS total FROM customer JOIN orders ON o_custkey = c_custkey JOIN nation ON n_nationkey = c_nationkey GROUP BY 1 ORDER BY orders DESC, total DESC, nation LIMIT 20")
def top_companies(spark, sf_dir):
    c, o, n = (table(spark, sf_dir, x) for x in ("customer", "orders", "nation"))
    per = o.join(c, F.col("o_custkey") == F.col("c_custkey")).groupBy("c_nationkey").agg(F.count("*").alias("orders"), F.sum(F.col("o_totalprice").cast("decimal(18,2)")).alias("total"))
    named = per.join(n, F.col("n_nationkey") == F.col("c_nationkey")).select(F.col("n_name").alias("nation"), "orders", "total")
    return profile.top(named, 20, F.col("orders").desc(), F.col("total").desc(), F.col("nation"))


STATUS = """{w}, m AS (SELECT * REPLACE (CASE WHEN turn % 5 = 3 AND response <> '' THEN 'gone-' || response ELSE response END AS response, CASE WHEN turn % 7 = 5 AND parent <> '' THEN 'gone-' || parent ELSE parent END AS parent) FROM msg), roots2 AS (SELECT a.id AS root FROM m a JOIN m r ON a.response = r.id WHERE a.parent = '' AND a.role = 'customer' AND r.role = 'support'),
ch AS (SELECT root, root AS id, 0 AS depth FROM roots2 UNION ALL SELECT c.root, e.id, c.depth + 1 FROM ch c JOIN m e ON e.parent = c.id WHERE c.depth < 100),
x AS (SELECT ch.root, m.parent <> '' AND p.id IS NULL AS np, m.response <> '' AND r.id IS NULL AS nr, m.parent <> '' AND i.id IS NULL AS po, m.parent <> '' AND p.id IS NOT NULL AND p.response <> m.id AS os
      FROM ch JOIN m ON m.id = ch.id LEFT JOIN m p ON p.id = m.parent LEFT JOIN m r ON r.id = m.response LEFT JOIN ch i ON i.root = ch.root AND i.id = m.parent),
g AS (SELECT root, bool_or(np) AS np, bool_or(nr) AS nr, bool_or(po) AS po, bool_or(os) AS os FROM x GROUP BY root)
SELECT root, CASE WHEN np OR nr OR po THEN 'partial' WHEN os THEN 'uncertain' ELSE 'complete' END AS status,
concat_ws(',', CASE WHEN np THEN 'missing_parent' END, CASE WHEN nr THEN 'missing_response_target' END, CASE WHEN os THEN 'non_reciprocal_link' END) AS reasons FROM g"""


@query(STATUS.format(w=f"WITH RECURSIVE {MSG}"))
def reconstruction_status(spark, sf_dir):
    m = broken_chat(spark, sf_dir)
    return threads.reconstruction_status(threads_of(m), m).withColumn("reasons", F.array_join("reasons", ","))


@query(f"""{WITHR}, r AS (SELECT root, role, text, lpad(CAST(turn AS VARCHAR), 6, '0') AS created_at, chain.id AS id FROM chain JOIN msg USING (id))
SELECT root, count(*) AS messages, count(*) FILTER (role = 'customer') AS customer_turns, count(*) FILTER (role = 'support') AS support_turns, min(created_at) AS started_at_raw, max(created_at) AS ended_at_raw,
count(*) FILTER (role = 'customer') >= 2 AND count(*) FILTER (role = 'support') >= 2 AS multi_turn, sha256(string_agg(role || chr(31) || text, chr(30) ORDER BY created_at, id)) AS exact_signature,
sha256(string_agg(role || chr(31) || trim(regexp_replace(lower(text), '\\s+', ' ', 'g')), chr(30) ORDER BY created_at, id)) AS normalized_signature, string_agg(id, ',' ORDER BY created_at, id) AS ids FROM r GROUP BY root""")
def journey_assembly(spark, sf_dir):
    m = chat(spark, sf_dir).withColumn("created_at", F.lpad(F.col("turn").cast("string"), 6, "0"))
    j = threads.assemble(threads_of(m), m)
    return j.select("root", F.size("messages").cast("long").alias("messages"), "customer_turns", "support_turns", "started_at_raw", "ended_at_raw", "multi_turn", "exact_signature", "normalized_signature", F.array_join(F.transform("messages", lambda x: x.id), ",").alias("ids"))


@query(f"{WITHR}, j AS (SELECT root, CAST(split_part(root, '-', 1) AS BIGINT) AS c, count(*) AS n FROM chain GROUP BY root) SELECT root, 'turn counts' AS rule FROM j WHERE c % 3 = 0 UNION ALL SELECT root, 'order' FROM j WHERE c % 4 = 1 AND n > 1")
def journey_violations(spark, sf_dir):
    """Journeys that were broken on purpose: a wrong turn count in one of three, messages in reverse order in one of four."""
    m = chat(spark, sf_dir).withColumn("created_at", F.lpad(F.col("turn").cast("string"), 6, "0"))
    c = F.split_part(F.col("root"), F.lit("-"), F.lit(1)).cast("long")
    j = threads.assemble(threads_of(m), m)
    return threads.journey_violations(j.withColumns({"customer_turns": F.col("customer_turns") + F.when(c % 3 == 0, 1).otherwise(0), "messages": F.when(c % 4 == 1, F.reverse("messages")).otherwise(F.col("messages"))}))


MARKS = {"said_of": r"\bof\b", "said_with_or_from": r"\b(?:with|from)\b"}


@query(f"{WITH} SELECT message_id, {word('of')} AS said_of, {word('(?:with|from)')} AS said_with_or_from FROM cm")
def marker_flags(spark, sf_dir):
    return chat_cases(spark, sf_dir).select("message_id", tx.flags(F.col("text"), MARKS).alias("f")).select("message_id", "f.*")


# ---- duplicates, splits, samples

@query("SELECT sha256(text) AS hash, count(*) AS copies FROM documents WHERE text IS NOT NULL GROUP BY 1 HAVING count(*) > 1")
def exact_dup_families(spark, sf_dir):
    return duplicates.families(table(spark, sf_dir, "documents").filter("text is not null"), F.sha2("text", 256))


@query("SELECT sha256(trim(regexp_replace(lower(text), '\\s+', ' ', 'g'))) AS hash, count(*) AS copies FROM documents WHERE text IS NOT NULL GROUP BY 1 HAVING count(*) > 1")
def norm_dup_families(spark, sf_dir):
    return duplicates.families(table(spark, sf_dir, "documents").filter("text is not null"), F.sha2(tx.simple_norm(F.col("text")), 256))


def signed(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("exact"), F.sha2(tx.simple_norm(F.col("text")), 256).alias("norm"))


SIGNED = "s AS (SELECT doc_id, sha256(coalesce(text, '')) AS exact, sha256(trim(regexp_replace(lower(coalesce(text, '')), '\\s+', ' ', 'g'))) AS norm FROM documents)"
GROUPS = f"{SIGNED}, g AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY norm) AS grp FROM s)"


@query(f'WITH {GROUPS} SELECT doc_id, grp AS "group" FROM g')
def duplicate_components(spark, sf_dir):
    return duplicates.components(signed(spark, sf_dir), "doc_id", "norm")


@query(f"WITH {SIGNED}, e AS (SELECT exact AS k, count(*) AS n FROM s GROUP BY 1 HAVING count(*) > 1), f AS (SELECT norm AS k, count(*) AS n FROM s GROUP BY 1 HAVING count(*) > 1) SELECT (SELECT count(*) FROM e) AS exact_families, (SELECT CAST(coalesce(sum(n), 0) AS BIGINT) FROM e) AS exact_rows, (SELECT CAST(coalesce(sum(n - 1), 0) AS BIGINT) FROM e) AS exact_surplus, (SELECT coalesce(max(n), 0) FROM e) AS exact_largest, (SELECT count(*) FROM f) AS normalized_families, (SELECT CAST(coalesce(sum(n), 0) AS BIGINT) FROM f) AS normalized_rows, (SELECT CAST(coalesce(sum(n - 1), 0) AS BIGINT) FROM f) AS normalized_surplus, (SELECT coalesce(max(n), 0) FROM f) AS normalized_largest")
def duplicate_statistics(spark, sf_dir):
    return duplicates.statistics(signed(spark, sf_dir), "exact", "norm")


@query(f"WITH {SIGNED} SELECT doc_id, CAST(count(*) OVER (PARTITION BY norm) AS BIGINT) AS copies FROM s")
def copies_per_document(spark, sf_dir):
    return duplicates.with_copies(signed(spark, sf_dir), F.col("norm")).select("doc_id", "copies")


SPLIT = f"""WITH {GROUPS}, z AS (SELECT grp, count(*) AS n, sha256('seed-1:' || grp) AS r FROM g GROUP BY grp),
c AS (SELECT grp, coalesce(sum(n) OVER (ORDER BY r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) < (SELECT count(*) * 0.2 FROM g) AS taken FROM z)"""


@query(f"{SPLIT} SELECT doc_id, grp AS \"group\", CASE WHEN taken THEN 'reserved' ELSE 'development' END AS split FROM g JOIN c USING (grp)")
def group_split(spark, sf_dir):
    return duplicates.group_split(duplicates.components(signed(spark, sf_dir), "doc_id", "norm"), "doc_id", "seed-1")


@query(f"WITH {GROUPS} SELECT 'id on both sides' AS rule, count(*) FILTER (doc_id % 31 = 5) AS violations FROM g UNION ALL SELECT 'group on both sides', count(DISTINCT grp) FILTER (doc_id % 31 = 5) FROM g UNION ALL SELECT 'id left out', count(*) FILTER (doc_id % 50 = 7) FROM g UNION ALL SELECT 'id added', count(*) FILTER (doc_id % 50 = 7) FROM g")
def split_violations(spark, sf_dir):
    """A split that was broken on purpose: some ids also stand on the other side, and some of the source's ids are others."""
    split = group_split(spark, sf_dir)
    other = F.when(F.col("split") == "reserved", "development").otherwise("reserved")
    sides = F.when(F.col("doc_id") % 31 == 5, F.array("split", other)).otherwise(F.array("split"))
    source = table(spark, sf_dir, "documents").select((F.col("doc_id") + F.when(F.col("doc_id") % 50 == 7, 10**12).otherwise(0)).alias("doc_id"))
    return duplicates.split_violations(split.select("doc_id", "group", F.explode(sides).alias("split")), source, "doc_id")


@query("SELECT DISTINCT d.doc_id FROM documents d JOIN benchmark b ON contains(d.text, b.text)")
def golden_overlap_guard(spark, sf_dir):
    return duplicates.quoting(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), "doc_id")


BUCKET = "CASE WHEN n <= 2 THEN 'single_turn' WHEN n <= 4 THEN 'short_multi_turn' WHEN n <= 8 THEN 'medium_multi_turn' ELSE 'long_multi_turn' END"


def dims(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count("*").alias("n"), F.bool_or(F.col("role") == "system").alias("has_system"), (F.count_if(F.col("role") == "user") >= 2).alias("multi_user"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x.text), " ").alias("text"))
    return c.select("conv_id", sampling.length_bucket(F.col("n")).alias("length_bucket"), "has_system", "multi_user", "text")


DIMS = f"d AS (SELECT conv_id, {BUCKET} AS length_bucket, s AS has_system, u AS multi_user FROM (SELECT conv_id, count(*) AS n, bool_or(role = 'system') AS s, count(*) FILTER (role = 'user') >= 2 AS u FROM conversations GROUP BY 1))"


@query(f"WITH {DIMS} SELECT conv_id, length_bucket, has_system, multi_user FROM d")
def length_buckets(spark, sf_dir):
    return dims(spark, sf_dir).drop("text")


@query(f"WITH {DIMS} SELECT 'length_bucket' AS dimension, length_bucket AS value, count(*) AS count FROM d GROUP BY 2 UNION ALL SELECT 'has_system', CAST(has_system AS VARCHAR), count(*) FROM d GROUP BY 2 UNION ALL SELECT 'multi_user', CAST(multi_user AS VARCHAR), count(*) FROM d GROUP BY 2")
def stratum_counts(spark, sf_dir):
    return sampling.stratum_counts(dims(spark, sf_dir), ("length_bucket", "has_system", "multi_user"))


@query("SELECT doc_id, sha256('s:' || doc_id) AS h FROM documents ORDER BY h DESC, doc_id LIMIT 50")
def stable_tie_topn(spark, sf_dir):
    return sampling.stable_top(table(spark, sf_dir, "documents"), "doc_id", "s", 50).select("doc_id", F.sha2(F.concat(F.lit("s:"), F.col("doc_id").cast("string")), 256).alias("h"))


@query("WITH t AS (SELECT DISTINCT conv_id, turn, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS token FROM conversations) SELECT token, count(*) AS df FROM t GROUP BY 1")
def token_df(spark, sf_dir):
    return sampling.token_frequencies(table(spark, sf_dir, "conversations"), "conv_id")


@query()
def greedy_sample(spark, sf_dir):
    goals = {"single_turn": 6, "short_multi_turn": 6, "medium_multi_turn": 6}
    return sampling.greedy_sample(dims(spark, sf_dir), "conv_id", "7", goals, {"has_system": {"true": 4}, "multi_user": {"true": 9}})


# ---- cases, lexical layer

@query(f"{WITH}, {CTX} SELECT conversation_id, CAST(pos AS INT) AS pos, message_id, CAST(point_pos AS INT) AS point_pos FROM ctx")
def visible_context(spark, sf_dir):
    m = chat_cases(spark, sf_dir)
    return cases.contexts(m, cases.default_points(m)).select("conversation_id", "pos", "message_id", "point_pos")


@query(f"{WITH} SELECT conversation_id, string_agg(message_id, ',' ORDER BY pos) FILTER (role = 'customer') AS customer_ids, coalesce(string_agg(message_id, ',' ORDER BY pos) FILTER (role = 'support'), '') AS support_ids FROM cm GROUP BY 1")
def ids_by_role(spark, sf_dir):
    return cases.ids_by_role(chat_cases(spark, sf_dir)).select("conversation_id", *(F.array_join(c, ",").alias(c) for c in ("customer_ids", "support_ids")))


LEXICON = {"north": {"of": 3, "that": 2}, "south": {"and": 2, "with": 3}, "east": {"in": 2, "from": 3, "of the": 2}, "west": {"to": 2, "this": 3}}
LEX_SQL = " UNION ALL ".join(f"SELECT conversation_id, '{i}' AS intent, {float(v)} * CASE WHEN pos = point_pos THEN 2 ELSE 1 END AS v FROM ctx WHERE {f'contains(lower(text), {chr(39)}{p}{chr(39)})' if ' ' in p else word(p)}" for i, ps in LEXICON.items() for p, v in ps.items())
SCORES = f"sc AS (SELECT conversation_id, intent, CAST(sum(v) AS DOUBLE) AS score FROM ({LEX_SQL}) GROUP BY 1, 2)"


def default_context(spark, sf_dir):
    m = chat_cases(spark, sf_dir)
    return cases.contexts(m, cases.default_points(m))


@query(f"{WITH}, {CTX}, {SCORES} SELECT * FROM sc")
def intent_scores(spark, sf_dir):
    return intent.intent_scores(default_context(spark, sf_dir), LEXICON).drop("evidence")


@query(f"""{WITH}, {CTX}, {SCORES}, r AS (SELECT *, row_number() OVER (PARTITION BY conversation_id ORDER BY score DESC, intent) AS k FROM sc),
f AS (SELECT a.conversation_id, a.intent, a.score / (a.score + coalesce(b.score, 0) + 1) AS c FROM r a LEFT JOIN r b ON b.conversation_id = a.conversation_id AND b.k = 2 WHERE a.k = 1),
alt AS (SELECT conversation_id, string_agg(intent, ',' ORDER BY k) AS alternatives FROM r WHERE k IN (2, 3) GROUP BY 1)
SELECT conversation_id, intent, CAST(CASE WHEN c IS NULL THEN 0 ELSE least(0.99, c) END AS DOUBLE) AS intent_confidence, coalesce(alternatives, '') AS alternatives FROM pt LEFT JOIN f USING (conversation_id) LEFT JOIN alt USING (conversation_id)""")
def intent_top1(spark, sf_dir):
    c = intent.classify(default_context(spark, sf_dir), LEXICON)
    return c.select("conversation_id", "intent", "intent_confidence", F.array_join("intent_alternatives", ",").alias("alternatives"))


LEX_STATE = {"failure": r"\bfrom\b", "investigation": r"\bthree\b", "private_channel": r"\bwhen\b", "account_word": r"\bwith\b", "access_risk": r"\bhad\b", "resolved": r"\bthis\b", "improving": r"\bwas\b", "result": r"\bbe\b", "proposal": r"\bwould\b", "platform": r"\bof\b", "symptom": r"\band\b", "diagnostic": r"\bto\b"}


def _state_sql(src_: str) -> str:
    h = lambda k, c: word(LEX_STATE[k].replace("\\b", ""), f"lower({c})")
    return f"""SELECT conversation_id, pos, CASE WHEN {h('investigation', 's')} THEN 'SPECIALIST_OR_PRODUCT_INVESTIGATION' WHEN {h('private_channel', 's')} AND {h('account_word', 's')} THEN 'PRIVATE_ACCOUNT_CONTEXT_REQUIRED'
WHEN {h('access_risk', 'cur')} THEN 'PRIVATE_ACCOUNT_CONTEXT_REQUIRED' WHEN {h('resolved', 'cur')} THEN 'RESOLVED' WHEN {h('improving', 'cur')} THEN 'MONITORING' WHEN f >= 2 THEN 'REPEATED_FAILURE_OR_BROADER_INCIDENT'
WHEN f = 1 OR {h('result', 'cur')} THEN 'ACTION_RESULT_REPORTED' WHEN {h('proposal', 's')} THEN 'FIRST_LINE_ACTION_PROPOSED' WHEN NOT {h('platform', 'c')} OR NOT {h('symptom', 'c')} THEN 'SYMPTOM_REPORTED'
WHEN {h('diagnostic', "c || ' ' || s")} THEN 'CONTEXT_COLLECTED' ELSE 'SYMPTOM_REPORTED' END AS state FROM {src_}"""


RUNNING = f"""run AS (SELECT conversation_id, pos, role, text AS cur, coalesce(string_agg(text, ' ' ORDER BY pos) FILTER (role = 'customer') OVER w, '') AS c, coalesce(string_agg(text, ' ' ORDER BY pos) FILTER (role = 'support') OVER w, '') AS s,
coalesce(sum(CASE WHEN role = 'customer' AND {word('from')} THEN 1 ELSE 0 END) OVER w, 0) AS f FROM cm WINDOW w AS (PARTITION BY conversation_id ORDER BY pos ROWS UNBOUNDED PRECEDING))""".replace("string_agg(text, ' ' ORDER BY pos)", "string_agg(text, ' ')")


@query(f"{WITH}, {RUNNING}, st AS ({_state_sql('run')} WHERE role = 'customer') SELECT conversation_id, CAST(pos AS INT) AS pos, state FROM st")
def state_at_every_point(spark, sf_dir):
    return state.at_every_customer_message(chat_cases(spark, sf_dir), LEX_STATE)


@query(f"{WITH}, {RUNNING}, st AS ({_state_sql('run')} WHERE role = 'customer'), l AS (SELECT conversation_id, max(pos) AS pos FROM st GROUP BY 1) SELECT conversation_id, state FROM st JOIN l USING (conversation_id, pos)")
def state_at_point(spark, sf_dir):
    return state.detect(default_context(spark, sf_dir), None, LEX_STATE).select("conversation_id", "state")


ACTS = {"ACT_OF": r"\bof\b", "ACT_WITH": r"\bwith\b", "ACT_TO": r"\bto\b"}
ENDS = {"failed": r"\bfrom\b", "resolved": r"\bthis\b", "improved": r"\bfor\b"}
LEDGER = f"""a AS (SELECT *, CASE WHEN role = 'customer' THEN text WHEN lead(role) OVER w = 'customer' THEN lead(text) OVER w ELSE '' END AS reply FROM cm WINDOW w AS (PARTITION BY conversation_id ORDER BY pos)),
hit AS (SELECT *, 0 AS n, 'ACT_OF' AS action FROM a WHERE {word('of')} UNION ALL SELECT *, 1, 'ACT_WITH' FROM a WHERE {word('with')} UNION ALL SELECT *, 2, 'ACT_TO' FROM a WHERE {word('to')}),
led AS (SELECT conversation_id, CAST(row_number() OVER (PARTITION BY conversation_id ORDER BY pos, n) AS INT) AS item, action, message_id, pos, CASE WHEN role = 'support' OR {word('is (in|to)')} THEN 'explicit' ELSE 'inferred' END AS explicitness,
CASE WHEN coalesce(reply, '') = '' THEN 'unknown' WHEN {word('from', 'lower(reply)')} THEN 'failed' WHEN {word('this', 'lower(reply)')} THEN 'resolved' WHEN {word('for', 'lower(reply)')} THEN 'improved' ELSE 'attempted' END AS result FROM hit)"""


def chat_ledger(spark, sf_dir):
    return ledger.attempts(chat_cases(spark, sf_dir), ACTS, ENDS, r"\bis (in|to)\b")


@query(f"{WITH}, {LEDGER} SELECT conversation_id, item, action, message_id, explicitness, result FROM led")
def ledger_attempts(spark, sf_dir):
    return chat_ledger(spark, sf_dir).select("conversation_id", "item", "action", "message_id", "explicitness", "result")


@query(f"{WITH}, {LEDGER}, f AS (SELECT conversation_id, action, min(item) AS i FROM led WHERE result = 'failed' GROUP BY 1, 2) SELECT conversation_id, string_agg(action, ',' ORDER BY i) AS failed_actions FROM f GROUP BY 1")
def failed_actions(spark, sf_dir):
    return ledger.failed_actions(chat_ledger(spark, sf_dir)).select("conversation_id", F.array_join("failed_actions", ",").alias("failed_actions"))


def event_ledger(spark, sf_dir):
    """Events as a ledger: an event names an action, and what follows it tells the result."""
    e = table(spark, sf_dir, "events")
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    nxt = F.lead("event_type").over(w)
    result = F.when(nxt == "error", "failed").when(nxt == "purchase", "resolved").when(nxt.isNull(), "unknown").otherwise("attempted")
    prev = F.lag("event_type").over(w)
    action = F.when(F.col("event_type") == "view", "SESSION_RESET").when(F.col("event_type") == "click", "BROWSER_REMEDIATION").when(F.col("event_type") == "signup", "PROVIDE_HELP_RESOURCE").otherwise("CONFIRM_AND_MONITOR")
    return e.select(F.col("user_id").cast("string").alias("conversation_id"), F.row_number().over(w).alias("item"), action.alias("action"), prev.alias("state"), result.alias("result"), "event_type")


EVENTS = """ev AS (SELECT CAST(user_id AS VARCHAR) AS conversation_id, row_number() OVER w AS item, event_type, lag(event_type) OVER w AS state,
CASE event_type WHEN 'view' THEN 'SESSION_RESET' WHEN 'click' THEN 'BROWSER_REMEDIATION' WHEN 'signup' THEN 'PROVIDE_HELP_RESOURCE' ELSE 'CONFIRM_AND_MONITOR' END AS action,
CASE WHEN lead(event_type) OVER w = 'error' THEN 'failed' WHEN lead(event_type) OVER w = 'purchase' THEN 'resolved' WHEN lead(event_type) OVER w IS NULL THEN 'unknown' ELSE 'attempted' END AS result
FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))"""
ACT_LIST = "(VALUES " + ", ".join(f"({i}, '{a}')" for i, a in enumerate(V.ACTIONS)) + ") acts(o, action)"


@query(f"WITH {EVENTS}, f AS (SELECT DISTINCT conversation_id, action FROM ev WHERE result = 'failed'), c AS (SELECT DISTINCT conversation_id FROM ev) SELECT c.conversation_id, string_agg(acts.action, ',' ORDER BY o) FILTER (f.action IS NULL) AS eligible, coalesce(string_agg(acts.action, ',' ORDER BY o) FILTER (f.action IS NOT NULL), '') AS rejected, count(f.action) / 13.0::DOUBLE AS repeated_failed_rate FROM c CROSS JOIN {ACT_LIST} LEFT JOIN f ON f.conversation_id = c.conversation_id AND f.action = acts.action GROUP BY 1")
def failed_action_filter(spark, sf_dir):
    items = event_ledger(spark, sf_dir)
    out = ledger.filter_candidates(items.select("conversation_id").distinct(), items)
    return out.select("conversation_id", *(F.array_join(c, ",").alias(c) for c in ("eligible", "rejected")), "repeated_failed_rate")


# ---- retrieval, transitions, policy

COS = """q AS (SELECT item_id AS k, unnest(regexp_extract_all(lower(text), '[a-z]+')) AS term FROM benchmark), d AS (SELECT doc_id AS k, unnest(regexp_extract_all(lower(text), '[a-z]+')) AS term FROM documents),
qt AS (SELECT k, term, count(*) AS n FROM q GROUP BY ALL), dt AS (SELECT k, term, count(*) AS n FROM d GROUP BY ALL),
qn AS (SELECT k, sqrt(sum(n * n)) AS z FROM qt GROUP BY 1), dn AS (SELECT k, sqrt(sum(n * n)) AS z FROM dt GROUP BY 1),
s AS (SELECT qt.k AS query_id, dt.k AS doc_id, sum((qt.n / qn.z) * (dt.n / dn.z)) AS score FROM qt JOIN dt USING (term) JOIN qn ON qn.k = qt.k JOIN dn ON dn.k = dt.k GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM s)"""


def searched(spark, sf_dir, mode):
    b = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    return retrieval.search(b, d, 5, mode, key="doc_id", pattern="[a-z]+" if mode == "tf" else "[a-z][a-z]+").select("query_id", "doc_id", F.col("rank").cast("long").alias("rank"))


@query(f"WITH {COS} SELECT query_id, doc_id, rank FROM r WHERE rank <= 5")
def tf_cosine_topk(spark, sf_dir):
    return searched(spark, sf_dir, "tf")


TFIDF = """tok AS (SELECT 'd' AS side, doc_id AS k, regexp_extract_all(lower(text), '[a-z][a-z]+') AS l FROM documents UNION ALL SELECT 'q', item_id, regexp_extract_all(lower(text), '[a-z][a-z]+') FROM benchmark),
gram AS (SELECT side, k, unnest(list_concat(l, list_transform(range(1, len(l)), lambda i: l[i] || ' ' || l[i + 1]))) AS term FROM tok), tf AS (SELECT side, k, term, count(*) AS n FROM gram GROUP BY ALL),
idf AS (SELECT term, ln((1 + (SELECT count(*) FROM documents)) / (1 + count(*))::DOUBLE) + 1 AS idf FROM tf WHERE side = 'd' GROUP BY 1),
w AS (SELECT side, k, term, n * idf AS w FROM tf JOIN idf USING (term)), z AS (SELECT side, k, sqrt(sum(w * w)) AS z FROM w GROUP BY ALL), u AS (SELECT side, k, term, w / z AS w FROM w JOIN z USING (side, k)),
s AS (SELECT q.k AS query_id, d.k AS doc_id, sum(q.w * d.w) AS score FROM u q JOIN u d USING (term) WHERE q.side = 'q' AND d.side = 'd' GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM s)"""


@query(f"WITH {TFIDF} SELECT query_id, doc_id, rank FROM r WHERE rank <= 5")
def tfidf_cosine_topk(spark, sf_dir):
    return searched(spark, sf_dir, "tfidf")


@query("WITH e AS (SELECT *, last_value(CASE WHEN event_type = 'view' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS view_id FROM events) SELECT event_id, view_id FROM e WHERE event_type = 'purchase'")
def asof_last_customer(spark, sf_dir):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, -1)
    e = table(spark, sf_dir, "events")
    seen = F.last(F.when(F.col("event_type") == "view", F.col("event_id")), ignorenulls=True).over(w)
    return e.select("event_id", "event_type", seen.alias("view_id")).filter("event_type = 'purchase'").select("event_id", "view_id")


@query(f"""WITH {EVENTS}, g AS (SELECT state, action, count(*) AS support_count, count(*) FILTER (result IN ('improved', 'resolved')) AS successful_count, count(*) FILTER (result = 'failed') AS failed_count, count(DISTINCT conversation_id) AS conversations FROM ev WHERE state IS NOT NULL GROUP BY 1, 2)
SELECT *, CASE WHEN support_count >= 3 AND NOT (successful_count > 0 AND failed_count > 0) THEN 'strong' WHEN support_count >= 2 THEN 'moderate' ELSE 'weak' END AS evidence_strength FROM g""")
def transition_evidence(spark, sf_dir):
    t = transitions.aggregate(event_ledger(spark, sf_dir).filter("state is not null"))
    return t.select("state", "action", "support_count", "successful_count", "failed_count", F.size("conversation_ids").cast("long").alias("conversations"), "evidence_strength")


def event_cases(spark, sf_dir):
    """A case per user: state and intent derived from counts of events."""
    e = table(spark, sf_dir, "events").groupBy(F.col("user_id").cast("string").alias("conversation_id")).agg(F.count("*").alias("n"), F.max("event_id").alias("m"))
    pick = lambda values, c: F.element_at(F.array(*map(F.lit, values)), (c % len(values) + 1).cast("int"))
    missing = F.when(F.col("m") % 3 == 0, F.array(F.lit("PLATFORM_CONTEXT"))).when(F.col("m") % 3 == 1, F.array(F.lit("SECURE_ACCOUNT_CONTEXT"))).otherwise(F.array().cast("array<string>"))
    return e.select("conversation_id", pick(V.INTENTS, F.col("n")).alias("intent"), pick(V.STATES, F.col("m")).alias("state"), missing.alias("missing"), ((F.col("n") % 10) / 10.0).alias("intent_confidence"))


_list = lambda values: "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"
CASES = f"""cs AS (SELECT conversation_id, ({_list(V.INTENTS)})[n % 10 + 1] AS intent, ({_list(V.STATES)})[m % 9 + 1] AS state, CASE m % 3 WHEN 0 THEN ['PLATFORM_CONTEXT'] WHEN 1 THEN ['SECURE_ACCOUNT_CONTEXT'] ELSE [] END AS missing, (n % 10) / 10.0::DOUBLE AS intent_confidence
FROM (SELECT CAST(user_id AS VARCHAR) AS conversation_id, count(*) AS n, max(event_id) AS m FROM events GROUP BY 1)),
fl AS (SELECT conversation_id, action, min(item) AS i FROM ev WHERE result = 'failed' GROUP BY 1, 2)"""
_pairs = lambda d: "(VALUES " + ", ".join(f"('{a}', '{b}', {v}::DOUBLE)" for (a, b), v in d.items()) + ")"
PARTS = f"""sup AS (SELECT conversation_id, action, count(*) AS support FROM ev WHERE state IS NOT NULL GROUP BY 1, 2),
el AS (SELECT cs.*, acts.o, acts.action FROM cs CROSS JOIN {ACT_LIST} LEFT JOIN fl ON fl.conversation_id = cs.conversation_id AND fl.action = acts.action WHERE fl.action IS NULL),
ps AS (SELECT el.conversation_id, el.action, el.o, least(4.0, coalesce(support, 0) / 2.0)::DOUBLE AS transition_support, coalesce(sf.v, 0)::DOUBLE AS state_fit,
CASE WHEN EXISTS (SELECT 1 FROM {_pairs(policy.MISSING_FIT)} mf(r, a, v) WHERE mf.a = el.action AND list_contains(el.missing, mf.r)) THEN 3.0 ELSE 0.0 END::DOUBLE AS missing_information_fit, coalesce(nf.v, 0)::DOUBLE AS intent_fit, coalesce(pf.v, 0)::DOUBLE AS progression_signal
FROM el LEFT JOIN sup ON sup.conversation_id = el.conversation_id AND sup.action = el.action LEFT JOIN {_pairs(policy.STATE_FIT)} sf(s, a, v) ON sf.s = el.state AND sf.a = el.action
LEFT JOIN {_pairs(V.INTENT_ACTIONS)} nf(s, a, v) ON nf.s = el.intent AND nf.a = el.action LEFT JOIN {_pairs(policy.PROGRESS_FIT)} pf(s, a, v) ON pf.s = el.state AND pf.a = el.action),
tot AS (SELECT *, transition_support + state_fit + missing_information_fit + intent_fit + progression_signal AS total FROM ps),
rk AS (SELECT *, row_number() OVER (PARTITION BY conversation_id ORDER BY total DESC, o) AS k FROM tot)"""


def event_scores(spark, sf_dir):
    items = event_ledger(spark, sf_dir)
    evidence = transitions.aggregate(items.filter("state is not null").withColumn("query_id", F.col("conversation_id")), ("query_id",))
    return policy.action_scores(event_cases(spark, sf_dir), items, evidence)


@query(f"WITH {EVENTS}, {CASES}, {PARTS} SELECT conversation_id, action, transition_support, state_fit, missing_information_fit, intent_fit, progression_signal, total FROM tot")
def next_action_scores(spark, sf_dir):
    return event_scores(spark, sf_dir).select("conversation_id", "action", *policy.PARTS, "total")


@query(f"WITH {EVENTS}, {CASES}, {PARTS} SELECT conversation_id, max(action) FILTER (k = 1) AS selected_action, max(total) FILTER (k = 1) AS score, string_agg(action, ',' ORDER BY k) FILTER (k BETWEEN 2 AND 4) AS alternatives FROM rk GROUP BY 1")
def next_action(spark, sf_dir):
    return policy.select_action(event_scores(spark, sf_dir)).select("conversation_id", "selected_action", "score", F.array_join("alternatives", ",").alias("alternatives"))


def event_decisions(spark, sf_dir):
    items = event_ledger(spark, sf_dir)
    held = event_cases(spark, sf_dir).join(ledger.failed_actions(items), "conversation_id", "left").withColumn("failed_actions", F.coalesce("failed_actions", F.array().cast("array<string>")))
    return escalation.decide(held.join(policy.select_action(event_scores(spark, sf_dir)), "conversation_id"))


CODES = f"""ch AS (SELECT cs.*, rk.action AS sel, (SELECT count(*) FROM fl WHERE fl.conversation_id = cs.conversation_id) AS nf FROM cs JOIN rk ON rk.conversation_id = cs.conversation_id AND rk.k = 1),
co AS (SELECT conversation_id, sel, list_filter([CASE WHEN state = '{V.STATES[5]}' THEN 'PRIVATE_ACCOUNT_CONTEXT' END, CASE WHEN intent = '{V.INTENTS[6]}' THEN 'SECURITY_OR_ACCOUNT_ACCESS' END, CASE WHEN intent = '{V.INTENTS[5]}' THEN 'BILLING_PAYMENT_OR_REFUND' END,
CASE WHEN state = '{V.STATES[4]}' OR nf >= 2 THEN 'REPEATED_FAILURE_OR_RELAPSE' END, CASE WHEN state = '{V.STATES[6]}' OR sel = 'ESCALATE_TECHNICAL_OR_PRODUCT_ISSUE' THEN 'SPECIALIST_OR_PRODUCT_INVESTIGATION' END, CASE WHEN intent_confidence < 0.5 THEN 'INSUFFICIENT_EVIDENCE' END], lambda x: x IS NOT NULL) AS c FROM ch)"""


@query(f"WITH {EVENTS}, {CASES}, {PARTS}, {CODES} SELECT conversation_id, array_to_string(c, ',') AS reason_codes, CASE WHEN len(c) > 0 THEN 'ESCALATE' ELSE 'AUTO_HANDLE' END AS decision, CASE WHEN list_has_any(c, ['PRIVATE_ACCOUNT_CONTEXT', 'SECURITY_OR_ACCOUNT_ACCESS', 'BILLING_PAYMENT_OR_REFUND', 'OTHER_HIGH_RISK']) THEN 'high' WHEN len(c) > 0 THEN 'medium' ELSE 'low' END AS risk FROM co")
def escalation_codes(spark, sf_dir):
    return event_decisions(spark, sf_dir).select("conversation_id", F.array_join("reason_codes", ",").alias("reason_codes"), "decision", "risk")


_reply = "CASE sel " + " ".join(f"WHEN '{a}' THEN '{t.replace(chr(39), chr(39) * 2).replace('{product}', 'app')}'" for a, t in V.REPLIES.items()) + " END"


@query(f"WITH {EVENTS}, {CASES}, {PARTS}, {CODES}, t AS (SELECT conversation_id, CASE WHEN len(c) = 0 THEN {_reply} WHEN list_has_any(c, ['PRIVATE_ACCOUNT_CONTEXT', 'SECURITY_OR_ACCOUNT_ACCESS', 'BILLING_PAYMENT_OR_REFUND']) THEN '{V.PRIVATE_REPLY}' ELSE '{V.REVIEW_REPLY}' END AS reply FROM co) SELECT conversation_id, reply, '' AS warnings FROM t")
def drafted_replies(spark, sf_dir):
    return escalation.draft(event_decisions(spark, sf_dir)).select("conversation_id", "reply", F.array_join("warnings", ",").alias("warnings"))


@query("SELECT doc_id, concat_ws(',', CASE WHEN regexp_matches(lower(text), '(?s)\\b(account|email|username)\\s*[:=]') THEN 'exposes account data in the draft' END) AS warnings FROM documents")
def response_warnings(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(escalation.reply_warnings(F.col("text"), F.lit("SESSION_RESET")), ",").alias("warnings"))


@query()
def whole_cases(spark, sf_dir):
    """The whole plan over all chats, with rule tables of their words."""
    m = chat_cases(spark, sf_dir)
    out = pipeline.run(m, m, rules=LEXICON, patterns={a: p for a, p in zip(V.ACTIONS, ACTS.values(), strict=False)})
    return out.select("conversation_id", "intent", "intent_confidence", "state", "selected", "score", "decision", "risk", "reply", F.size("hits").alias("n_hits"), F.size("evidence").alias("n_evidence"))


@query()
def simple_baseline(spark, sf_dir):
    return pipeline.simple_baseline(chat_cases(spark, sf_dir), rules=LEXICON)


# ---- evaluation

@query("WITH n AS (SELECT quality AS v, count(*) AS c, min(doc_id) AS f FROM labels GROUP BY 1) SELECT CAST(v AS VARCHAR) AS value, c AS n FROM n ORDER BY c DESC, f LIMIT 1")
def majority_mode(spark, sf_dir):
    return evaluation.majority(table(spark, sf_dir, "labels").withColumn("quality", F.col("quality").cast("string")), "quality", "doc_id")


@query("WITH c AS (SELECT quality AS t, toxic AS p, count(*) AS n FROM labels GROUP BY 1, 2), t AS (SELECT t, sum(n) AS a, coalesce(sum(n) FILTER (t = p), 0) AS tp FROM c GROUP BY 1), p AS (SELECT p, sum(n) AS q FROM c GROUP BY 1) SELECT (sum(tp) / sum(a))::DOUBLE AS accuracy, avg(2 * tp / (a + coalesce(q, 0)))::DOUBLE AS macro_f1, CAST(sum(a) AS BIGINT) AS count FROM t LEFT JOIN p ON p.p = t.t")
def classification_metrics(spark, sf_dir):
    return evaluation.classification_metrics(table(spark, sf_dir, "labels"), "quality", "toxic")


YES = "y AS (SELECT quality = 1 AS t, toxic = 1 AS p FROM labels)"


@query(f"WITH {YES}, c AS (SELECT count(*) FILTER (t AND p) AS tp, count(*) FILTER (NOT t AND p) AS fp, count(*) FILTER (t AND NOT p) AS fn, count(*) AS count FROM y), r AS (SELECT count, coalesce(tp / nullif(tp + fp, 0)::DOUBLE, 0) AS precision, coalesce(tp / nullif(tp + fn, 0)::DOUBLE, 0) AS recall FROM c) SELECT precision, recall, coalesce(2 * precision * recall / nullif(precision + recall, 0), 0) AS f1, count FROM r")
def binary_metrics(spark, sf_dir):
    yes = lambda c: F.when(F.col(c) == 1, "yes").otherwise("no").alias(c)
    return evaluation.binary_metrics(table(spark, sf_dir, "labels").select(yes("quality"), yes("toxic")), "quality", "toxic")


@query("WITH n AS (SELECT count(*)::DOUBLE AS n, count(*) FILTER (quality = toxic) AS s FROM labels), e AS (SELECT sum(a.c * b.c) AS c FROM (SELECT quality AS v, count(*) AS c FROM labels GROUP BY 1) a JOIN (SELECT toxic AS v, count(*) AS c FROM labels GROUP BY 1) b USING (v)), k AS (SELECT s / n AS o, c / (n * n) AS x, n FROM n, e) SELECT CAST((o - x) / (1 - x) AS DOUBLE) AS kappa, CAST(o AS DOUBLE) AS observed, CAST(x AS DOUBLE) AS expected, CAST(n AS BIGINT) AS count FROM k")
def cohens_kappa(spark, sf_dir):
    return evaluation.cohens_kappa(table(spark, sf_dir, "labels"), "quality", "toxic")


@query(f"{WITH}, a AS (SELECT conversation_id, list_distinct(flatten(list(regexp_extract_all(lower(text), '[a-z0-9]+')) FILTER (role = 'customer'))) AS l, list_distinct(flatten(list(regexp_extract_all(lower(text), '[a-z0-9]+')) FILTER (role = 'support'))) AS r FROM cm GROUP BY 1) SELECT conversation_id, CASE WHEN len(coalesce(l, [])) + len(coalesce(r, [])) = 0 THEN 1.0 ELSE len(list_intersect(coalesce(l, []), coalesce(r, []))) / len(list_distinct(list_concat(coalesce(l, []), coalesce(r, []))))::DOUBLE END AS jaccard FROM a")
def jaccard_codes(spark, sf_dir):
    per = chat_cases(spark, sf_dir).groupBy("conversation_id").agg(*(F.array_distinct(F.flatten(F.collect_list(F.when(F.col("role") == r, tx.ascii_tokens(F.col("text")))))).alias(r) for r in ("customer", "support")))
    return per.select("conversation_id", evaluation.jaccard(F.col("customer"), F.col("support")).alias("jaccard"))


def event_traces(spark, sf_dir):
    """Traces with synthetic hits: every case but those of score 0.0 has one."""
    d = event_decisions(spark, sf_dir)
    ev = transitions.aggregate(event_ledger(spark, sf_dir).filter("state is not null").withColumn("query_id", F.col("conversation_id")), ("query_id",)).groupBy(F.col("query_id").alias("conversation_id")).agg(F.collect_list(F.struct("action", "support_count")).alias("evidence"))
    none = F.array().cast("array<string>")
    return d.join(ev, "conversation_id", "left").select("conversation_id", F.col("selected_action").alias("selected"), "rejected", F.array(F.struct(F.col("intent_confidence").alias("score"))).alias("hits"), F.coalesce("evidence", F.array().cast("array<struct<action:string,support_count:bigint>>")).alias("evidence"), none.alias("warnings"), "intent_confidence", F.lit(0.9).alias("state_confidence"), "decision")


OPS = "ts AS (SELECT conversation_id, sum(support) AS s FROM sup GROUP BY 1)"


@query(f"WITH {EVENTS}, {CASES}, {PARTS}, {CODES}, {OPS} SELECT 0.0::DOUBLE AS repeated_failed_action_rate, avg(CASE WHEN ts.s IS NULL THEN 0.0 ELSE 1.0 END)::DOUBLE AS evidence_coverage, avg(coalesce(coalesce(sup.support, 0) / ts.s::DOUBLE, 0)) AS transition_consistency, 1.0::DOUBLE AS response_groundedness, count(*) AS count FROM co LEFT JOIN ts USING (conversation_id) LEFT JOIN sup ON sup.conversation_id = co.conversation_id AND sup.action = co.sel")
def operational_rates(spark, sf_dir):
    return evaluation.operational_metrics(event_traces(spark, sf_dir))


@query(f"WITH {EVENTS}, {CASES}, {PARTS}, {CODES}, {OPS} SELECT co.conversation_id, concat_ws(',', CASE WHEN intent_confidence < 0.5 THEN 'LOW_INTENT_CONFIDENCE' END, CASE WHEN intent_confidence < 0.1 THEN 'LOW_RETRIEVAL_SIMILARITY' END, CASE WHEN ts.s IS NULL THEN 'NO_HISTORICAL_TRANSITION_EVIDENCE' END, CASE WHEN len(c) > 0 THEN 'ESCALATION_REVIEW' END) AS signals FROM co JOIN cs USING (conversation_id) LEFT JOIN ts USING (conversation_id)")
def failure_signals(spark, sf_dir):
    return evaluation.failure_signals(event_traces(spark, sf_dir)).select("conversation_id", F.array_join("signals", ",").alias("signals"))


def event_annotations(spark, sf_dir):
    """Annotation records made from labels, with a few broken rules at known places."""
    n = F.col("doc_id")
    s = F.lit
    return table(spark, sf_dir, "labels").select(
        F.when(n % 17 == 0, "").otherwise(F.concat(s("a"), n.cast("string"))).alias("annotation_id"), n.cast("string").alias("journey_id"), F.when(n % 13 == 0, "other").otherwise(n.cast("string")).alias("root_tweet_id"), s("ann").alias("annotator_id"),
        F.when(n % 11 == 0, "nonsense").otherwise(V.INTENTS[0]).alias("intent"), s("").alias("current_state"), s("labelled").alias("intent_status"), s("labelled").alias("state_status"), s("UNKNOWN").alias("observed_next_action"), s("").alias("ideal_next_action"),
        s("resolved").alias("outcome"), F.when(F.col("quality") == 1, "yes").otherwise("maybe").alias("escalation_eligible"), s("visible").alias("evidence_visibility"), s("high").alias("confidence"),
        F.expr("cast(array() as array<struct<requirement:string,status:string>>)").alias("missing_information"), F.expr("cast(array() as array<struct<action:string,explicitness:string,result:string>>)").alias("attempted_actions"), F.when(F.col("toxic") == 1, "yes").alias("exclude_from_golden"),
    )


def _candidates(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.filter("doc_id % 7 <> 0").select(F.col("doc_id").cast("string").alias("journey_id"), F.col("doc_id").cast("string").alias("root_tweet_id")), d.filter("doc_id % 19 = 0").select(F.col("doc_id").cast("string").alias("journey_id"))


@query("SELECT CASE WHEN doc_id % 17 = 0 THEN '' ELSE 'a' || doc_id END AS annotation_id, CAST(doc_id AS VARCHAR) AS journey_id, error FROM (SELECT doc_id, 'annotation_id is required' AS error FROM labels WHERE doc_id % 17 = 0 UNION ALL SELECT doc_id, 'journey_id is not a golden annotation candidate' FROM labels WHERE doc_id % 7 = 0 UNION ALL SELECT doc_id, 'root_tweet_id does not match candidate' FROM labels WHERE doc_id % 7 <> 0 AND doc_id % 13 = 0 UNION ALL SELECT doc_id, 'golden journey appears in development data' FROM labels WHERE doc_id % 19 = 0 UNION ALL SELECT doc_id, 'intent is missing or outside the frozen vocabulary' FROM labels WHERE doc_id % 11 = 0 UNION ALL SELECT doc_id, 'escalation_eligible is missing or outside the frozen vocabulary' FROM labels WHERE quality <> 1)")
def annotation_errors(spark, sf_dir):
    return evaluation.annotation_errors(event_annotations(spark, sf_dir), *_candidates(spark, sf_dir))


@query("SELECT count(*) AS records, count(*) FILTER (toxic <> 1) AS included, CAST(0 AS BIGINT) AS repeated_ids, count(*) FILTER (doc_id % 7 = 0) AS non_candidates, count(*) FILTER (doc_id % 19 = 0) AS in_development FROM labels")
def golden_report(spark, sf_dir):
    return evaluation.golden_report(event_annotations(spark, sf_dir), *_candidates(spark, sf_dir))


@query("SELECT doc_id, 'NOT_AVAILABLE' AS status, CAST(NULL AS VARCHAR) AS value, 'NOT_AVAILABLE' AS judge_status FROM documents")
def provider_status(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    return evaluation.judged(src.with_provider(d, "text")).select("doc_id", "status", "value", "judge_status")


from threadloom import registry_checks, registry_stores  # noqa: E402, F401  register their queries

"""Further registered queries: link tables, stores, line reports and running evidence, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from threadloom.functions import text as tx
from threadloom.functions import vocab as V
from threadloom.functions.shared import shared_folder
from threadloom.operators import cases, constraints, duplicates, evaluation, profile, retrieval, sampling, threads, transitions
from threadloom.registry import ACTS, COS, ENDS, EVENTS, LEDGER, LEX_STATE, LINKS, ROOTS, RUNNING, SPLIT, WITH, WITHR, _state_sql, broken_chat, chat, chat_cases, event_ledger, group_split, query, signed, table, word
from threadloom.sources import provider, staging
from threadloom.sources import tables as src
from threadloom.sources.store import Store

# ---- reply graphs

@query(f"{WITHR} SELECT root, id, CAST(depth AS INT) AS depth FROM chain")
def threads_by_doubling(spark, sf_dir):
    """The threads of ``recursive_threads`` by pointer doubling."""
    m = chat(spark, sf_dir)
    return threads.threads_by_doubling(m, threads.roots(m))


@query(f"{WITH} SELECT id FROM msg WHERE conv_id % 7 = 3")
def messages_in_cycles(spark, sf_dir):
    """In one conversation of seven the first message answers the last, so that no reply link there ever ends."""
    m = chat(spark, sf_dir)
    last = m.groupBy("conv_id").agg(F.max_by("id", "turn").alias("last"))
    tied = m.join(last, "conv_id").withColumn("parent", F.when((F.col("conv_id") % 7 == 3) & (F.col("parent") == ""), F.col("last")).otherwise(F.col("parent"))).drop("last")
    return threads.in_cycles(tied, threads.roots(tied))


def staged(spark, sf_dir):
    return staging.stage(broken_chat(spark, sf_dir), 8)


BROKEN = "m AS (SELECT * REPLACE (CASE WHEN turn % 5 = 3 AND response <> '' THEN 'gone-' || response ELSE response END AS response, CASE WHEN turn % 7 = 5 AND parent <> '' THEN 'gone-' || parent ELSE parent END AS parent) FROM msg)"


@query(LINKS.format(w=WITH))
def staged_link_quality(spark, sf_dir):
    return staging.link_quality(staged(spark, sf_dir))


@query(f"{WITH}, {ROOTS.replace('FROM msg m JOIN msg r', 'FROM m m JOIN m r').replace('roots AS', f'{BROKEN}, roots AS')} SELECT root, company FROM roots")
def staged_roots(spark, sf_dir):
    return staging.roots(staged(spark, sf_dir))


@query(f"""{WITH}, {BROKEN} SELECT m.id, m.parent <> '' AND p.id IS NULL AS missing_parent, m.response <> '' AND r.id IS NULL AS missing_response, coalesce(m.parent <> '' AND p.response <> m.id, false) AS one_sided
FROM m LEFT JOIN m p ON p.id = m.parent AND m.parent <> '' LEFT JOIN m r ON r.id = m.response AND m.response <> ''""")
def staged_link_status(spark, sf_dir):
    return staging.link_status(staged(spark, sf_dir))


@query(f"{WITH}, {BROKEN} SELECT s.author_id, count(DISTINCT c.id) AS linked FROM m s JOIN m c ON c.role = 'customer' AND ((c.response = s.id AND c.response <> '') OR (s.parent = c.id AND s.parent <> '')) WHERE s.role = 'support' GROUP BY 1")
def staged_links_of_accounts(spark, sf_dir):
    return staging.linked_to(staged(spark, sf_dir))


# ---- stores and lines

@query("""WITH a AS (SELECT o_orderkey AS k, o_orderstatus AS status FROM orders), b AS (SELECT k, CASE WHEN k % 5 = 0 THEN 'X' ELSE status END AS status FROM a),
c AS (SELECT k, CASE WHEN k % 3 = 0 THEN 'Y' ELSE status END AS status FROM b UNION ALL SELECT -1 - k, 'new' FROM a WHERE k % 7 = 0)
SELECT k, status, 'second' AS version FROM b UNION ALL SELECT k, status, 'latest' FROM c""")
def versioned_store(spark, sf_dir):
    """Orders under two rounds of upserts and a compaction: the second version, as a reader that opened it still sees it, and the latest."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("long").alias("k"), F.col("o_orderstatus").alias("status"))
    store = Store(spark, shared_folder(spark, "store"), "k", o.schema)
    store.upsert(o)
    second = store.upsert(o.filter("k % 5 = 0").withColumn("status", F.lit("X")))
    store.upsert(o.filter("k % 3 = 0").withColumn("status", F.lit("Y")).unionByName(o.filter("k % 7 = 0").select((-1 - F.col("k")).alias("k"), F.lit("new").alias("status"))))
    store.compact()
    return store.read(second).withColumn("version", F.lit("second")).unionByName(store.read().withColumn("version", F.lit("latest")))


@query(r"""WITH l AS (SELECT conv_id % 4 AS part, conv_id, turn, row_number() OVER (PARTITION BY conv_id % 4 ORDER BY conv_id, turn) AS line FROM conversations)
SELECT part, line, CASE WHEN (conv_id + turn) % 11 = 4 THEN 'not JSON' ELSE 'missing conv_id' END AS error FROM l WHERE (conv_id + turn) % 11 IN (4, 7)""")
def broken_lines(spark, sf_dir):
    """Chats as JSON lines in four files; of each eleven lines one is cut off, one lacks its id and one is blank. Errors come with the line's number."""
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    kind, whole = (F.col("conv_id") + F.col("turn")) % 11, F.to_json(F.struct("conv_id", "turn", "role", "text"))
    line = F.when(kind == 4, F.substring(whole, 1, 10)).when(kind == 7, F.to_json(F.struct("turn", "role", "text"))).when(kind == 9, "").otherwise(whole)
    path = shared_folder(spark, "lines")
    dealt = c.select((F.col("conv_id") % 4).alias("part"), "conv_id", "turn", line.alias("value")).repartition(4, "part").sortWithinPartitions("part", "conv_id", "turn")
    dealt.select("part", "value").write.partitionBy("part").text(path)
    bad = src.bad_lines(spark, path, "conv_id long, turn long, role string, text string", "conv_id")
    return bad.select(F.regexp_extract("file", r"part=(\d+)", 1).cast("long").alias("part"), "line", "error")


# ---- evidence and splits

@query(f"""{WITH}, {RUNNING}, st AS ({_state_sql('run')} WHERE role = 'customer'), {LEDGER},
seen AS (SELECT led.*, (SELECT max(c.pos) FROM cm c WHERE c.conversation_id = led.conversation_id AND c.role = 'customer' AND c.pos < led.pos) AS seen FROM led)
SELECT seen.conversation_id, seen.item, st.state, seen.action, seen.result FROM seen JOIN st ON st.conversation_id = seen.conversation_id AND st.pos = seen.seen""")
def observed_states(spark, sf_dir):
    """Each attempted action with the state at the last customer message before it."""
    return transitions.observations(chat_cases(spark, sf_dir), ACTS, LEX_STATE, results=ENDS, own=r"\bis (in|to)\b")


@query(f"""WITH {EVENTS}, o AS (SELECT state, action, conversation_id, min(item) AS item FROM ev WHERE state IS NOT NULL GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY state, action ORDER BY conversation_id, item) AS n FROM o)
SELECT state, action, count(*) AS conversations, string_agg(conversation_id, ',' ORDER BY n) FILTER (n <= 25) AS first_seen FROM r GROUP BY 1, 2""")
def first_seen_conversations(spark, sf_dir):
    """The first conversations that show each state and action, in order, and how many do."""
    t = transitions.aggregate(event_ledger(spark, sf_dir).filter("state is not null"), most=25)
    return t.select("state", "action", "conversations", F.array_join("conversation_ids", ",").alias("first_seen"))


@query()
def shuffled_split(spark, sf_dir):
    """Whole duplicate families in the order of a seeded shuffle: the generator has no SQL, the tests compare with a plain list."""
    return duplicates.shuffled_split(duplicates.components(signed(spark, sf_dir), "doc_id", "norm"), "doc_id", 20240917)


# ---- constraints and providers

def broken_cases(spark, sf_dir):
    """Documents as case records, each seventh sound and all others with one rule broken, in turn."""
    c, n = F.col("doc_id"), len(constraints.case_rules())
    odd = lambda k: (c % 7 != 0) & (c % n == k)
    pick = lambda k, bad, good, kind="string": F.when(odd(k), F.lit(bad)).otherwise(F.lit(good)).cast(kind)
    missing = F.struct(pick(10, "NOTHING", V.REQUIREMENTS[0]).alias("requirement"), pick(11, None, "missing").alias("status"), pick(12, "maybe", "yes").alias("safely_requestable"), F.array(F.lit(V.ACTIONS[0]), pick(13, "DANCE", V.ACTIONS[1])).alias("candidate_actions"))
    attempted = F.struct(pick(14, "", V.ACTIONS[4]).alias("action"), pick(15, "loud", "explicit").alias("explicitness"), pick(16, "broken", "failed").alias("result"), pick(17, 0, 1, "int").alias("order"))
    hit = F.struct(pick(18, 0, 1, "int").alias("rank"), F.lit("other").alias("conversation_id"), pick(19, "huge", "weak").alias("evidence_strength"), pick(20, "golden", "development").alias("split"))
    ledger_ = F.array(pick(9, "DANCE", V.ACTIONS[2]))
    return table(spark, sf_dir, "documents").select(
        c.cast("string").alias("conversation_id"), pick(0, "support", "customer").alias("current_role"), pick(1, "Weather", V.INTENTS[0]).alias("intent"), pick(2, "LOST", V.STATES[0]).alias("state"), pick(3, "DANCE", None).alias("selected"),
        pick(4, None, "strong").alias("evidence_strength"), pick(5, "huge", "low").alias("risk"), pick(6, "MAYBE", "ESCALATE").alias("decision"), pick(7, 1.5, 0.5, "double").alias("intent_confidence"), pick(8, -0.1, None, "double").alias("state_confidence"),
        ledger_.alias("failed_actions"), F.array().cast("array<string>").alias("successful_actions"), F.array(missing).alias("missing"), F.array(attempted).alias("attempted"), F.array(hit).alias("hits"),
    )


RULE_NAMES = ("current message not by the customer", "intent", "state", "selected action", "evidence strength", "escalation risk", "automation decision", "intent confidence", "state confidence", "ledger entry", "missing requirement", "requirement status", "safely requestable", "candidate action", "attempted action", "explicitness", "action result", "action order under 1", "hit without rank or id", "hit''s evidence strength", "golden hit")


@query(f"SELECT CAST(doc_id AS VARCHAR) AS conversation_id, [{', '.join(f"'{n}'" for n in RULE_NAMES)}][doc_id % {len(RULE_NAMES)} + 1] AS rule FROM documents WHERE doc_id % 7 <> 0")
def case_violations(spark, sf_dir):
    return constraints.violations(broken_cases(spark, sf_dir), constraints.case_rules())


@query(f"""{WITHR}, per AS (SELECT root, count(*) AS n, count(*) FILTER (role = 'customer') AS c, count(*) FILTER (role = 'support') AS s FROM chain JOIN msg USING (id) GROUP BY root)
SELECT unnest(['rows', 'read_back', 'complete_journeys', 'partial_journeys', 'uncertain_journeys', 'message_count', 'customer_turn_count', 'support_turn_count', 'multi_turn_journeys', 'conversation without messages', 'message role']) AS name,
unnest([count(*), count(*), count(*), 0, 0, sum(n), sum(c), sum(s), count(*) FILTER (c >= 2 AND s >= 2), 0, 0])::BIGINT AS count FROM per""")
def journey_statistics(spark, sf_dir):
    """What was counted while the assembled journeys were written, as one row for each count."""
    m = chat(spark, sf_dir)
    chain = threads.threads_by_doubling(m, threads.roots(m))
    j = threads.assemble(chain, m, order="turn").withColumn("reconstruction_status", F.lit("complete"))
    rules = {k: v for k, v in constraints.message_rules().items() if k in ("conversation without messages", "message role")}
    counts = constraints.write_observed(j, shared_folder(spark, "journeys"), rules, constraints.journey_statistics(j))
    return spark.createDataFrame(list(counts.items()), "name string, count long")


@query("""SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'OK' WHEN 1 THEN 'ERROR' WHEN 2 THEN 'INVALID' ELSE 'OK' END AS status, CASE WHEN doc_id % 4 = 3 THEN 2 ELSE 1 END AS attempts,
CASE doc_id % 4 WHEN 0 THEN 'MEASURED' WHEN 1 THEN 'ERROR' WHEN 2 THEN 'INVALID' ELSE 'MEASURED' END AS judge_status FROM documents""")
def provider_answers(spark, sf_dir):
    """A stand-in provider that answers, fails, fails once, or gives no object; its answers are kept and then judged. The second run asks only what failed."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.col("doc_id").cast("string").alias("prompt"))
    store = provider.answer_store(spark, shared_folder(spark, "answers"))
    provider.ask(d, "prompt", stand_in(), store, limits=provider.Limits(pause=0.0))
    out = provider.ask(d, "prompt", stand_in(), store, limits=provider.Limits(pause=0.0))
    return evaluation.judged(out).select("doc_id", "status", "attempts", "judge_status")


def stand_in():
    """A function of batches that needs no network."""
    good, failed = {"scores": dict.fromkeys(V.JUDGE_DIMENSIONS, 4), "rationale": "fine"}, set()

    def one(p: str):
        if int(p) % 4 == 1:
            return RuntimeError("always")
        if int(p) % 4 == 2:
            return "no object"
        if int(p) % 4 == 3 and p not in failed:
            failed.add(p)
            return provider.Passing("once")
        return good

    return lambda prompts: [one(p) for p in prompts]


@query("SELECT 'a' || doc_id AS annotation_id, error FROM labels, (VALUES ('duplicate annotation_id'), ('missing or duplicate journey_id')) e(error) WHERE doc_id % 5 = 0 UNION ALL SELECT 'a' || doc_id, error FROM labels, (VALUES ('duplicate annotation_id'), ('missing or duplicate journey_id')) e(error) WHERE doc_id % 5 = 0 UNION ALL SELECT 'a' || doc_id, 'intent is missing or outside the frozen vocabulary' FROM labels WHERE doc_id % 11 = 0 UNION ALL SELECT 'a' || doc_id, 'intent is missing or outside the frozen vocabulary' FROM labels WHERE doc_id % 11 = 0 AND doc_id % 5 = 0")
def repeated_annotations(spark, sf_dir):
    """One record of five stands twice, and so does every candidate: an error is told once for each record."""
    labels = table(spark, sf_dir, "labels")
    twice = labels.unionByName(labels.filter("doc_id % 5 = 0"))
    sound = {"intent_status": V.LABEL_STATUSES[0], "state_status": V.LABEL_STATUSES[0], "observed_next_action": "UNKNOWN", "outcome": V.OUTCOMES[0], "escalation_eligible": V.ELIGIBILITY[0], "evidence_visibility": V.VISIBILITY[0], "confidence": V.CONFIDENCE[0], "annotator_id": "x"}
    none = "array<struct<requirement:string,status:string,action:string,explicitness:string,result:string>>"
    a = twice.select(
        F.concat(F.lit("a"), "doc_id").alias("annotation_id"), F.col("doc_id").cast("string").alias("journey_id"), F.col("doc_id").cast("string").alias("root_tweet_id"), F.when(F.col("doc_id") % 11 == 0, "Weather").otherwise(V.INTENTS[0]).alias("intent"), F.lit(V.STATES[0]).alias("current_state"), F.lit(V.ACTIONS[0]).alias("ideal_next_action"),
        *(F.lit(v).alias(n) for n, v in sound.items()), F.array().cast(none).alias("missing_information"), F.array().cast(none).alias("attempted_actions"),
    )
    c = labels.select(F.col("doc_id").cast("string").alias("journey_id"), F.col("doc_id").cast("string").alias("root_tweet_id"))
    return evaluation.annotation_errors(a, c.unionByName(c), c.limit(0)).select("annotation_id", "error")


@query("""WITH p AS (SELECT c_nationkey AS company, count(*) AS threads, 100.0::DOUBLE * count(*) FILTER (c_acctbal > 0) / count(*) AS pct FROM customer GROUP BY 1)
SELECT company, threads, CASE WHEN pct >= 90 AND threads >= t THEN 'strong' WHEN threads >= t THEN 'moderate' ELSE 'limited' END AS suitability FROM p, (SELECT avg(threads) AS t FROM p)""")
def suitability_labels(spark, sf_dir):
    """Nations as companies, customers as threads: with the mean as the threshold each label occurs."""
    c = table(spark, sf_dir, "customer")
    per = c.groupBy(F.col("c_nationkey").alias("company")).agg(F.count("*").alias("threads"), (100 * F.avg((F.col("c_acctbal") > 0).cast("int"))).alias("pct"))
    mean = per.agg(F.avg("threads")).first()[0]
    return per.select("company", "threads", profile.suitability(F.col("threads"), F.col("pct"), many=mean, often=90.0).alias("suitability"))


# ---- files, adapters and query texts

@query(r"""SELECT conv_id || '-' || turn AS tweet_id, CASE WHEN role = 'user' THEN 'customer' ELSE 'support' END AS role, regexp_replace(coalesce(text, ''), '^\s+|\s+$', '', 'g') AS text, CAST(epoch(make_timestamp(2017, 10, 23, 17, CAST(turn % 60 AS BIGINT), 0)) AS BIGINT) AS created_second,
sha256(CASE WHEN role = 'user' THEN 'customer' ELSE 'support' END || chr(31) || regexp_replace(coalesce(text, ''), '^\s+|\s+$', '', 'g')) AS text_hash FROM conversations""")
def messages_from_csv(spark, sf_dir):
    """Chats written as a message log with quoted commas and line ends, read again strictly, typed and hashed."""
    c = table(spark, sf_dir, "conversations")
    text = F.concat(F.lit(" "), F.coalesce("text", F.lit("")), F.lit("\n"))
    made = c.select(F.concat_ws("-", "conv_id", "turn").alias("tweet_id"), F.col("role").alias("author_id"), F.when(F.col("role") == "user", "True").otherwise("False").alias("inbound"), F.format_string("Mon Oct 23 17:%02d:00 +0000 2017", F.col("turn") % 60).alias("created_at"), text.alias("text"), F.lit("").alias("response_tweet_id"), F.lit("").alias("in_response_to_tweet_id"))
    path = shared_folder(spark, "log")
    made.write.option("header", True).option("quoteAll", True).option("escape", '"').option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)
    read = src.typed_messages(src.read_messages(spark, path))
    return read.select("tweet_id", "role", "text", F.unix_timestamp("created_ts").alias("created_second"), "text_hash")


@query("SELECT conv_id, turn, role, text FROM conversations")
def records_round_trip(spark, sf_dir):
    """Chats written as JSON lines with sorted keys and read again strictly."""
    c, path = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text"), shared_folder(spark, "records")
    src.write_records(c, path)
    if not src.written_as_given(c, path):
        raise ValueError("what was read isn't what was written")
    return src.read_records(spark, path, c.schema)


@query(f"{WITHR} SELECT root AS conversation_id, 'uncertain' AS reconstruction_status, CAST(row_number() OVER (PARTITION BY root ORDER BY turn) - 1 AS INT) AS pos, id AS message_id, role, text, 'journey:' || root || '/message:' || id AS source_reference FROM chain JOIN msg USING (id)")
def messages_of_journeys(spark, sf_dir):
    """Assembled journeys, nested, taken apart into canonical messages again; none has a status."""
    m = chat(spark, sf_dir)
    j = threads.assemble(threads.threads_by_doubling(m, threads.roots(m)), m.withColumn("at", F.format_string("%09d", "turn")), order="at")
    return cases.from_journeys(j.withColumnRenamed("root", "journey_id"), message_id="id")


@query(f"""{WITH}, per AS (SELECT conversation_id, string_agg(text, ' ' ORDER BY pos) FILTER (text <> '') AS texts, max_by(text, pos) AS last FROM cm GROUP BY 1)
SELECT conversation_id, concat_ws(' ', 'customer: ' || last, texts, 'intent: I-' || conversation_id, 'state: S', 'environment: app=' || conversation_id, 'environment: os=x', 'failed action: A', 'failed action: B') AS text FROM per""")
def query_texts(spark, sf_dir):
    """The text that a case is searched with: its last message, all its messages, labels, environment in key order and failed actions."""
    per = chat_cases(spark, sf_dir).groupBy("conversation_id").agg(F.array_sort(F.collect_list(F.struct("pos", "text"))).alias("m"))
    texts = F.transform("m", lambda m: m.text)
    environment = F.create_map(F.lit("os"), F.lit("x"), F.lit("app"), F.col("conversation_id"))
    text = retrieval.query_text(F.element_at(texts, -1), texts, F.concat(F.lit("I-"), "conversation_id"), F.lit("S"), environment, F.array(F.lit("A"), F.lit("B")))
    return per.select("conversation_id", text.alias("text"))


@query(f"WITH {COS}, x AS (SELECT s.*, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS n FROM s WHERE NOT doc_id BETWEEN query_id * 5 AND query_id * 5 + 40) SELECT query_id, doc_id, n AS rank FROM x WHERE n <= 3")
def search_with_exclusions(spark, sf_dir):
    """For each query some documents must not be returned."""
    b = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    barred = b.select("query_id", F.explode(F.sequence(F.col("query_id") * 5, F.col("query_id") * 5 + 40)).alias("doc_id"))
    return retrieval.search(b, d, 3, key="doc_id", pattern="[a-z]+", exclude=barred).select("query_id", "doc_id", F.col("rank").cast("long").alias("rank"))


@query(f"""{WITH}, {RUNNING}, st AS ({_state_sql('run')} WHERE role = 'customer'), {LEDGER},
seen AS (SELECT led.*, (SELECT max(c.pos) FROM cm c WHERE c.conversation_id = led.conversation_id AND c.role = 'customer' AND c.pos < led.pos) AS seen FROM led),
ob AS (SELECT seen.conversation_id, seen.item, st.state, seen.action, seen.result FROM seen JOIN st ON st.conversation_id = seen.conversation_id AND st.pos = seen.seen),
h AS (SELECT DISTINCT CAST(conversation_id AS BIGINT) - k AS query_id, conversation_id, k AS rank FROM cm, range(1, 4) r(k)),
f AS (SELECT query_id, state, action, conversation_id, min((rank, item)) AS first, count(*) AS n, count(*) FILTER (result IN ('improved', 'resolved')) AS good, count(*) FILTER (result = 'failed') AS bad FROM h JOIN ob USING (conversation_id) GROUP BY ALL)
SELECT query_id, state, action, CAST(sum(n) AS BIGINT) AS support_count, CAST(sum(good) AS BIGINT) AS successful_count, CAST(sum(bad) AS BIGINT) AS failed_count, string_agg(conversation_id, ',' ORDER BY first) AS conversation_ids,
CASE WHEN sum(n) >= 3 AND NOT (sum(good) > 0 AND sum(bad) > 0) THEN 'strong' WHEN sum(n) >= 2 THEN 'moderate' ELSE 'weak' END AS evidence_strength FROM f GROUP BY 1, 2, 3""")
def evidence_of_hits(spark, sf_dir):
    """Each conversation as a hit of the three queries numbered before it."""
    m = chat_cases(spark, sf_dir)
    ids = m.select("conversation_id").distinct()
    hits = ids.select((F.col("conversation_id").cast("long")).alias("c"), "conversation_id", F.explode(F.array(*map(F.lit, (1, 2, 3)))).alias("rank")).select((F.col("c") - F.col("rank")).alias("query_id"), "conversation_id", "rank")
    e = transitions.for_hits(hits, m, None, ACTS, LEX_STATE, results=ENDS, own=r"\bis (in|to)\b")
    return e.select("query_id", "state", "action", "support_count", "successful_count", "failed_count", F.array_join("conversation_ids", ",").alias("conversation_ids"), "evidence_strength")


MARKED = {"failure_marker": "from", "dm_handoff_marker": "of", "resolution_marker": "this", "diagnostic_context_marker": "to", "question_marker": "with"}


@query(f"""{WITHR}, j AS (SELECT root, count(*) AS n, {', '.join(f"bool_or({word(w)}) AS {d}" for d, w in MARKED.items())} FROM chain JOIN msg USING (id) GROUP BY root),
d AS (SELECT *, CASE WHEN n <= 2 THEN 'single_turn' WHEN n <= 4 THEN 'short_multi_turn' WHEN n <= 8 THEN 'medium_multi_turn' ELSE 'long_multi_turn' END AS length_bucket, 'complete' AS reconstruction_status FROM j)
{' UNION ALL '.join(f"SELECT '{d}' AS dimension, CAST({d} AS VARCHAR) AS value, count(*) AS count FROM d GROUP BY 2" for d in sampling.OBSERVABLE)}""")
def observable_strata(spark, sf_dir):
    """Counts over all seven observable dimensions of assembled journeys, with marker words that occur in the chats."""
    m = chat(spark, sf_dir)
    flags = m.select("*", *(tx.has(F.col("text"), rf"\b{w}\b").alias(f"{d}_flag") for d, w in MARKED.items()))
    j = threads.assemble(threads.threads_by_doubling(m, threads.roots(m)), flags, order="turn", marker_columns=tuple(f"{d}_flag" for d in MARKED))
    return sampling.stratum_counts(sampling.observable_dimensions(j.withColumn("reconstruction_status", F.lit("complete"))), sampling.OBSERVABLE)


@query(f"""{SPLIT}, sides AS (SELECT doc_id, CASE WHEN taken THEN 'reserved' ELSE 'development' END AS split FROM g JOIN c USING (grp)),
r AS (SELECT count(*) AS n FROM sides WHERE split = 'reserved' AND doc_id % 40 = 3)
SELECT unnest(['id on both sides', 'group on both sides', 'id left out', 'id added', 'another side when run again', 'rows of development that differ from the source', 'source digest of development', 'rows of reserved that differ from the source', 'source digest of reserved']) AS check, unnest([0, 0, 0, 0, 0, 0, 0, 2 * n, CASE WHEN n > 0 THEN 1 ELSE 0 END])::BIGINT AS violations FROM r""")
def written_split_checks(spark, sf_dir):
    """A split that is written and read back, decided twice, with some reserved rows changed on the way."""
    source = table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars")
    split, again = group_split(spark, sf_dir), group_split(spark, sf_dir)
    parts = {}
    for name in ("development", "reserved"):
        rows = source.join(split.filter(F.col("split") == name).select("doc_id"), "doc_id", "left_semi")
        if name == "reserved":
            rows = rows.withColumn("n_chars", F.when(F.col("doc_id") % 40 == 3, -1).otherwise(F.col("n_chars")))
        path = shared_folder(spark, name)
        src.write_records(rows, path)
        parts[name] = src.read_records(spark, path, source.schema)
    return duplicates.split_checks(parts, source, split, again, "doc_id")

"""The operators applied to the test tables, one thin query each, with SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from threadloom.llm import align, bpe, chat, decontaminate, jaccard, langid, licenses, mixing, pii, quality, runs, tokens
from threadloom.llm.common import let, words_of


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_chat_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.render_conversations(table(spark, sf_dir, "conversations"))


def op2_context_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.score_documents(table(spark, sf_dir, "documents"))


def op3_license_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")


def op4_feistel_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pseudonymize(table(spark, sf_dir, "documents"), pii.session_key(spark)).select("doc_id", "text", "n_pii", "pii_kinds")


def op5_prefix_tree_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.similarity_classes(table(spark, sf_dir, "documents"), k=4, num=85, den=100)


def op6_orc_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.orc_round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op7_word_backoff_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def op8_qgram_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_power_of_two_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.packed_buckets(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op10_weak_supervision(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = lambda c: F.col(f"f.{c}").alias(c)
    judged = quality.judge(table(spark, sf_dir, "documents"), keep=["doc_id"])
    return judged.select("row.doc_id", f("n_words"), f("word_chars"), f("n_symbols"), f("n_dup_lines"), f("n_repeat_words"), "base_failed", "kept", "quality_probability")


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    paths = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
    return align.aligned_documents(table(spark, sf_dir, "documents"), *paths, digest=True).withColumnRenamed("groups", "groups_sha256")


def planted(docs: DataFrame) -> DataFrame:
    """(doc_id, text): where h = crc32 of the id is a multiple of ten, the words from g % n on repeat with a period that g = h div 10 gives. A null id plants nothing."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g = F.floor(h / 10)

    def repeat(words: Column) -> Column:
        n = F.size(words)
        a = (g % n).cast("int")
        p = (1 + F.floor((n - a) / (3 + g % 8))).cast("int")
        return let(F.struct(words.alias("w"), a.alias("a"), p.alias("p")), lambda x: F.array_join(F.transform(x["w"], lambda w, i: F.when(i < x["a"], w).otherwise(F.get(x["w"], x["a"] + (i - x["a"]) % x["p"]))), " "))

    text = F.when(h % 10 == 0, let(words_of(F.col("text")), lambda w: F.when(F.size(w) > 0, repeat(w)))).otherwise(F.col("text"))
    return docs.select("doc_id", text.alias("text"))


def op12_tandem_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.digests(runs.find_runs(planted(table(spark, sf_dir, "documents"))))


def op13_prefix_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return bpe.digests(bpe.encoded_documents(table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    held = (op1_chat_snapshots, op2_context_mixing, op3_license_rules, op4_feistel_pseudonyms, op5_prefix_tree_join, op6_orc_token_ids, op7_word_backoff_language, op8_qgram_decontamination, op9_power_of_two_packing, op10_weak_supervision, op11_token_alignment, op12_tandem_runs, op13_prefix_bpe)
    return {f.__name__: f for f in held} | {"pipeline": corpus_pipeline.run}


OP1_SQL = r"""
WITH t AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role) AS i
  FROM conversations WHERE conv_id IS NOT NULL),
c AS (
  SELECT conv_id, count(*) AS n, list(role || chr(31) || text ORDER BY i) AS l,
         string_agg('<|im_start|>' || replace(role, '<|', '< |') || chr(10) || replace(text, '<|', '< |') || '<|im_end|>' || chr(10), '' ORDER BY i) AS rendered
  FROM t GROUP BY conv_id),
p AS (SELECT DISTINCT list_slice(l, 1, k) AS l FROM (SELECT l, unnest(range(1, n)) AS k FROM c)),
u AS (SELECT l, min(conv_id) AS conv_id, count(*) AS copies FROM c GROUP BY l)
SELECT c.conv_id, CAST(1 AS BIGINT) AS segment, CAST(0 AS BIGINT) AS first_turn, CAST(c.n AS BIGINT) AS n_turns,
       CAST(c.n AS BIGINT) AS conv_turns, CAST(u.copies AS BIGINT) AS copies, c.rendered
FROM c JOIN u ON u.conv_id = c.conv_id
WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.l = c.l)
"""

OP5_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS l FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(l) = 0 THEN [] WHEN len(l) < 4 THEN [array_to_string(l, ' ')]
         ELSE list_transform(range(1, len(l) - 2), lambda i: array_to_string(l[i:i + 3], ' ')) END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
x AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM x JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * k >= 85 * (p.n + q.n - k)),
r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, e.b FROM r JOIN e ON e.a = r.b)
SELECT r.a AS doc_id, CAST(coalesce(max(n.n), 0) AS BIGINT) AS n_shingles, min(r.b) AS component_id
FROM r LEFT JOIN n ON n.doc_id = r.a GROUP BY r.a
"""


def op3_sql() -> str:
    """The rules as a table of values; a window's end stands for the look-ahead, which DuckDB's expressions lack."""
    text = lambda x: "'" + x.replace("'", "''") + "'"
    held = licenses.rules()
    values = ", ".join(f"({text(r.head)}, {text(r.pattern.replace('^', '^(', 1).replace('(?= |$)', ')( |$)'))}, {text(r.label)}, {r.level})" for r in held)
    heads = "[" + ", ".join(text(h) for h in sorted({r.head for r in held})) + "]"
    base = " UNION ALL ".join(f"SELECT rid, i - 1 AS start, {text(v)} AS label FROM p WHERE list_slice(l, i, i + {len(k.split()) - 1}) = {[*k.split()]}" for k, v in licenses.BASE.items())
    return rf"""
WITH rules(head, pattern, label, level) AS (VALUES {values}),
w AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS l FROM documents),
p AS (SELECT rid, l, unnest(range(1, len(l) + 1)) AS i FROM w),
b AS ({base}),
h AS (SELECT rid, i - 1 AS start, i - 1 + len(string_split(regexp_extract(win, pattern, 1), ' ')) AS stop, level, label
      FROM (SELECT rid, i, l[i] AS head, array_to_string(list_slice(l, i, i + {licenses.WINDOW - 1}), ' ') AS win FROM p WHERE list_contains({heads}, l[i])) JOIN rules USING (head) WHERE regexp_matches(win, pattern)),
o AS (SELECT *, row_number() OVER (PARTITION BY rid ORDER BY start, stop DESC, level DESC, label) AS k FROM h),
d AS (SELECT * FROM o x WHERE NOT EXISTS (SELECT 1 FROM o y WHERE y.rid = x.rid AND y.k < x.k AND y.level >= x.level AND y.stop >= x.stop)),
bs AS (SELECT rid, count(*) AS n, min(start) AS lo, max(start) AS hi, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM b GROUP BY 1),
ls AS (SELECT rid, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(level) AS level FROM (SELECT rid, label, level FROM d UNION ALL SELECT rid, label, 1 FROM b) GROUP BY 1)
SELECT doc_id, CAST(len(l) AS BIGINT) AS n_words, CAST(coalesce(bs.n, 0) AS BIGINT) AS n_base, CAST(bs.lo AS BIGINT) AS first_word, CAST(bs.hi AS BIGINT) AS last_word,
       coalesce(bs.labels, '') AS base_labels, coalesce(ls.labels, '') AS labels, coalesce(ls.level, 0) / 3.0::DOUBLE AS score
FROM w LEFT JOIN bs USING (rid) LEFT JOIN ls USING (rid)"""


def oracle_sql() -> dict[str, str]:
    """Tokenizers, fitted models, keyed permutations and edit distances have no SQL; their tests compare with brute force."""
    held = {"op1_chat_snapshots": OP1_SQL, "op3_license_rules": op3_sql(), "op5_prefix_tree_join": OP5_SQL}
    return held | ({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})

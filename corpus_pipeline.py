"""A training-data pipeline over ``documents``: quality, near duplicates, benchmark passages, private data, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and
read again as the next stage's ``docs``. All but the last return the columns of ``documents``.

Defined results, by stage: quality rules drop null, empty and short texts; near duplicates keep
the row with the smallest id of each class, of rows that repeat an id the one whose columns come
first in order, and every row without an id; decontamination, pseudonyms and packing judge each
row by itself, so ties, repeated rows and null ids need nothing. An empty table passes through all
stages as one. Extra columns are carried as they are, whatever their names, up to packing.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.llm import decontaminate, jaccard, pii, quality, tokens
from threadloom.llm.common import materialize, quoted, unused


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that weak supervision accepts."""
    return quality.accepted(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class at a similarity of 0.8 on five-word shingles."""
    return jaccard.keep_one(docs, k=5, num=80, den=100)


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of ``benchmark``."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def private_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with pseudonyms in place of private values; n_chars follows the text."""
    names = {k: unused(docs, v) for k, v in (("kinds", "pii_kinds"), ("count", "n_pii"))}  # the table's own columns of these names stay
    out = pii.pseudonymize(docs, pii.session_key(spark), **names).select(*map(quoted, docs.columns))
    return out.withColumn("n_chars", F.length("text").cast(out.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Power-of-two pieces of token ids, each a sequence."""
    return tokens.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("quality rules", quality_rules), ("near duplicates", near_duplicates), ("benchmark decontamination", benchmark_passages), ("private data", private_data), ("packing", packing)]

#: Fitted rule accuracies, banded alignment, keyed permutations and tokenizers have no SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs

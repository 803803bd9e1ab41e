"""Profiles of a message table: roles, missing values, accounts, companies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def role_profile(messages: DataFrame) -> DataFrame:
    """Messages and distinct authors by role."""
    return messages.groupBy("role").agg(F.count("*").alias("messages"), F.countDistinct("author_id").alias("authors"))


def missing_by_column(df: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """(field, missing): blank or null values of each column, from one pass."""
    one = df.agg(*(F.count_if(F.trim(F.coalesce(F.col(c).cast("string"), F.lit(""))) == "").alias(c) for c in columns))
    return one.unpivot([], list(columns), "field", "missing")


def time_range(df: DataFrame, at: str) -> DataFrame:
    """One row: rows, rows without a time, first and last time."""
    return df.agg(F.count("*").alias("row_count"), F.count_if(F.col(at).isNull()).alias("without_time"), F.min(at).alias("first"), F.max(at).alias("last"))


def outbound_volume(messages: DataFrame) -> DataFrame:
    return messages.filter("role = 'support'").groupBy("author_id").agg(F.count("*").alias("outbound"))


def suitability(threads: Column, multi: Column, many: float = 1000, often: float = 20) -> Column:
    """Label of a company by its thread count and share (in per cent) of multi-turn threads."""
    return F.when((multi >= often) & (threads >= many), "strong").when(threads >= many, "moderate").otherwise("limited")


def company_stats(threads: DataFrame, volume: DataFrame, linked: DataFrame) -> DataFrame:
    """Per company: threads, messages, average length, share of multi-turn threads; outbound volume and linked messages (0 if none)."""
    per = threads.groupBy("company").agg(F.count("*").alias("threads"), F.sum("messages").alias("messages"), F.avg("messages").alias("avg_messages"), (100 * F.avg(F.col("multi_turn").cast("int"))).alias("multi_turn_pct"))
    out = per.join(volume, per["company"] == volume["author_id"], "left").drop("author_id").join(linked, per["company"] == linked["author_id"], "left").drop("author_id")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return out.select("company", "threads", "messages", "avg_messages", "multi_turn_pct", zero("outbound"), zero("linked"), suitability(F.col("threads"), F.col("multi_turn_pct")).alias("suitability"))


def top(df: DataFrame, n: int, *order: Column) -> DataFrame:
    """A top-n report."""
    return df.orderBy(*order).limit(n)

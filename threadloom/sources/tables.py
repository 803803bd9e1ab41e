"""Scans and sinks: delimited message logs, JSON-line records, manifests, and adapters of Parquet tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from threadloom.functions.text import message_digest, parsed_time, stripped

RAW_FIELDS = ("tweet_id", "author_id", "inbound", "created_at", "text", "response_tweet_id", "in_response_to_tweet_id")
RAW_SCHEMA = T.StructType([T.StructField(n, T.StringType()) for n in RAW_FIELDS])


def read_messages(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    """Raw messages of a CSV with quoted line breaks; a byte-order mark is skipped and bad bytes are replaced.

    ``strict`` fails on another header or malformed rows; otherwise they are kept as far as they parse.
    """
    options = {"header": True, "multiLine": True, "quote": '"', "escape": '"', "enforceSchema": not strict, "mode": "FAILFAST" if strict else "PERMISSIVE"}
    raw = spark.read.schema(RAW_SCHEMA).options(**options).csv(path)
    return raw.select(*(stripped(F.col(c)).alias(c) for c in RAW_FIELDS))


def typed_messages(raw: DataFrame, strict: bool = True) -> DataFrame:
    """Role, parsed time and text hash of each raw message; '' stands for an absent id.

    ``strict`` fails where ``inbound`` is neither true nor false; otherwise that counts as false.
    """
    said = F.lower("inbound")
    other = F.raise_error(F.concat(F.lit("inbound is neither true nor false: "), F.coalesce("inbound", F.lit("null")))).cast("boolean") if strict else F.lit(False)
    inbound = F.when(said == "true", True).when(said == "false", False).otherwise(other)
    held = raw.withColumn("inbound", inbound).withColumn("role", F.when(F.col("inbound"), "customer").otherwise("support"))
    return held.withColumn("created_ts", parsed_time(F.col("created_at"))).withColumn("text_hash", message_digest(F.col("role"), F.col("text")))


def last_per_key(df: DataFrame, key: str, order: str) -> DataFrame:
    """The row with the greatest ``order`` for each key: an upsert's result."""
    row = F.struct(*(F.col(f"`{c}`") for c in df.columns))
    return df.groupBy(F.col(f"`{key}`").alias("_k")).agg(F.max_by(row, F.col(f"`{order}`")).alias("_row")).select("_row.*")


def upsert(store: DataFrame, fresh: DataFrame, key: str, order: str | None = None) -> DataFrame:
    """``store`` with the rows of ``fresh`` in place of those with the same key.

    With ``order`` the last row of each key in ``fresh`` wins, and the column is left out of the result.
    """
    if order is not None:
        fresh = last_per_key(fresh, key, order).drop(order)
    return store.join(fresh.select(key), key, "left_anti").unionByName(fresh, allowMissingColumns=True)


def replace_records(df: DataFrame, path: str) -> None:
    """Write JSON lines beside ``path`` and move them there in one rename, so that a reader sees the old rows or the new ones.

    Between the removal of the old folder and the rename a reader may see none; a failed write leaves the old rows.
    """
    fresh = f"{path.rstrip('/')}.{uuid.uuid4().hex}"
    write_records(df, fresh)
    spark = df.sparkSession
    place = spark._jvm.org.apache.hadoop.fs.Path
    store = place(path).getFileSystem(spark._jsc.hadoopConfiguration())
    store.delete(place(path), True)
    if not store.rename(place(fresh), place(path)):
        raise OSError(f"{fresh} could not be moved to {path}")


def lookup(df: DataFrame, key: str, value=None) -> DataFrame:
    """The record with this id, or without one the first by id; fails where there is none."""
    held = df.filter(F.col(key) == value) if value is not None else df.orderBy(key)
    held = held.limit(1)
    if held.isEmpty():
        raise KeyError(f"no record with {key} {value}")
    return held


def read_records(spark: SparkSession, path: str, schema: T.StructType | str | None = None, strict: bool = True) -> DataFrame:
    """JSON lines; blank lines are skipped. ``strict`` fails on malformed ones."""
    reader = spark.read.option("mode", "FAILFAST" if strict else "PERMISSIVE")
    return (reader.schema(schema) if schema is not None else reader).json(path)


def raw_lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).filter(F.trim("value") != "")


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line, value) of every line, blank ones too, numbered from 1 in its file.

    Numbers are made in two levels: a line's place within its split of the file, from the rows'
    order in the task that reads it, and the lines of the file's splits before, a sum over one
    row for each split. No line is moved.
    """
    at = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"), "value")
    splits = at.groupBy("file", "block").agg(F.min("at").alias("first"), F.count("*").alias("lines"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    splits = splits.select("file", "block", "first", F.coalesce(F.sum("lines").over(before), F.lit(0)).alias("before"))
    return at.join(splits, ["file", "block"]).select("file", (F.col("before") + F.col("at") - F.col("first") + 1).alias("line"), "value")


def bad_lines(spark: SparkSession, path: str, schema: T.StructType | str, key: str) -> DataFrame:
    """(file, line, value, error) of lines that don't parse or lack ``key``: a report instead of a failure. Blank lines are no errors but are counted."""
    parsed = F.from_json("value", schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    held = numbered_lines(spark, path).filter(F.trim("value") != "").select("file", "line", "value", parsed.alias("r"))
    error = F.when(F.try_parse_json("value").isNull(), "not JSON").when(F.coalesce(F.col(f"r.{key}").cast("string"), F.lit("")) == "", f"missing {key}")
    return held.select("file", "line", "value", error.alias("error")).filter("error is not null")


def in_key_order(c: Column, kind: T.DataType) -> Column:
    """A value with the fields of all structs in it in sorted order, at any depth."""
    if isinstance(kind, T.StructType):
        fields = sorted(kind.fields, key=lambda f: f.name)
        return F.when(c.isNotNull(), F.struct(*(in_key_order(c[f.name], f.dataType).alias(f.name) for f in fields)))
    if isinstance(kind, T.ArrayType):
        return F.transform(c, lambda x: in_key_order(x, kind.elementType))
    if isinstance(kind, T.MapType):
        return F.map_from_entries(F.array_sort(F.map_entries(F.transform_values(c, lambda _, v: in_key_order(v, kind.valueType)))))
    return c


def write_records(df: DataFrame, path: str, single: bool = False) -> None:
    """JSON lines with keys in sorted order at every depth; ``single`` writes one file, for small results."""
    held = df.select(*(in_key_order(F.col(c), df.schema[c].dataType).alias(c) for c in sorted(df.columns)))
    (held.coalesce(1) if single else held).write.mode("overwrite").json(path)


def written_as_given(df: DataFrame, path: str) -> bool:
    """Does reading ``path`` give back exactly the rows of ``df``?"""
    back = df.sparkSession.read.schema(df.schema).json(path)
    held, read = (x.select(F.to_json(F.struct(*sorted(df.columns))).alias("j")) for x in (df, back))
    return held.exceptAll(read).isEmpty() and read.exceptAll(held).isEmpty()


def manifest(**parts: Column) -> Column:
    """One struct column of named parts, for a one-row manifest."""
    return F.struct(*(v.alias(k) for k, v in sorted(parts.items())))


def whole_digest(df: DataFrame, line: str, order: str) -> DataFrame:
    """One row: sha256 of the ordered lines joined by line ends. For results that fit in one row."""
    ordered = F.array_sort(F.collect_list(F.struct(F.col(order), F.col(line).alias("line"))))
    return df.agg(F.sha2(F.array_join(F.transform(ordered, lambda s: s.line), "\n"), 256).alias("digest"))


def with_provider(df: DataFrame, prompt: str, provider: Callable[[str], dict] | None = None) -> DataFrame:
    """``df`` with status and value (JSON text) from an external provider, called in batches; never raises.

    Without a provider every row is NOT_AVAILABLE and no Python runs.
    """
    if provider is None:
        return df.withColumn("status", F.lit("NOT_AVAILABLE")).withColumn("value", F.lit(None).cast("string"))
    import json

    @F.pandas_udf("status string, value string")
    def call(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for s in batches:
            rows = []
            for p in s:
                try:
                    rows.append(("OK", json.dumps(provider(p))))
                except Exception as error:  # noqa: BLE001  the source must not fail a job
                    rows.append(("ERROR", json.dumps({"error": str(error)})))
            yield pd.DataFrame(rows, columns=["status", "value"])

    return df.withColumn("_c", call(F.col(prompt))).select(*df.columns, "_c.status", "_c.value")


def chat_messages(conversations: DataFrame) -> DataFrame:
    """Adapter: a chat table as a reply chain. System turns are left out; each message answers the one before."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    ids = F.concat_ws("-", F.col("conv_id"), F.col("turn"))
    held = conversations.filter("role <> 'system'").select("conv_id", "turn", "role", "text", ids.alias("id"))
    return held.select(
        "id", F.col("conv_id").cast("string").alias("author_id"), F.when(F.col("role") == "user", "customer").otherwise("support").alias("role"), F.coalesce("text", F.lit("")).alias("text"),
        F.coalesce(F.lag("id").over(w), F.lit("")).alias("parent"), F.coalesce(F.lead("id").over(w), F.lit("")).alias("response"), "conv_id", "turn",
    )

"""Cutting lineage through the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def _base(spark: SparkSession) -> str:
    """The shared folder: spark.checkpoint.dir; only where that is unset (a local test) a temporary folder, which is set then."""
    context = spark.sparkContext
    if not context.getCheckpointDir():
        context.setCheckpointDir(context.getConf().get("spark.checkpoint.dir") or tempfile.mkdtemp(prefix="threadloom-"))
    return context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()


def shared_folder(spark: SparkSession, name: str) -> str:
    """A fresh place below the shared folder."""
    return f"{_base(spark).rstrip('/')}/threadloom/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """``df`` checkpointed in the shared folder."""
    _base(df.sparkSession)
    return df.checkpoint()


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read again: like ``cut``, but columns that aren't asked for are never read."""
    path = shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)

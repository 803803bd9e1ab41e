"""Small helpers shared by the training-data operators."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space, as the result contracts define it.
WS = r"[\x20\x09-\x0D]"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def shared_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder that driver and executors share.

    It lies below ``spark.checkpoint.dir``; only where that is unset (a local test) is a
    temporary folder used, and then also set as the session's checkpoint folder.
    """
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        held = spark.sparkContext.getCheckpointDir()
        base = held or tempfile.mkdtemp(prefix="threadloom-")
        if not held:
            spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/threadloom/{name}-{uuid.uuid4().hex}"


CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextlib.contextmanager
def shuffles_end(spark: SparkSession) -> Iterator[None]:
    """Queries made and run inside remove their shuffle files as soon as they end, not when the driver next collects garbage."""
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it again: cuts lineage, survives lost executors."""
    path = shared_dir(df.sparkSession, name)
    with shuffles_end(df.sparkSession):
        df.select("*").write.parquet(path)  # a query takes the setting when it is made
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


def discard(*frames: DataFrame) -> None:
    """Remove the folders of frames that come from ``materialize`` and that nothing will read again."""
    for df in frames:
        spark = df.sparkSession
        place = spark._jvm.org.apache.hadoop.fs.Path(df.written_to)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def unused(df: DataFrame, name: str) -> str:
    """``name``, or with underscores after it until no column of ``df`` is named so (Spark ignores case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def quoted(name: str) -> str:
    """``name`` as one column, whatever characters it holds."""
    return "`" + name.replace("`", "``") + "`"


def let(value: Column, body) -> Column:
    """Bind ``value`` once and use it in ``body``; else Catalyst evaluates it anew at every mention."""
    return F.element_at(F.transform(F.array(value), body), 1)


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, UPPER.lower())


def words_of(text: Column) -> Column:
    """Array of maximal runs of anything but ASCII white space; empty for null."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), f"{WS}+"), lambda w: w != "")


def split_side(doc_id: Column, folds: int) -> Column:
    """crc32 of the id's decimal text, modulo ``folds``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds

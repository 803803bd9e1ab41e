"""A versioned store: immutable folders of rows, and one small file a version that names them.

Version n exists once its file ``_versions/n.json`` does, and that file is published in one step
that fails if it is already there. So of two writers on the same version one wins and the
other starts again from the winner's rows; a reader holds on to the version that it opened and
never sees part of a write. A version lists the folders of its base and, behind it, those of
upserts in order; the last row of a key counts. ``compact`` writes one folder for them all, and
``vacuum`` removes folders that no kept version names.
"""

from __future__ import annotations

import json
import os
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


class Conflict(Exception):
    """Another writer published the version first."""


class Files:
    """The few calls on a Hadoop file system that the store needs, for the driver's small files."""

    def __init__(self, spark: SparkSession, path: str):
        self.jvm, self.conf = spark._jvm, spark._jsc.hadoopConfiguration()
        self.fs = self._path(path).getFileSystem(self.conf)
        self.local = self.fs.getUri().getScheme() == "file"

    def _path(self, path: str):
        return self.jvm.org.apache.hadoop.fs.Path(path)

    def names(self, folder: str) -> list[str]:
        place = self._path(folder)
        return sorted(s.getPath().getName() for s in self.fs.listStatus(place)) if self.fs.exists(place) else []

    def read(self, path: str) -> str:
        stream = self.fs.open(self._path(path))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def publish(self, path: str, text: str) -> bool:
        """Make ``path`` appear whole with this text; False if it is already there.

        A hidden file is written first. On a local disk a hard link then gives it its name; elsewhere
        a rename, which HDFS and file systems with its guarantees refuse where the name is taken.
        """
        parent, _, name = path.rpartition("/")
        hidden = f"{parent}/.{name}.{uuid.uuid4().hex}"
        self.fs.mkdirs(self._path(parent))
        out = self.fs.create(self._path(hidden), False)
        out.write(bytearray(text.encode()))
        out.close()
        try:
            if not self.local:
                return bool(self.fs.rename(self._path(hidden), self._path(path)))
            os.link(self._path(hidden).toUri().getPath(), self._path(path).toUri().getPath())
            return True
        except FileExistsError:
            return False
        finally:
            self.fs.delete(self._path(hidden), False)

    def delete(self, path: str) -> None:
        self.fs.delete(self._path(path), True)


@dataclass(frozen=True)
class Version:
    number: int
    folders: tuple[str, ...]


class Store:
    """Rows with a unique ``key`` below ``path``. Null keys are refused."""

    def __init__(self, spark: SparkSession, path: str, key: str, schema: T.StructType):
        self.spark, self.path, self.key, self.schema = spark, path.rstrip("/"), key, schema
        self.files = Files(spark, path)

    def versions(self) -> list[int]:
        return [int(n[:-5]) for n in self.files.names(f"{self.path}/_versions") if n.endswith(".json") and n[:-5].isdigit()]

    def latest(self) -> Version:
        held = self.versions()
        return self.at(max(held)) if held else Version(0, ())

    def at(self, number: int) -> Version:
        return Version(number, tuple(json.loads(self.files.read(f"{self.path}/_versions/{number:012d}.json"))["folders"]))

    def read(self, version: Version | None = None) -> DataFrame:
        """The rows of a version, the latest by default: it stays the same whatever is committed later."""
        version = version or self.latest()
        out = None
        for n, folder in enumerate(version.folders):
            part = self.spark.read.schema(self.schema).parquet(f"{self.path}/{folder}").withColumn("_n", F.lit(n))
            out = part if out is None else out.unionByName(part)
        if out is None:
            return self.spark.createDataFrame([], self.schema)
        if len(version.folders) == 1:
            return out.drop("_n")
        row = F.struct(*(F.col(f"`{c}`") for c in self.schema.names))
        return out.groupBy(F.col(f"`{self.key}`").alias("_k")).agg(F.max_by(row, "_n").alias("_row")).select("_row.*")

    def _write(self, rows: DataFrame) -> str:
        folder = f"rows-{uuid.uuid4().hex}"
        key = F.col(f"`{self.key}`")
        checked = F.when(key.isNull(), F.raise_error(F.lit("a row without a key"))).otherwise(key)
        held = rows.select(*(F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in self.schema))
        held.withColumn(self.key, checked.cast(self.schema[self.key].dataType)).write.parquet(f"{self.path}/{folder}")
        return folder

    def publish(self, base: Version, folders: tuple[str, ...]) -> Version:
        """The version after ``base``; raises Conflict if another writer made it."""
        number = base.number + 1
        if not self.files.publish(f"{self.path}/_versions/{number:012d}.json", json.dumps({"folders": list(folders)})):
            raise Conflict(f"version {number} was published by another writer")
        return Version(number, folders)

    def _repeated(self, rows: DataFrame) -> bool:
        return not rows.groupBy(F.col(f"`{self.key}`")).count().filter("count > 1").isEmpty()

    def upsert(self, rows: DataFrame, tries: int = 20) -> Version:
        """Rows take the place of those with the same key; the rows themselves are written once, a lost race costs one small file."""
        if self._repeated(rows):
            raise ValueError(f"a {self.key} stands twice in one upsert")
        folder = self._write(rows)
        for _ in range(tries):
            base = self.latest()
            try:
                return self.publish(base, (*base.folders, folder))
            except Conflict:
                continue
        raise Conflict(f"{tries} versions in a row were published by others")

    def update(self, change, tries: int = 20) -> Version:
        """Replace all rows by ``change(rows)``; on a lost race it is worked out anew from the winner's rows."""
        for _ in range(tries):
            base = self.latest()
            fresh = change(self.read(base))
            if self._repeated(fresh):
                raise ValueError(f"a {self.key} stands twice")
            folder = self._write(fresh)
            try:
                return self.publish(base, (folder,))
            except Conflict:
                self.files.delete(f"{self.path}/{folder}")
        raise Conflict(f"{tries} versions in a row were published by others")

    def compact(self, tries: int = 20) -> Version:
        """One folder instead of a base and upserts; upserts made meanwhile stay behind it."""
        for _ in range(tries):
            base = self.latest()
            if len(base.folders) < 2:
                return base
            folder = self._write(self.read(base))
            while True:
                now = self.latest()
                if now.folders[: len(base.folders)] != base.folders:
                    self.files.delete(f"{self.path}/{folder}")
                    break
                try:
                    return self.publish(now, (folder, *now.folders[len(base.folders) :]))
                except Conflict:
                    continue
        raise Conflict(f"{tries} versions in a row were published by others")

    def vacuum(self, keep: int = 2) -> list[str]:
        """Remove versions but the last ``keep``, and folders that none of these names. Readers and writers of removed ones must be done."""
        held = sorted(self.versions())
        kept = {f for n in held[-keep:] for f in self.at(n).folders}
        gone = [f for f in self.files.names(self.path) if f.startswith("rows-") and f not in kept]
        for n in held[:-keep]:
            self.files.delete(f"{self.path}/_versions/{n:012d}.json")
        for f in gone:
            self.files.delete(f"{self.path}/{f}")
        return gone

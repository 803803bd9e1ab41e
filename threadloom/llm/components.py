"""Connected components of an edge table, without collecting it."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadloom.llm.common import discard, materialize
from threadloom.llm.textvec import release

SALTS = 64  # parts over which the rows of one key are dealt, as many as a long has bits
EDGES = 1_000_000  # contracted at once


def salts_of(by: str) -> Column:
    """The salts of a group's rows where ``by`` is not null, as bits of one number, which is combined before rows move."""
    return F.bit_or(F.when(F.col(by).isNotNull(), F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.xxhash64(by), F.lit(SALTS)).cast("int"))))


def salt_rows(salts: str) -> Column:
    """A row for each salt of ``salts_of``."""
    return F.explode(F.filter(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long")), lambda i: F.getbit(salts, i.cast("int")) == 1))


def with_least(rows: DataFrame, key: str, value: str, by: str) -> DataFrame:
    """``rows`` with the column least: the least ``value`` among the rows of the same ``key``.

    A key's rows are dealt over ``SALTS`` parts by a hash of ``by``. The least is a plain aggregate
    (so a hub's rows are combined before they move) and is joined back by part; no group is ever gathered.
    """
    least = rows.groupBy(key).agg(F.min(value).alias("least"), salts_of(by).alias("salts")).select(key, "least", salt_rows("salts").alias("salt"))
    return rows.withColumn("salt", F.pmod(F.xxhash64(by), F.lit(SALTS))).join(least, [key, "salt"]).drop("salt")


def contracted(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each node of the edges that is not the least of its component, and that least node."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    root = np.arange(len(nodes))
    while len(a):
        x, y = root[a], root[b]
        open_ = x != y
        a, b, x, y = a[open_], b[open_], x[open_], y[open_]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while not np.array_equal(up := root[root], root):
            root = up
    lower = np.flatnonzero(root != np.arange(len(nodes)))
    return nodes[lower], nodes[root[lower]]


def _stars(edges: DataFrame) -> DataFrame:
    """(u, v), v < u: the edges of each task, a million at a time, as stars around the least nodes. A node whose rows come together is not cut."""

    def star(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(tuple(batch.column(c).to_numpy() for c in ("u", "v")))
            if sum(len(x) for x, _ in held) > EDGES:
                last = held[-1][0][-1]
                u, v = contracted(*(np.concatenate(x) for x in zip(*held, strict=True)))
                yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])
                held[:] = [(u[u == last], v[u == last])]  # its further rows meet it
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in contracted(*(np.concatenate(x) for x in zip(*held, strict=True)))], ["u", "v"])
        release()

    return edges.select("u", "v").mapInArrow(star, "u long, v long")


def components(edges: DataFrame, a: str = "a", b: str = "b", most_rounds: int = 50) -> DataFrame:
    """(node, component): component is the least node id reachable. Nodes without an edge don't appear.

    A node's parent is its least lower neighbour. Edges are contracted to stars in each task, then a
    round moves every edge up to its parent's parent and contracts what meets at a node; parents only
    ever sink, and once each node has one parent, a root, these are the components. A node has at most
    a row of each task (and million edges) by then, and edges of a common parent are dealt over
    ``SALTS`` parts. Each round is written to the shared folder, where only the result stays.
    """
    pairs = edges.select(F.greatest(a, b).cast("long").alias("u"), F.least(a, b).cast("long").alias("v")).filter("u <> v")
    now = materialize(_stars(_stars(pairs).repartition("u").sortWithinPartitions("u")), "edges")
    for _ in range(most_rounds):
        up = now.select(F.col("u").alias("node"), F.col("v").alias("parent"), F.lit(None).cast("long").alias("child"))
        down = now.select(F.col("v").alias("node"), F.lit(None).cast("long").alias("parent"), F.col("u").alias("child"))
        least = up.unionByName(down).groupBy("node").agg(F.min("parent").alias("parent"), F.max("parent").alias("other"), salts_of("child").alias("salts"))
        least = materialize(least.select("node", F.coalesce("parent", "node").alias("component"), "salts", (F.col("parent").isNotNull() & (F.col("salts").isNotNull() | (F.col("parent") < F.col("other")))).alias("open")), "components")
        if not least.filter("open").limit(1).count():
            break
        parents = least.select(F.col("node").alias("v"), F.col("component").alias("top"), salt_rows("salts").alias("salt"))
        moved = now.withColumn("salt", F.pmod(F.xxhash64("u"), F.lit(SALTS))).join(parents, ["v", "salt"]).select("u", F.col("top").alias("v"))
        then = materialize(_stars(moved.repartition("u").sortWithinPartitions("u")), "edges")
        discard(now, least)
        now = then
    else:
        raise RuntimeError("components: no fixed point; raise most_rounds")
    discard(now)
    out = least.select("node", "component")
    out.written_to = least.written_to
    return out

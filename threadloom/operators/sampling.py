"""Stratified samples: observable dimensions, stratum counts and the greedy quota sampler."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from threadloom.functions.shared import cut
from threadloom.functions.text import ascii_tokens, hash_fraction
from threadloom.functions.vocab import LENGTH_TARGETS, SECONDARY_TARGETS


def length_bucket(n: Column) -> Column:
    return F.when(n <= 2, "single_turn").when(n <= 4, "short_multi_turn").when(n <= 8, "medium_multi_turn").otherwise("long_multi_turn")


OBSERVABLE = ("length_bucket", "reconstruction_status", "failure_marker", "dm_handoff_marker", "resolution_marker", "diagnostic_context_marker", "question_marker")


def observable_dimensions(journeys: DataFrame, key: str = "root") -> DataFrame:
    """(key, and the seven dimensions) of assembled journeys with marker flags (``failure_marker_flag`` and so on).

    A missing flag counts as false, a missing status as its own value, a missing list of messages as an empty one.
    """
    n = F.greatest(F.size(F.coalesce("messages", F.array().cast(journeys.schema["messages"].dataType))), F.lit(0))
    flag = lambda d: F.coalesce(F.col(f"{d}_flag").cast("boolean"), F.lit(False)) if f"{d}_flag" in journeys.columns else F.lit(False)
    return journeys.select(key, length_bucket(n).alias("length_bucket"), F.coalesce("reconstruction_status", F.lit("None")).alias("reconstruction_status"), *(flag(d).alias(d) for d in OBSERVABLE[2:]))


def stratum_counts(df: DataFrame, dimensions: tuple[str, ...]) -> DataFrame:
    """(dimension, value, count) from one pass: grouping sets over the dimensions."""
    held = df.select(*(F.col(d).cast("string").alias(d) for d in dimensions))
    return held.unpivot([], list(dimensions), "dimension", "value").groupBy("dimension", "value").agg(F.count("*").alias("count"))


def token_frequencies(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(token, df): documents that hold each token."""
    rows = docs.select(F.explode(F.array_distinct(ascii_tokens(F.col(text)))).alias("token"))
    return rows.groupBy("token").agg(F.count("*").alias("df"))


def stable_top(df: DataFrame, key: str, seed: str, n: int) -> DataFrame:
    """The n rows of greatest hash value: a seeded sample."""
    return df.withColumn("tie", hash_fraction(seed, F.col(key).cast("string"))).orderBy(F.col("tie").desc(), F.col(key)).limit(n)


def greedy_sample(pool: DataFrame, key: str, seed: str, targets: dict[str, int] = LENGTH_TARGETS, secondary: dict[str, dict[str, int]] = SECONDARY_TARGETS, text: str = "text", bucket: str = "length_bucket", ahead: int = 256) -> DataFrame:
    """(key, pick): one row after another, each the best by coverage of open targets, then new tokens, then completeness, then hash, then key.

    Exact for pools of any size, by lazy evaluation. Coverage depends on a row's cell alone (its
    bucket and the targeted values it has), and what its tokens add only falls as others are picked.
    So Spark ranks the rows within each cell and the driver holds the first ``ahead`` of
    each, picking among them as long as the best is no worse than the last row held of any
    open cell was when it was ranked, which bounds all rows not held. Else the rows are ranked anew, with the
    tokens seen by then. A round gives one pick at least, mostly very many.
    """
    dims, kind = list(secondary), dict(pool.dtypes)[key]
    tokens = pool.select(F.col(key), F.explode(F.array_distinct(ascii_tokens(F.col(text)))).alias("token"))
    weights = tokens.join(token_frequencies(pool, key, text), "token").groupBy(key).agg(F.array_sort(F.collect_list(F.struct("token", (1.0 / F.col("df")).alias("w")))).alias("tokens"))
    value = lambda d: F.when(F.col(d).cast("string").isin(*secondary[d]), F.col(d).cast("string")).otherwise("")
    complete = F.coalesce(F.col("reconstruction_status") == "complete", F.lit(False)) if "reconstruction_status" in pool.columns else F.lit(False)
    held = pool.filter(F.col(bucket).isin(*targets)).select(F.col(key), F.array(F.col(bucket), *(value(d) for d in dims)).alias("cell"), complete.alias("complete"), hash_fraction(seed, F.col(key).cast("string")).alias("tie"))
    rows = cut(held.join(weights, key, "left").withColumn("tokens", F.coalesce("tokens", F.array().cast("array<struct<token:string,w:double>>"))))
    open_, counts, seen, picked, out = dict(targets), {d: dict.fromkeys(v, 0) for d, v in secondary.items()}, set(), set(), []

    def coverage(cell: tuple[str, ...]) -> float:
        gaps = ((secondary[d].get(v, 0), counts[d].get(v, 0)) for d, v in zip(dims, cell[1:], strict=True))
        return sum(10.0 + (goal - have) / goal for goal, have in gaps if goal and have < goal)

    def worth(r) -> tuple[float, bool, float]:
        return round(sum(t["w"] for t in r["tokens"] if t["token"] not in seen), 9), r["complete"], r["tie"]

    class Least:  # of equal rows the one with the least key
        def __init__(self, k):
            self.k = k

        def __lt__(self, other):
            return other.k < self.k

    while any(open_.values()):
        fresh = F.filter("tokens", lambda t: ~t["token"].isin(*seen)) if seen else F.col("tokens")
        novelty = F.round(F.aggregate(fresh, F.lit(0.0), lambda total, t: total + t["w"]), 9)
        order = Window.partitionBy("cell").orderBy(F.desc("novelty"), F.desc("complete"), F.desc("tie"), key)
        left = rows.filter(F.get("cell", F.lit(0)).isin(*(b for b, n in open_.items() if n > 0)))
        if picked:
            left = left.filter(~F.col(key).isin(*picked))
        ranked = left.withColumn("novelty", novelty).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= ahead)
        cells: dict[tuple[str, ...], list] = {}
        for r in sorted(ranked.collect(), key=lambda r: r["rank"]):  # ``ahead`` rows a cell, of a number of cells that the targets bound
            cells.setdefault(tuple(r["cell"]), []).append(r)
        bound = {c: (*worth(rs[-1]), Least(rs[-1][key])) for c, rs in cells.items() if len(rs) == ahead}
        if not cells:
            break
        while True:
            able = [(coverage(c), *worth(r), Least(r[key]), r) for c, rs in cells.items() if open_[c[0]] > 0 for r in rs]
            if not able:
                break
            *best, row = max(able, key=lambda x: x[:-1])
            if any(tuple(best) < (coverage(c), *b) for c, b in bound.items() if open_[c[0]] > 0):
                break
            cell = tuple(row["cell"])
            cells[cell].remove(row)
            out.append(row[key])
            picked.add(row[key])
            open_[cell[0]] -= 1
            for d, v in zip(dims, cell[1:], strict=True):
                if v in counts[d]:
                    counts[d][v] += 1
            seen |= {t["token"] for t in row["tokens"]}
        if not bound:  # every open row was held
            break
    return pool.sparkSession.createDataFrame([(k, i) for i, k in enumerate(out, 1)], f"`{key}` {kind}, pick long")


def sample_violations(sample: DataFrame, pool: DataFrame, other: DataFrame, key: str) -> DataFrame:
    """(rule, violations): picks outside the pool, repeated picks, picks also in ``other``."""
    rules = {
        "outside the pool": sample.join(pool.select(key), key, "left_anti"),
        "picked twice": sample.groupBy(key).count().filter("count > 1"),
        "also elsewhere": sample.join(other.select(key), key, "left_semi"),
    }
    out = None
    for name, df in rules.items():
        one = df.agg(F.count("*").alias("violations")).select(F.lit(name).alias("rule"), "violations")
        out = one if out is None else out.unionByName(one)
    return out


def dense_ranks(df: DataFrame, key: str) -> DataFrame:
    """``df`` with ``rank``, the row's place from 0 in the order of ``key`` (unique).

    Rows are dealt by ranges of the key and sorted inside; a rank is the place in the range plus
    the rows of the ranges before, a sum over one row for each range. No task sees all rows.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = cut(df.repartitionByRange(parts, key).sortWithinPartitions(key).withColumns({"_part": F.spark_partition_id(), "_at": F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)}))
    sizes = dealt.groupBy("_part").agg(F.count("*").alias("n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_start"))  # a row for each range
    return dealt.join(F.broadcast(starts), "_part").withColumn("rank", F.col("_start") + F.col("_at")).drop("_part", "_at", "_start")


def permutation(spark: SparkSession, n: int, seed: int, most: int = 1 << 27) -> DataFrame:
    """(rank, place): where each of n ranks goes when a list is shuffled with Python's seeded generator.

    The generator's steps follow each other, so one task makes them, on an array of four bytes a
    rank; a list of more than ``most`` is refused. Only ranks pass through it, never rows.
    """
    if n > most:
        raise ValueError(f"a seeded shuffle of {n} rows; at most {most}")

    def shuffled(_: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import random
        from array import array

        at = array("I", range(n))
        random.Random(seed).shuffle(at)
        for i in range(0, n, 1 << 16):
            some = np.frombuffer(at, np.uint32)[i : i + (1 << 16)].astype(np.int64)
            yield pd.DataFrame({"rank": some, "place": np.arange(i, i + len(some))})

    return spark.range(1, numPartitions=1).mapInPandas(shuffled, "rank long, place long")


def seeded_order(df: DataFrame, key: str, seed: int) -> DataFrame:
    """``df`` with ``place``: its row's place after the list sorted by ``key`` (unique, not null) is shuffled with the seed."""
    ranked = cut(dense_ranks(df, key))
    return ranked.join(permutation(df.sparkSession, ranked.count(), seed), "rank").drop("rank")

"""Chat formatting: collapse cumulative conversation snapshots, then render what is left.

A chat service often logs a conversation again after every exchange, so that one log is a
prefix of another. Each conversation gets the rolling hash of every turn prefix; a
conversation whose whole hash is among the proper prefixes of another is dropped by an
anti-join, and of equal ones the smallest id stays.

The prefix hash is an exclusive or of per-turn hashes that include the turn's rank, so it is
associative: turns are folded in blocks of ``block`` turn numbers and only the blocks' totals
meet per conversation. A conversation that holds a third of all rows is therefore spread over
many tasks, and it is rendered as several segments, one for each block.

Defined results:
* null role or text counts as empty; a null turn sorts before all others;
* rows with a null conversation id belong to no conversation and are left out;
* rows with the same turn number are ordered by role, then by a hash of their text;
* repeated rows are separate turns; an empty table gives an empty result;
* other columns of the input are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

OPEN, CLOSE = "<|im_start|>", "<|im_end|>"


def _turns(df: DataFrame, conv: str, turn: str, role: str, text: str, block: int) -> DataFrame:
    said = df.select(
        F.col(conv).alias("conv_id"),
        F.coalesce(F.col(turn).cast("long"), F.lit(-(2**62))).alias("turn"),
        F.coalesce(F.col(role).cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"),
    ).filter(F.col("conv_id").isNotNull())
    return said.select(
        "conv_id", F.floor(F.col("turn") / block).alias("block"), "turn", "role", "text",
        F.xxhash64("text").alias("a"), F.xxhash64(F.lit("second"), "text", "role").alias("b"),
    )


def _blocks(turns: DataFrame) -> DataFrame:
    """One row per block of a conversation, with its turns' hashes and the hash of all that came before."""
    by = Window.partitionBy("conv_id")
    before = by.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("long")
    xor = lambda name: F.aggregate("t", zero, lambda acc, e: acc.bitwiseXOR(e[name]))
    grouped = turns.groupBy("conv_id", "block").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "a", "b"))).alias("t"))
    placed = grouped.select(
        "conv_id", "block", "t",
        F.coalesce(F.sum(F.size("t")).over(before), zero).alias("offset"),
        F.sum(F.size("t")).over(by).alias("conv_turns"),
        F.row_number().over(by.orderBy("block")).alias("segment"),
    ).withColumn("t", F.transform("t", lambda e, i: F.struct(F.xxhash64(F.col("offset") + i, e.role, e.a).alias("x"), F.xxhash64(e.b, F.col("offset") + i).alias("y"))))
    return placed.select(
        "conv_id", "block", "segment", "offset", "conv_turns", "t",
        *(F.coalesce(F.bit_xor(xor(n)).over(before), zero).alias(f"{n}0") for n in ("x", "y")),
    )


def _prefixes(blocks: DataFrame) -> DataFrame:
    """(conv_id, conv_turns, n, x, y) for each turn prefix; within a block the fold appends to an array of bounded length."""

    def step(acc: Column, e: Column) -> Column:
        x, y = acc.x.bitwiseXOR(e.x), acc.y.bitwiseXOR(e.y)
        return F.struct(x.alias("x"), y.alias("y"), F.array_append(acc.out, F.struct(x.alias("x"), y.alias("y"))).alias("out"))

    start = F.struct(F.col("x0").alias("x"), F.col("y0").alias("y"), F.expr("cast(array() as array<struct<x:bigint,y:bigint>>)").alias("out"))
    folded = blocks.select("conv_id", "conv_turns", "offset", F.posexplode(F.aggregate("t", start, step, lambda acc: acc.out)).alias("i", "h"))
    return folded.select("conv_id", "conv_turns", (F.col("offset") + F.col("i") + 1).alias("n"), F.col("h.x").alias("x"), F.col("h.y").alias("y"))


def maximal_conversations(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", block: int = 256) -> DataFrame:
    """(conv_id, copies): conversations that are no proper prefix of another, one of each group of equal ones."""
    prefixes = _prefixes(_blocks(_turns(df, conv, turn, role, text, block)))
    return _maximal(prefixes)


def _maximal(prefixes: DataFrame) -> DataFrame:
    key = ["n", "x", "y"]
    whole = prefixes.filter("n = conv_turns").groupBy(*key).agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("copies"))
    proper = prefixes.filter("n < conv_turns").select(*key).distinct()
    return whole.join(proper, key, "left_anti").select("conv_id", "copies")


def render_conversations(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", block: int = 256) -> DataFrame:
    """Maximal conversations in a role-tagged chat format, one row per segment of ``block`` turn numbers.

    Returns conv_id, segment (from 1), first_turn (turns before it), n_turns, conv_turns, copies, rendered.
    Text that holds a tag's opening gets a space put in, so that it can't close or open a turn.
    """
    turns = _turns(df, conv, turn, role, text, block)
    blocks = _blocks(turns)
    kept = _maximal(_prefixes(blocks))
    keys = blocks.join(kept, "conv_id").select("conv_id", "block", "segment", F.col("offset").alias("first_turn"), "conv_turns", "copies")
    safe = lambda c: F.replace(c, F.lit("<|"), F.lit("< |"))
    one = lambda e: F.concat(F.lit(OPEN), safe(e.role), F.lit("\n"), safe(e.text), F.lit(f"{CLOSE}\n"))
    rows = turns.select("conv_id", "block", F.struct("turn", "role", "a", "text").alias("e")).join(keys, ["conv_id", "block"])
    return (
        rows.groupBy("conv_id", "block", "segment", "first_turn", "conv_turns", "copies")
        .agg(F.sort_array(F.collect_list("e")).alias("t"))
        .select("conv_id", F.col("segment").cast("long").alias("segment"), "first_turn", F.size("t").cast("long").alias("n_turns"), "conv_turns", "copies", F.array_join(F.transform("t", one), "").alias("rendered"))
    )

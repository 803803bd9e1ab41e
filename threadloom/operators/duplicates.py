"""Duplicate families, group-safe splits and their checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from threadloom.functions.shared import cut
from threadloom.operators.sampling import seeded_order


def families(df: DataFrame, key: Column) -> DataFrame:
    """(hash, copies) of keys found twice or more."""
    return df.groupBy(key.alias("hash")).agg(F.count("*").alias("copies")).filter("copies > 1")


SALTS = 64  # parts over which the rows of one key are dealt


def _spare(df: DataFrame, name: str) -> str:
    """``name``, with underscores behind it until no column of ``df`` is named so (Spark ignores case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def _dealt(df: DataFrame, by: Column | str) -> Column:
    """The part of a key's rows that a row belongs to, by a hash of ``by``."""
    return F.pmod(F.xxhash64(by), F.lit(SALTS))


def with_copies(df: DataFrame, key: Column, name: str = "copies") -> DataFrame:
    """``df`` with the number of rows that share the key. A null key is a key of its own.

    A key's rows are dealt over ``SALTS`` parts by a hash of the whole row, in the counts (which
    are summed before and across parts) as in the join back, so that the rows of a hot key
    never meet in one task unless they are alike in all columns.
    """
    k, salt = _spare(df, "_key"), _spare(df, "_salt")
    dealt = df.withColumns({k: key, salt: _dealt(df, F.struct(*(F.col(f"`{c.replace('`', '``')}`") for c in df.columns)))})
    parts = dealt.groupBy(k, salt).agg(F.count("*").alias("n"))
    counts = parts.select(F.col(k).alias("held"), F.col(salt).alias("part"), F.sum("n").over(Window.partitionBy(k)).alias(name))  # SALTS rows a key
    met = dealt.join(counts, dealt[k].eqNullSafe(counts["held"]) & (dealt[salt] == counts["part"]))
    return met.drop("held", "part", k, salt)


def _with_least(rows: DataFrame, key: str, value: str, by: str) -> DataFrame:
    """``rows`` with ``least``: the least ``value`` of a key's rows, taken over parts so that a hot key isn't gathered."""
    dealt = rows.withColumn("salt", _dealt(rows, by))
    least = dealt.groupBy(key, "salt").agg(F.min(value).alias("least"))
    least = least.select(key, "salt", F.min("least").over(Window.partitionBy(key)).alias("least"))  # SALTS rows a key
    return dealt.join(least, [key, "salt"]).drop("salt")


def components(df: DataFrame, node: str, *signatures: str) -> DataFrame:
    """(node, group): rows tied by any shared signature; a group is named by its least node.

    A null signature ties nothing: a node without any signature is a group of its own. Repeated
    nodes count once; rows without a node are left out.

    With one signature it is one aggregate. In general least labels travel over the
    node-signature graph until they rest; after each round a label is replaced by the label of
    the node it names, so that rounds grow with the logarithm of a group's diameter. The nodes
    of a hot signature, and those named by a hot label, are dealt over parts.
    """
    nodes = df.filter(F.col(node).isNotNull()).select(F.col(node).alias("n")).distinct()
    pairs = None
    for s in signatures:
        one = df.filter(F.col(s).isNotNull() & F.col(node).isNotNull()).select(F.col(node).alias("n"), F.concat_ws(":", F.lit(s), F.col(s)).alias("s"))
        pairs = one if pairs is None else pairs.unionByName(one)
    pairs = cut(pairs.distinct())
    if len(signatures) == 1:
        least = _with_least(pairs, "s", "n", "n").groupBy("n").agg(F.min("least").alias("g"))
        if pairs.groupBy("n").count().filter("count > 1").isEmpty():
            return nodes.join(least, "n", "left").select(F.col("n").alias(node), F.coalesce("g", "n").alias("group"))
    labels = nodes.withColumn("g", F.col("n"))
    while True:
        fresh = _with_least(pairs.join(labels, "n"), "s", "g", "n").groupBy("n").agg(F.min("least").alias("fresh"))
        moved = cut(labels.join(fresh, "n", "left").select("n", F.least("g", "fresh").alias("g"), (F.col("fresh") < F.col("g")).alias("moved")))
        if moved.filter("moved").isEmpty():
            return moved.select(F.col("n").alias(node), F.col("g").alias("group"))
        named = moved.filter("n <> g").select(F.col("n").alias("g"), F.col("g").alias("of"))  # a label that rests needs no look
        labels = cut(moved.join(named, "g", "left").select("n", F.coalesce("of", "g").alias("g")))


def group_key(groups: DataFrame, node: str = "id") -> DataFrame:
    """(group, key, members): sha256 of a group's sorted members joined by line ends, for groups of bounded size."""
    return groups.groupBy("group").agg(F.count("*").alias("members"), F.sha2(F.array_join(F.array_sort(F.collect_list(F.col(node).cast("string"))), "\n"), 256).alias("key"))


def statistics(groups: DataFrame, exact: str, normalized: str) -> DataFrame:
    """One row: families, rows in them, surplus rows and the largest family, by exact and by normalized signature."""
    out = None
    for name, c in (("exact", exact), ("normalized", normalized)):
        f = families(groups, F.col(c))
        one = f.agg(F.count("*").alias(f"{name}_families"), F.coalesce(F.sum("copies"), F.lit(0)).alias(f"{name}_rows"), F.coalesce(F.sum(F.col("copies") - 1), F.lit(0)).alias(f"{name}_surplus"), F.coalesce(F.max("copies"), F.lit(0)).alias(f"{name}_largest"))
        out = one if out is None else out.crossJoin(one)  # one row each
    return out


def group_split(groups: DataFrame, node: str, seed: str, share: float = 0.2, digits: int = 3) -> DataFrame:
    """(node, split): whole groups in the order of sha256('seed:group') until the reserved share is reached.

    The running size is taken in two levels, over hash buckets and within the bucket where the
    target falls, so no task sees all groups; a bucket is the order's first ``digits`` hex digits. The first group is always taken; the last one
    taken may overshoot.
    """
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("group").cast("string")), 256)
    sized = groups.groupBy("group").agg(F.count("*").alias("members")).withColumn("r", order).withColumn("bucket", F.substring("r", 1, digits))
    total = groups.agg(F.count("*").alias("n")).select(F.bround(F.col("n") * share).alias("target"))
    per = sized.groupBy("bucket").agg(F.sum("members").alias("size"))
    before = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    start = per.select("bucket", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("start"))  # 16 ** digits rows at most
    inside = Window.partitionBy("bucket").orderBy("r").rowsBetween(Window.unboundedPreceding, -1)
    placed = sized.withColumn("within", F.coalesce(F.sum("members").over(inside), F.lit(0))).join(F.broadcast(start), "bucket").crossJoin(F.broadcast(total))
    chosen = placed.select("group", F.when(F.col("start") + F.col("within") < F.col("target"), "reserved").otherwise("development").alias("split"))
    return groups.join(chosen, "group").select(node, "group", "split")


def shuffled_split(groups: DataFrame, node: str, seed: int, share: float = 0.2) -> DataFrame:
    """(node, group, split): whole groups in the order of a seeded shuffle of the sorted group keys, until the reserved share is reached.

    The share counts distinct nodes and is rounded half to even; the last group taken may overshoot. The running size is
    taken in two levels, over blocks of places and within a block, so no task sees all groups.
    """
    members = groups.select(node, "group").distinct()
    sized = members.groupBy("group").agg(F.count("*").alias("members"))
    placed = seeded_order(sized, "group", seed).withColumn("block", F.shiftright("place", 12))
    target = members.agg(F.bround(F.count("*") * share).alias("target"))
    per = placed.groupBy("block").agg(F.sum("members").alias("size"))
    start = per.select("block", F.coalesce(F.sum("size").over(Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("start"))  # a row for 4096 groups
    inside = Window.partitionBy("block").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    held = placed.withColumn("within", F.coalesce(F.sum("members").over(inside), F.lit(0))).join(start, "block").crossJoin(F.broadcast(target))  # one row
    taken = (F.col("place") == 0) | (F.col("start") + F.col("within") < F.col("target"))
    return members.join(held.select("group", F.when(taken, "reserved").otherwise("development").alias("split")), "group").select(node, "group", "split")


def split_violations(split: DataFrame, source: DataFrame, node: str) -> DataFrame:
    """(rule, violations): ids or groups on both sides, ids left out or added."""
    rules = {
        "id on both sides": split.groupBy(node).agg(F.countDistinct("split").alias("k")).filter("k > 1"),
        "group on both sides": split.groupBy("group").agg(F.countDistinct("split").alias("k")).filter("k > 1"),
        "id left out": source.select(node).distinct().join(split.select(node), node, "left_anti"),
        "id added": split.select(node).distinct().join(source.select(node), node, "left_anti"),
    }
    out = None
    for name, df in rules.items():
        one = df.agg(F.count("*").alias("violations")).select(F.lit(name).alias("rule"), "violations")
        out = one if out is None else out.unionByName(one)
    return out


def split_checks(parts: dict[str, DataFrame], source: DataFrame, split: DataFrame, again: DataFrame, node: str) -> DataFrame:
    """(check, violations) of written partitions: zero where a split can be trusted.

    ``parts`` holds the rows of each side as read back, ``split`` (node, group, split) what was
    decided and ``again`` the same decided anew from the source: both must agree on every id, and every
    row must stand in the source as it is. ``source digest`` counts partitions whose rows together have
    another order-free digest than those of the source with their ids.
    """
    base = split_violations(split, source, node)
    agreed = split.select(node, F.col("split").alias("one")).join(again.select(node, F.col("split").alias("two")), node, "full_outer")
    row = lambda df: F.xxhash64(*(F.col(f"`{c}`") for c in sorted(source.columns)))
    digest = lambda df: df.agg(F.coalesce(F.bit_xor(row(df)), F.lit(0)).alias("x"), F.coalesce(F.sum(row(df).cast("decimal(38,0)")), F.lit(0)).alias("s"), F.count("*").alias("n"))
    more = {"another side when run again": agreed.filter(~F.col("one").eqNullSafe(F.col("two")))}
    for name, df in parts.items():
        ids = split.filter(F.col("split") == name).select(node)
        expected = source.join(ids, node, "left_semi").select(*sorted(source.columns))
        held = df.select(*sorted(source.columns))
        more[f"rows of {name} that differ from the source"] = held.exceptAll(expected).unionByName(expected.exceptAll(held))
        a, b = digest(held).toDF("xa", "sa", "na"), digest(expected).toDF("xb", "sb", "nb")
        more[f"source digest of {name}"] = a.crossJoin(b).filter("NOT (xa <=> xb AND sa <=> sb AND na = nb)")  # one row each
    out = base.withColumnRenamed("rule", "check")
    for name, df in more.items():
        out = out.unionByName(df.agg(F.count("*").alias("violations")).select(F.lit(name).alias("check"), "violations"))
    return out


def overlap(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Keys on both sides: must be empty between development and reserved sets."""
    return left.select(key).intersect(right.select(key))


def same_rows(left: DataFrame, right: DataFrame) -> bool:
    """Do two tables hold the same rows, repeats included?"""
    return left.exceptAll(right).isEmpty() and right.exceptAll(left).isEmpty()


def differences(left: DataFrame, right: DataFrame) -> DataFrame:
    """(side, rows): rows found on one side only, repeats included; none where the tables hold the same rows."""
    count = lambda df, side: df.agg(F.count("*").alias("rows")).select(F.lit(side).alias("side"), "rows")
    return count(left.exceptAll(right), "left").unionByName(count(right.exceptAll(left), "right")).filter("rows > 0")


def pool_statistics(pool: DataFrame, flags: tuple[str, ...], status: str = "reconstruction_status", multi: str = "multi_turn") -> DataFrame:
    """(name, count): multi-turn and other journeys, journeys of each status, and journeys with each flag."""
    yes = lambda c: F.count_if(F.coalesce(F.col(c).cast("boolean"), F.lit(False)))
    one = pool.agg(yes(multi).alias("multi_turn_journeys"), (F.count("*") - yes(multi)).alias("single_or_short_journeys"), *(yes(f).alias(f) for f in flags))
    by_status = pool.groupBy(F.concat(F.lit("status."), F.col(status)).alias("name")).agg(F.count("*").alias("count"))
    return one.unpivot([], one.columns, "name", "count").unionByName(by_status)


HEAD = 16


def quoting(docs: DataFrame, reserved: DataFrame, key: str, text: str = "text", most: int = 10_000) -> DataFrame:
    """Ids of documents that hold a reserved text (column ``text``) as it is, at any place; a null or empty text quotes nothing, nor is it quoted.

    Candidates meet on a reserved text's first HEAD characters, or all of a shorter one. Up to ``most``
    heads are looked up inside a document's row, so that only places with a known head leave it;
    beyond that number all places are shuffled to meet their heads.
    """
    held = reserved.select(F.col(text).alias("quoted")).filter(F.length(text) > 0).distinct()
    heads = held.select(F.substring("quoted", 1, HEAD).alias("head"), "quoted")
    lengths = sorted(r[0] for r in heads.select(F.length("head").alias("n")).distinct().collect())  # HEAD rows at most
    if not lengths:
        return docs.select(key).limit(0)
    found = F.flatten(F.array(*(F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{n}}}))"), F.lit(1)) for n in lengths)))
    known = [r[0] for r in heads.select("head").distinct().limit(most + 1).collect()]  # most + 1 rows at most
    if len(known) <= most:
        found = F.filter(found, lambda h: h.isin(*known))
    rows = docs.filter(F.length(text) >= lengths[0]).select(key, text, F.array_distinct(found).alias("heads"))
    if len(known) <= most:
        rows = rows.filter(F.size("heads") > 0)
        met = rows.select(key, text, F.explode("heads").alias("head")).join(heads, "head")
        return met.filter(F.contains(F.col(text), F.col("quoted"))).select(key).distinct()
    near = rows.select(key, F.explode("heads").alias("head")).join(heads, "head").select(key, "quoted").distinct()
    return docs.join(near, key).filter(F.contains(F.col(text), F.col("quoted"))).select(key).distinct()

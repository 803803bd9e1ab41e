"""Reply graphs: roots, recursive threads, link quality, reconstruction status and journey assembly.

Messages have id, author_id, role, text, parent and response; '' means no id. Ids are text.
"""

from __future__ import annotations

import contextlib
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.functions.shared import cut
from threadloom.functions.text import RECORD, UNIT, digest

MAX_DEPTH = 100
RECURSION = {"spark.sql.cteRecursionLevelLimit": str(MAX_DEPTH + 2), "spark.sql.cteRecursionRowLimit": "-1"}


@contextlib.contextmanager
def recursion(spark: SparkSession) -> Iterator[None]:
    """Limits under which a chain of MAX_DEPTH + 1 messages is rebuilt whole."""
    before = {k: spark.conf.get(k, None) for k in RECURSION}
    for k, v in RECURSION.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def roots(messages: DataFrame, account: str | None = None) -> DataFrame:
    """Customer messages that answer nothing and whose reply is by support (of one account, if given)."""
    m, r = messages.alias("m"), messages.alias("r")
    first = F.expr("m.role = 'customer' and m.parent = '' and r.role = 'support'")
    held = m.filter("parent = ''").join(r, F.col("m.response") == F.col("r.id")).filter(first)
    if account is not None:
        held = held.filter(F.col("r.author_id") == account)
    return held.select(F.col("m.id").alias("root"), F.col("r.author_id").alias("company"))


def threads(messages: DataFrame, start: DataFrame, max_depth: int = MAX_DEPTH, rounds_by_join: bool = False, guard: bool = False) -> DataFrame:
    """(root, id, depth) of every message reachable from a root by reply links, all roots at once.

    One recursive query; ``rounds_by_join`` uses a checkpointed join per depth instead, for
    results beyond what a recursive query holds. Each id has one parent, so from true roots
    the reachable set is a tree and needs no cycle guard; the depth bound ends any other. With
    ``guard`` (in rounds) a message joins a root's thread once, which ends a walk into a cycle.
    """
    spark = messages.sparkSession
    if rounds_by_join:
        edges = messages.filter("parent <> ''").select(F.col("parent").alias("from"), F.col("id").alias("to"))
        front = start.select("root", F.col("root").alias("id"), F.lit(0).alias("depth")).distinct()
        out = front
        for depth in range(1, max_depth + 1):
            front = front.join(edges, front["id"] == edges["from"]).select("root", F.col("to").alias("id"), F.lit(depth).alias("depth"))
            front = cut(front.join(out.select("root", "id"), ["root", "id"], "left_anti").distinct() if guard else front)
            if front.isEmpty():
                break
            out = out.unionByName(front)
        return out
    edges, tops = messages.filter("parent <> ''").select("id", "parent"), start.select("root").distinct()
    return spark.sql(
        f"""
        WITH RECURSIVE chain(root, id, depth) MAX RECURSION LEVEL {max_depth + 2} AS (
          SELECT root, root, 0 FROM {{tops}}
          UNION ALL
          SELECT c.root, e.id, c.depth + 1 FROM chain c JOIN {{edges}} e ON e.parent = c.id WHERE c.depth < {max_depth})
        SELECT root, id, depth FROM chain""",
        edges=edges,
        tops=tops,
    )


def pointers(messages: DataFrame, start: DataFrame, rounds: int | None = None) -> DataFrame:
    """(id, at, depth, rest): how far up the reply links each message has been followed, by pointer doubling.

    In each round a pointer that isn't at rest takes the pointer of the message that it names, so
    it reaches twice as far: a message n links below its root rests after log2(n) joins. A pointer
    rests at a root of ``start`` or at a message whose parent isn't there. Without ``rounds`` as
    many are made as the longest possible chain needs; pointers that don't rest then lead into
    a cycle. Messages have one parent each; repeated ids count once, with their least parent.
    """
    links = messages.groupBy("id").agg(F.min("parent").alias("parent"))
    tops = start.select(F.col("root").alias("id")).distinct().withColumn("top", F.lit(True))
    known = links.select(F.col("id").alias("up"))
    first = links.join(tops, "id", "left").join(known, F.col("parent") == F.col("up"), "left")
    moves = F.col("top").isNull() & F.col("up").isNotNull()
    state = cut(first.select("id", F.when(moves, F.col("up")).otherwise(F.col("id")).alias("at"), moves.cast("long").alias("depth"), (~moves).alias("rest")))
    rounds = state.count().bit_length() if rounds is None else rounds
    for _ in range(rounds):
        moving = state.filter("NOT rest")
        if moving.isEmpty():
            break
        named = state.select(F.col("id").alias("at"), F.col("at").alias("next"), F.col("depth").alias("more"), F.col("rest").alias("there"))
        state = cut(state.filter("rest").unionByName(moving.join(named, "at").select("id", F.col("next").alias("at"), (F.col("depth") + F.col("more")).alias("depth"), F.col("there").alias("rest"))))
    return state


def threads_by_doubling(messages: DataFrame, start: DataFrame, max_depth: int = MAX_DEPTH) -> DataFrame:
    """(root, id, depth) as ``threads`` gives it, in log2(max_depth) joins instead of one for each depth."""
    tops = start.select("root").distinct()
    held = pointers(messages, start, max_depth.bit_length()).filter(F.col("rest") & (F.col("depth") <= max_depth))
    return held.join(tops, held["at"] == tops["root"]).select("root", "id", F.col("depth").cast("int").alias("depth"))


def in_cycles(messages: DataFrame, start: DataFrame) -> DataFrame:
    """(id) of messages whose reply links never end: on a cycle, or leading into one."""
    return pointers(messages, start).filter("NOT rest").select("id")


def at_depth_limit(chain: DataFrame, messages: DataFrame, max_depth: int = MAX_DEPTH) -> DataFrame:
    """Roots whose thread goes on below the depth limit."""
    children = messages.filter("parent <> ''").select(F.col("parent").alias("id"))
    return chain.filter(F.col("depth") == max_depth).join(children, "id", "left_semi").select("root").distinct()


def link_quality(messages: DataFrame) -> DataFrame:
    """One row: populated, resolvable and reciprocal links in both directions."""
    ids = messages.select(F.col("id").alias("_id"), F.col("parent").alias("_parent"), F.col("response").alias("_response"))
    out = []
    for name, link, back in (("response", "response", "_parent"), ("parent", "parent", "_response")):
        held = messages.filter(F.col(link) != "").select("id", link)
        met = held.join(ids, held[link] == ids["_id"], "left")
        out.append(met.agg(F.count("*").alias(f"{name}_populated"), F.count("_id").alias(f"{name}_resolvable"), F.count_if(F.col(back) == F.col("id")).alias(f"{name}_reciprocal")))
    return out[0].crossJoin(out[1])  # one row each


def linked_to(messages: DataFrame, role: str = "support") -> DataFrame:
    """(author_id, linked): distinct customer messages tied to an account in either direction.

    The two conditions are two equi-joins, united; an OR in one join would compare all pairs.
    """
    ours = messages.filter(F.col("role") == role).select(F.col("author_id").alias("account"), F.col("id").alias("own"), F.col("parent").alias("own_parent"))
    theirs = messages.filter(F.col("role") != role).select("id", "response")
    forward = theirs.filter("response <> ''").join(ours, F.col("response") == F.col("own")).select("account", "id")
    backward = theirs.join(ours.filter("own_parent <> ''"), F.col("id") == F.col("own_parent")).select("account", "id")
    return forward.unionByName(backward).groupBy("account").agg(F.countDistinct("id").alias("linked")).withColumnRenamed("account", "author_id")


def reconstruction_status(chain: DataFrame, messages: DataFrame, max_depth: int = MAX_DEPTH) -> DataFrame:
    """(root, status, reasons): partial beyond the depth limit or with a missing link, else uncertain with a one-sided link."""
    m = messages.select("id", "parent", "response")
    ids = messages.select(F.col("id").alias("_id"))
    rows = chain.join(m, "id")
    rows = rows.join(ids.withColumnRenamed("_id", "_p"), F.col("parent") == F.col("_p"), "left").join(ids.withColumnRenamed("_id", "_r"), F.col("response") == F.col("_r"), "left")
    back = messages.select(F.col("id").alias("_q"), F.col("response").alias("_q_response"))
    rows = rows.join(back, F.col("parent") == F.col("_q"), "left")
    inside = chain.select(F.col("root").alias("_root"), F.col("id").alias("_in"))
    rows = rows.join(inside, (F.col("root") == F.col("_root")) & (F.col("parent") == F.col("_in")), "left")
    per = rows.groupBy("root").agg(
        F.bool_or(F.expr("parent <> '' and _p is null")).alias("no_parent"),
        F.bool_or(F.expr("response <> '' and _r is null")).alias("no_response"),
        F.bool_or(F.expr("parent <> '' and _in is null")).alias("parent_outside"),
        F.bool_or(F.expr("parent <> '' and _q is not null and _q_response <> id")).alias("one_sided"),
    )
    deep = at_depth_limit(chain, messages, max_depth).withColumn("deep", F.lit(True))
    held = per.join(deep, "root", "left").withColumn("deep", F.coalesce("deep", F.lit(False)))
    reasons = F.array_compact(F.array(*(F.when(F.col(c), F.lit(t)) for c, t in (("deep", "depth_limit"), ("no_parent", "missing_parent"), ("no_response", "missing_response_target"), ("one_sided", "non_reciprocal_link")))))
    missing = F.col("no_parent") | F.col("no_response") | F.col("parent_outside")
    status = F.when(F.col("deep") | missing, "partial").when(F.col("one_sided"), "uncertain").otherwise("complete")
    return held.select("root", status.alias("status"), F.array_sort(F.array_distinct(reasons)).alias("reasons"))


def thread_stats(chain: DataFrame, messages: DataFrame) -> DataFrame:
    """Per thread: messages, customer and support turns, and whether both sides spoke twice."""
    per = chain.join(messages.select("id", "role"), "id").groupBy("root").agg(F.count("*").alias("messages"), F.count_if(F.col("role") == "customer").alias("customer"), F.count_if(F.col("role") == "support").alias("support"))
    return per.withColumn("multi_turn", (F.col("customer") >= 2) & (F.col("support") >= 2))


def assemble(chain: DataFrame, messages: DataFrame, order: str = "created_at", marker_columns: tuple[str, ...] = ()) -> DataFrame:
    """One nested row per thread: ordered messages, turn counts, any-marker flags and two signatures.

    Messages are sorted by parsed time (unknown last), then raw time, then id.
    """
    held = chain.join(messages, "id")
    last = F.lit("￿")
    when = F.coalesce(F.col("created_ts").cast("string"), last) if "created_ts" in messages.columns else F.coalesce(F.col(order).cast("string"), last)
    payload = [c for c in messages.columns if c != "id"]
    item = F.struct(when.alias("_at"), F.coalesce(F.col(order).cast("string"), F.lit("")).alias("_raw"), "id", "depth", *payload)
    simple = F.trim(F.regexp_replace(F.lower("text"), r"\s+", " "))
    held = held.withColumn("_item", item).withColumn("_norm", simple)
    per = held.groupBy("root").agg(
        F.array_sort(F.collect_list("_item")).alias("messages"),
        F.count_if(F.col("role") == "customer").alias("customer_turns"),
        F.count_if(F.col("role") == "support").alias("support_turns"),
        F.min(F.col(order).cast("string")).alias("started_at_raw"),
        F.max(F.col(order).cast("string")).alias("ended_at_raw"),
        *(F.bool_or(c).alias(c) for c in marker_columns),
    )
    exact = F.array_join(F.transform("messages", lambda m: F.concat_ws(UNIT, m.role, m.text)), RECORD)
    norm = F.array_join(F.transform("messages", lambda m: F.concat_ws(UNIT, m.role, F.trim(F.regexp_replace(F.lower(m.text), r"\s+", " ")))), RECORD)
    return per.withColumn("multi_turn", F.expr("customer_turns >= 2 and support_turns >= 2")).withColumn("exact_signature", digest(exact)).withColumn("normalized_signature", digest(norm))


def journey_violations(journeys: DataFrame) -> DataFrame:
    """(root, rule) of every journey that breaks a rule of the nested form."""
    n = F.size("messages")
    ids = F.transform("messages", lambda m: m.id)
    inside = lambda p: (p == "") | F.array_contains(ids, p)
    turns = F.col("customer_turns") + F.col("support_turns")
    rules = {
        "repeated message id": F.size(F.array_distinct(ids)) != n,
        "turn counts": turns != n,
        "role": F.exists("messages", lambda m: ~m.role.isin("customer", "support")),
        "parent left out": F.exists("messages", lambda m: (m.depth > 0) & ~inside(m.parent)),
        "order": F.array_sort("messages") != F.col("messages"),
        "empty": n == 0,
    }
    each = [journeys.filter(c).select("root", F.lit(name).alias("rule")) for name, c in rules.items()]
    repeated = journeys.groupBy("root").count().filter("count > 1").select("root", F.lit("repeated root").alias("rule"))
    out = repeated
    for e in each:
        out = out.unionByName(e)
    return out

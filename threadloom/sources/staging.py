"""A staged link table: messages bucketed and sorted by id, by parent and by response.

The three tables have the same number of buckets, so every join of a link with the message that
it names, or of a message with what answers it, reads matching buckets and shuffles nothing.
Rows without a link are left out of the tables by link; they would all fall in one bucket.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.functions.shared import shared_folder

SIDES = {"id": "id", "parent": "parent", "response": "response"}


@dataclass(frozen=True)
class Links:
    """The tables of one staging; ``drop`` removes them from the catalog."""

    spark: SparkSession
    name: str

    def by(self, side: str) -> DataFrame:
        return self.spark.table(f"{self.name}_by_{side}")

    def drop(self) -> None:
        for side in SIDES:
            self.spark.sql(f"DROP TABLE IF EXISTS {self.name}_by_{side}")


def stage(messages: DataFrame, buckets: int = 64, folder: str | None = None) -> Links:
    """Write ``messages`` (id, author_id, role, parent, response, ...) in the three orders, below ``folder`` or the shared folder."""
    spark, name = messages.sparkSession, f"threadloom_links_{uuid.uuid4().hex[:12]}"
    folder = folder or shared_folder(spark, "links")
    for side, column in SIDES.items():
        rows = messages if side == "id" else messages.filter(F.coalesce(F.col(column), F.lit("")) != "")
        # one task a bucket, so that a bucket is one file and its order holds
        dealt = rows.repartition(buckets, column)
        dealt.write.bucketBy(buckets, column).sortBy(column).option("path", f"{folder}/{side}").saveAsTable(f"{name}_by_{side}")
    return Links(spark, name)


def roots(links: Links, account: str | None = None) -> DataFrame:
    """(root, company) as ``threads.roots``: the join of responses with ids reads bucket by bucket."""
    m, r = links.by("response").alias("m"), links.by("id").alias("r")
    held = m.filter("coalesce(parent, '') = '' AND role = 'customer'").join(r.filter("role = 'support'"), F.expr("m.response = r.id"))
    if account is not None:
        held = held.filter(F.col("r.author_id") == account)
    return held.select(F.col("m.id").alias("root"), F.col("r.author_id").alias("company"))


def resolved(links: Links, side: str) -> DataFrame:
    """(id, link, found, reciprocal) of every populated link of one side: is the message there, and does it link back?"""
    back = {"parent": "response", "response": "parent"}[side]
    m, t = links.by(side).alias("m"), links.by("id").alias("t")
    met = m.join(t, F.expr(f"m.{side} = t.id"), "left")
    return met.select("m.id", F.col(f"m.{side}").alias("link"), F.col("t.id").isNotNull().alias("found"), F.coalesce(F.expr(f"t.{back} = m.id"), F.lit(False)).alias("reciprocal"))


def link_quality(links: Links) -> DataFrame:
    """One row as ``threads.link_quality``."""
    out = []
    for side in ("response", "parent"):
        out.append(resolved(links, side).agg(F.count("*").alias(f"{side}_populated"), F.count_if("found").alias(f"{side}_resolvable"), F.count_if("reciprocal").alias(f"{side}_reciprocal")))
    return out[0].crossJoin(out[1])  # one row each


def linked_to(links: Links, role: str = "support") -> DataFrame:
    """(author_id, linked) as ``threads.linked_to``; both directions are bucketed joins, only the pairs found are shuffled."""
    own, theirs = links.by("id").filter(F.col("role") == role).alias("o"), links.by("response").filter(F.col("role") != role).alias("t")
    forward = theirs.join(own, F.expr("t.response = o.id")).select(F.col("o.author_id").alias("author_id"), F.col("t.id").alias("id"))
    answers, asked = links.by("parent").filter(F.col("role") == role).alias("a"), links.by("id").filter(F.col("role") != role).alias("q")
    backward = answers.join(asked, F.expr("a.parent = q.id")).select(F.col("a.author_id").alias("author_id"), F.col("q.id").alias("id"))
    return forward.unionByName(backward).groupBy("author_id").agg(F.countDistinct("id").alias("linked"))


def link_status(links: Links) -> DataFrame:
    """(id, missing_parent, missing_response, one_sided) of every message: the parts of a thread's status that one message decides.

    Both links are looked up bucket by bucket; only the messages with a fault, few in a sound
    log, are brought to their ids' buckets.
    """
    up = resolved(links, "parent").filter("NOT (found AND reciprocal)").select("id", (~F.col("found")).alias("no_parent"), F.lit(False).alias("no_response"), F.col("found").alias("one_way"))
    down = resolved(links, "response").filter("NOT found").select("id", F.lit(False).alias("no_parent"), F.lit(True).alias("no_response"), F.lit(False).alias("one_way"))
    faults = up.unionByName(down).groupBy("id").agg(F.bool_or("no_parent").alias("no_parent"), F.bool_or("no_response").alias("no_response"), F.bool_or("one_way").alias("one_way"))
    held = links.by("id").select("id").join(faults, "id", "left")
    return held.select("id", *(F.coalesce(F.col(c), F.lit(False)).alias(name) for c, name in (("no_parent", "missing_parent"), ("no_response", "missing_response"), ("one_way", "one_sided"))))


def thread_stats(links: Links, chain: DataFrame) -> DataFrame:
    """Per thread as ``threads.thread_stats``: the chain alone moves to the messages' buckets."""
    per = links.by("id").select("id", "role").join(chain, "id")
    per = per.groupBy("root").agg(F.count("*").alias("messages"), F.count_if(F.col("role") == "customer").alias("customer"), F.count_if(F.col("role") == "support").alias("support"))
    return per.withColumn("multi_turn", (F.col("customer") >= 2) & (F.col("support") >= 2))

"""Running cases over a stream of messages.

A case is a session of one conversation: it closes when no message has come for ``gap``.
Everything kept is a sum or a flag, so the state of an open case has a fixed size, and the
watermark drops it when the session can't grow any more. As in batch, a case at a time is a
function of the messages up to then only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from threadloom.functions.text import has
from threadloom.functions.vocab import MARKERS, STATE_PATTERNS


def open_cases(messages: DataFrame, at: str = "ts", late: str = "10 minutes", gap: str = "2 hours", failure: str = STATE_PATTERNS["failure"], markers: dict[str, str] = MARKERS) -> DataFrame:
    """One row per session: turns by role, failures told by the customer, any-marker flags, whether both spoke twice."""
    customer = F.col("role") == "customer"
    per = (
        messages.withWatermark(at, late)
        .groupBy("conversation_id", F.session_window(at, gap).alias("session"))
        .agg(
            F.count_if(customer).alias("customer_turns"),
            F.count_if(~customer).alias("support_turns"),
            F.count_if(customer & has(F.col("text"), failure)).alias("failures"),
            *(F.max(has(F.col("text"), p).cast("int")).alias(n) for n, p in markers.items()),
        )
    )
    return per.select("conversation_id", F.col("session.start").alias("started"), F.col("session.end").alias("closed"), "customer_turns", "support_turns", "failures", *(F.col(n).cast("boolean").alias(n) for n in markers), F.expr("customer_turns >= 2 and support_turns >= 2").alias("multi_turn"))


def start(cases: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append closed cases to Parquet, exactly once."""
    return cases.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()

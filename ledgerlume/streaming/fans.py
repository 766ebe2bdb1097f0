"""Fan-in, fan-out and labels over a stream of transfers, with watermarks for late ones.

Windows are those of event time; a window's result is final once the watermark has passed it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def fan_counts(stream: DataFrame, *, direction: str = "in", size: str = "1 day", late: str = "1 hour", least: int = 4) -> DataFrame:
    """(start, hub, n, total, first_at) of windows in which a hub has enough distinct partners.

    Distinct partners are exact: state holds a row for each partner of a hub and window, which
    a first aggregate adds up before the hub's own.
    """
    if direction not in ("in", "out"):
        raise ValueError(f"direction must be in or out, not {direction!r}")
    hub, other = ("receiver", "sender") if direction == "in" else ("sender", "receiver")
    w = stream.withWatermark("timestamp", late)
    per = w.groupBy(F.window("timestamp", size).alias("w"), F.col(hub).alias("hub"), F.col(other).alias("other")).agg(F.sum("amount").alias("amount"), F.min("timestamp").alias("first_at"))
    whole = per.groupBy(F.window("w", size).alias("w"), "hub").agg(F.count("*").alias("n"), F.sum("amount").alias("total"), F.min("first_at").alias("first_at"))
    return whole.where(F.col("n") >= least).select(F.col("w.start").alias("start"), "hub", "n", "total", "first_at")


def active_labels(stream: DataFrame, *, size: str = "1 day", late: str = "1 hour") -> DataFrame:
    """(start, account_id, y): accounts active in a window and whether a transfer was positive."""
    w = stream.withWatermark("timestamp", late)
    legs = w.select("timestamp", "label", F.explode(F.array("sender", "receiver")).alias("account_id"))
    return legs.groupBy(F.window("timestamp", size).alias("w"), "account_id").agg(F.max((F.col("label") == 1).cast("int")).alias("y")).select(F.col("w.start").alias("start"), "account_id", "y")

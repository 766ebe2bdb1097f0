"""Tables from which queries start, made from the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlume.operators import features as ft
from ledgerlume.operators import graph, labels, patterns, windows
from ledgerlume.operators.graph import kept, scratch  # noqa: F401, for the plans
from ledgerlume.sources import adapters


def transfers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return adapters.load_active(spark, "events", sf_dir)


def dirty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transfers with faults at fixed places, and some of them twice."""
    tx = transfers(spark, sf_dir)
    at = lambda n: F.col("row_ord") % n == 0
    bad = tx.withColumns({
        "sender": F.when(~at(97), F.col("sender")), "receiver": F.when(at(89), "").otherwise(F.col("receiver")), "amount": F.when(at(83), 0.0).when(at(79), -F.col("amount")).otherwise(F.col("amount")), "timestamp": F.when(~at(73), F.col("timestamp")),
    })
    return bad.unionByName(bad.where(at(71)).withColumn("row_ord", F.col("row_ord") + 10_000_000))


def sparse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The transfers of the first window: a graph of few edges."""
    return windows.tumbling(transfers(spark, sf_dir)).where("window_id = 0")


def fans(spark: SparkSession, sf_dir: str) -> DataFrame:
    tx = transfers(spark, sf_dir)
    return patterns.fan_in(tx).unionByName(patterns.fan_out(tx))


def candidates(spark: SparkSession, sf_dir: str, events: DataFrame | None = None) -> DataFrame:
    """A candidate for each account at the centre of fan-in or fan-out events."""
    e = (fans(spark, sf_dir) if events is None else events).withColumn("us", F.unix_micros("timestamp"))
    g = e.groupBy(F.col("central_account").alias("candidate_ring_id")).agg(
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("accounts")))).alias("accounts"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("transaction_ids")))).alias("transaction_ids"), F.array_sort(F.collect_set("pattern_type")).alias("patterns"),
        F.count("*").alias("event_count"), F.min("us").alias("start_us"), F.max("us").alias("end_us"),
    )
    return g.withColumns({"density": F.col("event_count") / F.size("accounts"), "candidate_id": F.col("candidate_ring_id")})


def account_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = graph.node_activity(transfers(spark, sf_dir))
    return n.select("account_id", ((F.col("unique_senders") * 37 + F.col("out_count")) % 128 / F.lit(128.0)).alias("score"))


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels with a score that is a function of the key."""
    y = labels.same_window(transfers(spark, sf_dir))
    number = F.substring("account_id", 2, 20).cast("long")
    return y.withColumn("score", (F.col("window_id") * 31 + number * 17) % 101 / F.lit(100.0))


def feature_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    tx = transfers(spark, sf_dir)
    return ft.build(tx, network=ft.degree_features(tx))


def flat(events: DataFrame) -> DataFrame:
    """Events as plain columns."""
    return events.select("pattern_type", "window_id", F.unix_micros("timestamp").alias("us"), "span", "central_account", F.array_join("accounts", ",").alias("accounts"), F.array_join("transaction_ids", ",").alias("transaction_ids"), "pattern_strength")

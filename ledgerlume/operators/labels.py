"""Labels of accounts by window, forecasts that don't look at the present, and a split by time."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerlume.operators import windows
from ledgerlume.operators.features import KEYS, legs


def same_window(tx: DataFrame, size: str = "1d") -> DataFrame:
    """(window_id, account_id, y): whether an active account took part in a positive transfer."""
    return legs(windows.tumbling(tx, size)).groupBy(*KEYS).agg(F.max((F.col("label") == 1).cast("int")).alias("y"))


def forecast(tx: DataFrame, size: str = "1d", horizon: int = 2) -> DataFrame:
    """y: whether the account is positive in one of the next `horizon` windows, this one apart."""
    ahead = Window.partitionBy("account_id").orderBy("window_id").rangeBetween(1, horizon)
    return same_window(tx, size).select(*KEYS, F.coalesce(F.max("y").over(ahead), F.lit(0)).alias("y"))


def attach(features: DataFrame, labels: DataFrame) -> DataFrame:
    return features.join(labels, KEYS, "left").fillna(0, ["y"])


def chronological(df: DataFrame, train: float = 0.6, validation: float = 0.2) -> DataFrame:
    """df with split, by rank of the window among the distinct ones."""
    ids = df.select("window_id").distinct()
    n = ids.agg(F.count("*").alias("n"))
    rank = F.row_number().over(Window.orderBy("window_id")) - 1  # a row for each window
    cuts = ids.withColumn("r", rank).crossJoin(F.broadcast(n))  # one row
    part = F.when(F.col("r") < F.floor(F.col("n") * train), "train").when(F.col("r") < F.floor(F.col("n") * (train + validation)), "validation").otherwise("test")
    return df.join(F.broadcast(cuts.select("window_id", part.alias("split"))), "window_id")

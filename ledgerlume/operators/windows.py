"""Time windows: half-open, numbered from the first timestamp on (not from midnight)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlume.functions.columns import micros
from ledgerlume.functions.durations import duration_us


def extent(tx: DataFrame) -> DataFrame:
    """One row: t0 and t1, microseconds of the first and last transfer."""
    return tx.agg(F.min(micros("timestamp")).alias("t0"), F.max(micros("timestamp")).alias("t1"))


def bounds(tx: DataFrame, size: str = "1d", step: str = "1d") -> DataFrame:
    """window_id, start_us, end_us: starts one step apart until one is after the last transfer."""
    s, z = duration_us(step), duration_us(size)
    ids = extent(tx).where("t0 is not null").select("t0", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("t1") - F.col("t0")) / s))).alias("i"))
    start = F.col("t0") + F.col("i") * s
    return ids.select(F.col("i").cast("int").alias("window_id"), start.alias("start_us"), (start + z).alias("end_us"))


def with_extent(df: DataFrame, tx: DataFrame) -> DataFrame:
    return df.crossJoin(F.broadcast(extent(tx)))  # one row


def tumbling(tx: DataFrame, size: str = "1d") -> DataFrame:
    """tx with us, t0 and window_id, by arithmetic."""
    out = with_extent(tx, tx).withColumn("us", micros("timestamp"))
    return out.withColumn("window_id", F.floor((F.col("us") - F.col("t0")) / duration_us(size)).cast("int")).drop("t1")


def assigned(tx: DataFrame, size: str, step: str) -> DataFrame:
    """A row for each transfer and window that holds it: none in gaps, several where windows overlap."""
    s, z = duration_us(step), duration_us(size)
    out = with_extent(tx, tx).withColumn("us", micros("timestamp"))
    since = F.col("us") - F.col("t0")
    low = F.greatest(F.lit(0).cast("long"), F.floor((since - z) / s) + 1)
    high = F.least(F.floor(since / s), F.floor((F.col("t1") - F.col("t0")) / s))
    ids = F.when(low <= high, F.sequence(low, high)).otherwise(F.array().cast("array<bigint>"))
    return out.withColumn("window_id", F.explode(ids)).withColumn("window_id", F.col("window_id").cast("int")).drop("t0", "t1")


def window_of(us: Column, t0: Column, t1: Column, size: str = "1d", step: str = "1d", *, fallback: bool = True) -> Column:
    """The first window that holds a moment; else the last window, or null without fallback."""
    s, z = duration_us(step), duration_us(size)
    last = F.floor((t1 - t0) / s)
    first = F.greatest(F.lit(0).cast("long"), F.floor((us - t0 - z) / s) + 1)
    inside = (us >= t0 + first * s) & (first <= last) & (us < t0 + first * s + z)
    return F.when(inside, first).otherwise(last if fallback else F.lit(None)).cast("int")

"""Cleaning in a fixed order of steps, in one pass: every row gets the first step that drops it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerlume.functions.columns import is_blank
from ledgerlume.sources import canonical

# The steps in their order.
STEPS = ("validate_schema", "parse_timestamp", "missing_endpoint", "amount_not_numeric", "amount_zero", "amount_negative", "self_transaction", "duplicate_id", "sort_by_time", "check_label")


def marked(df: DataFrame, *, drop_null_amount: bool = True, drop_zero: bool = True, drop_negative: bool = True, drop_self: bool = False) -> DataFrame:
    """df with dropped_by, the step that drops the row, or null. Of the rows of an id that other
    steps keep, the first in input order stays."""
    if problems := canonical.schema_problems(df):
        raise ValueError("; ".join(problems))
    amount = F.col("amount")
    step = F.when(F.col("timestamp").isNull(), "parse_timestamp").when(is_blank("sender") | is_blank("receiver"), "missing_endpoint")
    if drop_null_amount:
        step = step.when(amount.isNull(), "amount_not_numeric")
    if drop_zero:
        step = step.when(amount == 0, "amount_zero")
    if drop_negative:
        step = step.when(amount < 0, "amount_negative")
    if drop_self:
        step = step.when(F.col("sender") == F.col("receiver"), "self_transaction")
    first = F.row_number().over(Window.partitionBy("transaction_id", F.col("__step").isNull()).orderBy("row_ord")) == 1
    return df.withColumn("__step", step).withColumn("dropped_by", F.when(F.col("__step").isNull() & ~first, "duplicate_id").otherwise(F.col("__step"))).drop("__step")


def clean(df: DataFrame, **switches: bool) -> DataFrame:
    """The rows that stay. Their order is (timestamp, row_ord)."""
    return marked(df, **switches).where(F.col("dropped_by").isNull()).drop("dropped_by")


def step_log(df: DataFrame, **switches: bool) -> DataFrame:
    """A row for each step: step_no, step, rows_before, rows_affected, rows_after, details. The
    self-transaction step reports how many there are even where it drops none."""
    m = marked(df, **switches)
    kept = F.col("dropped_by").isNull() | (F.col("dropped_by") == "duplicate_id")
    own = F.sum((kept & (F.col("sender") == F.col("receiver"))).cast("int"))
    bad = F.sum((F.col("dropped_by").isNull() & ~F.coalesce(F.col("label").isin(-1, 0, 1), F.lit(False))).cast("int"))
    sums = [F.sum((F.col("dropped_by") == s).cast("int")).alias(s) for s in STEPS[1:8]]
    one = m.agg(F.count("*").alias("n"), own.alias("own"), bad.alias("bad"), *sums)
    affected = F.array(F.lit(0), *[F.coalesce(s, F.lit(0)) for s in STEPS[1:8]], F.lit(0), F.lit(0))
    details = F.array(*[F.coalesce(F.col("own"), F.lit(0)) if s == "self_transaction" else F.coalesce(F.col("bad"), F.lit(0)) if s == "check_label" else F.lit(0) for s in STEPS])
    rows = one.select("n", F.posexplode(F.arrays_zip(affected.alias("a"), F.array(*map(F.lit, STEPS)).alias("s"), details.alias("d"))).alias("i", "x"))
    before = F.coalesce(F.sum("x.a").over(Window.orderBy("i").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # ten rows
    return rows.select((F.col("i") + 1).alias("step_no"), F.col("x.s").alias("step"), (F.col("n") - before).alias("rows_before"), F.col("x.a").cast("long").alias("rows_affected"), (F.col("n") - before - F.col("x.a")).alias("rows_after"), F.col("x.d").cast("long").alias("details"))


def check_labels(df: DataFrame) -> None:
    if n := df.where(~F.coalesce(F.col("label").isin(-1, 0, 1), F.lit(False))).limit(1).count():
        raise ValueError(f"{n} or more labels are not -1, 0 or 1")

"""Data quality: what is wrong with a table of transfers, found and not mended."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlume.functions.columns import count_where, half_up, is_blank, micros
from ledgerlume.sources.canonical import COLUMNS

CONTENT = ("sender", "receiver", "amount", "timestamp")


def issue_conditions(now: dt.datetime) -> dict[str, Column]:
    """Issues of single rows. Blank endpoints count as missing."""
    amount, label = F.col("amount"), F.col("label")
    ring, scenario = F.coalesce("ring_id", F.lit("")), F.coalesce("scenario_id", F.lit(""))
    out = {f"missing_{c}": F.col(c).isNull() for c in COLUMNS}
    return out | {
        "missing_sender": is_blank("sender"), "missing_receiver": is_blank("receiver"), "invalid_amount_nan": amount.isNull() | F.isnan(amount), "negative_amount": amount < 0, "zero_amount": amount == 0,
        "self_transaction": ~is_blank("sender") & ~is_blank("receiver") & (F.col("sender") == F.col("receiver")), "invalid_timestamp": F.col("timestamp").isNull(),
        "future_timestamp": F.col("timestamp") > F.lit(now + dt.timedelta(days=1)), "invalid_label_value": ~F.coalesce(label.isin(-1, 0, 1), F.lit(False)),
        "ring_without_scenario": (ring != "") & (scenario == ""), "positive_label_without_ring": (label == 1) & (ring == ""),
    }


def flagged(df: DataFrame, now: dt.datetime) -> DataFrame:
    """df with a boolean column for each issue, duplicates (all members) and order included.

    The order of input is checked across ranges of row_ord, so that no task sees all rows. Rows
    without an id are all duplicates of one another if there are two; they are counted and not
    gathered.
    """
    same = lambda *c: F.count("*").over(Window.partitionBy(*c)) > 1
    none = df.agg(count_where(F.col("transaction_id").isNull()).alias("__none"))
    out = df.crossJoin(F.broadcast(none))  # one row
    for name, c in issue_conditions(now).items():
        out = out.withColumn(f"is_{name}", F.coalesce(c, F.lit(False)))
    spread = F.when(F.col("transaction_id").isNull(), F.col("row_ord"))
    twice = F.when(F.col("transaction_id").isNull(), F.col("__none") > 1).otherwise(same("transaction_id", spread))
    return out.withColumn("is_duplicate_transaction_ids", twice).drop("__none").withColumn("is_duplicate_transaction_content", same(*CONTENT))


def issue_counts(df: DataFrame, now: dt.datetime) -> DataFrame:
    """issue, count and pct (of all rows, 4 digits), from one aggregate."""
    f = flagged(df, now)
    names = [c[3:] for c in f.columns if c.startswith("is_")]
    one = f.agg(F.count("*").alias("n"), *[F.coalesce(F.sum(F.col(f"is_{x}").cast("int")), F.lit(0)).cast("long").alias(x) for x in names])
    rows = one.select("n", F.explode(F.array(*[F.struct(F.lit(x).alias("issue"), F.col(x).alias("count")) for x in names])).alias("x"))
    return rows.select("x.issue", "x.count", half_up(100.0 * F.col("x.count") / F.greatest("n", F.lit(1)), 4).alias("pct"))


def issue_samples(df: DataFrame, now: dt.datetime, k: int = 20) -> DataFrame:
    """issue, sample_ids: the first k ids in input order."""
    f = flagged(df, now)
    names = [c[3:] for c in f.columns if c.startswith("is_")]
    hits = f.select("transaction_id", "row_ord", F.explode(F.array_compact(F.array(*[F.when(F.col(f"is_{x}"), F.lit(x)) for x in names]))).alias("issue"))
    top = hits.withColumn("n", F.row_number().over(Window.partitionBy("issue").orderBy("row_ord"))).where(F.col("n") <= k)
    return top.groupBy("issue").agg(F.transform(F.sort_array(F.collect_list(F.struct("n", "transaction_id"))), lambda x: x["transaction_id"]).alias("sample_ids"))


def out_of_order(df: DataFrame, chunk: int = 100_000) -> DataFrame:
    """One row: how many rows are earlier than the row before them in input order. Rows are
    compared inside ranges of row_ord; each range's first meets the last of the range before."""
    own = df.select("row_ord", micros("timestamp").alias("us"), F.floor(F.col("row_ord") / chunk).alias("part"))
    inside = own.withColumn("prev", F.lag("us").over(Window.partitionBy("part").orderBy("row_ord")))
    n = inside.agg(F.coalesce(F.sum((F.col("us") < F.col("prev")).cast("int")), F.lit(0)).alias("n"))
    ends = own.groupBy("part").agg(F.min_by("us", "row_ord").alias("first"), F.max_by("us", "row_ord").alias("last"))
    seams = ends.withColumn("prev", F.lag("last").over(Window.orderBy("part"))).agg(F.coalesce(F.sum((F.col("first") < F.col("prev")).cast("int")), F.lit(0)).alias("m"))
    return n.crossJoin(seams).select((F.col("n") + F.col("m")).cast("long").alias("out_of_order_rows"))  # one row each


def summary(df: DataFrame) -> DataFrame:
    """One row of totals, the range of time and the distribution of amounts."""
    ends = df.select(F.explode(F.array("sender", "receiver")).alias("a")).where("a is not null").agg(F.count_distinct("a").alias("n_accounts"))
    one = df.agg(
        F.count("*").alias("n_rows"), F.count_distinct("transaction_id").alias("n_ids"), F.min(micros("timestamp")).alias("first_us"), F.max(micros("timestamp")).alias("last_us"),
        F.count("amount").alias("n_amounts"), F.avg("amount").alias("amount_mean"), F.median("amount").alias("amount_median"), F.stddev_samp("amount").alias("amount_std"), F.min("amount").alias("amount_min"), F.max("amount").alias("amount_max"),
    )
    return one.crossJoin(ends)  # one row each


def class_distribution(df: DataFrame) -> DataFrame:
    return df.groupBy("label").agg(F.count("*").alias("n"))


def top_scenarios(df: DataFrame, k: int = 50) -> DataFrame:
    return df.where("scenario_id <> ''").groupBy("scenario_id").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "scenario_id").limit(k)


def report(df: DataFrame, now: dt.datetime) -> DataFrame:
    """Issues with counts and samples, and in every row the number of issues that were found."""
    counts = issue_counts(df, now).join(issue_samples(df, now), "issue", "left")
    found = F.sum((F.col("count") > 0).cast("int")).over(Window.partitionBy())  # a row for each issue
    return counts.withColumn("categories_with_findings", found)

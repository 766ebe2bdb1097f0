"""Running totals over a whole table without a task that holds all of it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def totals_before(df: DataFrame, by: str, values: dict[str, str], *, descending: bool = False, ranges: int = 256) -> DataFrame:
    """df with, for each value column, the sum over all rows before in the order of `by`, under
    the given name. df has one row for each value of `by`.

    Quantiles of `by` cut the table into ranges of about as many rows, however the values lie;
    totals of ranges (`ranges` rows) add up to what comes before a range.
    """
    cuts = df.agg(F.percentile_approx(by, [i / ranges for i in range(1, ranges)], 10_000).alias("__cuts"))
    beyond = (lambda c: c > F.col(by)) if descending else (lambda c: c < F.col(by))
    part = F.coalesce(F.size(F.filter("__cuts", beyond)), F.lit(0))
    dealt = df.crossJoin(F.broadcast(cuts)).withColumn("__part", part).drop("__cuts")  # one row
    order = F.desc(by) if descending else F.asc(by)
    before = Window.partitionBy("__part").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    inside = dealt.withColumns({name: F.coalesce(F.sum(c).over(before), F.lit(0)) for c, name in values.items()})
    ahead = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    sums = dealt.groupBy("__part").agg(*[F.sum(c).alias(c) for c in values])
    offsets = sums.select("__part", *[F.coalesce(F.sum(c).over(ahead), F.lit(0)).alias(f"__{c}") for c in values])
    joined = inside.join(F.broadcast(offsets), "__part")
    return joined.select(*df.columns, *[(F.col(name) + F.col(f"__{c}")).alias(name) for c, name in values.items()])

"""Features of accounts by window. Windows are a grouping column; what is cumulative comes from
first sightings and running sums over a dense (account, window) grid, never from a loop."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlume.functions.columns import DAY_US, HOUR_US, count_where, ratio, zero_if_null
from ledgerlume.functions.config import INDICATOR_STRUCTURAL, PATTERN_ORDER
from ledgerlume.functions.durations import duration_us
from ledgerlume.operators import windows

KEYS = ["window_id", "account_id"]
# The feature groups, by their columns.
NETWORK = ("in_degree", "out_degree", "total_degree", "weighted_in_degree", "weighted_out_degree", "degree_ratio_out_in", "pagerank", "betweenness_centrality", "clustering_coefficient", "component_size", "neighbor_count", "intermediary_balance_ratio")
TRANSACTION = ("out_count", "out_amount", "out_amount_mean", "out_amount_median", "out_amount_std", "in_count", "in_amount", "in_amount_mean", "in_amount_median", "in_amount_std", "unique_receivers", "unique_senders", "repeated_receiver_count", "repeated_sender_count", "out_amount_concentration", "total_count", "total_amount", "log_total_amount", "amount_ratio_out_in", "unique_counterparties")
TEMPORAL = ("transaction_velocity", "median_time_gap_seconds", "min_time_gap_seconds", "max_time_gap_seconds", "burstiness", "activity_acceleration", "activity_trend_slope", "recent_vs_historical_activity", "activity_persistence_windows")
CHANGED = ("total_degree", "weighted_in_degree", "weighted_out_degree", "pagerank", "component_size", "neighbor_count", "total_count", "total_amount", "transaction_velocity")
DELTA = (*(f"delta_{c}" for c in CHANGED), "delta_connectivity")
INDICATORS = tuple(f"pattern_{p}" for p in PATTERN_ORDER)
ALL = (*NETWORK, *TRANSACTION, *TEMPORAL, *DELTA)


def transaction_features(w: DataFrame) -> DataFrame:
    """w: transfers with window_id. Zero where an account sent or received nothing."""

    def side(me: str, other: str, name: str, partners: str) -> DataFrame:
        by = w.where(F.col(me).isNotNull()).withColumnRenamed(me, "account_id")
        a = F.col("amount")
        base = by.groupBy(*KEYS).agg(F.count("*").alias(f"{name}_count"), F.sum(a).alias(f"{name}_amount"), F.avg(a).alias(f"{name}_amount_mean"), F.median(a).alias(f"{name}_amount_median"), F.stddev_samp(a).alias(f"{name}_amount_std"))
        pair = by.groupBy(*KEYS, other).agg(F.count("*").alias("n"), F.sum(a).alias("s")).where(F.col(other).isNotNull())
        total = F.sum("s")
        more = pair.groupBy(*KEYS).agg(F.count("*").alias(f"unique_{partners}s"), count_where(F.col("n") > 1).alias(f"repeated_{partners}_count"), F.when(total > 0, F.sum(F.col("s") * F.col("s")) / (total * total)).otherwise(0.0).alias(f"{name}_amount_concentration"))
        return base.join(more, KEYS, "left")

    both = side("sender", "receiver", "out", "receiver").join(side("receiver", "sender", "in", "sender").drop("in_amount_concentration"), KEYS, "full_outer").fillna(0)
    total = F.col("out_amount") + F.col("in_amount")
    return both.withColumns({
        "total_count": F.col("out_count") + F.col("in_count"), "total_amount": total, "log_total_amount": F.log1p(total), "amount_ratio_out_in": ratio(F.col("out_amount"), F.col("in_amount")),
        "unique_counterparties": F.col("unique_receivers") + F.col("unique_senders"),
    }).select(*KEYS, *TRANSACTION)


def legs(w: DataFrame) -> DataFrame:
    """Each transfer twice, once for either end (a transfer to oneself counts twice)."""
    return w.select("*", F.explode(F.array("sender", "receiver")).alias("account_id")).where("account_id is not null")


def grid(tx: DataFrame, size: str = "1d") -> DataFrame:
    """(window_id, account_id, first_us): every account from its first window on."""
    first = legs(windows.tumbling(tx, size)).groupBy("account_id").agg(F.min("window_id").alias("lo"), F.min("us").alias("first_us"))
    last = windows.bounds(tx, size, size).agg(F.max("window_id").alias("hi"))
    return first.crossJoin(F.broadcast(last)).select("account_id", "first_us", F.explode(F.sequence("lo", "hi")).alias("window_id"))  # one row


def temporal_features(tx: DataFrame, size: str = "1d") -> DataFrame:
    """Every account seen so far has a row in every window."""
    z = duration_us(size)
    own = legs(windows.tumbling(tx, size))
    gap = (F.col("us") - F.lag("us").over(Window.partitionBy(*KEYS).orderBy("us", "row_ord"))) / 1e6
    inside = own.withColumn("gap", gap).groupBy(*KEYS).agg(
        F.count("*").alias("cnt"), F.median("gap").alias("median_time_gap_seconds"), F.min("gap").alias("min_time_gap_seconds"), F.max("gap").alias("max_time_gap_seconds"),
        F.count("gap").alias("n_gaps"), F.avg("gap").alias("mu"), F.stddev_pop("gap").alias("sigma"),
    )
    dense = windows.with_extent(grid(tx, size), tx).join(inside, KEYS, "left").withColumn("cnt", F.coalesce("cnt", F.lit(0)))
    by = Window.partitionBy("account_id").orderBy("window_id")
    # an account's windows before its first hold nothing, yet count as windows
    before = lambda n: F.when(F.col("window_id") >= n, F.coalesce(F.lag("cnt", n).over(by), F.lit(0)))
    dense = dense.withColumns({"c1": before(1), "c2": before(2), "c3": before(3), "so_far": F.sum("cnt").over(by.rowsBetween(Window.unboundedPreceding, 0))})
    spread = F.col("sigma") + F.col("mu")
    end = F.col("t0") + (F.col("window_id") + 1) * z
    days = F.greatest(F.lit(1), F.floor((end - F.col("first_us")) / DAY_US))
    c1, c2, c3 = F.col("c1"), F.col("c2"), F.col("c3")
    slope = F.when(c3.isNotNull() & (c1 + c2 + c3 > 0), (c1 - c3) / 2.0).when(c3.isNull() & c2.isNotNull() & (c1 + c2 > 0), (c1 - c2).cast("double"))
    on = lambda c: F.coalesce(c > 0, F.lit(False))
    return dense.select(
        *KEYS, (F.col("cnt") / (z / HOUR_US)).alias("transaction_velocity"), "median_time_gap_seconds", "min_time_gap_seconds", "max_time_gap_seconds",
        F.when((F.col("n_gaps") >= 2) & (spread != 0), (F.col("sigma") - F.col("mu")) / spread).alias("burstiness"), (F.col("cnt") - c1).cast("double").alias("activity_acceleration"), slope.alias("activity_trend_slope"),
        (F.col("cnt") / (F.col("so_far") / days + F.lit(1e-9))).alias("recent_vs_historical_activity"),
        F.when(on(c1) & on(c2) & on(c3), 3).when(on(c1) & on(c2), 2).when(on(c1), 1).otherwise(0).alias("activity_persistence_windows"),
    )


def degree_features(tx: DataFrame, size: str = "1d") -> DataFrame:
    """Degrees, weights and neighbours in the graph of all time before a window's end."""
    w = windows.tumbling(tx, size)
    first = w.groupBy("sender", "receiver").agg(F.min("window_id").alias("window_id"))
    ends = lambda c: F.col(c).alias("account_id")
    n = lambda df, c, name: df.groupBy("window_id", ends(c)).agg(F.count("*").alias(name))
    near = w.select("window_id", F.least("sender", "receiver").alias("a"), F.greatest("sender", "receiver").alias("b")).groupBy("a", "b").agg(F.min("window_id").alias("window_id"))
    near = near.select("window_id", F.explode(F.array_distinct(F.array("a", "b"))).alias("account_id")).groupBy(*KEYS).agg(F.count("*").alias("neighbor_count"))
    money = lambda c, name: w.groupBy("window_id", ends(c)).agg(F.sum("amount").alias(name))
    parts = [n(first, "receiver", "in_degree"), n(first, "sender", "out_degree"), near, money("receiver", "weighted_in_degree"), money("sender", "weighted_out_degree")]
    out = grid(tx, size).drop("first_us")
    for p in parts:
        out = out.join(p, KEYS, "left")
    so_far = Window.partitionBy("account_id").orderBy("window_id").rowsBetween(Window.unboundedPreceding, 0)
    names = ["in_degree", "out_degree", "neighbor_count", "weighted_in_degree", "weighted_out_degree"]
    out = out.fillna(0).select(*KEYS, *[F.sum(c).over(so_far).alias(c) for c in names])
    i, o = F.col("in_degree"), F.col("out_degree")
    balance = F.when(i + o > 0, F.least(i, o) / (F.greatest(i, o) + F.lit(1e-9))).otherwise(0.0)
    return out.withColumns({"total_degree": i + o, "degree_ratio_out_in": ratio(o, i), "intermediary_balance_ratio": balance})


def network_features(tx: DataFrame, size: str = "1d", betweenness_sources: int | None = 100, seed: int = 42) -> DataFrame:
    """degree_features with PageRank, betweenness, clustering and component size."""
    from ledgerlume.operators import centrality

    return degree_features(tx, size).join(centrality.by_window(tx, size, betweenness_sources, seed), KEYS, "left").select(*KEYS, *NETWORK)


def change_features(table: DataFrame) -> DataFrame:
    """table with the difference of each changing column to the account's row before."""
    by = Window.partitionBy("account_id").orderBy("window_id")
    there = [c for c in CHANGED if c in table.columns]
    out = table.withColumns({f"delta_{c}": F.col(c) - F.lag(c).over(by) for c in there})
    return out.withColumn("delta_connectivity", zero_if_null(F.col("delta_total_degree")) + zero_if_null(F.col("delta_neighbor_count")))


def build(tx: DataFrame, size: str = "1d", betweenness_sources: int | None = 100, network: DataFrame | None = None) -> DataFrame:
    """The whole table. Of columns ending in _count or _amount a null is zero; others stay null."""
    own = network_features(tx, size, betweenness_sources) if network is None else network
    out = own.join(transaction_features(windows.tumbling(tx, size)), KEYS, "left").join(temporal_features(tx, size), KEYS, "left")
    out = out.fillna(0, [c for c in out.columns if c.endswith(("_count", "_amount"))])
    return change_features(out)


def _flag(p: str) -> Column:
    return F.max((F.col("pattern_type") == p).cast("int")).alias(f"pattern_{p}")


def indicators(events: DataFrame) -> DataFrame:
    """By (window, account): which patterns the account is part of, counts and strengths."""
    own = events.where(F.col("pattern_type").isin(*PATTERN_ORDER) & F.col("window_id").isNotNull())
    accounts = F.array_distinct(F.filter(F.transform(F.col("accounts"), lambda a: F.trim(a)), lambda a: a.isNotNull() & (a != "")))
    each = own.select("window_id", "pattern_type", F.coalesce("pattern_strength", F.lit(1.0)).alias("strength"), F.explode(accounts).alias("account_id"))
    structural = F.col("pattern_type").isin(*INDICATOR_STRUCTURAL)
    return each.groupBy(*KEYS).agg(
        *map(_flag, PATTERN_ORDER), F.count("*").alias("pattern_event_count"), F.count_distinct("pattern_type").alias("pattern_type_count"), F.sum("strength").alias("pattern_strength_sum"), F.avg("strength").alias("pattern_strength_mean"),
        count_where(structural).alias("pattern_structural_count"), count_where(~structural).alias("pattern_temporal_count"),
    )


def parse_accounts(text: Column) -> Column:
    """An account list written as text, such as ['a', 'b'], ("a",) or {'a'}, or one name."""
    inner = F.regexp_replace(F.trim(text), r"^[\[\(\{]|[\]\)\}]$", "")
    return F.filter(F.transform(F.split(inner, ","), lambda x: F.trim(F.regexp_replace(F.trim(x), "^['\"]|['\"]$", ""))), lambda x: x != "")


def attach_indicators(features: DataFrame, ind: DataFrame) -> DataFrame:
    """features with the indicators of their key; zero where there are none."""
    own = [c for c in ind.columns if c not in KEYS]
    keyed = features.drop(*own).withColumn("account_id", F.trim(F.col("account_id").cast("string")))
    return keyed.join(ind.dropDuplicates(KEYS), KEYS, "left").fillna(0, own)


def as_float32(df: DataFrame) -> DataFrame:
    return df.select(*[F.col(c).cast("float").alias(c) if k == "double" else F.col(c) for c, k in df.dtypes])

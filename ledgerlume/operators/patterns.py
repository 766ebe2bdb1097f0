"""Detectors of fund-flow patterns. Each returns events of one layout (EVENT below).

Same-timestamp order is (timestamp, row_ord). Joins are equi-joins on an account and a time
bucket or an ordinal, so that a hub meets its neighbours in time and not its whole history.
"""

from __future__ import annotations

import functools

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlume.functions.columns import DAY_US, HOUR_US, capped, half_up, micros, ordered, zero_if_null
from ledgerlume.functions.config import PATTERN_ORDER, Settings
from ledgerlume.functions.durations import duration_us
from ledgerlume.operators import timeslices, windows
from ledgerlume.operators.graph import can_checkpoint, weak_components

EVENT = ("pattern_type", "window_id", "timestamp", "span", "central_account", "accounts", "transaction_ids", "pattern_strength", "evidence")


def _event(kind: str, window: Column, us: Column, central: Column, accounts: Column, ids: Column, strength: Column, evidence: dict[str, Column], span: Column | None = None) -> list[Column]:
    return [
        F.lit(kind).alias("pattern_type"), window.cast("int").alias("window_id"), F.timestamp_micros(us).alias("timestamp"), (F.lit(None).cast("string") if span is None else span).alias("span"), central.alias("central_account"),
        accounts.alias("accounts"), ids.alias("transaction_ids"), half_up(strength.cast("double"), 4).alias("pattern_strength"), F.to_json(F.struct(*[c.alias(k) for k, c in evidence.items()])).alias("evidence"),
    ]


def _fan(w: DataFrame, kind: str, hub: str, other: str, least: int, label: str) -> DataFrame:
    g = w.groupBy("window_id", hub).agg(
        F.count_distinct(other).alias("n"), F.sum("amount").alias("total"), F.avg("amount").alias("mean"), zero_if_null(F.stddev_samp("amount")).alias("std"), F.min("us").alias("first"), F.max("us").alias("last"),
        ordered(F.struct(F.col(other).alias("o"), F.col("transaction_id").alias("t")), "us", "row_ord").alias("rows"),
    ).where(F.col("n") >= least)
    others = F.array_distinct(F.transform("rows", lambda r: r["o"]))
    return g.select(*_event(kind, F.col("window_id"), F.col("first"), F.col(hub), F.concat(F.array(hub), others), F.transform("rows", lambda r: r["t"]), capped(F.col("n") / (2.0 * least)), {label: F.col("n"), "total_amount": F.col("total"), "mean_amount": F.col("mean"), "amount_std": F.col("std"), "time_span_seconds": (F.col("last") - F.col("first")) / 1e6}))


def fan_in(tx: DataFrame, size: str = "1d", min_senders: int = 4) -> DataFrame:
    """Receivers with enough distinct senders in a window."""
    return _fan(windows.tumbling(tx, size), "fan_in", "receiver", "sender", min_senders, "n_senders")


def fan_out(tx: DataFrame, size: str = "1d", min_receivers: int = 4) -> DataFrame:
    """Senders with enough distinct receivers in a window."""
    return _fan(windows.tumbling(tx, size), "fan_out", "sender", "receiver", min_receivers, "n_receivers")


def _with_extent(tx: DataFrame) -> DataFrame:
    return windows.with_extent(tx, tx).withColumn("us", micros("timestamp"))


def layering_chains(tx: DataFrame, max_hops: int = 6, gap_hours: float = 24, tolerance: float = 0.3, min_hops: int = 1) -> DataFrame:
    """The greedy chain of every transfer, if it has min_hops or more: (start, hops: array of its
    transfers, accounts).

    A round joins every open chain's end with the sends of that account in its own and the
    next time bucket of the length of the gap, and keeps the earliest that fits. Each round is a
    checkpoint of the chains that went on; few live past the first.
    """
    can_checkpoint(tx.sparkSession)
    gap = int(gap_hours * HOUR_US)
    own = tx.withColumn("us", micros("timestamp")).select("transaction_id", "sender", "receiver", "amount", "us", "row_ord")
    leg = F.struct("us", "row_ord", "transaction_id", "sender", "receiver", "amount")
    sends = own.select(F.col("sender").alias("at"), F.floor(F.col("us") / gap).alias("bucket"), leg.alias("next"))
    chains = own.select(F.col("transaction_id").alias("start"), F.array(leg).alias("hops"), F.array("sender", "receiver").alias("accounts"))
    done = None
    for n in range(1, max_hops):
        last = F.element_at("hops", -1)
        b = F.floor(last["us"] / gap)
        open_ = chains.withColumn("at", last["receiver"]).withColumn("bucket", F.explode(F.array(b, b + 1)))
        fits = (F.col("next.us") > last["us"]) & (F.col("next.us") <= last["us"] + gap) & (F.col("next.amount") >= last["amount"] * (1 - tolerance)) & (F.col("next.amount") <= last["amount"] * 1.05) & ~F.array_contains("accounts", F.col("next.receiver"))
        best = open_.join(sends, ["at", "bucket"]).where(fits).groupBy("start").agg(F.min("next").alias("next"), F.first("hops").alias("hops"), F.first("accounts").alias("accounts"))
        grown = best.select("start", F.concat("hops", F.array("next")).alias("hops"), F.concat("accounts", F.array("next.receiver")).alias("accounts")).checkpoint()
        if n >= min_hops:
            ended = chains.join(grown.select("start"), "start", "left_anti")
            done = ended if done is None else done.unionByName(ended)
        chains = grown
    return chains if done is None else done.unionByName(chains)


def _unsuppressed(pdf: pd.DataFrame) -> pd.DataFrame:
    used: set[str] = set()
    keep = []
    for r in pdf.sort_values(["us", "row_ord"]).itertuples(index=False):
        if r.start not in used:
            keep.append(r.start)
            used.update(r.ids)
    return pd.DataFrame({"start": keep})


def suppressed(flat: DataFrame, rounds: int = 12) -> DataFrame:
    """(start) of chains that begin with a transfer of an earlier chain that stays.

    flat: (start, us, row_ord, ids). Hops are strictly later than the start, so "holds the
    start of" never leads back. A chain whose start no open chain holds stays, and what it
    holds goes; each round settles all such chains at once. What is left after `rounds` is
    folded in order, apart for each connected group.
    """
    can_checkpoint(flat.sparkSession)
    starts = flat.select(F.col("start").alias("id"))
    held = flat.select(F.col("start").alias("by"), F.explode("ids").alias("id")).where("by <> id")
    edges = held.join(starts, "id").select("by", F.col("id").alias("start")).distinct().checkpoint()
    gone = flat.sparkSession.createDataFrame([], flat.select("start").schema)
    left = edges.limit(1).count()
    while left and rounds:
        stays = edges.select("by").distinct().join(edges.select(F.col("start").alias("by")).distinct(), "by", "left_anti").checkpoint()
        now = edges.join(stays, "by").select("start").distinct().checkpoint()
        rest = edges.join(stays, "by", "left_anti").join(now, "start", "left_anti").join(now.withColumnRenamed("start", "by"), "by", "left_anti")
        gone, edges, rounds = gone.unionByName(now), rest.checkpoint(), rounds - 1
        left = edges.limit(1).count()
    if not left:
        return gone
    nodes = edges.select(F.explode(F.array("by", "start")).alias("start")).distinct()
    group = weak_components(edges, a="by", b="start")
    dealt = flat.join(nodes, "start", "left_semi").join(group, F.col("start") == group.node).select("component", "start", "us", "row_ord", "ids")
    kept = dealt.groupBy("component").applyInPandas(_unsuppressed, "start string")
    return gone.unionByName(nodes.join(kept, "start", "left_anti"))


def layering(tx: DataFrame, size: str = "1d", min_hops: int = 3, max_hops: int = 6, gap_hours: float = 24, tolerance: float = 0.3) -> DataFrame:
    """Chains of enough hops. A transfer of an emitted chain starts no later one."""
    long = layering_chains(tx, max_hops, gap_hours, tolerance, min_hops).where(F.size("hops") >= min_hops).checkpoint()
    first = F.get("hops", 0)
    flat = long.select("start", first["us"].alias("us"), first["row_ord"].alias("row_ord"), F.transform("hops", lambda h: h["transaction_id"]).alias("ids"))
    ended = windows.with_extent(long.join(suppressed(flat), "start", "left_anti"), tx)
    n, last = F.size("hops"), F.element_at("hops", -1)
    window = windows.window_of(last["us"], F.col("t0"), F.col("t1"), size, size)
    strength = capped((n - min_hops + 1) / float(max_hops - min_hops + 1))
    kept_share = F.when(first["amount"] != 0, last["amount"] / first["amount"]).otherwise(0.0)
    return ended.select(*_event("layering", window, first["us"], first["sender"], F.col("accounts"), F.transform("hops", lambda h: h["transaction_id"]), strength, {"n_hops": n, "start_amount": first["amount"], "end_amount": last["amount"], "amount_retention_ratio": kept_share, "total_duration_hours": (last["us"] - first["us"]) / float(HOUR_US)}))


def split_merge(tx: DataFrame, size: str = "1d", window: str = "2d") -> DataFrame:
    """The first transfer of each sender after which it pays two or more receivers of whom two
    or more pay one account. Each slice of time finds its first one; of these the first stays."""
    z = duration_us(window)
    found = timeslices.by_slices(tx, DAY_US, 2 * z, functools.partial(timeslices.merges, z=z), timeslices.MERGE)
    e = F.min_by(F.struct("t", "targets", "rows", "dest", "ids"), F.struct("t", "o")).alias("e")
    placed = windows.with_extent(found.groupBy("source").agg(e).select("source", "e.*"), tx)
    n = F.size("targets")
    return placed.select(*_event(
        "split_merge", windows.window_of(F.col("t"), F.col("t0"), F.col("t1"), size, size), F.col("t"), F.col("source"), F.array_distinct(F.concat(F.array("source"), "targets", F.array("dest"))),
        F.array_distinct(F.concat("rows", "ids")), capped(n / 4.0), {"split_targets": F.col("targets"), "merge_destination": F.col("dest"), "n_split_paths": n},
    ))


def circular_flow(tx: DataFrame, size: str = "1d", max_length: int = 6, days: float = 7, starts: DataFrame | None = None, branching: int | None = 5) -> DataFrame:
    """Cycles of strictly later transfers that return to their first sender within `days`.

    starts: (account_id) the accounts that may start one; None for all. branching: how many of an
    account's later sends are followed, the first ones; None for all of them.
    """
    span = int(days * DAY_US)
    solve = functools.partial(timeslices.cycles, max_length=max_length, days_us=span, branching=branching)
    placed = windows.with_extent(timeslices.by_slices(tx, DAY_US, span, solve, timeslices.CYCLE, "amount", starts=starts), tx)
    n = F.size("ids")
    return placed.select(*_event(
        "circular_flow", windows.window_of(F.col("last_us"), F.col("t0"), F.col("t1"), size, size), F.col("first_us"), F.get("accounts", 0), F.col("accounts"), F.col("ids"), capped(F.lit(1.0) / (n + 1) * 3),
        {"cycle_length": n, "duration_hours": (F.col("last_us") - F.col("first_us")) / float(HOUR_US), "start_amount": F.col("start_amount"), "closing_amount": F.col("closing_amount")},
    ))


def pass_through(tx: DataFrame, hold_hours: float = 48) -> DataFrame:
    """(account, in leg, out leg): each incoming leg with the nearest outgoing one at or after it
    within the time, unless that is the same transfer; of incoming legs with one outgoing leg
    the first. One sort by account and time, no range join."""
    own = tx.withColumn("us", micros("timestamp"))
    leg = F.struct("us", "row_ord", "transaction_id", "sender", "receiver", "amount")
    inc = own.select(F.col("receiver").alias("account"), "us", F.lit(0).alias("kind"), "row_ord", leg.alias("leg"))
    out = own.select(F.col("sender").alias("account"), "us", F.lit(1).alias("kind"), "row_ord", leg.alias("leg"))
    # from the last leg backwards, so that the frame only grows: one step for each leg
    ahead = Window.partitionBy("account").orderBy(F.desc("us"), F.desc("kind"), F.desc("row_ord")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    nearest = inc.unionByName(out).withColumn("o", F.last(F.when(F.col("kind") == 1, F.col("leg")), ignorenulls=True).over(ahead)).where("kind = 0")
    near = nearest.where(F.col("o").isNotNull() & (F.col("o.us") - F.col("us") <= int(hold_hours * HOUR_US)) & (F.col("o.transaction_id") != F.col("leg.transaction_id")))
    first = F.row_number().over(Window.partitionBy("account", "o.transaction_id").orderBy("us", "row_ord")) == 1
    return near.withColumn("one", first).where("one").select("account", F.col("leg").alias("i"), "o")


def rapid_pass_through(tx: DataFrame, size: str = "1d", hold_hours: float = 48) -> DataFrame:
    p = windows.with_extent(pass_through(tx, hold_hours), tx)
    hours = (F.col("o.us") - F.col("i.us")) / float(HOUR_US)
    share = F.when(F.col("i.amount") != 0, F.col("o.amount") / F.col("i.amount")).otherwise(0.0)
    return p.select(*_event(
        "rapid_pass_through", windows.window_of(F.col("o.us"), F.col("t0"), F.col("t1"), size, size), F.col("i.us"), F.col("account"), F.array("i.sender", "account", "o.receiver"), F.array("i.transaction_id", "o.transaction_id"),
        F.greatest(F.lit(0.0), capped(1 - hours / hold_hours)), {"hold_time_hours": hours, "in_amount": F.col("i.amount"), "out_amount": F.col("o.amount"), "retention": share},
    ))


def anchored_episodes(events: DataFrame, keys: list[str], us: str, days: float, *ties: str) -> DataFrame:
    """events with episode: an episode takes what is at most `days` after its first event. Not
    gap-based. A fold over the sorted moments of a key gives the episodes' starts (a key's
    moments are 8 bytes each); an event's episode is the last start at or before it, by one sort
    of starts and events, never a pair of each event and each episode."""
    span = int(days * DAY_US)
    moments = events.groupBy(*keys).agg(F.array_sort(F.collect_set(us)).alias("m"))
    fold = F.aggregate("m", F.array().cast("array<bigint>"), lambda acc, t: F.when((F.size(acc) == 0) | (t - F.element_at(acc, F.greatest(F.size(acc), F.lit(1))) > span), F.concat(acc, F.array(t))).otherwise(acc))
    starts = moments.select(*keys, F.posexplode(fold).alias("episode", us)).withColumn("__event", F.lit(False))
    row = events.select(*[F.col(c) for c in keys], us, F.lit(True).alias("__event"), F.struct(*events.columns).alias("__row"))
    so_far = Window.partitionBy(*keys).orderBy(us, "__event").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = row.unionByName(starts, allowMissingColumns=True).withColumn("__episode", F.last("episode", ignorenulls=True).over(so_far)).where("__event AND __episode IS NOT NULL")
    return placed.select("__row.*", F.col("__episode").alias("episode"))


def repeated_intermediary(tx: DataFrame, size: str = "1d", hold_hours: float = 48, min_count: int = 3, days: float = 10) -> DataFrame:
    """Episodes of one account that passes through often enough."""
    p = pass_through(tx, hold_hours).withColumn("us", F.col("i.us")).withColumn("ord", F.col("i.row_ord"))
    e = anchored_episodes(p, ["account"], "us", days)
    hours = (F.col("o.us") - F.col("i.us")) / float(HOUR_US)
    g = e.groupBy("account", "episode").agg(
        F.count("*").alias("n"), F.min("us").alias("first"), F.max("us").alias("last"), F.max_by(F.col("o.us"), F.struct("us", "ord")).alias("last_out"), F.avg(hours).alias("hold"), F.count_distinct("i.sender").alias("up"), F.count_distinct("o.receiver").alias("down"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.array("i.sender", "account", "o.receiver"))))).alias("accounts"), ordered(F.array("i.transaction_id", "o.transaction_id"), "us", "ord").alias("ids"), F.array_sort(F.collect_list("us")).alias("times"),
    ).where(F.col("n") >= min_count)
    placed = windows.with_extent(g, tx)
    gaps = F.array_max(F.zip_with(F.slice("times", 2, F.size("times")), F.slice("times", 1, F.size("times") - 1), lambda b, a: b - a))
    return placed.select(*_event(
        "repeated_intermediary", windows.window_of(F.col("last_out"), F.col("t0"), F.col("t1"), size, size), F.col("last"), F.col("account"), F.col("accounts"), F.array_distinct(F.flatten("ids")), capped(F.col("n") / (2.0 * min_count)),
        {"pass_through_count": F.col("n"), "upstream_accounts": F.col("up"), "downstream_accounts": F.col("down"), "mean_hold_time_hours": F.col("hold"), "episode_start_us": F.col("first"), "episode_end_us": F.col("last"), "span_days": (F.col("last") - F.col("first")) / float(DAY_US), "max_gap_days": zero_if_null(gaps / float(DAY_US))},
    ))


def escalating_connectivity(features: DataFrame, min_windows: int = 2, min_total: float = 3.0) -> DataFrame:
    """Runs of an account's consecutive rows whose connectivity rises, long and steep enough."""
    by = Window.partitionBy("account_id").orderBy("window_id")
    up = F.coalesce(F.col("delta_connectivity") > 0, F.lit(False))
    island = F.sum((~up).cast("int")).over(by.rowsBetween(Window.unboundedPreceding, 0))
    runs = features.select("account_id", "window_id", "delta_connectivity", up.alias("up"), island.alias("island")).where("up")
    g = runs.groupBy("account_id", "island").agg(F.count("*").alias("n"), F.sum("delta_connectivity").alias("total"), F.min("window_id").alias("a"), F.max("window_id").alias("b")).where((F.col("n") >= min_windows) & (F.col("total") >= min_total))
    span = F.concat(F.lit("window_"), F.col("a").cast("string"), F.lit("_to_"), F.col("b").cast("string"))
    none = F.lit(None).cast("bigint")
    return g.select(*_event("escalating_connectivity", F.col("b"), none, F.col("account_id"), F.array("account_id"), F.array().cast("array<string>"), capped(F.col("total") / (3 * min_total)), {"n_windows": F.col("n"), "total_delta": F.col("total"), "start_window": F.col("a"), "end_window": F.col("b")}, span))


def participants(events: DataFrame) -> DataFrame:
    return events.select(F.explode("accounts").alias("account_id")).distinct()


def detect_all(tx: DataFrame, settings: Settings | None = None, features: DataFrame | None = None, scope: str | None = "structural") -> DataFrame:
    """Every detector's events. scope: which accounts may start a cycle: participants of
    structural events ("structural"), of any other event ("all"), or all accounts (None)."""
    s = settings or Settings()
    w = s.window_size
    structural = fan_in(tx, w, s.fan_in_senders).unionByName(fan_out(tx, w, s.fan_out_receivers)).unionByName(layering(tx, w, s.layering_min_hops, s.layering_max_hops, s.layering_gap_hours, s.layering_tolerance)).unionByName(split_merge(tx, w, s.split_merge_window))
    others = rapid_pass_through(tx, w, s.hold_hours).unionByName(repeated_intermediary(tx, w, s.hold_hours, s.intermediary_count, s.intermediary_days))
    if scope not in (None, "structural", "all"):
        raise ValueError(f"scope must be structural, all or None, not {scope!r}")
    if scope is not None:  # read for the starts and in the end
        can_checkpoint(tx.sparkSession)
        structural = structural.checkpoint()
    starts = None if scope is None else participants(structural if scope == "structural" else structural.unionByName(others))
    out = structural.unionByName(others).unionByName(circular_flow(tx, w, s.cycle_length, s.cycle_days, starts, s.cycle_branching))
    return out if features is None else out.unionByName(escalating_connectivity(features, s.rising_windows, s.rising_total))


def detector_rank(kind: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, PATTERN_ORDER)), kind).cast("int")


def type_summary(events: DataFrame) -> DataFrame:
    return events.groupBy("pattern_type").agg(F.count("*").alias("n"), half_up(F.avg("pattern_strength"), 6).alias("mean_strength"), F.count_distinct("central_account").alias("n_central"))

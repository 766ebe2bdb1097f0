"""Read-only queries over the store, one for each endpoint of a dashboard."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlume.functions.columns import count_where, half_up
from ledgerlume.operators.evidence import NOT_EVALUATED

STRUCTURAL = ("fan_in", "fan_out", "layering", "split_merge")


def health() -> dict[str, str]:
    return {"status": "ok"}


def stub(action: str) -> dict[str, str]:
    """analyze, retrain and upload are accepted and do nothing."""
    if action not in ("analyze", "retrain", "upload"):
        raise ValueError(f"no action {action!r}")
    return {"status": "accepted", "action": action}


def summary(tx: DataFrame, events: DataFrame, candidates: DataFrame, scores: DataFrame) -> DataFrame:
    """One row of counts, levels and the mean score."""
    n = lambda df, name: df.agg(F.count("*").alias(name))
    levels = scores.agg(F.count("*").alias("n_scores"), *[count_where(F.col("risk_level") == x).alias(f"n_{x.lower()}") for x in ("LOW", "MODERATE", "HIGH", "CRITICAL")], half_up(F.avg("risk_score"), 2).alias("avg_risk"))
    return n(tx, "n_transactions").crossJoin(n(events, "n_events")).crossJoin(n(candidates, "n_candidates")).crossJoin(levels)  # one row each


def page(df: DataFrame, limit: int, offset: int) -> DataFrame:
    return df.offset(offset).limit(limit)


def alerts(candidates: DataFrame, scores: DataFrame, risk_level: str | None = None, limit: int = 50, offset: int = 0) -> DataFrame:
    """Scored candidates, the highest first; of one level or of all."""
    own = candidates.select("candidate_ring_id", F.size("accounts").alias("n_accounts")).join(scores, "candidate_ring_id")
    if risk_level is not None:
        own = own.where(F.col("risk_level") == risk_level.upper())
    return page(own.orderBy(F.desc("risk_score"), "candidate_ring_id"), limit, offset)


def rings(candidates: DataFrame, scores: DataFrame, limit: int = 50, offset: int = 0) -> DataFrame:
    own = candidates.join(scores.select("candidate_ring_id", "risk_score", "risk_level"), "candidate_ring_id", "left").withColumn("note", F.when(F.col("risk_score").isNull(), NOT_EVALUATED))
    return page(own.orderBy(F.desc_nulls_last("risk_score"), "candidate_ring_id"), limit, offset)


def ring(candidates: DataFrame, scores: DataFrame, ring_id: str) -> DataFrame:
    return rings(candidates.where(F.col("candidate_ring_id") == ring_id), scores, 1)


def ring_graph(records: DataFrame, ring_id: str) -> DataFrame:
    return records.where(F.col("candidate_ring_id") == ring_id).select("candidate_ring_id", "evidence_subgraph.nodes", "evidence_subgraph.edges")


def ring_timeline(candidates: DataFrame, ring_id: str) -> DataFrame:
    """What the candidate's trajectory holds; what it doesn't store is empty, not made up."""
    return candidates.where(F.col("candidate_ring_id") == ring_id).select(
        "candidate_ring_id", "start_us", "end_us", "formation_stage", "pattern_sequence", "event_window_ids", F.array().cast("array<string>").alias("pattern_transitions"), F.lit(0).alias("pattern_escalation_steps"), F.lit(False).alias("has_structural_sequence"),
    )


def ring_patterns(candidates: DataFrame, events: DataFrame, ring_id: str, limit: int = 500) -> DataFrame:
    """Events that share an account with the candidate, by window and time."""
    own = candidates.where(F.col("candidate_ring_id") == ring_id).select(F.explode("accounts").alias("a")).distinct()
    keyed = events.withColumn("__k", F.xxhash64("pattern_type", "window_id", "timestamp", "span", "central_account", "accounts", "transaction_ids"))
    hit = keyed.select("__k", F.explode("accounts").alias("a")).join(F.broadcast(own), "a", "left_semi").select("__k").distinct()
    return keyed.join(hit, "__k", "left_semi").drop("__k").orderBy("window_id", "timestamp", "pattern_type", "central_account").limit(limit)


def ring_evidence(records: DataFrame, ring_id: str, limit: int = 500) -> DataFrame:
    return records.where(F.col("candidate_ring_id") == ring_id).withColumn("transactions", F.slice("evidence_subgraph.edges", 1, limit)).drop("evidence_subgraph")


def ring_explanation(explanations: DataFrame, ring_id: str) -> DataFrame:
    return explanations.where(F.col("candidate_ring_id") == ring_id)


def account(tx: DataFrame, candidates: DataFrame, account_id: str) -> DataFrame:
    """One row: transfers in and out and the candidates that hold the account."""
    n = tx.where((F.col("sender") == account_id) | (F.col("receiver") == account_id)).agg(count_where(F.col("receiver") == account_id).alias("n_in"), count_where(F.col("sender") == account_id).alias("n_out"))
    member = candidates.where(F.array_contains("accounts", account_id)).agg(F.array_join(F.array_sort(F.collect_list("candidate_ring_id")), ",").alias("candidates"))
    return n.crossJoin(member).withColumn("account_id", F.lit(account_id))  # one row each


def transactions(tx: DataFrame, account_id: str | None = None, limit: int = 100, offset: int = 0) -> DataFrame:
    own = tx if account_id is None else tx.where((F.col("sender") == account_id) | (F.col("receiver") == account_id))
    return page(own.orderBy(F.desc("timestamp"), "row_ord"), limit, offset)


def patterns(events: DataFrame, pattern_type: str | None = None, limit: int = 100, offset: int = 0) -> DataFrame:
    own = events if pattern_type is None else events.where(F.col("pattern_type") == pattern_type)
    return page(own.orderBy("window_id", "timestamp", "pattern_type", "central_account"), limit, offset)


def metric_tree(rows: DataFrame) -> DataFrame:
    """(method, metrics by split) of rows (method, split, metric, value)."""
    inner = rows.groupBy("method", "split").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("metric", "value")))).alias("m"))
    return inner.groupBy("method").agg(F.map_from_entries(F.collect_list(F.struct("split", "m"))).alias("metrics"))


def lead_time(leads: DataFrame | None) -> dict[str, object]:
    """The summary row, or a note where nothing was measured."""
    row = None if leads is None else leads.first()
    return {"note": "lead time has not been computed"} if row is None else row.asDict()


def models(rows: DataFrame) -> DataFrame:
    return rows.select("method").distinct()


def event_counts(events: DataFrame) -> DataFrame:
    """Counts by type, the largest first, and whether the type is structural."""
    return events.groupBy("pattern_type").agg(F.count("*").alias("n")).withColumn("structural", F.col("pattern_type").isin(*STRUCTURAL)).orderBy(F.desc("n"), "pattern_type")


def search(tx: DataFrame, text: str) -> DataFrame:
    """One row over transfers that hold the text in any field, in either case: count, labelled
    count and amount."""
    fields = F.lower(F.concat_ws(" ", "transaction_id", "sender", "receiver", F.col("amount").cast("string"), "scenario_id", "ring_id"))
    return tx.where(F.contains(fields, F.lit(text.lower()))).agg(F.count("*").alias("n"), count_where(F.col("label") == 1).alias("n_labelled"), F.coalesce(F.sum("amount"), F.lit(0.0)).alias("amount"))


def alert_queue(scores: DataFrame) -> DataFrame:
    """One row: alerts, high (50 or more, critical ones too) and critical (75 or more)."""
    return scores.agg(F.count("*").alias("n"), count_where(F.col("risk_score") >= 50).alias("n_high"), count_where(F.col("risk_score") >= 75).alias("n_critical"))

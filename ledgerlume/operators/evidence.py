"""Evidence of candidates: transfers, subgraph, notable paths, and an explanation in words."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlume.operators.scoring import PARTS

# What each pattern is called in an explanation, and the notes.
DESCRIPTIONS = {
    "fan_in": "multiple accounts converging funds into one", "fan_out": "one account distributing funds to many", "layering": "rapid multi-hop pass-through of funds", "split_merge": "funds split across accounts then recombined",
    "circular_flow": "funds returning to their origin", "repeated_intermediary": "an account repeatedly used as a pass-through", "rapid_pass_through": "funds held only briefly before forwarding", "escalating_connectivity": "growing network connectivity over time",
}
FULL_SEQUENCE = "fan-in collector -> layering chain -> fan-out distribution (full structural sequence observed)"
LAYERED = "layering chain observed (see layering pattern evidence for exact hops)"
CLOSED = "circular flow closes back toward an originating account"
NOT_EVALUATED = "Not yet evaluated"
DISCLAIMER = "A risk score indicates investigative priority and does not establish criminal guilt."
HOW_EARLY = "Computed by the lead-time engine (Phase 15), not this module."
ROLES = {"fan_in": "possible_collector", "fan_out": "possible_distributor", "repeated_intermediary": "possible_mule"}


def transactions(candidates: DataFrame, tx: DataFrame) -> DataFrame:
    """(candidate_ring_id, a transfer of it) by a join on the transfer's id."""
    ids = candidates.select("candidate_ring_id", F.explode(F.array_distinct("transaction_ids")).alias("transaction_id"))
    return ids.join(tx.select("transaction_id", "sender", "receiver", "amount", "timestamp", "row_ord"), "transaction_id")


def subgraph(own: DataFrame) -> DataFrame:
    """(candidate_ring_id, nodes, edges) of transactions(), both in input order."""
    edge = F.struct("row_ord", "transaction_id", "sender", "receiver", "amount", "timestamp")
    rows = own.groupBy("candidate_ring_id").agg(F.sort_array(F.collect_list(edge)).alias("rows"))
    nodes = F.array_distinct(F.flatten(F.transform("rows", lambda r: F.array(r["sender"], r["receiver"]))))
    return rows.select(
        "candidate_ring_id", F.transform(nodes, lambda n: F.struct(n.alias("id"), n.alias("label"))).alias("nodes"),
        F.transform("rows", lambda r: F.struct(r["transaction_id"].alias("id"), r["sender"].alias("source"), r["receiver"].alias("target"), r["amount"].alias("amount"), r["timestamp"].alias("timestamp"))).alias("edges"),
    )


def notable_paths(patterns: Column) -> Column:
    has = lambda p: F.array_contains(patterns, p)
    return F.array_compact(F.array(F.when(has("fan_in") & has("layering") & has("fan_out"), FULL_SEQUENCE).when(has("layering"), LAYERED), F.when(has("circular_flow"), CLOSED)))


def _or_null(df: DataFrame, name: str, kind: str) -> Column:
    """A column that some candidate tables have not."""
    return F.col(name) if name in df.columns else F.lit(None).cast(kind).alias(name)


def _scored(candidates: DataFrame, scores: DataFrame | None) -> DataFrame:
    """candidates with risk_score, risk_level, score_components and top_factors; null without scores."""
    if scores is None:
        parts = ", ".join(f"{p}: double" for p in PARTS)
        return candidates.withColumns({"risk_score": F.lit(None).cast("double"), "risk_level": F.lit(None).cast("string"), "score_components": F.lit(None).cast(f"struct<{parts}>"), "top_factors": F.lit(None).cast("array<string>")})
    own = scores.select("candidate_ring_id", "risk_score", "risk_level", F.struct(*PARTS).alias("score_components"), "top_factors")
    return candidates.join(own, "candidate_ring_id", "left")


def records(candidates: DataFrame, tx: DataFrame, scores: DataFrame | None = None) -> DataFrame:
    """A row of evidence for each candidate; fields of lead time are null until measured, and so
    is what a candidate table does not hold."""
    held = candidates.join(subgraph(transactions(candidates, tx)), "candidate_ring_id", "left")
    out = _scored(held, scores)
    none = F.lit(None).cast("string")
    note = F.when(F.col("risk_score").isNull(), NOT_EVALUATED)
    listed = F.transform("edges", lambda e: F.struct(e["id"].alias("transaction_id"), e["source"].alias("sender"), e["target"].alias("receiver"), e["amount"].alias("amount"), e["timestamp"].alias("timestamp")))
    trajectory = F.struct(*[_or_null(held, c, k) for c, k in (("pattern_sequence", "array<string>"), ("event_window_ids", "array<int>"), ("pattern_count", "int"), ("pattern_diversity", "int"), ("source_trajectory_id", "string"))])
    return out.select(
        "candidate_ring_id", "accounts", F.coalesce(listed, F.array().cast("array<struct<transaction_id:string,sender:string,receiver:string,amount:double,timestamp:timestamp>>")).alias("transactions"), "patterns", notable_paths(F.col("patterns")).alias("paths"),
        F.struct(_or_null(held, "start_us", "long"), _or_null(held, "end_us", "long")).alias("time_range"), F.struct("risk_score", "risk_level", "score_components", "top_factors", note.alias("note")).alias("risk_factors"), trajectory.alias("trajectory"),
        F.struct("nodes", "edges").alias("evidence_subgraph"), "risk_score", note.alias("note"), none.alias("warning_time"), none.alias("observable_time"), F.lit(None).cast("int").alias("lead_time"),
    )


def description(patterns: Column) -> Column:
    words = F.create_map(*[F.lit(x) for kv in DESCRIPTIONS.items() for x in kv])
    text = F.array_join(F.transform(F.array_sort(F.array_distinct(patterns)), lambda p: F.coalesce(F.element_at(words, p), p)), "; ")
    return F.when(F.size(patterns) == 0, "No fund-flow patterns recorded.").otherwise(F.concat(F.upper(F.substring(text, 1, 1)), F.lower(F.substring(text, 2, 1 << 20)), F.lit(".")))


def roles(patterns: Column) -> Column:
    """The roles that patterns hint at; the evidence of the named pattern has the account."""
    return F.array_compact(F.array(*[F.when(F.array_contains(patterns, p), r) for p, r in ROLES.items()]))


def explanations(candidates: DataFrame, scores: DataFrame | None = None) -> DataFrame:
    """who, what, when, where, how, why and how_early of each candidate, as structs. Roles are
    read from the sequence of patterns."""
    out = _scored(candidates, scores)
    none = F.lit(None).cast("string")
    density = F.col("network_statistics.density")
    return out.select(
        "candidate_ring_id", F.struct("accounts", F.size("accounts").alias("n_accounts"), roles(F.col("pattern_sequence")).alias("account_roles")).alias("who"),
        F.struct("patterns", "pattern_sequence", description(F.col("patterns")).alias("description")).alias("what"), F.struct("start_us", "end_us", "formation_stage", "formation_stage_is_provisional").alias("when"),
        F.struct("network_statistics", density.alias("evidence_density")).alias("where"), F.struct("transaction_ids", F.size("transaction_ids").alias("n_transactions"), "evidence_event_count", "source_trajectory_id").alias("how"),
        F.struct("risk_score", "risk_level", "score_components", "top_factors", F.when(F.col("risk_score").isNull(), NOT_EVALUATED).alias("note"), F.lit(DISCLAIMER).alias("disclaimer")).alias("why"),
        F.struct(none.alias("warning_time"), none.alias("observable_time"), none.alias("lead_time"), F.lit(HOW_EARLY).alias("note")).alias("how_early"),
    )

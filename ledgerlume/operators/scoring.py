"""Risk scores of candidates, 0 to 100: four weighted components, levels and factors.

A candidate table has candidate_ring_id, accounts, patterns, event_count and density.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlume.functions.columns import half_up
from ledgerlume.functions.config import PATTERN_WEIGHTS, Settings
from ledgerlume.functions.running import totals_before

PARTS = ("behavioural", "network", "fund_flow", "persistence")


def account_scores(predictions: DataFrame) -> DataFrame:
    """An account's score: its largest over all windows."""
    return predictions.groupBy("account_id").agg(F.max("score").alias("score"))


def behavioural(candidates: DataFrame, scores: DataFrame) -> DataFrame:
    """(candidate_ring_id, behavioural): 100 times the mean score of the accounts that have one."""
    each = candidates.select("candidate_ring_id", F.explode(F.array_distinct("accounts")).alias("account_id")).join(scores, "account_id")
    mean = each.groupBy("candidate_ring_id").agg((100 * F.avg("score")).alias("behavioural"))
    return candidates.select("candidate_ring_id").join(mean, "candidate_ring_id", "left").fillna(0.0, ["behavioural"])


def network(candidates: DataFrame) -> DataFrame:
    """(candidate_ring_id, network): percent of candidates of strictly lower density; 50 for one
    alone. Distinct densities are counted and added up by ranges, so no task sorts all candidates."""
    per = candidates.groupBy("density").agg(F.count("*").alias("n"))
    total = candidates.agg(F.count("*").alias("total"))
    ranked = totals_before(per, "density", {"n": "below"}).select("density", "below").crossJoin(F.broadcast(total))  # one row
    value = F.when(F.col("total") < 2, 50.0).otherwise(100.0 * F.col("below") / F.col("total"))
    return candidates.join(ranked, "density").select("candidate_ring_id", value.alias("network"))


def fund_flow(patterns: Column) -> Column:
    weights = F.create_map(*[F.lit(x) for kv in PATTERN_WEIGHTS.items() for x in kv])
    total = F.aggregate(F.array_distinct(patterns), F.lit(0.0), lambda acc, p: acc + F.coalesce(F.element_at(weights, p), F.lit(0.5)))
    return F.least(F.lit(100.0), 100.0 * total / sum(PATTERN_WEIGHTS.values()))


def persistence(events: Column, accounts: Column) -> Column:
    return F.least(F.lit(100.0), 35.0 * F.log1p(3.0 * events / F.greatest(accounts, F.lit(1))))


def level(score: Column, settings: Settings | None = None) -> Column:
    """Half-open bands that leave no gap; the last is closed."""
    bands = (settings or Settings()).risk_bands
    out = None
    for i, (name, low, high) in enumerate(bands):
        inside = (score >= low) & ((score < high) if i < len(bands) - 1 else (score <= high + 1e-9))
        out = F.when(inside, name) if out is None else out.when(inside, name)
    return out.otherwise("UNKNOWN")


def score_candidates(candidates: DataFrame, scores: DataFrame, settings: Settings | None = None) -> DataFrame:
    """candidate_ring_id, the four components (2 digits), risk_score, risk_level, top_factors. The
    level is that of the score as it is given, of 2 digits."""
    s = settings or Settings()
    w = s.score_weights
    if abs(sum(w.values()) - 1) > 1e-6 or set(w) != set(PARTS):
        raise ValueError("the component weights must be of the four components and add up to 1")
    c = candidates.select("candidate_ring_id", fund_flow(F.col("patterns")).alias("fund_flow"), persistence(F.col("event_count"), F.size("accounts")).alias("persistence"))
    c = c.join(behavioural(candidates, scores), "candidate_ring_id").join(network(candidates), "candidate_ring_id")
    factors = F.array_sort(F.array(*[F.struct((-F.col(p) * w[p]).alias("v"), F.lit(p).alias("name")) for p in PARTS]))
    total = sum((half_up(F.col(p), 2) * F.lit(w[p]) for p in PARTS), F.lit(0.0))
    return c.select("candidate_ring_id", *[half_up(p, 2).alias(p) for p in PARTS], half_up(total, 2).alias("risk_score"), level(half_up(total, 2), s).alias("risk_level"), F.transform(factors, lambda f: f["name"]).alias("top_factors"))


def ranked(scores: DataFrame) -> DataFrame:
    return scores.orderBy(F.desc("risk_score"), "candidate_ring_id")

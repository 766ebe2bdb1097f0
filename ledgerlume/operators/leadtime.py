"""Ground truth, matching of candidates to it, and how early a warning would have come."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlume.functions.columns import DAY_US, HOUR_US, count_where, half_up, micros
from ledgerlume.functions.config import PATTERN_WEIGHTS
from ledgerlume.operators import scoring


def alert_ground_truth(alerts: DataFrame) -> DataFrame:
    """alerts: (alert_id, account_id, us). Per alert: accounts, start, observable (last) and n."""
    return alerts.groupBy("alert_id").agg(F.array_sort(F.collect_set("account_id")).alias("accounts"), F.min("us").alias("start_us"), F.max("us").alias("observable_us"), F.count("*").alias("n"))


def alert_events(tx: DataFrame) -> DataFrame:
    """Per ring of labelled transfers: participants, transfers, first and last time."""
    own = tx.where("ring_id <> ''").withColumn("us", micros("timestamp"))
    return own.groupBy(F.col("ring_id").alias("alert_id")).agg(
        F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.array("sender", "receiver"))))).alias("participants"), F.array_sort(F.collect_set("transaction_id")).alias("transaction_ids"),
        F.min("us").alias("first_us"), F.max("us").alias("last_us"), F.min_by("scenario_id", F.struct("us", "row_ord")).alias("alert_type"), (F.max("label") == 1).alias("is_sar"), F.count("*").alias("n_transactions"),
    )


def shared(candidates: DataFrame, truth: DataFrame) -> DataFrame:
    """(candidate_id, truth_id, shared) of pairs with a common account: an equi-join on the
    account, so pairs with nothing in common are never made."""
    c = candidates.select("candidate_id", F.explode(F.array_distinct("accounts")).alias("a"))
    g = truth.select("truth_id", F.explode(F.array_distinct("accounts")).alias("a"))
    return c.join(g, "a").groupBy("candidate_id", "truth_id").agg(F.count("*").alias("shared"))


def overlap_match(candidates: DataFrame, truth: DataFrame, least: float = 0.3) -> DataFrame:
    """Per truth the candidate of the largest share of its accounts, if large enough."""
    pair = shared(candidates, truth).join(truth.select("truth_id", F.size(F.array_distinct("accounts")).alias("size")), "truth_id").withColumn("overlap", F.col("shared") / F.col("size"))
    best = pair.withColumn("n", F.row_number().over(Window.partitionBy("truth_id").orderBy(F.desc("overlap"), "candidate_id"))).where((F.col("n") == 1) & (F.col("overlap") >= least))
    return truth.select("truth_id").join(best.select("truth_id", "candidate_id", "overlap"), "truth_id", "left")


def interval_pairs(candidates: DataFrame, truth: DataFrame, min_shared: int = 2, max_gap_days: float = 10) -> DataFrame:
    """Pairs with enough shared accounts that overlap in time (STRONG) or nearly (MODERATE)."""
    c = candidates.select("candidate_id", F.size(F.array_distinct("accounts")).alias("c_size"), F.col("start_us").alias("c0"), F.col("end_us").alias("c1"))
    g = truth.select("truth_id", F.size(F.array_distinct("accounts")).alias("g_size"), F.col("start_us").alias("g0"), F.col("end_us").alias("g1"))
    pair = shared(candidates, truth).where(F.col("shared") >= min_shared).join(c, "candidate_id").join(g, "truth_id")
    both = F.least("c1", "g1") - F.greatest("c0", "g0")
    gap = F.greatest(F.lit(0).cast("long"), -both) / float(DAY_US)
    s = F.col("shared")
    out = pair.withColumns({"overlap_days": F.greatest(F.lit(0).cast("long"), both) / float(DAY_US), "gap_days": gap, "recall": s / F.col("g_size"), "precision": s / F.col("c_size"), "jaccard": s / (F.col("g_size") + F.col("c_size") - s), "match_type": F.when(both >= 0, "STRONG").when(gap <= max_gap_days, "MODERATE")})
    return out.where("match_type is not null").drop("c_size", "g_size")


def best_match(pairs: DataFrame, per: str = "truth_id") -> DataFrame:
    """The best pair of each truth: STRONG, shared, recall, jaccard, overlap, then least gap."""
    order = [F.desc(F.col("match_type") == "STRONG"), F.desc("shared"), F.desc("recall"), F.desc("jaccard"), F.desc("overlap_days"), F.asc("gap_days"), F.asc("candidate_id"), F.asc("truth_id")]
    return pairs.withColumn("n", F.row_number().over(Window.partitionBy(per).orderBy(*order))).where("n = 1").drop("n")


def best_candidate(candidates: DataFrame, truth: DataFrame) -> DataFrame:
    """Per truth the candidate best by shared accounts, recall, common transfers, overlap in
    time, least gap and jaccard. Both tables have transaction_ids."""
    pairs = interval_pairs(candidates, truth, 1, float("inf"))
    c = candidates.select("candidate_id", F.explode(F.array_distinct("transaction_ids")).alias("t"))
    g = truth.select("truth_id", F.explode(F.array_distinct("transaction_ids")).alias("t"))
    exact = c.join(g, "t").groupBy("candidate_id", "truth_id").agg(F.count("*").alias("exact"))
    full = pairs.join(exact, ["candidate_id", "truth_id"], "left").fillna(0, ["exact"])
    order = [F.desc("shared"), F.desc("recall"), F.desc("exact"), F.desc("overlap_days"), F.asc("gap_days"), F.desc("jaccard"), F.asc("candidate_id")]
    return full.withColumn("n", F.row_number().over(Window.partitionBy("truth_id").orderBy(*order))).where("n = 1").select("truth_id", "candidate_id", "shared", "exact", "recall")


def cumulative_risk(events: DataFrame, fixed: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """Risk of a candidate at each of its event windows, from events up to there.

    events: (candidate_id, window_id, pattern_type); fixed: (candidate_id, behavioural, network,
    n_accounts). First sightings of types and counts are added up along the windows.
    """
    w = weights or {"behavioural": 0.35, "network": 0.20, "fund_flow": 0.25, "persistence": 0.20}
    table = F.create_map(*[F.lit(x) for kv in PATTERN_WEIGHTS.items() for x in kv])
    first = events.groupBy("candidate_id", "pattern_type").agg(F.min("window_id").alias("window_id")).groupBy("candidate_id", "window_id").agg(F.sum(F.coalesce(F.element_at(table, F.col("pattern_type")), F.lit(0.5))).alias("new"))
    count = events.groupBy("candidate_id", "window_id").agg(F.count("*").alias("n"))
    so_far = Window.partitionBy("candidate_id").orderBy("window_id").rowsBetween(Window.unboundedPreceding, 0)
    run = count.join(first, ["candidate_id", "window_id"], "left").select("candidate_id", "window_id", F.sum("n").over(so_far).alias("events"), F.sum(F.coalesce("new", F.lit(0.0))).over(so_far).alias("flow"))
    out = run.join(fixed, "candidate_id")
    flow = F.least(F.lit(100.0), 100.0 * F.col("flow") / sum(PATTERN_WEIGHTS.values()))
    parts = {"behavioural": F.col("behavioural"), "network": F.col("network"), "fund_flow": flow, "persistence": scoring.persistence(F.col("events"), F.col("n_accounts"))}
    risk = sum((half_up(c, 2) * F.lit(w[k]) for k, c in parts.items()), F.lit(0.0))
    return out.select("candidate_id", "window_id", half_up(risk, 2).alias("risk"))


def warning_window(risk: DataFrame, threshold: float = 50) -> DataFrame:
    return risk.groupBy("candidate_id").agg(F.min(F.when(F.col("risk") >= threshold, F.col("window_id"))).alias("warning_window"))


def lead_times(matches: DataFrame, warnings: DataFrame, observable: DataFrame) -> DataFrame:
    """Per truth: candidate, warning and observable window, lead_time, alerted and early.

    matches: (truth_id, candidate_id or null); observable: (truth_id, observable_window).
    """
    out = observable.join(matches, "truth_id", "left").join(warnings, "candidate_id", "left")
    lead = F.col("observable_window") - F.col("warning_window")
    return out.select("truth_id", "candidate_id", "warning_window", "observable_window", lead.alias("lead_time"), F.col("warning_window").isNotNull().alias("alerted"), F.coalesce(lead >= 0, F.lit(False)).alias("early"))


def lead_summary(leads: DataFrame, alerted_candidates: Column | int = 0, matched_alerted: Column | int = 0) -> DataFrame:
    """One row: counts, rates and the distribution of lead times (std of the population, where
    there are two or more)."""
    n = F.count("lead_time")
    c = lambda x: x if isinstance(x, Column) else F.lit(x)
    return leads.agg(
        F.count("*").alias("n_truth"), count_where(F.col("candidate_id").isNotNull()).alias("n_matched"), count_where(F.col("alerted")).alias("n_alerted"), count_where(F.col("early")).alias("n_early"),
        F.avg("lead_time").alias("mean_lead"), F.median("lead_time").alias("median_lead"), F.min("lead_time").alias("min_lead"), F.max("lead_time").alias("max_lead"), F.when(n > 1, F.stddev_pop("lead_time")).alias("std_lead"),
        F.when(n > 0, count_where(F.col("early")) / n).alias("early_rate"), (count_where(F.col("alerted")) / F.greatest(F.count("*"), F.lit(1))).alias("detection_rate"),
        F.when(c(alerted_candidates) > 0, 1 - c(matched_alerted) / c(alerted_candidates)).alias("false_warning_rate"),
    )


def completion_leads(leads: DataFrame, truth: DataFrame, window_us: int = DAY_US) -> DataFrame:
    """leads with the lead to the truth's last moment, in windows. truth: (truth_id, last_window)."""
    return leads.join(truth, "truth_id", "left").withColumn("completion_lead", F.col("last_window") - F.col("warning_window"))


def candidate_leads(candidates: DataFrame, pairs: DataFrame, warnings: DataFrame, windows_of_truth: DataFrame) -> DataFrame:
    """A row for each candidate: its best truth and the match's kind (NONE without one), whether
    and when it warned, and the lead to the truth's first transfer (observable) and to its last
    (completion), in windows.

    pairs: interval_pairs(); windows_of_truth: (truth_id, observable_window, completion_window).
    """
    best = best_match(pairs, "candidate_id").select("candidate_id", "truth_id", "match_type", "shared", "recall", "precision", "jaccard", "overlap_days", "gap_days")
    out = candidates.select("candidate_id").join(best, "candidate_id", "left").join(warnings, "candidate_id", "left").join(windows_of_truth, "truth_id", "left")
    lead, done = F.col("observable_window") - F.col("warning_window"), F.col("completion_window") - F.col("warning_window")
    return out.select(
        "candidate_id", "truth_id", F.coalesce("match_type", F.lit("NONE")).alias("match_strength"), "shared", "recall", "precision", "jaccard", "overlap_days", "gap_days", F.col("warning_window").isNotNull().alias("alerted"), "warning_window",
        "observable_window", lead.alias("lead_time"), F.coalesce(lead >= 0, F.lit(False)).alias("early"), "completion_window", done.alias("completion_lead_time"), F.coalesce(done >= 0, F.lit(False)).alias("completion_early"),
    )


def lead_report(rows: DataFrame, n_truth: int) -> DataFrame:
    """One row over candidate_leads(): strict figures count STRONG matches only, extended ones
    MODERATE matches too; a warned candidate without a counted match is a false warning. The
    distribution of completion leads is there for both."""
    strong, near = F.col("match_strength") == "STRONG", F.col("match_strength").isin("STRONG", "MODERATE")
    share = lambda a, b: F.when(b > 0, a / b)
    alerted = count_where(F.col("alerted"))
    out = [F.lit(n_truth).cast("long").alias("n_truth"), F.count("*").alias("n_candidates"), count_where(strong).alias("n_strong"), count_where(F.col("match_strength") == "MODERATE").alias("n_moderate"), count_where(near).alias("n_extended"), alerted.alias("n_alerted")]
    for name, matched in (("strict", strong), ("extended", near)):
        used = matched & F.col("lead_time").isNotNull()
        found = F.count_distinct(F.when(used, F.col("truth_id")))
        out += [
            count_where(used).alias(f"{name}_alerted_and_matched"), share(count_where(matched), F.count("*")).alias(f"{name}_candidate_match_rate"), found.alias(f"{name}_truth_detected"), share(found, F.lit(n_truth)).alias(f"{name}_detection_rate"),
            share(count_where(F.col("alerted") & ~matched), alerted).alias(f"{name}_false_warning_rate"),
        ]
        for kind in ("lead_time", "completion_lead_time"):
            x = F.when(matched, F.col(kind))
            early = count_where(matched & (F.col(kind) >= 0))
            out += [f(x).alias(f"{name}_{label}_{kind}") for label, f in (("mean", F.avg), ("median", F.median), ("min", F.min), ("max", F.max))]
            out += [F.when(F.count(x) > 1, F.stddev_pop(x)).alias(f"{name}_std_{kind}"), early.alias(f"{name}_early_{kind}"), share(early, F.count(x)).alias(f"{name}_early_rate_{kind}")]
    return rows.agg(*out)


def account_overlap(candidates: DataFrame, known: DataFrame, steps: tuple[int, ...] = (1, 2, 3, 5, 10)) -> DataFrame:
    """(min_shared, n_candidates): candidates with so many known accounts at least."""
    hit = candidates.select("candidate_id", F.explode(F.array_distinct("accounts")).alias("account_id")).join(known.select("account_id").distinct(), "account_id", "left_semi").groupBy("candidate_id").agg(F.count("*").alias("n"))
    one = hit.agg(*[count_where(F.col("n") >= k).alias(f"k{k}") for k in steps])
    return one.select(F.explode(F.array(*[F.struct(F.lit(k).alias("min_shared"), F.col(f"k{k}").alias("n_candidates")) for k in steps])).alias("x")).select("x.*")


def interval_status(candidates: DataFrame, spans: DataFrame) -> DataFrame:
    """Per candidate: shared accounts, those known at the time, and a status.

    spans: (account_id, start_us, end_us) of known accounts; overlap must be of some length.
    """
    c = candidates.select("candidate_id", F.explode(F.array_distinct("accounts")).alias("account_id"), F.col("start_us").alias("c0"), F.col("end_us").alias("c1"))
    met = c.join(spans, "account_id").groupBy("candidate_id", "account_id").agg(F.max((F.least("c1", "end_us") > F.greatest("c0", "start_us")).cast("int")).alias("met"))
    n = met.groupBy("candidate_id").agg(F.count("*").alias("shared"), F.sum("met").alias("at_the_time"))
    out = candidates.select("candidate_id").join(n, "candidate_id", "left").fillna(0)
    s, t = F.col("shared"), F.col("at_the_time")
    return out.withColumn("status", F.when(t >= 3, "STRONG_TEMPORAL").when(t >= 2, "TEMPORAL").when(s >= 2, "ACCOUNT_NO_OVERLAP").when(s >= 1, "SINGLE").otherwise("NO_MATCH"))


def pair_status(candidates: DataFrame, truth: DataFrame) -> DataFrame:
    """Per candidate its best pair by (common, overlap_hours) and the pair's status. Pairs with
    nothing in common are NO_MATCH and are not made one by one."""
    g = truth.select("truth_id", F.col("start_us").alias("g0"), F.col("end_us").alias("g1"))
    c = candidates.select("candidate_id", F.col("start_us").alias("c0"), F.col("end_us").alias("c1"))
    pair = shared(candidates, truth).join(c, "candidate_id").join(g, "truth_id")
    over = F.greatest(F.lit(0).cast("long"), F.least("c1", "g1") - F.greatest("c0", "g0")) / float(HOUR_US)
    ranked = pair.withColumn("overlap_hours", over).withColumn("n", F.row_number().over(Window.partitionBy("candidate_id").orderBy(F.desc("shared"), F.desc("overlap_hours"), "truth_id"))).where("n = 1")
    s, o = F.col("shared"), F.col("overlap_hours")
    status = F.when((s >= 2) & (o > 0), "STRONG_MATCH").when((s >= 1) & (o > 0), "WEAK_MATCH").when(s >= 1, "ACCOUNT_ONLY").otherwise("NO_MATCH")
    best = ranked.select("candidate_id", "truth_id", "shared", "overlap_hours", status.alias("status"), ((s >= 2) & (F.col("c0") < F.col("g0"))).alias("early_warning"), ((F.col("g0") - F.col("c0")) / float(DAY_US)).alias("lead_days"))
    return candidates.select("candidate_id").join(best, "candidate_id", "left").withColumns({"status": F.coalesce("status", F.lit("NO_MATCH")), "shared": F.coalesce("shared", F.lit(0)), "early_warning": F.coalesce("early_warning", F.lit(False))})


def clean_id(c: Column) -> Column:
    """Ids that went through a float: "123.0" is "123"."""
    text = F.trim(c.cast("string"))
    return F.when(text.rlike(r"^-?\d+\.0+$"), F.regexp_replace(text, r"\.0+$", "")).otherwise(text)

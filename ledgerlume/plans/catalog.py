"""The registered queries of the library, by name."""

from __future__ import annotations

import datetime as dt
import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlume.functions.columns import half_up, micros
from ledgerlume.operators import centrality, cleaning, episodes, evidence, graph, labels, leadtime, metrics, models, patterns, profile, rings, scoring, serving, windows
from ledgerlume.operators import features as ft
from ledgerlume.plans import fixtures as fx
from ledgerlume.sources import generate, sinks

Query = Callable[[SparkSession, str], DataFrame]
NOW = dt.datetime(2024, 1, 20, tzinfo=dt.UTC)
FOUND: dict[str, Query] = {}


def query(f: Query) -> Query:
    FOUND[f.__name__] = f
    return f


def over(table: Query) -> Callable[[Callable[[DataFrame], DataFrame]], Query]:
    """Registers a query that takes one table."""

    def register(f: Callable[[DataFrame], DataFrame]) -> Query:
        @functools.wraps(f)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(table(spark, sf_dir))

        return query(run)

    return register


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*[half_up(c, digits).alias(c) if kind in ("double", "float") else F.col(c) for c, kind in df.dtypes])


# --- sources and cleaning


@over(fx.transfers)
def canonical_coerce(tx):
    return tx.withColumn("us", micros("timestamp")).drop("timestamp")


@over(fx.dirty)
def clean_transactions(tx):
    return cleaning.clean(tx).select("transaction_id", "sender", "receiver", "amount", micros("timestamp").alias("us"), "row_ord")


@over(fx.dirty)
def clean_keep_amounts(tx):
    return cleaning.marked(tx, drop_zero=False, drop_negative=False, drop_self=True).groupBy("dropped_by").agg(F.count("*").alias("n"))


@over(fx.dirty)
def clean_step_log(tx):
    return cleaning.step_log(tx)


@query
def clean_dedup_lineitem(spark, sf_dir):
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    tx = li.select(
        F.concat_ws("-", "l_orderkey", "l_linenumber").alias("transaction_id"), F.col("l_partkey").cast("string").alias("sender"), F.col("l_suppkey").cast("string").alias("receiver"), F.lit(1.0).alias("amount"), F.lit("2024-01-01").cast("timestamp").alias("timestamp"),
        F.lit(0).alias("label"), F.lit("").alias("scenario_id"), F.lit("").alias("ring_id"), F.lit("lineitem").alias("dataset_source"), (F.col("l_partkey") * 1_000_000 + F.col("l_suppkey")).alias("row_ord"),
    )
    return cleaning.clean(tx).select("transaction_id", "row_ord")


# --- data quality


@over(fx.dirty)
def dq_issue_counts(tx):
    return profile.issue_counts(tx, NOW)


@over(fx.dirty)
def dq_duplicates(tx):
    return profile.issue_counts(tx, NOW).where("issue LIKE 'duplicate%'").select("issue", "count")


@over(fx.dirty)
def dq_sample_ids(tx):
    return profile.issue_samples(tx, NOW, 5).select("issue", F.array_join("sample_ids", ",").alias("sample_ids"))


@over(fx.dirty)
def dq_out_of_order(tx):
    return profile.out_of_order(tx, 500)


@over(fx.transfers)
def dq_summary_stats(tx):
    return rounded(profile.summary(tx))


@over(fx.transfers)
def dq_class_distribution(tx):
    return profile.class_distribution(tx)


@over(fx.transfers)
def dq_top_scenarios(tx):
    return profile.top_scenarios(tx, 5)


# --- windows and graphs


@over(fx.transfers)
def window_bounds_tumbling(tx):
    return windows.bounds(tx)


@over(fx.transfers)
def window_bounds_sliding(tx):
    return windows.bounds(tx, "2d", "12h")


@over(fx.transfers)
def window_assign_sliding(tx):
    return windows.assigned(tx, "2d", "12h").groupBy("window_id").agg(F.count("*").alias("n"), F.sum("amount").alias("amount"))


@over(fx.transfers)
def window_assign_gapped(tx):
    return windows.assigned(tx, "6h", "1d").groupBy("window_id").agg(F.count("*").alias("n"))


@over(fx.transfers)
def window_of_timestamp(tx):
    placed = windows.with_extent(tx, tx).withColumn("us", micros("timestamp"))
    first = windows.window_of(F.col("us"), F.col("t0"), F.col("t1"), "6h", "1d")
    strict = windows.window_of(F.col("us"), F.col("t0"), F.col("t1"), "6h", "1d", fallback=False)
    return placed.select("transaction_id", first.alias("window_id"), strict.alias("strict_window_id"))


@over(fx.sparse)
def graph_stats(tx):
    return rounded(graph.stats(tx))


@over(fx.transfers)
def graph_window_summary(tx):
    return graph.window_summary(tx)


@over(fx.transfers)
def graph_cumulative_summary(tx):
    return graph.cumulative_summary(tx)


@over(fx.transfers)
def graph_level_deltas(tx):
    return rounded(graph.level_deltas(graph.cumulative_summary(tx)))


@over(fx.transfers)
def graph_snapshot(tx):
    b = windows.bounds(tx).where("window_id = 3").first()
    snap = lambda mode: graph.snapshot(tx, b["start_us"], b["end_us"], mode).agg(F.count("*").alias("n"), F.sum("amount").alias("amount")).withColumn("mode", F.lit(mode))
    return snap("window").unionByName(snap("cumulative"))


@over(fx.transfers)
def node_activity(tx):
    return graph.node_activity(tx)


@over(fx.sparse)
def khop_neighborhood(tx):
    start = tx.agg(F.min("sender")).first()[0]
    return graph.k_hop(tx, start or "", 3, "both")


@over(fx.sparse)
def simple_paths(tx):
    ends = tx.agg(F.min("sender"), F.max("receiver")).first()
    return graph.simple_paths(tx, ends[0] or "", ends[1] or "", 5).select(F.array_join("path", ",").alias("path"), "length")


@over(fx.sparse)
def simple_cycles(tx):
    return graph.simple_cycles(tx, 5).select(F.array_join("cycle", ",").alias("cycle"), "length")


@over(fx.sparse)
def wcc_components(tx):
    return graph.weak_components(tx)


@over(fx.sparse)
def scc_components(tx):
    return graph.strong_components(tx)


@over(fx.sparse)
def ring_cycles(tx):
    return graph.ring_cycles(tx, 4)


# The same over all transfers with the operators' defaults; no SQL, as it is too slow for some.


@over(fx.transfers)
def graph_stats_all(tx):
    return rounded(graph.stats(tx))


@over(fx.transfers)
def khop_neighborhood_all(tx):
    start = tx.agg(F.min("sender")).first()[0]
    return graph.k_hop(tx, start or "", 3, "both")


@over(fx.transfers)
def simple_paths_all(tx):
    ends = tx.agg(F.min("sender"), F.max("receiver")).first()
    return graph.simple_paths(tx, ends[0] or "", ends[1] or "").select(F.array_join("path", ",").alias("path"), "length")


@over(fx.transfers)
def simple_cycles_all(tx):
    return graph.simple_cycles(tx).select(F.array_join("cycle", ",").alias("cycle"), "length")


@over(fx.transfers)
def wcc_components_all(tx):
    return graph.weak_components(tx)


@over(fx.transfers)
def scc_components_all(tx):
    return graph.strong_components(tx)


@over(fx.transfers)
def ring_cycles_all(tx):
    return graph.ring_cycles(tx)


# --- features


@over(fx.transfers)
def feat_transaction(tx):
    return rounded(ft.transaction_features(windows.tumbling(tx)))


@over(fx.transfers)
def feat_concentration(tx):
    return rounded(ft.transaction_features(windows.tumbling(tx)).select(*ft.KEYS, "out_amount_concentration", "repeated_receiver_count"))


@over(fx.transfers)
def feat_temporal(tx):
    return rounded(ft.temporal_features(tx).select(*ft.KEYS, "transaction_velocity", "activity_acceleration", "activity_trend_slope", "recent_vs_historical_activity", "activity_persistence_windows"))


@over(fx.transfers)
def feat_gaps_burstiness(tx):
    return rounded(ft.temporal_features(tx).select(*ft.KEYS, "median_time_gap_seconds", "min_time_gap_seconds", "max_time_gap_seconds", "burstiness"), 4)


@over(fx.transfers)
def feat_network_degrees(tx):
    return rounded(ft.degree_features(tx))


@over(fx.transfers)
def feat_delta(tx):
    return rounded(ft.change_features(ft.degree_features(tx)).select(*ft.KEYS, "delta_total_degree", "delta_neighbor_count", "delta_weighted_in_degree", "delta_weighted_out_degree", "delta_connectivity"))


@query
def feature_table(spark, sf_dir):
    t = fx.feature_table(spark, sf_dir)
    return rounded(t.select(*ft.KEYS, "total_degree", "neighbor_count", "total_count", "total_amount", "out_count", "in_amount", "unique_receivers", "log_total_amount", "transaction_velocity", "delta_total_count", "delta_total_amount", "delta_transaction_velocity", "delta_connectivity"))


@over(fx.transfers)
def feat_pagerank(tx):
    return rounded(centrality.pagerank_one(graph.pairs(tx), 5), 9)


@over(fx.transfers)
def feat_clustering(tx):
    return rounded(centrality.clustering_one(graph.pairs(tx)))


@over(fx.transfers)
def feat_centrality(tx):
    return rounded(centrality.by_window(tx))


# --- patterns


@over(fx.transfers)
def pattern_fan_in(tx):
    return fx.flat(patterns.fan_in(tx))


@over(fx.transfers)
def pattern_fan_out(tx):
    return fx.flat(patterns.fan_out(tx))


@over(fx.transfers)
def pattern_fan_evidence(tx):
    e = patterns.fan_in(tx)
    got = F.from_json("evidence", "n_senders long, total_amount double, mean_amount double, amount_std double, time_span_seconds double")
    return rounded(e.select("window_id", "central_account", got.alias("e")).select("window_id", "central_account", "e.*"))


@over(fx.transfers)
def pattern_split_merge(tx):
    return fx.flat(patterns.split_merge(tx))


@over(fx.transfers)
def pattern_rapid_pass_through(tx):
    return fx.flat(patterns.rapid_pass_through(tx))


@over(fx.transfers)
def pattern_repeated_intermediary(tx):
    return fx.flat(patterns.repeated_intermediary(tx))


@over(fx.transfers)
def pattern_layering(tx):
    return fx.flat(patterns.layering(tx))


@over(fx.transfers)
def pattern_circular_flow(tx):
    return fx.flat(patterns.circular_flow(tx, max_length=3, days=3))


@over(fx.transfers)
def pattern_circular_scoped(tx):
    starts = patterns.participants(patterns.layering(tx))
    return fx.flat(patterns.circular_flow(tx, max_length=3, days=3, starts=starts))


@over(fx.transfers)
def pattern_escalating(tx):
    return fx.flat(patterns.escalating_connectivity(ft.change_features(ft.degree_features(tx))))


def _log(tx: DataFrame) -> DataFrame:
    tables = {"fan_in": patterns.fan_in(tx), "fan_out": patterns.fan_out(tx), "rapid": patterns.rapid_pass_through(tx), "split": patterns.split_merge(tx), "repeated": patterns.repeated_intermediary(tx), "layering": patterns.layering(tx)}
    return sinks.union_logs(tables)


@over(fx.transfers)
def pattern_event_log(tx):
    return fx.flat(_log(tx)).groupBy("pattern_type", "window_id").agg(F.count("*").alias("n"), half_up(F.sum("pattern_strength"), 4).alias("strength"))


@over(fx.transfers)
def pattern_type_summary(tx):
    return patterns.type_summary(_log(tx))


@query
def pattern_indicators(spark, sf_dir):
    return rounded(ft.indicators(fx.fans(spark, sf_dir)))


@query
def indicators_attached(spark, sf_dir):
    tx = fx.transfers(spark, sf_dir)
    own = ft.attach_indicators(labels.same_window(tx), ft.indicators(fx.fans(spark, sf_dir)))
    return rounded(own.select(*ft.KEYS, "y", "pattern_fan_in", "pattern_fan_out", "pattern_event_count", "pattern_strength_sum"))


# --- episodes and rings


@query
def bounded_episodes(spark, sf_dir):
    return episodes.bounded_episodes(fx.fans(spark, sf_dir), 3)


@query
def event_components(spark, sf_dir):
    e = fx.fans(spark, sf_dir).where("window_id < 3")
    return episodes.event_components(e, 3, 1).groupBy("component").agg(F.count("*").alias("n")).groupBy("n").agg(F.count("*").alias("n_components"))


@query
def event_components_all(spark, sf_dir):
    e = fx.fans(spark, sf_dir)
    return episodes.event_components(e).groupBy("component").agg(F.count("*").alias("n")).groupBy("n").agg(F.count("*").alias("n_components"))


def _trajectories(spark, sf_dir):
    """Trajectories of every detector's events."""
    tx = fx.transfers(spark, sf_dir)
    events = patterns.detect_all(tx, features=ft.change_features(ft.degree_features(tx)))
    return tx, episodes.trajectories(fx.kept(events, "events"))


@query
def trajectories(spark, sf_dir):
    return _trajectories(spark, sf_dir)[1].select("candidate_id", "start_us", "end_us", F.size("accounts").alias("n_accounts"), F.size("events").alias("n_events"))


@query
def trajectory_features(spark, sf_dir):
    return episodes.trajectory_features(_trajectories(spark, sf_dir)[1])


@query
def ring_candidates(spark, sf_dir):
    tx, t = _trajectories(spark, sf_dir)
    return rings.ring_candidates(t, tx)


@query
def ring_stage(spark, sf_dir):
    return fx.candidates(spark, sf_dir).select("candidate_ring_id", rings.stage(F.col("patterns")).alias("formation_stage"))


# --- scores, evidence


def _scores(spark, sf_dir):
    return scoring.score_candidates(fx.kept(fx.candidates(spark, sf_dir), "candidates"), fx.account_scores(spark, sf_dir))


@query
def risk_components(spark, sf_dir):
    return _scores(spark, sf_dir).select("candidate_ring_id", *scoring.PARTS)


@query
def risk_scores(spark, sf_dir):
    return _scores(spark, sf_dir).select("candidate_ring_id", "risk_score", "risk_level")


@query
def risk_level_bands(spark, sf_dir):
    return spark.range(0, 1003).select((F.col("id") / 10.0).alias("score")).select("score", scoring.level(F.col("score")).alias("risk_level"))


@query
def evidence_transactions(spark, sf_dir):
    return evidence.transactions(fx.candidates(spark, sf_dir), fx.transfers(spark, sf_dir)).groupBy("candidate_ring_id").agg(F.count("*").alias("n"), F.sum("amount").alias("amount"), F.min(micros("timestamp")).alias("first_us"))


@query
def evidence_nodes(spark, sf_dir):
    g = evidence.subgraph(evidence.transactions(fx.candidates(spark, sf_dir), fx.transfers(spark, sf_dir)))
    return g.select("candidate_ring_id", F.size("nodes").alias("n_nodes"), F.size("edges").alias("n_edges"), F.get("nodes", 0)["id"].alias("first_node"))


@query
def notable_paths(spark, sf_dir):
    sets = spark.createDataFrame([(i, [p for k, p in enumerate(("fan_in", "layering", "fan_out", "circular_flow")) if i >> k & 1]) for i in range(16)], "id int, patterns array<string>")
    return sets.select("id", F.array_join(evidence.notable_paths(F.col("patterns")), "; ").alias("paths"), evidence.description(F.col("patterns")).alias("description"))


@query
def evidence_records(spark, sf_dir):
    return evidence.records(fx.candidates(spark, sf_dir), fx.transfers(spark, sf_dir), _scores(spark, sf_dir))


@query
def forensic_explanations(spark, sf_dir):
    tx, t = _trajectories(spark, sf_dir)
    found = fx.kept(rings.ring_candidates(t, tx), "rings")
    scored = scoring.score_candidates(found.withColumns({"event_count": F.col("evidence_event_count"), "density": F.col("network_statistics.density")}), fx.account_scores(spark, sf_dir))
    return evidence.explanations(found, scored)


# --- labels, metrics, models


@over(fx.transfers)
def labels_same_window(tx):
    return labels.same_window(tx)


@over(fx.transfers)
def labels_forecast(tx):
    return labels.forecast(tx)


@over(fx.transfers)
def labels_attached(tx):
    return labels.attach(ft.degree_features(tx).select(*ft.KEYS, "total_degree"), labels.forecast(tx))


@over(fx.transfers)
def chrono_split(tx):
    return labels.chronological(labels.same_window(tx)).groupBy("split").agg(F.min("window_id").alias("first_window"), F.max("window_id").alias("last_window"), F.count("*").alias("n"), F.sum("y").alias("positives"))


@over(fx.scored)
def metrics_confusion(s):
    return rounded(metrics.confusion(s))


@over(fx.scored)
def metrics_roc_auc(s):
    return rounded(metrics.roc_auc(s), 9)


@over(fx.scored)
def metrics_avg_precision(s):
    return rounded(metrics.average_precision(s), 9)


@over(fx.scored)
def metrics_topk(s):
    out = None
    for k in (10, 20, 50):
        row = metrics.precision_at(s, k, *ft.KEYS)
        out = row if out is None else out.unionByName(row)
    return rounded(out)


@over(fx.scored)
def metrics_no_positives(s):
    return metrics.evaluate(s.withColumn("y", F.lit(0)), 0.5, (10,), *ft.KEYS).select("precision", "roc_auc", "pr_auc", "precision_at_10", "note")


@over(fx.scored)
def threshold_sweep(s):
    return rounded(metrics.sweep(s))


@over(fx.scored)
def threshold_best(s):
    return rounded(metrics.best_threshold(metrics.sweep(s)))


@over(fx.scored)
def threshold_final(s):
    """The threshold that is best on validation, on test."""
    t = labels.chronological(s)
    best = metrics.best_threshold(metrics.sweep(t.where("split = 'validation'"))).first()["threshold"]
    return rounded(metrics.confusion(t.where("split = 'test'"), best).withColumn("threshold", F.lit(best)))


@query
def run_report(spark, sf_dir):
    """The figures of a run: levels and mean score of candidates, events and strength by type."""
    scores, kinds = _scores(spark, sf_dir), patterns.type_summary(fx.fans(spark, sf_dir))
    a = scores.groupBy("risk_level").agg(F.count("*").alias("n"), F.avg("risk_score").alias("mean")).select(F.lit("level").alias("part"), F.col("risk_level").alias("name"), "n", "mean")
    b = kinds.select(F.lit("pattern").alias("part"), F.col("pattern_type").alias("name"), "n", F.col("mean_strength").alias("mean"))
    return rounded(a.unionByName(b), 4)


def _model_table(spark, sf_dir):
    tx = fx.transfers(spark, sf_dir)
    table = labels.attach(fx.feature_table(spark, sf_dir), labels.forecast(tx))
    return labels.chronological(table)


def _columns(*groups):
    missing = {"pagerank", "betweenness_centrality", "clustering_coefficient", "component_size", "delta_pagerank", "delta_component_size"}
    return tuple(c for g in groups for c in g if c not in missing)


def _modelled(model):
    def run(spark, sf_dir):
        t = fx.kept(_model_table(spark, sf_dir), "features")  # each pass of a fit reads it
        return model.fit(t.where("split = 'train'")).predict(t.where("split = 'test'")).select(*ft.KEYS, "y", "score")

    return run


FOUND |= {
    "model_logreg": _modelled(models.Behavioural()), "model_rf": _modelled(models.Temporal(_columns(ft.TEMPORAL, ft.DELTA), 20, 5)),
    "model_gbt": _modelled(models.Boosted(_columns(ft.NETWORK, ft.TRANSACTION, ft.TEMPORAL, ft.DELTA), 5, 3)), "model_iforest": _modelled(models.Isolation(_columns(ft.NETWORK), 50, 128)),
}


@query
def model_comparison(spark, sf_dir):
    return models.compare(_model_table(spark, sf_dir), {"behavioural": models.Behavioural(), "static": models.Isolation(_columns(ft.NETWORK), 20, 128)})


@query
def ablation(spark, sf_dir):
    return models.ablation(_model_table(spark, sf_dir), lambda c: models.Boosted(c, 3, 3), {"A": ft.TRANSACTION, "D": _columns(ft.TRANSACTION, ft.NETWORK, ft.TEMPORAL)})


@query
def shapley_importance(spark, sf_dir):
    t = fx.kept(_model_table(spark, sf_dir), "features")
    m = models.Boosted(ft.TRANSACTION, 3, 3).fit(t.where("split = 'train'"))
    return models.shapley_global(models.shapley(m, t.where("split = 'test'")), ft.TRANSACTION)


# --- ground truth and lead time


def _truth(spark, sf_dir):
    a = leadtime.alert_events(fx.transfers(spark, sf_dir))
    return a.select(F.col("alert_id").alias("truth_id"), F.col("participants").alias("accounts"), F.col("first_us").alias("start_us"), F.col("last_us").alias("end_us"), "transaction_ids")


def _pairs(spark, sf_dir, candidates=None):
    return leadtime.interval_pairs(fx.kept(fx.candidates(spark, sf_dir), "candidates") if candidates is None else candidates, _truth(spark, sf_dir))


@over(fx.transfers)
def gt_alert_events(tx):
    e = leadtime.alert_events(tx)
    return e.select("alert_id", F.array_join("participants", ",").alias("participants"), F.size("transaction_ids").alias("n_ids"), "first_us", "last_us", "alert_type", "is_sar", "n_transactions")


@query
def gt_match_overlap(spark, sf_dir):
    return rounded(leadtime.overlap_match(fx.candidates(spark, sf_dir), _truth(spark, sf_dir), 0.01))


@query
def gt_match_interval(spark, sf_dir):
    return rounded(_pairs(spark, sf_dir))


@query
def gt_best_match(spark, sf_dir):
    return leadtime.best_match(_pairs(spark, sf_dir)).select("truth_id", "candidate_id", "match_type", "shared")


@query
def gt_best_truth(spark, sf_dir):
    return leadtime.best_match(_pairs(spark, sf_dir), "candidate_id").select("candidate_id", "truth_id", "match_type", "shared")


def _inputs(spark, sf_dir):
    """Events and candidates, written once."""
    e = fx.kept(fx.fans(spark, sf_dir), "fans")
    return e, fx.kept(fx.candidates(spark, sf_dir, e), "candidates")


def _risk(spark, sf_dir, inputs=None):
    fans, c = inputs or _inputs(spark, sf_dir)
    events = fans.select(F.col("central_account").alias("candidate_id"), "window_id", "pattern_type")
    fixed = c.select("candidate_id", F.size("accounts").alias("n_accounts")).join(scoring.behavioural(c, fx.account_scores(spark, sf_dir)).withColumnRenamed("candidate_ring_id", "candidate_id"), "candidate_id").join(scoring.network(c).withColumnRenamed("candidate_ring_id", "candidate_id"), "candidate_id")
    return leadtime.cumulative_risk(events, fixed)


def _leads(spark, sf_dir):
    tx, inputs = fx.transfers(spark, sf_dir), _inputs(spark, sf_dir)
    match = leadtime.best_match(_pairs(spark, sf_dir, inputs[1])).select("truth_id", "candidate_id")
    seen = windows.with_extent(_truth(spark, sf_dir), tx)
    observable = seen.select("truth_id", windows.window_of(F.col("end_us"), F.col("t0"), F.col("t1")).alias("observable_window"))
    return leadtime.lead_times(match, leadtime.warning_window(_risk(spark, sf_dir, inputs), 30), observable)


@over(fx.transfers)
def gt_alert_accounts(tx):
    own = ft.legs(tx.where("ring_id <> ''")).select(F.col("ring_id").alias("alert_id"), "account_id", micros("timestamp").alias("us"))
    return leadtime.alert_ground_truth(own).select("alert_id", F.array_join("accounts", ",").alias("accounts"), "start_us", "observable_us", "n")


@query
def diag_best_candidate(spark, sf_dir):
    return rounded(leadtime.best_candidate(fx.candidates(spark, sf_dir), _truth(spark, sf_dir)))


@query
def lead_completion(spark, sf_dir):
    leads = _leads(spark, sf_dir)
    last = leads.select("truth_id", (F.col("observable_window") + 1).alias("last_window"))
    return leadtime.completion_leads(leads, last).select("truth_id", "completion_lead")


@query
def cumulative_risk(spark, sf_dir):
    return _risk(spark, sf_dir)


@query
def warning_windows(spark, sf_dir):
    return leadtime.warning_window(_risk(spark, sf_dir), 30)


@query
def lead_time(spark, sf_dir):
    return _leads(spark, sf_dir)


@query
def lead_time_summary(spark, sf_dir):
    return rounded(leadtime.lead_summary(_leads(spark, sf_dir), 10, 4))


@query
def diag_account_overlap(spark, sf_dir):
    tx = fx.transfers(spark, sf_dir)
    known = graph.nodes(tx.where("label = 1 AND ring_id = 'R1'"))
    return leadtime.account_overlap(fx.candidates(spark, sf_dir), known)


@query
def diag_interval_status(spark, sf_dir):
    tx = fx.transfers(spark, sf_dir).where("label = 1 AND ring_id = 'R1'").withColumn("us", micros("timestamp"))
    spans = ft.legs(tx).groupBy("account_id").agg(F.min("us").alias("start_us"), F.max("us").alias("end_us"))
    return leadtime.interval_status(fx.candidates(spark, sf_dir), spans)


@query
def diag_pair_status(spark, sf_dir):
    return rounded(leadtime.pair_status(fx.candidates(spark, sf_dir), _truth(spark, sf_dir)))


# --- serving


@query
def api_summary(spark, sf_dir):
    return serving.summary(fx.transfers(spark, sf_dir), fx.fans(spark, sf_dir), fx.candidates(spark, sf_dir), _scores(spark, sf_dir))


@query
def api_alerts(spark, sf_dir):
    return serving.alerts(fx.candidates(spark, sf_dir), _scores(spark, sf_dir), "moderate", 20, 5).select("candidate_ring_id", "n_accounts", "risk_score", "risk_level")


@query
def api_rings(spark, sf_dir):
    some = _scores(spark, sf_dir).where("risk_score > 45")
    return serving.rings(fx.candidates(spark, sf_dir), some, 1000, 0).select("candidate_ring_id", "risk_score", "risk_level", "note")


@query
def api_ring_patterns(spark, sf_dir):
    return fx.flat(serving.ring_patterns(fx.candidates(spark, sf_dir), fx.fans(spark, sf_dir), "A1", 50))


@query
def api_account(spark, sf_dir):
    return serving.account(fx.transfers(spark, sf_dir), fx.candidates(spark, sf_dir), "A1")


@over(fx.transfers)
def api_transactions(tx):
    return serving.transactions(tx, "A1", 20, 5).select("transaction_id", "sender", "receiver", "amount", micros("timestamp").alias("us"))


@query
def api_patterns(spark, sf_dir):
    return fx.flat(serving.patterns(fx.fans(spark, sf_dir), "fan_out", 30, 10))


@query
def api_models(spark, sf_dir):
    rows = spark.createDataFrame([("behavioural", "test"), ("static", "test"), ("behavioural", "validation")], "method string, split string")
    return serving.models(rows)


@query
def api_event_counts(spark, sf_dir):
    return serving.event_counts(fx.fans(spark, sf_dir))


@over(fx.transfers)
def api_search(tx):
    return serving.search(tx, "r3")


@query
def api_alert_queue(spark, sf_dir):
    return serving.alert_queue(_scores(spark, sf_dir))


@query
def demo_generator(spark, sf_dir):
    return generate.generate(spark, accounts=60, rings=3, days=20, per_day=20)[0].drop("row_ord")


def queries() -> dict[str, Query]:
    from ledgerlume.plans import whole  # noqa: F401, it registers its queries

    return dict(FOUND)

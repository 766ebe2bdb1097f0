"""Queries over files, the store, the endpoints, and the chain from transfers to lead times.

They complete the catalogue; each stands beside its SQL where SQL can express it.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlume.functions.columns import DAY_US, half_up, micros, ordered
from ledgerlume.operators import centrality, episodes, evidence, graph, labels, leadtime, metrics, models, patterns, profile, rings, scoring, serving, windows
from ledgerlume.operators import features as ft
from ledgerlume.plans import catalog
from ledgerlume.plans import fixtures as fx
from ledgerlume.plans.catalog import over, query, rounded
from ledgerlume.plans.fixtures import kept, scratch
from ledgerlume.plans.oracles import DAY, cte, sql
from ledgerlume.sources import adapters, sinks


# --- whole graphs: SQL for the queries of the catalogue that read all transfers

_STEP = "SELECT r.a, e.receiver FROM {name} r JOIN (SELECT DISTINCT sender, receiver FROM tx {way}) e ON r.b = e.sender"
_ALL = "SELECT a, a FROM (SELECT DISTINCT unnest([sender, receiver]) AS a FROM tx)"
cte("ureach_all(a, b)", f"{_ALL} UNION {_STEP.format(name='ureach_all', way='UNION SELECT receiver, sender FROM tx')}")
cte("dreach_all(a, b)", f"{_ALL} UNION {_STEP.format(name='dreach_all', way='')}")
cte("weak_all", "SELECT a AS node, min(b) AS component FROM ureach_all GROUP BY a")
cte("strong_all", "SELECT x.a AS node, min(x.b) AS component FROM dreach_all x JOIN dreach_all y ON x.a = y.b AND x.b = y.a GROUP BY x.a")
sql("wcc_components_all", "SELECT node, component FROM weak_all")
sql("scc_components_all", "SELECT node, component FROM strong_all")
sql("graph_stats_all", """
SELECT *, round(CASE WHEN n_nodes > 1 THEN n_pairs / (n_nodes * (n_nodes - 1)) ELSE 0.0 END, 6) AS density FROM (
  SELECT count(*) AS n_edges, sum(amount) AS total_amount, (SELECT count(*) FROM weak_all) AS n_nodes, (SELECT count(*) FROM pairs) AS n_pairs,
    (SELECT count(DISTINCT component) FROM weak_all) AS weak_components, (SELECT max(n) FROM (SELECT count(*) AS n FROM weak_all GROUP BY component)) AS largest_weak,
    (SELECT count(DISTINCT component) FROM strong_all) AS strong_components, (SELECT max(n) FROM (SELECT count(*) AS n FROM strong_all GROUP BY component)) AS largest_strong FROM tx)
""")
cte("hop_all(a, h)", "SELECT (SELECT min(sender) FROM tx), 0 UNION SELECT e.b, h + 1 FROM hop_all JOIN (SELECT sender AS a, receiver AS b FROM tx UNION SELECT receiver, sender FROM tx) e ON hop_all.a = e.a WHERE h < 3")
sql("khop_neighborhood_all", "SELECT a AS account_id, min(h) AS hops FROM hop_all WHERE a <> (SELECT min(sender) FROM tx) GROUP BY a")

cte("fe", "SELECT row_number() OVER (ORDER BY pattern_type, window_id, central_account) AS e, us, unnest(list_distinct(string_split(accounts, ','))) AS a FROM fans")
cte("fl", f"SELECT x.e AS x, y.e AS y FROM fe x JOIN fe y ON x.a = y.a AND x.e <> y.e AND abs(x.us - y.us) <= {10 * DAY} GROUP BY 1, 2 HAVING count(*) >= 2")
cte("fr(a, b)", "SELECT DISTINCT e, e FROM fe UNION SELECT fr.a, y FROM fr JOIN fl ON fr.b = fl.x")
sql("event_components_all", "SELECT n, count(*) AS n_components FROM (SELECT c, count(*) AS n FROM (SELECT a, min(b) AS c FROM fr GROUP BY a) GROUP BY c) GROUP BY n")


@over(fx.transfers)
def feat_window_structure(tx):
    """Clustering and component sizes of every cumulative window graph."""
    return rounded(centrality.by_window(tx, structure_only=True))


@over(fx.transfers)
def simple_cycles_windows(tx):
    """Simple cycles of the graph of every window."""
    return graph.simple_cycles(windows.tumbling(tx), 6, "window_id").select("window_id", F.array_join("cycle", ",").alias("cycle"), "length")


cte("dp", "SELECT DISTINCT window_id, sender, receiver FROM w WHERE sender <> receiver")
cte("dloop(window_id, p, tail, done)", """
SELECT window_id, [sender, receiver], receiver, false FROM dp WHERE sender < receiver
UNION ALL SELECT l.window_id, CASE WHEN receiver = p[1] THEN p ELSE list_append(p, receiver) END, receiver, receiver = p[1] FROM dloop l JOIN dp ON dp.window_id = l.window_id AND tail = sender WHERE NOT done AND len(p) <= 6 AND (receiver = p[1] OR (receiver > p[1] AND NOT list_contains(p, receiver)))
""")
sql("simple_cycles_windows", "SELECT window_id, array_to_string(p, ',') AS cycle, len(p)::INT AS length FROM dloop WHERE done AND len(p) <= 6")


@over(fx.transfers)
def ring_cycles_windows(tx):
    """Cycles among each ring's accounts in the graph of every window of four days."""
    return graph.ring_cycles(windows.tumbling(tx, "4d"), 8, "window_id")


cte("w4", f"SELECT tx.*, ((us - t0) // {4 * DAY})::INT AS window_id FROM tx, ext")
cte("m4", "SELECT DISTINCT window_id, ring_id AS r, unnest([sender, receiver]) AS a FROM w4 WHERE ring_id <> ''")
cte("r4", "SELECT DISTINCT w4.window_id, x.r, sender, receiver FROM w4 JOIN m4 x ON x.window_id = w4.window_id AND x.a = sender JOIN m4 y ON y.window_id = w4.window_id AND y.a = receiver AND x.r = y.r WHERE sender <> receiver")
cte("rloop4(window_id, r, p, tail, done)", """
SELECT window_id, r, [sender, receiver], receiver, false FROM r4 WHERE sender < receiver
UNION ALL SELECT l.window_id, l.r, CASE WHEN receiver = p[1] THEN p ELSE list_append(p, receiver) END, receiver, receiver = p[1] FROM rloop4 l JOIN r4 ON r4.window_id = l.window_id AND r4.r = l.r AND tail = sender WHERE NOT done AND len(p) <= 8 AND (receiver = p[1] OR (receiver > p[1] AND NOT list_contains(p, receiver)))
""")
sql("ring_cycles_windows", "SELECT window_id, r AS ring_id, count(*) AS n_cycles FROM rloop4 WHERE done AND len(p) <= 8 GROUP BY 1, 2")


cte("fp", "SELECT sender, receiver, min(window_id) AS f FROM w GROUP BY 1, 2")
cte("wp", "SELECT i::INT AS window_id, sender, receiver FROM (SELECT unnest(generate_series(0, hi)) AS i FROM lastw) JOIN fp ON f <= i")
cte("wn", "SELECT DISTINCT window_id, unnest([sender, receiver]) AS v FROM wp")
cte("wu", "SELECT DISTINCT window_id, unnest([sender, receiver]) AS a, unnest([receiver, sender]) AS b FROM wp WHERE sender <> receiver")
cte("wr(window_id, a, b)", "SELECT window_id, v, v FROM wn UNION SELECT r.window_id, r.a, u.b FROM wr r JOIN wu u ON u.window_id = r.window_id AND u.a = r.b")
cte("wt", "SELECT x.window_id, x.a AS v, count(*) AS t FROM wu x JOIN wu y ON y.window_id = x.window_id AND y.a = x.a AND x.b < y.b JOIN wu z ON z.window_id = x.window_id AND z.a = x.b AND z.b = y.b GROUP BY 1, 2")
sql("feat_window_structure", """
SELECT window_id, v AS account_id, round(CASE WHEN coalesce(d, 0) > 1 THEN 2.0::DOUBLE * coalesce(t, 0) / (d * (d - 1)) ELSE 0.0 END, 6) AS clustering_coefficient, n AS component_size
FROM wn LEFT JOIN (SELECT window_id, a AS v, count(*) AS d FROM wu GROUP BY 1, 2) USING (window_id, v) LEFT JOIN wt USING (window_id, v) JOIN (SELECT window_id, a AS v, count(*) AS n FROM wr GROUP BY 1, 2) USING (window_id, v)
""")


# --- files


@query
def adapter_simulator(spark, sf_dir):
    """The same transfers as simulator files with days counted from a start, and with dates."""
    tx, path = fx.transfers(spark, sf_dir), scratch(spark, "simulator")
    raw = tx.select(F.col("row_ord").alias("tran_id"), F.col("sender").alias("orig_acct"), F.col("receiver").alias("bene_acct"), F.col("amount").alias("base_amt"), micros("timestamp").alias("us"), F.when(F.col("label") == 1, "True").otherwise("False").alias("is_sar"), F.when(F.col("ring_id") != "", F.substring("ring_id", 2, 9)).otherwise("-1").alias("alert_id"))
    first = tx.agg(F.min(micros("timestamp"))).first()[0]
    out = None
    for kind, moment in (("steps", F.floor((F.col("us") - first) / DAY_US)), ("dates", F.timestamp_micros("us").cast("string"))):
        raw.withColumn("tran_timestamp", moment).drop("us").write.csv(f"{path}/{kind}/transactions.csv", header=True)
        got = adapters.load_active(spark, "simulator", f"{path}/{kind}").select(F.lit(kind).alias("kind"), "transaction_id", "sender", "receiver", "amount", micros("timestamp").alias("us"), "label", "ring_id")
        out = got if out is None else out.unionByName(got)
    return out


sql("adapter_simulator", f"""
SELECT kind, row_ord::VARCHAR AS transaction_id, sender, receiver, amount, CASE WHEN kind = 'steps' THEN epoch_us(TIMESTAMP '2024-01-01') + (us - t0) // {DAY} * {DAY} ELSE us END AS us, label, substr(ring_id, 2) AS ring_id FROM tx, ext, (VALUES ('steps'), ('dates')) v(kind)
""")


@query
def adapter_accounts(spark, sf_dir):
    """The account dimension of simulator files, with ring membership from the alerts' accounts."""
    tx, path = fx.transfers(spark, sf_dir), scratch(spark, "simulator-accounts")
    graph.nodes(tx).write.csv(f"{path}/accounts.csv", header=True)
    alerts = tx.where("ring_id = 'R3'").select(F.explode(F.array("sender", "receiver")).alias("acct_id"), F.col("ring_id").alias("alert_id"))
    alerts.write.csv(f"{path}/alert_transactions.csv", header=True)
    files = adapters.SimulatorAdapter(spark, path)
    return sinks.ring_members(files.accounts(), files.alert_transactions())


sql("adapter_accounts", "SELECT a AS account_id, a IN (SELECT unnest([sender, receiver]) FROM tx WHERE ring_id = 'R3') AS is_ring_member FROM (SELECT DISTINCT unnest([sender, receiver]) AS a FROM tx)")


@query
def adapter_pair_graph(spark, sf_dir):
    tx, path = fx.transfers(spark, sf_dir), scratch(spark, "pair-graph")
    number = F.substring("account_id", 2, 20).cast("long")
    nodes = graph.nodes(tx).select("account_id", number.alias("k")).where("k % 11 <> 0")  # some are unknown
    nodes.select("account_id", F.col("k") % 49 + 1, F.lit(0.5)).write.csv(f"{path}/features.csv", header=False)
    nodes.select(F.col("account_id").alias("txId"), F.when(F.col("k") % 7 == 0, "1").when(F.col("k") % 3 == 0, "2").otherwise("unknown").alias("class")).write.csv(f"{path}/classes.csv", header=True)
    graph.pairs(tx).toDF("txId1", "txId2").write.csv(f"{path}/edgelist.csv", header=True)
    return adapters.load_active(spark, "pair_graph", path).select("transaction_id", "sender", "receiver", "amount", micros("timestamp").alias("us"), "label")


sql("adapter_pair_graph", f"""
SELECT sender || '_' || receiver AS transaction_id, sender, receiver, NULL::DOUBLE AS amount, CASE WHEN k % 11 <> 0 THEN epoch_us(TIMESTAMP '2024-01-01') + k % 49 * 14 * {DAY} END AS us, CASE WHEN k % 11 = 0 THEN -1 WHEN k % 7 = 0 THEN 1 WHEN k % 3 = 0 THEN 0 ELSE -1 END AS label
FROM (SELECT *, substr(sender, 2)::BIGINT AS k FROM pairs)
""")


@query
def adapter_demo(spark, sf_dir):
    path = scratch(spark, "demo")
    tx = fx.transfers(spark, sf_dir)
    tx.drop("row_ord").withColumn("timestamp", F.col("timestamp").cast("string")).write.csv(f"{path}/transactions.csv", header=True)
    return adapters.load_active(spark, "demo", path).select("transaction_id", "sender", "receiver", "amount", micros("timestamp").alias("us"), "label", "ring_id", "dataset_source")


sql("adapter_demo", "SELECT transaction_id, sender, receiver, amount, us, label, ring_id, 'events' AS dataset_source FROM tx")


@query
def sink_files(spark, sf_dir):
    """Events written as CSV and as JSON and read again."""
    e, path = fx.fans(spark, sf_dir), scratch(spark, "sinks")
    sinks.write_csv(e, f"{path}/csv")
    sinks.write_json(e, f"{path}/json")
    listed = F.from_json("accounts", "array<string>")
    read = spark.read.csv(f"{path}/csv", header=True, escape='"').select(F.lit("csv").alias("format"), "pattern_type", F.size(listed).alias("n"), F.col("pattern_strength").cast("double").alias("strength"))
    both = read.unionByName(spark.read.json(f"{path}/json").select(F.lit("json").alias("format"), "pattern_type", F.size("accounts").alias("n"), F.col("pattern_strength").alias("strength")))
    return both.groupBy("format", "pattern_type").agg(F.count("*").alias("n_events"), F.sum("n").alias("n_accounts"), half_up(F.sum("strength"), 4).alias("strength"))


sql("sink_files", "SELECT format, pattern_type, count(*) AS n_events, sum(len(string_split(accounts, ',')))::BIGINT AS n_accounts, round(sum(pattern_strength), 4) AS strength FROM fans, (VALUES ('csv'), ('json')) v(format) GROUP BY 1, 2")


@query
def sink_resumed(spark, sf_dir):
    """Windows appended in two runs, the second from where the first ended."""
    own, path = windows.tumbling(fx.transfers(spark, sf_dir)).select("window_id", "transaction_id"), scratch(spark, "append")
    last = own.agg(F.max("window_id")).first()[0] or 0
    make = lambda a, b: own.where(F.col("window_id").between(a, b))
    for until in (last // 2, last):
        sinks.append_windows(make, spark, path, until, 7)
    return spark.read.parquet(path).groupBy(F.col("window_id").cast("int").alias("window_id")).agg(F.count("*").alias("n"), F.count_distinct("transaction_id").alias("n_ids"))


sql("sink_resumed", "SELECT window_id, count(*) AS n, count(DISTINCT transaction_id) AS n_ids FROM w GROUP BY 1")


@query
def store_tables(spark, sf_dir):
    """The store, filled twice; rows of each table afterwards."""
    path = scratch(spark, "store")
    tx, fans = fx.transfers(spark, sf_dir), kept(fx.fans(spark, sf_dir), "fans")
    c = kept(fx.candidates(spark, sf_dir, fans), "candidates")
    scores = kept(scoring.score_candidates(c, fx.account_scores(spark, sf_dir)), "scores")
    records = kept(evidence.records(c, tx, scores).select("candidate_ring_id", "paths", F.size("transactions").alias("n_transactions"), "risk_score", "note"), "records")
    tables = {
        "accounts": sinks.ring_members(graph.nodes(tx), graph.nodes(tx.where("label = 1")).withColumnRenamed("account_id", "acct_id")), "transactions": tx, "windows": windows.bounds(tx), "pattern_events": fans,
        "ring_candidates": c, "risk_scores": scores, "evidence": records, "alerts": sinks.alerts_of(scores),
    }
    name = f"ledgerlume_{uuid.uuid4().hex}"
    for _ in range(2):
        sinks.load_store(spark, name, tables, path)
    counted = [(t, spark.table(f"{name}.{t}").count()) for t in sinks.STORE]
    spark.sql(f"DROP DATABASE {name} CASCADE")
    return spark.createDataFrame(counted, "table_name string, n long")


sql("store_tables", """
SELECT * FROM (VALUES ('metrics', 0::BIGINT), ('model_runs', 0), ('lead_times', 0)) v(table_name, n) UNION ALL SELECT 'accounts', count(DISTINCT a) FROM (SELECT unnest([sender, receiver]) AS a FROM tx) UNION ALL SELECT 'transactions', count(*) FROM tx
UNION ALL SELECT 'windows', hi + 1 FROM lastw UNION ALL SELECT 'pattern_events', count(*) FROM fans UNION ALL SELECT unnest(['ring_candidates', 'risk_scores', 'evidence']), (SELECT count(*) FROM cand) UNION ALL SELECT 'alerts', count(*) FROM risks WHERE risk_score >= 50
""")


@over(fx.dirty)
def dq_report(tx):
    """Every issue with its count, and how many issues were found at all."""
    return profile.report(tx, catalog.NOW).select("issue", "count", "categories_with_findings")


sql("dq_report", "SELECT issue, n AS count, count(*) FILTER (WHERE n > 0) OVER () AS categories_with_findings FROM (SELECT issue, sum(hit::INT)::BIGINT AS n FROM hits GROUP BY issue)")


# --- endpoints


def _rings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fixture's candidates with what a candidate stores besides."""
    e = fx.fans(spark, sf_dir).withColumn("us", F.unix_micros("timestamp"))
    seq = e.groupBy(F.col("central_account").alias("candidate_ring_id")).agg(ordered(F.col("pattern_type"), "us", "pattern_type").alias("pattern_sequence"), ordered(F.col("window_id"), "us", "pattern_type").alias("event_window_ids"))
    c = fx.candidates(spark, sf_dir).join(seq, "candidate_ring_id")
    return c.withColumns({"formation_stage": rings.stage(F.col("patterns")), "formation_stage_is_provisional": F.lit(True), "network_statistics": F.struct("density"), "evidence_event_count": F.col("event_count").cast("int"), "source_trajectory_id": F.concat(F.lit("T"), "candidate_ring_id")})


cte("seqs", "SELECT central_account AS id, list(pattern_type ORDER BY us, pattern_type) AS seq, list(window_id ORDER BY us, pattern_type) AS wins FROM fans GROUP BY 1")


@query
def api_ring_graph(spark, sf_dir):
    g = serving.ring_graph(evidence.records(fx.candidates(spark, sf_dir), fx.transfers(spark, sf_dir)), "A1")
    return g.select("candidate_ring_id", F.size("nodes").alias("n_nodes"), F.explode("edges").alias("e")).select("candidate_ring_id", "n_nodes", "e.id", "e.source", "e.target", "e.amount", micros(F.col("e.timestamp")).alias("us"))


sql("api_ring_graph", "SELECT id AS candidate_ring_id, (SELECT count(DISTINCT a) FROM (SELECT unnest([sender, receiver]) AS a FROM ctx WHERE id = 'A1'))::INT AS n_nodes, transaction_id AS id, sender AS source, receiver AS target, amount, us FROM ctx WHERE ctx.id = 'A1'")


@query
def api_ring_timeline(spark, sf_dir):
    t = serving.ring_timeline(_rings(spark, sf_dir), "A1")
    return t.select("candidate_ring_id", "start_us", "end_us", "formation_stage", F.array_join("pattern_sequence", ",").alias("sequence"), F.array_join(F.transform("event_window_ids", lambda w: w.cast("string")), ",").alias("windows"), F.size("pattern_transitions").alias("n_transitions"), "pattern_escalation_steps", "has_structural_sequence")


sql("api_ring_timeline", "SELECT id AS candidate_ring_id, start_us, end_us, CASE WHEN len(pats) >= 3 THEN 'EMERGING' WHEN len(pats) >= 2 THEN 'FORMING' ELSE 'WATCH' END AS formation_stage, array_to_string(seq, ',') AS sequence, array_to_string(wins, ',') AS windows, 0 AS n_transitions, 0 AS pattern_escalation_steps, false AS has_structural_sequence FROM cand JOIN seqs USING (id) WHERE id = 'A1'")


@query
def api_ring_evidence(spark, sf_dir):
    r = evidence.records(_rings(spark, sf_dir), fx.transfers(spark, sf_dir), catalog._scores(spark, sf_dir))
    e = serving.ring_evidence(r, "A1", 12)
    return e.select("candidate_ring_id", "time_range.start_us", "time_range.end_us", "risk_factors.risk_score", "risk_factors.risk_level", "risk_factors.score_components.fund_flow", "note", F.size("trajectory.pattern_sequence").alias("n_sequence"), F.explode("transactions").alias("t")).select("*", "t.id").drop("t")


sql("api_ring_evidence", "SELECT r.id AS candidate_ring_id, start_us, end_us, risk_score, risk_level, fund_flow, NULL::VARCHAR AS note, len(seq)::INT AS n_sequence, x.transaction_id AS id FROM risks r JOIN cand USING (id) JOIN seqs USING (id) JOIN (SELECT * FROM ctx WHERE id = 'A1' ORDER BY row_ord LIMIT 12) x ON x.id = r.id WHERE r.id = 'A1'")


@query
def api_ring_explanation(spark, sf_dir):
    e = serving.ring_explanation(evidence.explanations(_rings(spark, sf_dir), catalog._scores(spark, sf_dir)), "A1")
    return _explained(e)


def _explained(e: DataFrame) -> DataFrame:
    return e.select(
        "candidate_ring_id", "who.n_accounts", F.array_join("who.account_roles", ",").alias("roles"), "what.description", F.size("what.pattern_sequence").alias("n_sequence"), "when.formation_stage", "when.formation_stage_is_provisional", half_up(F.col("where.evidence_density"), 6).alias("density"),
        "how.n_transactions", "how.evidence_event_count", "how.source_trajectory_id", "why.risk_score", "why.risk_level", "why.score_components.behavioural", F.size("why.top_factors").alias("n_factors"), F.col("why.note").alias("note"), F.col("how_early.note").alias("how_early"),
    )


@query
def evidence_explained(spark, sf_dir):
    """Explanations of all of the fixture's candidates."""
    return _explained(evidence.explanations(_rings(spark, sf_dir), catalog._scores(spark, sf_dir)))


_D = evidence.DESCRIPTIONS
cte("expl", f"""
SELECT r.id AS candidate_ring_id, len(acc)::INT AS n_accounts, concat_ws(',', CASE WHEN list_contains(pats, 'fan_in') THEN 'possible_collector' END, CASE WHEN list_contains(pats, 'fan_out') THEN 'possible_distributor' END) AS roles,
  (SELECT upper(d[1]) || lower(d[2:]) || '.' FROM (SELECT concat_ws('; ', CASE WHEN list_contains(pats, 'fan_in') THEN '{_D["fan_in"]}' END, CASE WHEN list_contains(pats, 'fan_out') THEN '{_D["fan_out"]}' END) AS d)) AS description,
  len(seq)::INT AS n_sequence, CASE WHEN len(pats) >= 3 THEN 'EMERGING' WHEN len(pats) >= 2 THEN 'FORMING' ELSE 'WATCH' END AS formation_stage, true AS formation_stage_is_provisional, round(density, 6) AS density, len(ids)::INT AS n_transactions, event_count::INT AS evidence_event_count,
  'T' || r.id AS source_trajectory_id, risk_score, risk_level, behavioural, 4 AS n_factors, NULL::VARCHAR AS note, '{evidence.HOW_EARLY}' AS how_early FROM risks r JOIN cand USING (id) JOIN seqs USING (id)
""")
sql("evidence_explained", "SELECT * FROM expl")
sql("api_ring_explanation", "SELECT * FROM expl WHERE candidate_ring_id = 'A1'")


@query
def api_metrics(spark, sf_dir):
    """Metrics nested by method and split, opened again."""
    s, rows = labels.chronological(fx.scored(spark, sf_dir)), None
    for split in ("train", "validation", "test"):
        m = metrics.confusion(s.where(F.col("split") == split)).select(F.lit("score").alias("method"), F.lit(split).alias("split"), F.explode(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value")) for c in ("precision", "recall", "f1")])).alias("x")).select("method", "split", "x.*")
        rows = m if rows is None else rows.unionByName(m)
    opened = serving.metric_tree(rows).select("method", F.explode("metrics").alias("split", "m")).select("method", "split", F.explode("m").alias("metric", "value"))
    return rounded(opened)


cte("mt", "SELECT split, count(*) FILTER (WHERE score >= 0.5 AND y = 1) AS tp, count(*) FILTER (WHERE score >= 0.5 AND y = 0) AS fp, count(*) FILTER (WHERE score < 0.5 AND y = 1) AS fn FROM sc JOIN parted USING (window_id) GROUP BY 1")
sql("api_metrics", "SELECT 'score' AS method, split, unnest(['precision', 'recall', 'f1']) AS metric, round(unnest([CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0.0 END, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0.0 END, CASE WHEN tp > 0 THEN 2.0 * tp / (2 * tp + fp + fn) ELSE 0.0 END]), 6) AS value FROM mt")


@query
def api_lead_time(spark, sf_dir):
    """What the endpoint answers, and its note where nothing was measured."""
    answers = [serving.lead_time(None), serving.lead_time(leadtime.lead_summary(catalog._leads(spark, sf_dir)))]
    return spark.createDataFrame([(a.get("note"), a.get("n_truth"), a.get("n_matched"), a.get("n_early")) for a in answers], "note string, n_truth long, n_matched long, n_early long")


sql("api_lead_time", "SELECT NULL::VARCHAR AS note, count(*) AS n_truth, count(id) AS n_matched, count(*) FILTER (WHERE ow >= ww) AS n_early FROM lt UNION ALL SELECT 'lead time has not been computed', NULL, NULL, NULL")


@query
def api_status(spark, sf_dir):
    answers = [("health", serving.health()["status"])] + [(a, serving.stub(a)["status"]) for a in ("analyze", "retrain", "upload")]
    return spark.createDataFrame(answers, "action string, status string")


sql("api_status", "SELECT * FROM (VALUES ('health', 'ok'), ('analyze', 'accepted'), ('retrain', 'accepted'), ('upload', 'accepted')) v(action, status)")


@query
def risk_ranked(spark, sf_dir):
    """Candidates by score, with their places."""
    return scoring.ranked(catalog._scores(spark, sf_dir)).select("candidate_ring_id", "risk_score").limit(10)


sql("risk_ranked", "SELECT id AS candidate_ring_id, risk_score FROM risks ORDER BY risk_score DESC, id LIMIT 10")


# --- lead time from real inputs


def _candidate_leads(spark: SparkSession, sf_dir: str) -> DataFrame:
    tx, truth, inputs = fx.transfers(spark, sf_dir), catalog._truth(spark, sf_dir), catalog._inputs(spark, sf_dir)
    placed = windows.with_extent(truth, tx)
    at = lambda c: windows.window_of(F.col(c), F.col("t0"), F.col("t1"))
    seen = placed.select("truth_id", at("start_us").alias("observable_window"), at("end_us").alias("completion_window"))
    return leadtime.candidate_leads(inputs[1], catalog._pairs(spark, sf_dir, inputs[1]), leadtime.warning_window(catalog._risk(spark, sf_dir, inputs), 30), seen)


@query
def lead_by_candidate(spark, sf_dir):
    return rounded(_candidate_leads(spark, sf_dir))


cte("ctr", "SELECT * FROM ivm WHERE mt IS NOT NULL QUALIFY row_number() OVER (PARTITION BY id ORDER BY mt = 'STRONG' DESC, s DESC, s / gn DESC, j DESC, od DESC, gd, id, tid) = 1")
cte("lc", f"""
SELECT c.id, b.tid, coalesce(mt, 'NONE') AS ms, s, s / gn AS recall, s / cn AS precision, j, od, gd, ww, ((g0 - t0) // {DAY})::INT AS ow, ((g1 - t0) // {DAY})::INT AS cw FROM cand c LEFT JOIN ctr b USING (id) LEFT JOIN warned USING (id), ext
""")
sql("lead_by_candidate", """
SELECT id AS candidate_id, tid AS truth_id, ms AS match_strength, s AS shared, round(recall, 6) AS recall, round(precision, 6) AS precision, round(j, 6) AS jaccard, round(od, 6) AS overlap_days, round(gd, 6) AS gap_days, ww IS NOT NULL AS alerted, ww AS warning_window,
  ow AS observable_window, ow - ww AS lead_time, coalesce(ow >= ww, false) AS early, cw AS completion_window, cw - ww AS completion_lead_time, coalesce(cw >= ww, false) AS completion_early FROM lc
""")


@query
def lead_time_report(spark, sf_dir):
    """Strict and extended figures over all candidates."""
    return rounded(leadtime.lead_report(_candidate_leads(spark, sf_dir), catalog._truth(spark, sf_dir).count()))


def _report(name: str, matched: str) -> str:
    used = f"{matched} AND ow - ww IS NOT NULL"
    found = f"count(DISTINCT tid) FILTER (WHERE {used})"
    out = [
        f"count(*) FILTER (WHERE {used}) AS {name}_alerted_and_matched, round(count(*) FILTER (WHERE {matched}) / count(*), 6) AS {name}_candidate_match_rate, {found} AS {name}_truth_detected, round({found} / (SELECT count(*) FROM gt), 6) AS {name}_detection_rate",
        f"round(CASE WHEN count(ww) > 0 THEN count(*) FILTER (WHERE ww IS NOT NULL AND NOT ({matched})) / count(ww) END, 6) AS {name}_false_warning_rate",
    ]
    for kind, lead in (("lead_time", "ow - ww"), ("completion_lead_time", "cw - ww")):
        x = f"CASE WHEN {matched} THEN {lead} END"
        out += [f"round(avg({x}), 6) AS {name}_mean_{kind}, round(median({x}), 6) AS {name}_median_{kind}, min({x}) AS {name}_min_{kind}, max({x}) AS {name}_max_{kind}, round(CASE WHEN count({x}) > 1 THEN stddev_pop({x}) END, 6) AS {name}_std_{kind}"]
        out += [f"count(*) FILTER (WHERE {matched} AND {lead} >= 0) AS {name}_early_{kind}, round(CASE WHEN count({x}) > 0 THEN count(*) FILTER (WHERE {matched} AND {lead} >= 0) / count({x}) END, 6) AS {name}_early_rate_{kind}"]
    return ", ".join(out)


sql("lead_time_report", f"""
SELECT (SELECT count(*) FROM gt) AS n_truth, count(*) AS n_candidates, count(*) FILTER (WHERE ms = 'STRONG') AS n_strong, count(*) FILTER (WHERE ms = 'MODERATE') AS n_moderate, count(*) FILTER (WHERE ms <> 'NONE') AS n_extended, count(ww) AS n_alerted, {_report("strict", "ms = 'STRONG'")}, {_report("extended", "ms <> 'NONE'")} FROM lc
""")


# --- from transfers to lead times


def _everything(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Transfers, and the events of every detector, written once."""
    tx = fx.transfers(spark, sf_dir)
    rising = ft.change_features(ft.degree_features(tx))
    return tx, kept(patterns.detect_all(tx, features=rising), "events")


@over(fx.transfers)
def pattern_circular_flow_all(tx):
    """Cycles of the detector's own length and days, from every account, over all later sends."""
    return fx.flat(patterns.circular_flow(tx, branching=None))


@query
def pattern_event_log_all(spark, sf_dir):
    """Events of all detectors by type and window."""
    return fx.flat(_everything(spark, sf_dir)[1]).groupBy("pattern_type", "window_id").agg(F.count("*").alias("n"), half_up(F.sum("pattern_strength"), 4).alias("strength"))


@query
def detect_all_summary(spark, sf_dir):
    """All eight detectors with their defaults, cycles from participants of structural events."""
    return patterns.type_summary(_everything(spark, sf_dir)[1])


@query
def lead_time_chain(spark, sf_dir):
    """From transfers to lead times: all detectors, trajectories, candidates, scores over time,
    matches with the truth, and the lead of each candidate."""
    tx, events = _everything(spark, sf_dir)
    found = kept(rings.ring_candidates(episodes.trajectories(events), tx), "rings")
    c = found.withColumns({"candidate_id": F.col("candidate_ring_id"), "event_count": F.col("evidence_event_count").cast("long"), "density": F.col("network_statistics.density")})
    own = F.explode(F.arrays_zip(F.col("event_window_ids").alias("window_id"), F.col("pattern_sequence").alias("pattern_type"))).alias("x")
    each = c.select("candidate_id", own).select("candidate_id", "x.*")
    scores = fx.account_scores(spark, sf_dir)
    named = lambda df: df.withColumnRenamed("candidate_ring_id", "candidate_id")
    fixed = c.select("candidate_id", F.size("accounts").alias("n_accounts")).join(named(scoring.behavioural(c, scores)), "candidate_id").join(named(scoring.network(c)), "candidate_id")
    truth = catalog._truth(spark, sf_dir)
    placed = windows.with_extent(truth, tx)
    at = lambda col: windows.window_of(F.col(col), F.col("t0"), F.col("t1"))
    seen = placed.select("truth_id", at("start_us").alias("observable_window"), at("end_us").alias("completion_window"))
    warned = leadtime.warning_window(leadtime.cumulative_risk(each, fixed), 50)
    return rounded(leadtime.candidate_leads(c, leadtime.interval_pairs(c, truth), warned, seen))


# --- models, all four, all sets and weights


def _full_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The feature table with every network feature, labelled and split."""
    tx = fx.transfers(spark, sf_dir)
    return labels.chronological(labels.attach(ft.build(tx), labels.forecast(tx)))


@query
def model_comparison_all(spark, sf_dir):
    """The four methods on all features."""
    four = {"static": models.Isolation(), "behavioural": models.Behavioural(), "temporal": models.Temporal(), "proposed": models.Boosted()}
    return models.compare(_full_table(spark, sf_dir), four)


@query
def ablation_all(spark, sf_dir):
    """The six nested sets of features."""
    return models.ablation(_full_table(spark, sf_dir), models.Boosted)


@query
def class_weights(spark, sf_dir):
    """The six multipliers of the positive weight, the best on validation first."""
    return models.class_weight_experiment(_full_table(spark, sf_dir), lambda w: models.Boosted(multiplier=w))


@query
def predictions_export(spark, sf_dir):
    """Scores of a fitted baseline, written and read again."""
    t = kept(_full_table(spark, sf_dir), "features")
    return kept(models.Behavioural().fit(t.where("split = 'train'")).predict(t.where("split = 'test'")).select(*ft.KEYS, "y", "score"), "predictions")


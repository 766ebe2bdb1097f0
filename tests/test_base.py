import datetime as dt

import duckdb
import pytest
from pyspark.sql import functions as F

from ledgerlume.functions.durations import duration_us
from ledgerlume.operators import centrality, cleaning, evidence, graph, labels, leadtime, metrics, profile, scoring, windows
from ledgerlume.operators import features as ft
from ledgerlume.plans import catalog, oracles
from ledgerlume.sources import adapters, canonical, generate, sinks
from tests.helpers import at, table


def rows(df):
    return [r.asDict() for r in df.collect()]


def test_durations():
    assert duration_us("1d") == 86_400_000_000 and duration_us("12h") * 2 == duration_us("1D") and duration_us("2w") == 14 * duration_us("1d") and duration_us("15min") == 15 * duration_us("60s")
    with pytest.raises(ValueError):
        duration_us("soon")


def test_coercion(spark):
    df = spark.createDataFrame([("1", "a", "b", "x", "2026-01-01"), ("2", "a", "b", "3.5", "never")], "transaction_id string, sender string, receiver string, amount string, timestamp string")
    a, b = canonical.coerce(df, "test").orderBy("transaction_id").collect()
    assert a["amount"] is None and a["label"] == -1 and a["ring_id"] == "" and a["dataset_source"] == "test" and b["timestamp"] is None and b["amount"] == 3.5
    with pytest.raises(ValueError):
        canonical.coerce(df.drop("amount"), "test")
    assert not canonical.schema_problems(canonical.empty(spark)) and canonical.schema_problems(df)


def test_simulator_files(spark, tmp_path):
    (tmp_path / "transactions.csv").write_text("tran_id,orig_acct,bene_acct,tx_type,base_amt,tran_timestamp,is_sar,alert_id\n1,10,11,T,5.5,0,True,7\n2,11,12,T,x,3,False,-1\n")
    a, b = adapters.load_active(spark, "simulator", str(tmp_path)).orderBy("transaction_id").collect()
    assert (a["ring_id"], a["label"], b["ring_id"], b["label"], b["amount"]) == ("7", 1, "", 0, None)
    assert (b["timestamp"] - a["timestamp"]).days == 3
    assert adapters.SimulatorAdapter(spark, str(tmp_path)).accounts() is None
    (tmp_path / "transactions.csv").write_text("tran_id,orig_acct,bene_acct,base_amt,tran_timestamp\n1,10,11,5.5,2017-01-03T00:00:00Z\n")
    assert adapters.load_active(spark, "simulator", str(tmp_path)).first()["timestamp"].year == 2017
    with pytest.raises(ValueError):
        adapters.load_active(spark, "nothing", str(tmp_path))


def test_pair_graph_files(spark, tmp_path):
    (tmp_path / "features.csv").write_text("5,1,0.1\n6,2,0.2\n")
    (tmp_path / "classes.csv").write_text("txId,class\n5,1\n6,unknown\n")
    (tmp_path / "edgelist.csv").write_text("txId1,txId2\n5,6\n6,5\n")
    a, b = adapters.load_active(spark, "pair_graph", str(tmp_path)).orderBy("transaction_id").collect()
    assert a["transaction_id"] == "5_6" and (a["label"], b["label"]) == (1, -1) and (b["timestamp"] - a["timestamp"]).days == 14 and a["amount"] is None
    assert cleaning.clean(adapters.load_active(spark, "pair_graph", str(tmp_path)), drop_null_amount=False).count() == 2


def test_generator(spark):
    tx, ends, truth = generate.generate(spark, accounts=20, rings=2, days=12, per_day=5)
    again = generate.generate(spark, accounts=20, rings=2, days=12, per_day=5)[0]
    assert sorted(map(str, tx.collect())) == sorted(map(str, again.collect()))
    assert truth.count() == 2 and ends.where("is_ring_member").count() == 28 and tx.where("label = 1").count() == 2 * 27
    for stage in generate.STAGES:
        assert tx.where(f"scenario_id LIKE '%:{stage[0]}'").count()


def test_cleaning(spark):
    raw = [("A", "B", 1, at(2)), ("A", "B", 1, None), (None, "B", 1, at()), ("A", " ", 1, at()), ("A", "B", 0, at()), ("A", "B", -10, at()), ("A", "B", None, at()), ("A", "A", 5, at(1))]
    df = table(spark, raw)
    assert {r["transaction_id"] for r in rows(cleaning.clean(df))} == {"t0", "t7"} and cleaning.clean(df, drop_self=True).count() == 1
    twice = df.where("row_ord = 0").unionByName(df.where("row_ord = 0").selectExpr("* EXCEPT (row_ord, receiver)", "'later' AS receiver", "9 AS row_ord"))
    assert rows(cleaning.clean(twice))[0]["receiver"] == "B"
    log = {r["step"]: r for r in rows(cleaning.step_log(df))}
    assert log["validate_schema"]["rows_before"] == 8 and log["check_label"]["rows_after"] == 2 and log["self_transaction"]["details"] == 1
    with pytest.raises(ValueError):
        cleaning.check_labels(table(spark, [("A", "B", 1, at(), 7)]))


def test_quality(spark):
    raw = [("A", "B", 1, at()), ("A", "B", 1, at()), ("A", "B", -5, at(1)), ("A", None, 0, at(2)), ("C", "C", 1, dt.datetime(2099, 1, 1, tzinfo=dt.UTC)), ("A", "D", 1, at(0.5), 7), ("A", "E", 1, at(5), 1)]
    n = {r["issue"]: r["count"] for r in rows(profile.issue_counts(table(spark, raw), at(30)))}
    assert (n["duplicate_transaction_content"], n["negative_amount"], n["zero_amount"], n["missing_receiver"], n["self_transaction"], n["future_timestamp"], n["invalid_label_value"], n["positive_label_without_ring"]) == (2, 1, 1, 1, 1, 1, 1, 1)
    assert profile.out_of_order(table(spark, raw), 2).first()[0] == 1 and len(n) == 20
    assert profile.report(table(spark, raw), at(30)).first()["categories_with_findings"] >= 8


def test_windows(spark):
    tx = table(spark, [("A", "B", 1, at(0, 5)), ("A", "B", 1, at(3, 4)), ("A", "B", 1, at(3, 6))])
    assert windows.bounds(tx).count() == 4 and windows.tumbling(tx).where("window_id = 2").count() == 1 and windows.bounds(canonical.empty(spark)).count() == 0
    assert windows.assigned(tx, "2d", "1d").count() == 5


def test_graphs(spark):
    chain = table(spark, [("A", "B", 1, at()), ("B", "C", 1, at()), ("A", "B", 2, at()), ("X", "Y", 1, at())])
    s = graph.stats(chain).first()
    assert (s["n_nodes"], s["n_edges"], s["n_pairs"], s["weak_components"], s["largest_weak"], s["strong_components"]) == (5, 4, 3, 2, 3, 5)
    assert {r["account_id"] for r in rows(graph.k_hop(chain, "A", 2))} == {"B", "C"} and graph.k_hop(chain, "Q").count() == 0
    assert [r["path"] for r in rows(graph.simple_paths(chain, "A", "C"))] == [["A", "B", "C"]]
    ring = table(spark, [("A", "B", 1, at()), ("B", "C", 1, at()), ("C", "A", 1, at())])
    assert [r["cycle"] for r in rows(graph.simple_cycles(ring))] == [["A", "B", "C"]] and graph.simple_cycles(chain).count() == 0
    assert graph.strong_components(ring).select("component").distinct().count() == 1
    with pytest.raises(ValueError):
        graph.snapshot(ring, 0, 1, "other")


def test_centrality(spark):
    tx = table(spark, [("A", "B", 1, at()), ("B", "C", 1, at()), ("C", "A", 1, at()), ("C", "D", 1, at())])
    c = {r["account_id"]: r for r in rows(centrality.by_window(tx, "1d", None))}
    assert c["C"]["betweenness_centrality"] == pytest.approx(3 / 6) and c["A"]["clustering_coefficient"] == 1 and c["C"]["clustering_coefficient"] == pytest.approx(1 / 3) and c["A"]["component_size"] == 4
    assert sum(x["pagerank"] for x in c.values()) == pytest.approx(1)
    one = {r["account_id"]: r["pagerank"] for r in rows(centrality.pagerank_one(graph.pairs(tx), 60))}
    assert all(one[k] == pytest.approx(c[k]["pagerank"], abs=1e-5) for k in c)
    assert {r["account_id"]: r["clustering_coefficient"] for r in rows(centrality.clustering_one(graph.pairs(tx)))}["C"] == pytest.approx(1 / 3)


def test_features(spark):
    f = {r["account_id"]: r for r in rows(ft.transaction_features(windows.tumbling(table(spark, [(f"S{i}", "HUB", 100, at()) for i in range(4)]))))}
    assert f["HUB"]["in_count"] == 4 and f["HUB"]["in_amount"] == 400 and f["S0"]["out_amount_concentration"] == 1
    f = {r["account_id"]: r for r in rows(ft.transaction_features(windows.tumbling(table(spark, [("A", f"R{i}", 10, at()) for i in range(4)]))))}
    assert f["A"]["out_amount_concentration"] == 0.25
    t = rows(ft.build(table(spark, [("A", "B", 100, at(0)), ("C", "B", 100, at(1)), ("D", "B", 300, at(1))]), betweenness_sources=None).where("account_id = 'B'").orderBy("window_id"))
    assert t[0]["delta_total_degree"] is None and t[1]["delta_total_degree"] == 2 and t[1]["delta_connectivity"] == 4 and set(ft.ALL) <= set(t[0])
    assert [r[0] for r in spark.createDataFrame([("['a', 'b']",), ("('a',)",), ("x",)], "t string").select(ft.parse_accounts(F.col("t"))).collect()] == [["a", "b"], ["a"], ["x"]]


def test_labels(spark):
    tx = table(spark, [("A", "B", 1, at(0)), ("A", "B", 1, at(2), 1), ("A", "B", 1, at(5), 1)])
    y = {r["window_id"]: r["y"] for r in rows(labels.forecast(tx).where("account_id = 'A'"))}
    assert y == {0: 1, 2: 0, 5: 0}
    split = labels.chronological(spark.range(100).selectExpr("CAST(id AS INT) AS window_id")).groupBy("split").count()
    assert {r["split"]: r["count"] for r in rows(split)} == {"train": 60, "validation": 20, "test": 20}


def test_scores(spark):
    with pytest.raises(ValueError):
        from ledgerlume.functions.config import Settings

        scoring.score_candidates(None, None, Settings(score_weights={"behavioural": 1.0}))
    got = [r["risk_level"] for r in rows(catalog.risk_level_bands(spark, "").orderBy("score"))]
    assert got[:1001].count("UNKNOWN") == 0 and got[744] == "HIGH" and got[1000] == "CRITICAL"
    c = spark.createDataFrame([("R1", list("abcd"), ["fan_in"], 2, 0.1), ("R2", list("efgh"), ["fan_in"], 2, 0.2)], "candidate_ring_id string, accounts array<string>, patterns array<string>, event_count int, density double")
    s = spark.createDataFrame([("a", 0.9), ("b", 0.85), ("c", 0.92), ("d", 0.88), ("e", 0.99), ("f", 0.01), ("g", 0.02), ("h", 0.03)], "account_id string, score double")
    b = {r["candidate_ring_id"]: r["behavioural"] for r in rows(scoring.behavioural(c, s))}
    assert b["R1"] > 80 and b["R2"] < 30
    assert {r["candidate_ring_id"]: r["network"] for r in rows(scoring.network(c))} == {"R1": 0, "R2": 50}


def test_metrics(spark):
    s = spark.createDataFrame([(1, 0.9), (1, 0.8), (0, 0.8), (0, 0.1)], "y int, score double")
    e = metrics.evaluate(s, 0.5, (2,), "y").first()
    assert e["roc_auc"] == pytest.approx(0.875) and e["pr_auc"] == pytest.approx(0.5 + 0.5 * 2 / 3) and e["precision"] == pytest.approx(2 / 3)
    none = metrics.evaluate(spark.createDataFrame([(0, 0.5)], "y int, score double"), 0.5, (10,), "y").first()
    assert none["precision"] is None and none["roc_auc"] is None and none["note"]


def test_lead_time(spark):
    obs = spark.createDataFrame([("g1", 6), ("g2", 3)], "truth_id string, observable_window int")
    match = spark.createDataFrame([("g1", "c1")], "truth_id string, candidate_id string")
    warn = spark.createDataFrame([("c1", 2)], "candidate_id string, warning_window int")
    got = {r["truth_id"]: r for r in rows(leadtime.lead_times(match, warn, obs))}
    assert got["g1"]["lead_time"] == 4 and got["g1"]["early"] and not got["g2"]["alerted"] and got["g2"]["lead_time"] is None
    from pyspark.sql import functions as F

    assert [r[0] for r in spark.createDataFrame([("123.0",), ("a.0",), (" 7 ",)], "x string").select(leadtime.clean_id(F.col("x"))).collect()] == ["123", "a.0", "7"]


def test_evidence(spark):
    tx = table(spark, [("A", "B", 1, at(0)), ("B", "C", 2, at(1)), ("C", "D", 3, at(2)), ("X", "Y", 9, at(3))])
    c = spark.createDataFrame([("R1", ["A"], ["t0", "t1", "t2"], ["layering"])], "candidate_ring_id string, accounts array<string>, transaction_ids array<string>, patterns array<string>")
    r = evidence.records(c, tx).first()
    assert len(r["evidence_subgraph"]["nodes"]) == 4 and len(r["evidence_subgraph"]["edges"]) == 3 and r["note"] == evidence.NOT_EVALUATED and r["lead_time"] is None


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(i, f"<{i}>", [i]) for i in range(5)], "window_id int, name string, xs array<int>")
    sinks.write_csv(df, str(tmp_path / "c"))
    sinks.write_json(df, str(tmp_path / "j"))
    assert spark.read.csv(str(tmp_path / "c"), header=True).count() == 5 == spark.read.json(str(tmp_path / "j")).count()
    make = lambda a, b: df.where(f"window_id BETWEEN {a} AND {b}")
    assert sinks.append_windows(make, spark, str(tmp_path / "w"), 2, 2) == 2 and sinks.append_windows(make, spark, str(tmp_path / "w"), 4, 2) == 1
    assert spark.read.parquet(str(tmp_path / "w")).count() == 5
    page = sinks.html_report("T", {"a": 1}, {"n": 5}, {"rows": sinks.html_table(df.orderBy("window_id"), 2)})
    assert "&lt;1&gt;" in page and "&lt;2&gt;" not in page
    members = sinks.ring_members(spark.createDataFrame([("a",), ("b",)], "account_id string"), spark.createDataFrame([("a",)], "acct_id string"))
    assert {r["account_id"]: r["is_ring_member"] for r in rows(members)} == {"a": True, "b": False}


SLOW = {"graph_window_summary", "pattern_event_log", "pattern_type_summary"}


@pytest.mark.parametrize("name", sorted(set(oracles.oracle_sql()) - SLOW))
def test_queries_against_sql(spark, sf, name):
    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    for t in ("events", "lineitem"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    got = catalog.queries()[name](spark, sf)
    want = con.sql(oracles.oracle_sql()[name])
    assert sorted(got.columns) == sorted(want.columns)
    plain = lambda rs: sorted(str([round(float(x), 9) if isinstance(x, (int, float)) and not isinstance(x, bool) else str(x) for x in r]) for r in rs)
    assert plain(got.select(sorted(got.columns)).collect()) == plain(want.select(", ".join(f'"{c}"' for c in sorted(want.columns))).fetchall())


def test_every_query_has_its_name():
    import __spark_entry__

    assert set(oracles.oracle_sql()) <= set(catalog.queries()) <= set(__spark_entry__.queries())

import json
import random
import time
from collections import deque

import duckdb
import pytest
from pyspark.sql import functions as F

from ledgerlume.functions.columns import DAY_US, HOUR_US
from ledgerlume.functions.running import totals_before
from ledgerlume.operators import centrality, evidence, graph, leadtime, patterns
from ledgerlume.plans import catalog, oracles
from ledgerlume.sources import adapters, canonical, sinks
from tests.helpers import at, table


def moves(seed, n, accounts, days, hours=4):
    """Random transfers with many ties in time."""
    r = random.Random(seed)
    return [(f"a{r.randrange(accounts)}", f"a{r.randrange(accounts)}", r.randrange(1, 9), at(r.randrange(days), r.randrange(0, 24, hours))) for _ in range(n)]


def us(x):
    return int(x[3].timestamp() * 1_000_000)


@pytest.mark.parametrize("seed", range(3))
def test_pass_through_against_brute_force(spark, seed):
    rows = moves(seed, 120, 8, 12)
    hold = 30 * HOUR_US
    near = {}
    for i, x in sorted(enumerate(rows), key=lambda y: (us(y[1]), y[0])):
        outs = sorted((us(o), k) for k, o in enumerate(rows) if o[0] == x[1] and us(o) >= us(x))
        if outs and outs[0][1] != i and outs[0][0] - us(x) <= hold:
            near.setdefault((x[1], outs[0][1]), i)
    got = {(r["account"], int(r["o"]["transaction_id"][1:])): int(r["i"]["transaction_id"][1:]) for r in patterns.pass_through(table(spark, rows), 30).collect()}
    assert got == near and near


def test_a_hub_takes_time_in_proportion(spark):
    took = []
    for n in (20_000, 80_000):
        legs = spark.range(n).selectExpr("concat('t', id) transaction_id", "if(id % 2 = 0, concat('s', id % 50), 'hub') sender", "if(id % 2 = 0, 'hub', concat('r', id % 50)) receiver", "1.0D amount", "timestamp_seconds(1700000000 + id * 60) timestamp", "id row_ord")
        start = time.monotonic()
        assert patterns.pass_through(legs).count() == n // 2
        took.append(time.monotonic() - start)
    assert took[1] < 12 * took[0] + 5


@pytest.mark.parametrize("seed", range(4))
def test_split_merge_against_brute_force(spark, seed):
    rows = moves(seed, 90, 14, 20, 8)
    z = 2 * DAY_US
    want = {}
    for i, x in sorted(enumerate(rows), key=lambda y: (us(y[1]), y[0])):
        if x[0] in want:
            continue
        paid = [(us(o), k) for k, o in enumerate(rows) if o[0] == x[0] and us(x) <= us(o) < us(x) + z]
        targets = list(dict.fromkeys(rows[k][1] for _, k in sorted(paid)))
        if len(targets) < 2:
            continue
        onward = [(us(o), k) for k, o in enumerate(rows) if o[0] in targets and us(x) <= us(o) < us(x) + 2 * z]
        from_ = {}
        for _, k in onward:
            from_.setdefault(rows[k][1], set()).add(rows[k][0])
        dests = sorted((-len(s), d) for d, s in from_.items() if len(s) >= 2)
        if dests:
            dest = dests[0][1]
            ids = [f"t{k}" for _, k in sorted(paid)] + [f"t{k}" for t, k in sorted(onward) if rows[k][1] == dest]
            want[x[0]] = (us(x), targets, dest, list(dict.fromkeys(ids)))
    got = {}
    for e in patterns.split_merge(table(spark, rows)).withColumn("us", F.unix_micros("timestamp")).collect():
        d = json.loads(e["evidence"])
        got[e["central_account"]] = (e["us"], d["split_targets"], d["merge_destination"], e["transaction_ids"])
    assert got == want and want


def test_suppression_against_the_fold(spark):
    r = random.Random(5)
    flat = []
    for i in range(300):
        later = sorted(r.sample(range(i + 1, i + 12), r.randrange(2, 5)))
        flat.append((f"t{i}", i * 10, i, [f"t{i}", *[f"t{k}" for k in later]]))
    flat = [x for x in flat if r.random() < 0.7]
    used, want = set(), set()
    for start, _, _, ids in flat:
        if start in used:
            want.add(start)
        else:
            used.update(ids)
    df = spark.createDataFrame(flat, "start string, us long, row_ord long, ids array<string>").repartition(3)
    for rounds in (0, 2, 100):
        got = [x["start"] for x in patterns.suppressed(df, rounds).collect()]
        assert set(got) == want and len(got) == len(want) > 50
    assert patterns.suppressed(df.limit(0)).count() == 0


@pytest.mark.parametrize("seed", range(2))
def test_circular_flow_against_brute_force(spark, seed):
    rows = moves(seed, 70, 7, 25)
    sends = {}
    for i, x in enumerate(rows):
        sends.setdefault(x[0], []).append((us(x), i))
    want = set()

    def walk(path, accounts, deadline):
        last = rows[path[-1]]
        later = [(t, k) for t, k in sorted(sends.get(last[1], [])) if t > us(last)][:5]
        for t, k in later:
            if t > deadline:
                continue
            if rows[k][1] == accounts[0]:
                want.add(tuple(f"t{i}" for i in (*path, k)))
            elif rows[k][1] not in accounts and len(accounts) < 6:
                walk([*path, k], [*accounts, rows[k][1]], deadline)

    for i, x in enumerate(rows):
        walk([i], [x[0], x[1]], us(x) + 7 * DAY_US)
    got = patterns.circular_flow(table(spark, rows)).collect()
    assert sorted(tuple(e["transaction_ids"]) for e in got) == sorted(want) and max(map(len, want)) > 3


@pytest.mark.parametrize("seed", range(3))
def test_strong_components_of_one_graph(spark, seed):
    r = random.Random(seed)
    edges = [(f"n{r.randrange(30)}", f"n{r.randrange(30)}") for _ in range(r.choice([25, 40, 70]))] + [(f"c{i}", f"c{(i + 1) % 12}") for i in range(12)] + [(f"p{i}", f"p{i + 1}") for i in range(9)] + [("c3", "p0"), ("s", "s")]
    df = spark.createDataFrame(edges, "sender string, receiver string")
    got = {x["node"]: x["component"] for x in graph.strong_components(df).collect()}
    assert got == graph.tarjan(edges)


def test_totals_before(spark):
    r = random.Random(1)
    values = sorted({r.choice([r.random(), r.random() * 1e-9, float(r.randrange(5))]) for _ in range(900)})
    df = spark.createDataFrame([(v, r.randrange(5)) for v in values], "x double, n long").repartition(5)
    rows = {a["x"]: a for a in totals_before(df, "x", {"n": "b"}, ranges=16).collect()}
    down = {a["x"]: a["b"] for a in totals_before(df, "x", {"n": "b"}, descending=True, ranges=16).collect()}
    assert len(rows) == len(down) == len(values)
    total = 0
    for v in values:
        assert rows[v]["b"] == total
        total += rows[v]["n"]
        assert down[v] == sum(a["n"] for x, a in rows.items() if x > v)
    assert totals_before(df.limit(0), "x", {"n": "b"}).count() == 0


def plain_betweenness(edges, nodes):
    out = dict.fromkeys(nodes, 0.0)
    near = {v: sorted({b for a, b in edges if a == v and b != v}) for v in nodes}
    for s in nodes:
        dist, paths, order, back = {s: 0}, {s: 1.0}, [], {}
        queue = deque([s])
        while queue:
            v = queue.popleft()
            order.append(v)
            for w in near[v]:
                if w not in dist:
                    dist[w] = dist[v] + 1
                    queue.append(w)
                if dist[w] == dist[v] + 1:
                    paths[w] = paths.get(w, 0) + paths[v]
                    back.setdefault(w, []).append(v)
        depend = dict.fromkeys(nodes, 0.0)
        for w in reversed(order):
            for v in back.get(w, []):
                depend[v] += paths[v] / paths[w] * (1 + depend[w])
            if w != s:
                out[w] += depend[w]
    n = len(nodes)
    return {v: x / ((n - 1) * (n - 2)) if n > 2 else 0.0 for v, x in out.items()}


def test_betweenness_of_every_window_against_brute_force(spark):
    rows = moves(7, 50, 9, 5)
    tx = table(spark, rows)
    start = min(us(x) for x in rows)
    for chunks, groups in ((64, 4), (2, 1)):
        got = {(r["window_id"], r["account_id"]): r["betweenness_centrality"] for r in centrality.by_window(tx, sources=None, chunks=chunks, source_groups=groups).collect()}
        want = {}
        for w in range(max((us(x) - start) // DAY_US for x in rows) + 1):
            edges = [(x[0], x[1]) for x in rows if (us(x) - start) // DAY_US <= w]
            nodes = sorted({a for e in edges for a in e})
            want |= {(w, v): b for v, b in plain_betweenness(edges, nodes).items()}
        assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], abs=1e-12) for k in want)


def test_preconditions_of_a_temporal_graph(spark):
    rows = [("a", "b", 1, at(0)), ("b", "c", 1, at(1)), ("c", "d", 1, at(1))]
    assert graph.checked(table(spark, rows)).count() == 3
    with pytest.raises(ValueError, match="order"):
        graph.checked(table(spark, rows[::-1]))
    with pytest.raises(ValueError, match="none"):
        graph.checked(canonical.empty(spark).withColumn("row_ord", F.lit(0)).limit(0))


def test_full_evidence_and_explanation(spark):
    tx = table(spark, [("A", "B", 1, at(0)), ("B", "C", 2, at(1))])
    c = spark.createDataFrame(
        [("R1", ["A", "B"], ["t1", "t0"], ["fan_in", "layering"], ["layering", "fan_in"], [0, 1], 5, 9, "FORMING", True, (0.25,), 2, "T1")],
        "candidate_ring_id string, accounts array<string>, transaction_ids array<string>, patterns array<string>, pattern_sequence array<string>, event_window_ids array<int>, start_us long, end_us long, formation_stage string, formation_stage_is_provisional boolean, network_statistics struct<density:double>, evidence_event_count int, source_trajectory_id string",
    )
    scores = spark.createDataFrame([("R1", 1.0, 2.0, 3.0, 4.0, 55.5, "HIGH", ["network"])], "candidate_ring_id string, behavioural double, network double, fund_flow double, persistence double, risk_score double, risk_level string, top_factors array<string>")
    r = evidence.records(c, tx, scores).first()
    assert [t["transaction_id"] for t in r["transactions"]] == ["t0", "t1"] and tuple(r["time_range"]) == (5, 9) and r["trajectory"]["pattern_sequence"] == ["layering", "fan_in"]
    assert r["risk_factors"]["risk_level"] == "HIGH" and r["risk_factors"]["score_components"]["persistence"] == 4 and r["risk_factors"]["top_factors"] == ["network"] and r["note"] is None
    e = evidence.explanations(c, scores).first()
    assert e["who"]["account_roles"] == ["possible_collector"] and e["what"]["pattern_sequence"] == ["layering", "fan_in"] and e["when"]["formation_stage_is_provisional"] and e["where"]["evidence_density"] == 0.25
    assert e["how"]["evidence_event_count"] == 2 and e["why"]["risk_level"] == "HIGH" and e["why"]["score_components"]["network"] == 2 and e["how_early"]["note"] == evidence.HOW_EARLY
    bare = evidence.explanations(c).first()
    assert bare["why"]["note"] == evidence.NOT_EVALUATED and bare["why"]["top_factors"] is None


def test_lead_report(spark):
    rows = [("c1", "g1", "STRONG", True, 2, True, 4, True), ("c2", "g1", "STRONG", True, -1, False, 1, True), ("c3", "g2", "MODERATE", True, 3, True, 3, True), ("c4", None, "NONE", True, None, False, None, False), ("c5", None, "NONE", False, None, False, None, False)]
    df = spark.createDataFrame(rows, "candidate_id string, truth_id string, match_strength string, alerted boolean, lead_time int, early boolean, completion_lead_time int, completion_early boolean")
    r = leadtime.lead_report(df, 4).first()
    assert (r["n_candidates"], r["n_strong"], r["n_moderate"], r["n_extended"], r["n_alerted"]) == (5, 2, 1, 3, 4)
    assert r["strict_detection_rate"] == 0.25 and r["extended_detection_rate"] == 0.5 and r["strict_false_warning_rate"] == 0.5 and r["extended_false_warning_rate"] == 0.25
    assert r["strict_mean_lead_time"] == 0.5 and r["strict_std_lead_time"] == 1.5 and r["extended_median_lead_time"] == 2 and r["strict_early_rate_lead_time"] == 0.5 and r["strict_max_completion_lead_time"] == 4
    none = leadtime.lead_report(df.limit(0), 0).first()
    assert none["n_candidates"] == 0 and none["strict_mean_lead_time"] is None and none["strict_detection_rate"] is None


def test_a_stopped_append_leaves_no_row_twice(spark, tmp_path):
    df = spark.createDataFrame([(w, f"x{w}-{k}") for w in range(9) for k in range(3)], "window_id int, name string")
    make = lambda a, b: df.where(f"window_id BETWEEN {a} AND {b}")
    path = str(tmp_path / "w")
    assert sinks.append_windows(make, spark, path, 3, 2) == 2
    make(4, 5).write.mode("append").partitionBy("window_id").parquet(path)  # written, but the run stopped before its mark
    assert sinks.append_windows(make, spark, path, 8, 2) == 3
    assert sorted(r["name"] for r in spark.read.parquet(path).collect()) == sorted(r["name"] for r in df.collect())


def test_store(spark, tmp_path):
    with pytest.raises(ValueError):
        sinks.load_store(spark, "ledgerlume_test", {"nothing": spark.range(1)})
    runs = spark.createDataFrame([("r", "m", at(0)), ("s", "m", at(1))], "run_id string, method string, started timestamp")
    lead = spark.createDataFrame([("g", "c", "1", 2, 1)], "truth_id string, candidate_id string, warning_window string, observable_window int, lead_time int")
    try:
        sinks.load_store(spark, "ledgerlume_test", {"model_runs": runs}, str(tmp_path / "store"))
        sinks.load_store(spark, "ledgerlume_test", {"lead_times": lead})
        assert spark.table("ledgerlume_test.model_runs").count() == 0 and spark.table("ledgerlume_test.lead_times").first()["warning_window"] == 1
        assert {t.name for t in spark.catalog.listTables("ledgerlume_test") if not t.isTemporary} == set(sinks.STORE)
    finally:
        spark.sql("DROP DATABASE IF EXISTS ledgerlume_test CASCADE")


def test_demo_files(spark, tmp_path):
    (tmp_path / "transactions.csv").write_text("transaction_id,sender,receiver,amount,timestamp,label,ring_id\n1,a,b,5,2026-01-01T00:00:00Z,1,R1\n")
    demo = adapters.DemoAdapter(spark, str(tmp_path))
    assert demo.load().first()["ring_id"] == "R1" and demo.validate() == [] and demo.ground_truth() is None and demo.describe()["source"] == "demo"
    (tmp_path / "ring_ground_truth.json").write_text(json.dumps([{"ring_id": "R1", "accounts": ["a", "b"], "stages": [{"stage_name": "x", "day_offset": 0, "transaction_ids": ["1"]}]}]))
    assert demo.ground_truth().first()["accounts"] == ["a", "b"]


SLOW = ("graph_window_summary", "pattern_event_log", "pattern_type_summary")


@pytest.mark.parametrize("name", SLOW)
def test_slow_queries_against_sql(spark, sf, name, tmp_path):
    """The queries left out elsewhere, over the first ten days of the table."""
    first = spark.read.parquet(f"{sf}/events.parquet").where("ts < timestamp_ntz '2024-01-11'")
    first.toPandas().to_parquet(tmp_path / "events.parquet", coerce_timestamps="us")
    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    con.sql(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet'")
    got, want = catalog.queries()[name](spark, str(tmp_path)), con.sql(oracles.oracle_sql()[name])
    plain = lambda rs: sorted(str([round(float(x), 9) if isinstance(x, (int, float)) and not isinstance(x, bool) else str(x) for x in r]) for r in rs)
    assert plain(got.select(sorted(got.columns)).collect()) == plain(want.select(", ".join(f'"{c}"' for c in sorted(want.columns))).fetchall())

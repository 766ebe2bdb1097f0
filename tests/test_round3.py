"""Findings of round 3."""

import itertools
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from ledgerlume.functions.columns import DAY_US
from ledgerlume.functions.config import Settings
from ledgerlume.operators import centrality, cyclecount, episodes, graph, models, patterns, scoring, timeslices
from ledgerlume.plans import catalog, whole
from tests.helpers import at, table


def moves(seed, n, accounts, days, hours=4):
    r = random.Random(seed)
    return [(f"a{r.randrange(accounts)}", f"a{r.randrange(accounts)}", r.randrange(1, 9), at(r.randrange(days), r.randrange(0, 24, hours))) for _ in range(n)]


def us(x):
    return int(x[3].timestamp() * 1_000_000)


def test_level_is_that_of_the_score_of_two_digits(spark):
    one = spark.createDataFrame([("c", ["a", "b", "d"], ["fan_in"], 1, 0.5)], "candidate_ring_id string, accounts array<string>, patterns array<string>, event_count long, density double")
    scores = spark.createDataFrame([("a", 0.5001)], "account_id string, score double")
    r = scoring.score_candidates(one, scores, Settings(risk_bands=(("LOW", 0, 34.44), ("HIGH", 34.44, 100)))).first()  # 34.438 before rounding
    assert (r["risk_score"], r["risk_level"]) == (34.44, "HIGH")


def all_cycles(rows, most, days, branching=None):
    sends, want = {}, set()
    for i, x in enumerate(rows):
        sends.setdefault(x[0], []).append((us(x), i))

    def walk(path, accounts, deadline):
        last = rows[path[-1]]
        for t, k in [(t, k) for t, k in sorted(sends.get(last[1], [])) if t > us(last)][:branching]:
            if t <= deadline and rows[k][1] == accounts[0]:
                want.add(tuple(f"t{i}" for i in (*path, k)))
            elif t <= deadline and rows[k][1] not in accounts and len(accounts) < most:
                walk([*path, k], [*accounts, rows[k][1]], deadline)

    for i, x in enumerate(rows):
        walk([i], [x[0], x[1]], us(x) + days * DAY_US)
    return want


@pytest.mark.parametrize(("seed", "most", "branching", "block"), [(0, 6, None, 1 << 20), (1, 6, None, 7), (2, 5, 2, 50), (3, 4, None, 1), (4, 3, 1, 1 << 20), (5, 2, None, 5)])
def test_cycles_over_all_later_sends(spark, seed, most, branching, block):
    rows = moves(seed, 110, 6, 9)
    want = all_cycles(rows, most, 3, branching)
    starts = None if seed % 2 else spark.createDataFrame([("a1",), ("a2",)], "account_id string")
    want = want if starts is None else {c for c in want if rows[int(c[0][1:])][0] in ("a1", "a2")}
    solved = [r for r in slices_of(spark, rows, 3, most, branching, starts)]
    assert sorted(solved) == sorted(want) and max(map(len, want)) == most
    if starts is None:
        found = [tuple(ids) for b in timeslices.cycles(whole_slice(rows), most, 3 * DAY_US, branching, block) for ids in b["ids"].to_pylist()]
        assert sorted(found) == sorted(want)


def whole_slice(rows):
    n = range(len(rows))
    return pa.table({"us": [us(x) for x in rows], "row_ord": list(n), "sender": [x[0] for x in rows], "receiver": [x[1] for x in rows], "transaction_id": [f"t{i}" for i in n], "amount": [float(x[2]) for x in rows], "own": [True] * len(rows)})


def slices_of(spark, rows, days, most, branching, starts):
    return [tuple(e["transaction_ids"]) for e in patterns.circular_flow(table(spark, rows), max_length=most, days=days, starts=starts, branching=branching).collect()]


def test_circular_flow_all_has_no_cap(spark, tmp_path, monkeypatch):
    rows = [("a", "b", 1, at(0))] + [("b", f"c{i}", 1, at(0, 1, i)) for i in range(8)] + [("c7", "a", 1, at(1))]
    monkeypatch.setattr(catalog.fx, "transfers", lambda spark, folder: table(spark, rows))
    assert [r["transaction_ids"] for r in whole.pattern_circular_flow_all.__wrapped__(table(spark, rows)).collect()] == ["t0,t8,t9"]
    e = [x for x in patterns.detect_all(table(spark, rows), scope=None).collect() if x["pattern_type"] == "circular_flow"]
    assert len(e) == 1


def first_merges(rows, z):
    out = []
    for s in sorted({x[0] for x in rows}):
        for i in sorted((i for i, x in enumerate(rows) if x[0] == s), key=lambda i: (us(rows[i]), i)):
            t = us(rows[i])
            legs = sorted((us(x), k) for k, x in enumerate(rows) if x[0] == s and t <= us(x) < t + z)
            targets = list(dict.fromkeys(rows[k][1] for _, k in legs))
            on = sorted((us(x), k) for k, x in enumerate(rows) if x[0] in targets and t <= us(x) < t + 2 * z)
            n = {d: len({rows[k][0] for _, k in on if rows[k][1] == d}) for d in {rows[k][1] for _, k in on}}
            best = min(((-c, d) for d, c in n.items() if c >= 2), default=None)
            if len(targets) >= 2 and best:
                ids = dict.fromkeys([k for _, k in legs] + [k for _, k in on if rows[k][1] == best[1]])
                out.append((s, t, tuple(f"t{k}" for k in ids), tuple(dict.fromkeys([s, *targets, best[1]]))))
                break
    return out


@pytest.mark.parametrize(("seed", "n", "accounts", "block"), [(0, 60, 6, 1 << 20), (1, 60, 14, 1), (2, 150, 40, 30), (3, 90, 5, 8)])
def test_split_merge_over_slices(spark, seed, n, accounts, block):
    rows = moves(seed, n, accounts, 12)
    got = [(e["central_account"], int(e["timestamp"].timestamp() * 1e6), tuple(e["transaction_ids"]), tuple(e["accounts"])) for e in patterns.split_merge(table(spark, rows)).collect()]
    want = first_merges(rows, 2 * DAY_US)
    assert sorted(got) == want and got
    one = [e for b in timeslices.merges(whole_slice(rows), 2 * DAY_US, block) for e in b.to_pylist()]
    assert [(e["source"], e["t"], tuple(dict.fromkeys(e["rows"] + e["ids"]))) for e in one] == [x[:3] for x in want]


def test_models_read_their_features_from_one_evaluation(spark, monkeypatch):
    n = spark.sparkContext.accumulator(0)

    def seen(x):
        n.add(1)
        return x

    rows = spark.createDataFrame([(i // 30, f"a{i}", int(i % 3 == 0), float(i % 7), ("train", "test")[i // 200]) for i in range(300)], "window_id int, account_id string, y int, f double, split string")
    marked = rows.withColumn("f", F.udf(seen, "double")("f"))
    monkeypatch.setattr(catalog, "_model_table", lambda spark, folder: marked)
    assert catalog._modelled(models.Behavioural(("f",)))(spark, "").count() == 100
    assert n.value == 300
    n.value = 0
    assert models.compare(marked, {"b": models.Behavioural(("f",))}).count() == 1
    assert n.value == 300


def test_stats_of_one_graph_are_joins(spark, monkeypatch):
    called = []
    plain = graph.strong_one
    monkeypatch.setattr(graph, "strong_one", lambda edges: called.append(1) or plain(edges))
    r = graph.stats(table(spark, [("a", "b", 1, at(0)), ("b", "a", 1, at(1)), ("b", "c", 1, at(1))])).first()
    assert called and (r["strong_components"], r["largest_strong"], r["weak_components"], r["n_nodes"]) == (2, 2, 1, 3)


@pytest.mark.parametrize(("seed", "rows"), [(0, 1 << 20), (1, 3), (2, 40)])
def test_triangles_by_the_window_that_closes_them(seed, rows):
    r = random.Random(seed)
    pairs = {tuple(sorted(r.sample(range(14), 2))): r.randrange(5) for _ in range(45)}
    want = {}
    for a, b, c in itertools.combinations(range(14), 3):
        if (a, b) in pairs and (b, c) in pairs and (a, c) in pairs:
            w = max(pairs[a, b], pairs[b, c], pairs[a, c])
            for v in (a, b, c):
                want[v, w] = want.get((v, w), 0) + 1
    und, got = np.array([[*p, w] for p, w in pairs.items()]).T, {}
    for part in range(3):
        for v, w, n in zip(*centrality.triangles(und, 14, part, 3, rows), strict=True):
            got[v, w] = got.get((v, w), 0) + n
    assert got == want and want


@pytest.mark.parametrize("seed", range(3))
def test_component_sizes_against_tarjan(seed):
    r = np.random.default_rng(seed)
    src, dst = r.integers(0, 60, 40), r.integers(0, 60, 40)
    own = graph.tarjan([(f"{a:02d}", f"{b:02d}") for a, b in [*zip(src, dst), *zip(dst, src), *((i, i) for i in range(60))]])
    want = [sum(own[f"{j:02d}"] == own[f"{i:02d}"] for j in range(60)) for i in range(60)]
    assert centrality.component_sizes(src, dst, 60).tolist() == want


def test_window_structure_shuffles_no_copies_of_pairs(spark):
    tx = table(spark, moves(3, 150, 12, 10))
    both = ["window_id", "account_id", "clustering_coefficient", "component_size"]
    whole, part = centrality.by_window(tx), centrality.by_window(tx, structure_only=True)
    assert sorted(map(tuple, whole.select(*both).collect())) == sorted(map(tuple, part.select(*both).collect())) and part.columns == both
    assert "FlatMapGroupsInPandas" not in whole._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize(("shared", "most"), [(1, 64), (2, 64), (2, 3), (2, 0), (3, 64)])
def test_event_components_against_all_pairs(spark, monkeypatch, shared, most):
    monkeypatch.setattr(episodes, "PAIRED", most)
    r = random.Random(shared + most)
    rows = [("fan_in", 0, at(r.randrange(60), r.randrange(0, 24, 6)), None, f"c{i}", [f"a{x}" for x in r.sample(range(300 if shared == 1 else 9 if shared == 3 else 30), r.randrange(2, 6))], [f"t{i}"], 1.0, "") for i in range(70)]
    df = spark.createDataFrame(rows, "pattern_type string, window_id int, timestamp timestamp, span string, central_account string, accounts array<string>, transaction_ids array<string>, pattern_strength double, evidence string")
    edges = [(x[4], y[4]) for x in rows for y in rows if x is y or len(set(x[5]) & set(y[5])) >= shared and abs((x[2] - y[2]).total_seconds()) <= 10 * 86400]
    groups = {}
    for c, least in graph.tarjan(edges).items():
        groups.setdefault(least, set()).add(c)
    name = {x["eid"]: x["central_account"] for x in episodes.normalised(df).collect()}
    got = {}
    plan = episodes.event_components(df, shared)
    for x in plan.collect():
        got.setdefault(x["component"], set()).add(name[x["eid"]])
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, groups.values())) and 1 < len(groups) < 70


@pytest.mark.parametrize("seed", range(3))
def test_sparse_cycles_are_searched_and_dense_ones_counted(monkeypatch, seed):
    r = random.Random(seed)
    edges = sorted({(f"n{r.randrange(12)}", f"n{r.randrange(12)}") for _ in range(40)})
    edges = [e for e in edges if e[0] != e[1]]
    few = cyclecount.simple_cycles(edges, 6)
    monkeypatch.setattr(cyclecount, "SEARCHED", 0)
    assert cyclecount.simple_cycles(edges, 6) == few > 0
    ring = [(f"m{i:04d}", f"m{(i * 7 + k) % 3000:04d}") for i in range(3000) for k in (1, 5)]
    monkeypatch.setattr(cyclecount, "SEARCHED", 20_000_000)
    monkeypatch.setattr(cyclecount, "_closed", None)  # no matrices of 3,000 accounts for two partners each
    assert cyclecount.simple_cycles([e for e in ring if e[0] != e[1]], 8) >= 0


def test_models_of_all_methods_have_their_full_size(spark, monkeypatch):
    made = {}
    monkeypatch.setattr(whole, "_full_table", lambda spark, folder: None)
    monkeypatch.setattr(models, "compare", lambda table, four: made.update(four))
    monkeypatch.setattr(models, "ablation", lambda table, make: made.update(set=make(("f",))))
    monkeypatch.setattr(models, "class_weight_experiment", lambda table, make: made.update(weight=make(0.1)))
    for q in (whole.model_comparison_all, whole.ablation_all, whole.class_weights):
        q(spark, "")
    assert all((made[k].rounds, made[k].depth) == (300, 5) for k in ("proposed", "set", "weight"))
    assert (made["temporal"].trees, made["temporal"].depth, made["static"].trees, made["static"].sample) == (300, 8, 200, 256)

"""Graph queries over all windows, against brute force on a few transfers of many days."""

import datetime as dt
import itertools
import math
import random

import pytest

from ledgerlume.operators import cyclecount, graph
from ledgerlume.plans import catalog, fixtures


@pytest.fixture(scope="module")
def many_days(spark, tmp_path_factory):
    """Nine accounts; the receiver of a transfer is a function of its number, see fixtures."""
    path = str(tmp_path_factory.mktemp("days"))
    start = dt.datetime(2024, 1, 1)
    rows = [(i, start + dt.timedelta(days=i // 3, minutes=i), i * 5 % 9, "error" if i % 2 else "view", 1.0 + i, "{}") for i in range(18)]
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string").write.parquet(f"{path}/events.parquet")
    return path


def cycles(edges, longest):
    nodes = sorted({x for e in edges for x in e})
    ways = (p for n in range(2, longest + 1) for p in itertools.permutations(nodes, n) if p[0] == min(p))
    return {p for p in ways if all(e in edges for e in zip(p, p[1:] + p[:1], strict=True))}


def test_whole_graphs_against_brute_force(spark, many_days):
    tx = fixtures.transfers(spark, many_days).collect()
    edges = {(r["sender"], r["receiver"]) for r in tx if r["sender"] != r["receiver"]}
    nodes = {x for r in tx for x in (r["sender"], r["receiver"])}
    run = lambda name: catalog.queries()[name](spark, many_days).collect()
    stats = run("graph_stats_all")[0]
    assert (stats["n_edges"], stats["n_nodes"]) == (len(tx), len(nodes))
    assert {tuple(r["cycle"].split(",")) for r in run("simple_cycles_all")} == cycles(edges, 6)
    first, last = min(r["sender"] for r in tx), max(r["receiver"] for r in tx)
    paths = {(first, *p, last) for n in range(6) for p in itertools.permutations(nodes - {first, last}, n)}
    want = {p for p in paths if all(e in edges for e in zip(p, p[1:], strict=False))}
    assert {tuple(r["path"].split(",")) for r in run("simple_paths_all")} == want
    reach = {a: {a} for a in nodes}
    for _ in nodes:
        for a in nodes:
            reach[a] |= {y for x, y in edges if x in reach[a]}
    assert {r["node"]: r["component"] for r in run("scc_components_all")} == {a: min(b for b in nodes if b in reach[a] and a in reach[b]) for a in nodes}
    assert {r["node"] for r in run("wcc_components_all")} == nodes
    both, near = edges | {(b, a) for a, b in edges}, {first}
    for _ in range(3):
        near |= {b for a, b in both if a in near}
    assert {r["account_id"] for r in run("khop_neighborhood_all")} == near - {first}
    rings = {}
    for r in tx:
        if r["ring_id"]:
            rings.setdefault(r["ring_id"], set()).update((r["sender"], r["receiver"]))
    found = {k: len(cycles({e for e in edges if set(e) <= v}, 8)) for k, v in rings.items()}
    assert {r["ring_id"]: r["n_cycles"] for r in run("ring_cycles_all")} == {k: n for k, n in found.items() if n}


def test_event_components_reach_all_windows(spark, sf):
    events = fixtures.fans(spark, sf).count()
    got = catalog.queries()["event_components_all"](spark, sf).collect()
    assert sum(r["n"] * r["n_components"] for r in got) == events > fixtures.fans(spark, sf).where("window_id < 3").count()


def layers(n, width):
    """Edges from each account of a layer to each of the next, layer after layer."""
    return [(f"l{i}_{a:02}", f"l{i + 1}_{b:02}") for i in range(n - 1) for a in range(width) for b in range(width)]


def test_paths_of_a_graph_with_many_partial_ones(spark):
    edges = [e for e in layers(5, 49) if e[1] != "l4_00"] + [("s", f"l0_{a:02}") for a in range(49)] + [("l3_07", "l4_00"), ("l4_00", "t"), ("s", "t")]
    tx = spark.createDataFrame(edges, "sender string, receiver string")
    got = graph.simple_paths(tx, "s", "t")  # the fifth hop alone has 49 ** 4 * 48 ways, or 276,710,448, and more
    assert got.groupBy("length").count().orderBy("length").collect() == [(1, 1), (6, 49**3)]
    assert got.distinct().count() == 49**3 + 1
    assert graph.simple_paths(tx, "s", "s").count() == 0 == graph.simple_paths(tx, "t", "s").count()


def test_halves_that_meet_against_brute_force(spark):
    r = random.Random(5)
    for longest in (1, 2, 3, 4, 5, 7):
        nodes = [f"n{i}" for i in range(7)]
        edges = {(a, b) for a in nodes for b in nodes if a != b and r.random() < 0.5}
        tx = spark.createDataFrame([*edges, ("n0", "n0")], "sender string, receiver string")
        paths = {("n0", *p, "n1") for n in range(longest) for p in itertools.permutations(nodes[2:], n)}
        got = [tuple(x["path"]) for x in graph.simple_paths(tx, "n0", "n1", longest).collect()]
        assert sorted(got) == sorted(p for p in paths if all(e in edges for e in zip(p, p[1:], strict=False)))


def test_hot_ends_are_dealt_to_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(graph, "TASK_PAIRS", 7)
    tx = spark.createDataFrame([e for i in range(9) for e in (("s", f"a{i}"), (f"a{i}", "hot"), ("hot", f"b{i}"), (f"b{i}", "t"))], "sender string, receiver string")
    got = graph.simple_paths(tx, "s", "t")
    assert got.count() == got.distinct().count() == 81 and got.first()["length"] == 4


def brute_cycles(edges, longest):
    out = {}
    for a, b in edges:
        out.setdefault(a, []).append(b)

    def grow(path):
        for y in out.get(path[-1], ()):
            if y == path[0]:
                yield tuple(path)
            elif y > path[0] and y not in path and len(path) < longest:
                yield from grow([*path, y])

    return sorted(p for a in out for p in grow([a]))


def test_cycles_of_a_graph_with_many_partial_paths(spark):
    tx = spark.createDataFrame([*layers(6, 26), ("l5_03", "l0_05")], "sender string, receiver string")
    got = graph.simple_cycles(tx)  # 26 ** 6 paths of six accounts, or 308,915,776, and one edge back
    assert got.groupBy("length").count().collect() == [(6, 26**4)] and got.distinct().count() == 26**4


def test_cycles_of_many_graphs_against_brute_force(spark):
    r, rows = random.Random(6), []
    for w in range(4):
        rows += [(w, f"n{a}", f"n{b}") for a in range(8) for b in range(8) if r.random() < (0.2, 0.4, 0.7, 0.0)[w]]
    tx = spark.createDataFrame(rows, "window_id int, sender string, receiver string")
    for longest in (2, 3, 5, 6):
        got = [(x["window_id"], tuple(x["cycle"])) for x in graph.simple_cycles(tx, longest, "window_id").collect()]
        assert sorted(got) == [(w, c) for w in range(4) for c in brute_cycles({(a, b) for v, a, b in rows if v == w and a != b}, longest)]


def test_cycles_of_a_dense_ring(spark):
    edges = [(f"a{i:02}", f"a{j:02}", "R") for i in range(24) for j in range(24) if i != j]
    got = graph.ring_cycles(spark.createDataFrame(edges, "sender string, receiver string, ring_id string"))
    assert got.collect() == [("R", sum(math.comb(24, k) * math.factorial(k - 1) for k in range(2, 9)))]


def test_cycle_counts_by_matrices_residues_and_joins(spark, monkeypatch):
    r = random.Random(7)
    rows = [(w, f"{g}{a}", f"{g}{b}", g) for w in range(2) for g, n, share in (("p", 8, 0.9), ("q", 9, 0.5), ("r", 7, 0.2), ("s", 3, 0.6)) for a in range(n) for b in range(n) if r.random() < share]
    tx = spark.createDataFrame(rows, "window_id int, sender string, receiver string, ring_id string")
    for longest in (2, 4, 8):
        want = {(w, g): len(brute_cycles({(a, b) for v, a, b, h in rows if (v, h) == (w, g) and a != b}, longest)) for w in range(2) for g in "pqrs"}
        want = {k: n for k, n in want.items() if n}
        for most in (4096, 8, 1) if longest == 4 else (4096,):
            assert {(x["window_id"], x["ring_id"]): x["n_cycles"] for x in graph.ring_cycles(tx, longest, "window_id", most=most).collect()} == want
        monkeypatch.setattr(cyclecount, "EXACT", 0)
        assert {(w, g): n for w, g in want if (n := cyclecount.simple_cycles(sorted({(a, b) for v, a, b, h in rows if (v, h) == (w, g) and a != b}), longest))} == want
        monkeypatch.undo()

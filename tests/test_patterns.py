import datetime as dt
import json
import random

import pytest

from ledgerlume.functions.columns import DAY_US, HOUR_US
from ledgerlume.operators import patterns
from tests.helpers import at, table


def events(df):
    return [r.asDict() for r in df.collect()]


def test_fans(spark):
    tx = table(spark, [(f"S{i}", "HUB", 100, at(0, i)) for i in range(5)])
    (e,) = events(patterns.fan_in(tx))
    assert e["central_account"] == "HUB" and json.loads(e["evidence"])["n_senders"] == 5 and e["accounts"] == ["HUB", *[f"S{i}" for i in range(5)]] and e["pattern_strength"] == 0.625
    assert not events(patterns.fan_in(table(spark, [(f"S{i}", "HUB", 1, at()) for i in range(3)])))
    (e,) = events(patterns.fan_out(table(spark, [("HUB", f"R{i}", 10, at()) for i in range(5)])))
    assert e["central_account"] == "HUB" and e["transaction_ids"] == [f"t{i}" for i in range(5)]


@pytest.mark.parametrize(("legs", "n"), [
    ([("A", "B", 1000, at(0, 0)), ("B", "C", 950, at(0, 2)), ("C", "D", 900, at(0, 4))], 1), ([("A", "B", 1000, at(0, 0)), ("B", "C", 50, at(0, 2)), ("C", "D", 900, at(0, 4))], 0),
    ([("A", "B", 1000, at(0)), ("B", "C", 950, at(5)), ("C", "D", 900, at(10))], 0), ([("A", "B", 1000, at(0, 4)), ("B", "C", 950, at(0, 2)), ("C", "D", 900, at(0, 0))], 0),
])
def test_layering(spark, legs, n):
    found = events(patterns.layering(table(spark, legs)))
    assert len(found) == n
    if n:
        assert found[0]["accounts"] == list("ABCD") and json.loads(found[0]["evidence"])["n_hops"] == 3


def test_split_merge(spark):
    legs = [("A", "B", 100, at(0, 0)), ("A", "C", 100, at(0, 1)), ("B", "D", 90, at(0, 5)), ("C", "D", 90, at(0, 6))]
    (e,) = events(patterns.split_merge(table(spark, legs)))
    assert json.loads(e["evidence"])["merge_destination"] == "D" and sorted(json.loads(e["evidence"])["split_targets"]) == ["B", "C"]
    assert not events(patterns.split_merge(table(spark, legs[:3] + [("C", "E", 90, at(0, 6))])))


def test_circular(spark):
    ring = table(spark, [("A", "B", 1, at(0)), ("B", "C", 1, at(1)), ("C", "A", 1, at(2)), ("Z", "A", 1, at(3))])
    assert len(events(patterns.circular_flow(ring))) == 1
    assert not events(patterns.circular_flow(table(spark, [("A", "B", 1, at(0)), ("B", "C", 1, at(1))])))
    two = table(spark, [("A", "B", 1, at(0)), ("B", "A", 1, at(1))])
    for name, n in (("Z", 0), ("A", 1)):
        assert len(events(patterns.circular_flow(two, starts=spark.createDataFrame([(name,)], "account_id string")))) == n


def test_rapid_and_repeated(spark):
    (e,) = events(patterns.rapid_pass_through(table(spark, [("A", "B", 100, at(0, 0)), ("B", "C", 90, at(0, 2))]), hold_hours=6))
    assert e["accounts"] == ["A", "B", "C"] and json.loads(e["evidence"])["hold_time_hours"] == 2
    assert not events(patterns.rapid_pass_through(table(spark, [("A", "B", 100, at(0)), ("B", "C", 90, at(3))]), hold_hours=6))
    legs = [x for d in range(3) for x in ((f"S{d}", "M", 100, at(d, 1)), ("M", f"R{d}", 90, at(d, 3)))]
    (e,) = events(patterns.repeated_intermediary(table(spark, legs), hold_hours=6))
    assert json.loads(e["evidence"])["pass_through_count"] == 3 and e["central_account"] == "M"
    assert not events(patterns.repeated_intermediary(table(spark, legs[:2]), hold_hours=6))


def test_escalating(spark):
    rows = lambda ds: spark.createDataFrame([("A", i, d) for i, d in enumerate(ds)], "account_id string, window_id int, delta_connectivity double")
    (e,) = events(patterns.escalating_connectivity(rows([None, 2.0, 3.0])))
    assert json.loads(e["evidence"])["total_delta"] == 5 and e["span"] == "window_1_to_2"
    assert not events(patterns.escalating_connectivity(rows([-1.0, 0.0])))


def random_rows(seed, n=60, accounts=6, ties=True):
    r = random.Random(seed)
    return [(f"A{r.randrange(accounts)}", f"A{r.randrange(accounts)}", r.choice([100, 90, 80, 101]), at(r.randrange(12), r.choice([0, 6]) if ties else r.random() * 24)) for _ in range(n)]


def ordered(rows):
    return sorted(((int((t - dt.datetime(1970, 1, 1, tzinfo=dt.UTC)) / dt.timedelta(microseconds=1)), i, f"t{i}", a, b, x) for i, (a, b, x, t) in enumerate(rows)))


@pytest.mark.parametrize("seed", range(3))
def test_layering_against_plain_reading(spark, seed):
    rows = random_rows(seed)
    legs, used, want = ordered(rows), set(), []
    for start in legs:
        if start[2] in used:
            continue
        chain, seen = [start], {start[3], start[4]}
        while len(chain) < 6:
            c = chain[-1]
            nxt = [x for x in legs if x[3] == c[4] and c[0] < x[0] <= c[0] + DAY_US and c[5] * 0.7 <= x[5] <= c[5] * 1.05 and x[4] not in seen]
            if not nxt:
                break
            chain.append(nxt[0])
            seen.add(nxt[0][4])
        if len(chain) >= 3:
            want.append([x[2] for x in chain])
            used.update(want[-1])
    assert sorted(e["transaction_ids"] for e in events(patterns.layering(table(spark, rows)))) == sorted(want) and want


@pytest.mark.parametrize("seed", range(3))
def test_cycles_against_plain_search(spark, seed):
    rows = random_rows(seed, 40)
    legs, want = ordered(rows), set()

    def search(path, accounts, deadline):
        if len(accounts) > 4:
            return
        nxt = [x for x in legs if x[3] == accounts[-1] and x[0] > path[-1][0] and x[0] <= deadline][:5]
        for x in nxt:
            if x[4] == accounts[0]:
                want.add(tuple(p[2] for p in [*path, x]))
            elif x[4] not in accounts:
                search([*path, x], [*accounts, x[4]], deadline)

    for s in legs:
        search([s], [s[3], s[4]], s[0] + 4 * DAY_US)
    found = [tuple(e["transaction_ids"]) for e in events(patterns.circular_flow(table(spark, rows), max_length=4, days=4))]
    assert sorted(found) == sorted(want) and want


@pytest.mark.parametrize("seed", range(3))
def test_pass_through_against_plain_reading(spark, seed):
    rows = random_rows(seed)
    legs, want, taken = ordered(rows), [], set()
    for i in legs:
        out = [x for x in legs if x[3] == i[4] and x[0] >= i[0]]
        if out and out[0][0] - i[0] <= 48 * HOUR_US and out[0][2] != i[2] and (i[4], out[0][2]) not in taken:
            taken.add((i[4], out[0][2]))
            want.append([i[2], out[0][2]])
    assert sorted(e["transaction_ids"] for e in events(patterns.rapid_pass_through(table(spark, rows)))) == sorted(want) and want


def test_results_do_not_depend_on_partitions(spark):
    rows = random_rows(7)
    seen = []
    for n in (1, 4, 17):
        spark.conf.set("spark.sql.shuffle.partitions", str(n))
        e = patterns.detect_all(table(spark, rows).repartition(n)).drop("evidence").collect()
        seen.append(sorted(map(str, e)))
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert seen[0] == seen[1] == seen[2]


def test_empty(spark):
    assert patterns.detect_all(table(spark, [])).count() == 0

import math
import random
from collections import Counter
from fractions import Fraction

import numpy as np

from ledgerlume.llm import mixing


def within_a_block(order, targets):
    """Every prefix of order is within less than one block of each target, exactly."""
    whole = sum(Fraction(w) for w in targets.values())
    share = {s: Fraction(w) / whole for s, w in targets.items()}
    due = {s: [] for s in targets}
    for slot, s in enumerate(order):
        due[s].append(slot)
    for s, slots in due.items():
        if not share[s]:
            assert not slots
            continue
        # the count jumps at its slots: it is least before and greatest after one
        for j, slot in enumerate(slots):
            assert slot * share[s] - j < 1 and (j + 1) - (slot + 1) * share[s] < 1, s
        assert len(order) * share[s] - len(slots) < 1


def test_prefixes_are_within_a_block_of_the_target_for_any_number_of_sources():
    r = random.Random(17)
    for n in (1, 2, 3, 7, 50, 400, 2000):
        targets = {f"s{i}": math.sqrt(2 + i) * math.exp(r.uniform(-6, 2)) for i in range(n)}
        own = mixing.whole_weights(targets)
        total, parts = sum(own.values()), sum(map(Fraction, targets.values()))
        assert all(Fraction(own[s], total) == Fraction(w) / parts for s, w in targets.items())
        within_a_block(mixing.period(own, 6000), targets)


def test_a_million_blocks_follow_uneven_targets():
    targets = {"a": 0.12345, "b": 0.43217, "c": 0.44438}
    counts = {"a": 123_450, "b": 432_180, "c": 444_390}
    order = np.array(list(mixing.slots(counts, targets)))
    assert Counter(order.tolist()) == counts
    ends = [max(np.flatnonzero(order == s)) for s in targets]
    upto = min(ends) + 1  # until a source has no block left
    assert upto > 990_000
    at = np.arange(1, upto + 1)
    for s, w in targets.items():
        assert np.abs(np.cumsum(order[:upto] == s) - at * (w / sum(targets.values()))).max() < 1


def test_a_hot_source_and_a_long_tail():
    targets = {"hot": 0.667, **{f"t{i}": 0.333 / 500 for i in range(500)}}
    blocks = {"hot": 20_000, **{f"t{i}": 20 for i in range(500)}}
    order = mixing.schedule(blocks, targets)
    assert Counter(order) == blocks
    upto = min(len(order) - 1 - order[::-1].index(s) for s in targets) + 1
    within_a_block(order[:upto], targets)


def test_slots_in_parts_are_those_of_one_broadcast(spark, frame):
    docs = frame([(i, f"t{i}", r) for i, r in enumerate(random.Random(2).choices(["a", "b", "c", None], [8, 3, 2, 1], k=2000))])
    weights = {"a": 3, "b": 2, "c": 1.5, "": 0.25}
    want = sorted(mixing.mix_sources(docs, weights).collect())
    assert sorted(mixing.mix_sources(docs, weights, map_runs=50).collect()) == want and len(want) == 2000


def test_slots_do_not_depend_on_the_number_of_blocks(spark, frame):
    docs = frame([(i, f"t{i}", r) for i, r in enumerate(random.Random(3).choices(["a", "b", "c", None], [8, 3, 2, 1], k=1500))])
    for weights in (mixing.shares, {"a": 1, "b": 2, "c": 1.5}):
        want = sorted(mixing.mix_sources(docs, weights).collect())
        assert sorted(mixing.mix_sources(docs, weights, max_runs=20).collect()) == want and len(want) == 1500
    targets = Counter(r["source"] or "" for r in docs.collect())
    order = [s for _, s in sorted({(r["slot"], r["source"]) for r in mixing.mix_sources(docs, max_runs=1).collect()})]
    within_a_block(order[: min(len(order) - 1 - order[::-1].index(s) for s in targets) + 1], targets)


def test_names_of_the_operator_may_be_columns(spark):
    docs = spark.createDataFrame([(i, f"t{i}", "ab"[i % 2], 1, 2, 3) for i in range(60)], "doc_id long, text string, source string, __src int, __last int, last int")
    kept = mixing.mixed_documents(docs, {"a": 1, "b": 1})
    assert kept.columns == docs.columns and kept.count() == 60

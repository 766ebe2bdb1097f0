import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerlume.operators import metrics, models

COLS = ("f0", "f1", "f2")


@pytest.fixture(scope="module")
def shifted(spark):
    """Normal columns, moved by 3 for the tenth that is positive."""
    r = np.random.default_rng(0)
    rows = [(int(i // 30), f"a{i}", int(i % 10 == 0), *(float(r.normal() + 3 * (i % 10 == 0)) for _ in COLS)) for i in range(300)]
    return spark.createDataFrame(rows, "window_id int, account_id string, y int, f0 double, f1 double, f2 double")


def auc(df):
    return metrics.roc_auc(df).first()[0]


def test_models_find_the_shift(shifted):
    for m in (models.Behavioural(COLS), models.Temporal(COLS, 10, 4), models.Boosted(COLS, 5, 3), models.Isolation(COLS, 50, 64)):
        assert auc(m.fit(shifted).predict(shifted)) > 0.8
    assert models.Temporal(COLS, 5, 3).fit(shifted).importances()[0][1] > 0


def test_refusals(shifted):
    none = shifted.withColumn("y", F.lit(0))
    for m in (models.Behavioural(COLS), models.Temporal(COLS), models.Boosted(COLS)):
        with pytest.raises(ValueError):
            m.fit(none)
    with pytest.raises(ValueError):
        models.Boosted(COLS, multiplier=0).fit(shifted)
    assert models.Boosted(COLS, 2, 2, multiplier=0.5).fit(shifted).info["scale_pos_weight"] == 4.5


def test_ablation_and_weights(shifted):
    t = shifted.withColumn("split", F.when(F.col("window_id") < 6, "train").when(F.col("window_id") < 8, "validation").otherwise("test"))
    got = models.ablation(t, lambda c: models.Boosted(c, 2, 2), {"one": ("f0",), "all": COLS, "none": ("missing",)}).collect()
    assert [r["n_features"] for r in got] == [1, 3, 0] and got[2]["note"].startswith("skipped")
    assert models.class_weight_experiment(t, lambda w: models.Boosted(COLS, 2, 2, multiplier=w), (0.1, 1.0)).count() == 2
    assert models.compare(t, {"b": models.Behavioural(COLS)}).first()["roc_auc"] > 0.8
    sets = [set(models.FEATURE_SETS[k]) for k in "CDEF"]
    assert all(a < b for a, b in zip(sets, sets[1:], strict=False))


def test_shapley_values_add_up(shifted):
    m = models.Boosted(COLS, 3, 3).fit(shifted)
    tree = m.model.trees[0]
    leaves = models.leaves_of(tree)
    x = np.array(shifted.select(*COLS).limit(20).collect())
    phi = models.tree_shapley(leaves, x)

    def expected(row, known):
        total = 0.0
        for value, path in leaves:
            p = value
            for f, left, t, share in path:
                p *= ((row[f] <= t) == left) if f in known else share
            total += p
        return total

    for row, got in zip(x, phi, strict=True):
        assert got.sum() == pytest.approx(expected(row, {0, 1, 2}) - expected(row, set()))
        from itertools import permutations

        want = np.zeros(3)
        for order in permutations(range(3)):
            for i, f in enumerate(order):
                want[f] += (expected(row, set(order[: i + 1])) - expected(row, set(order[:i]))) / 6
        assert got == pytest.approx(want)
    values = models.shapley(m, shifted)
    assert models.shapley_global(values, COLS).count() == 3 and models.shapley_local(values, COLS, 2).first()["raising"] is not None


def test_isolation_trees():
    r = np.random.default_rng(1)
    x = np.vstack([r.normal(size=(200, 2)), [[9, 9]]])
    trees = [models.grow_isolation(x, r, 8) for _ in range(30)]
    depth = sum(models.isolation_depths(t, x) for t in trees)
    assert depth.argmin() == 200

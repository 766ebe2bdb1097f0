"""Models over feature tables: an isolation forest, logistic regression, a random forest and
gradient boosting, with comparison, ablation and exact Shapley values of tree models."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field
from itertools import combinations
from math import factorial, log

import numpy as np
import pandas as pd
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlume.operators import features as ft
from ledgerlume.operators import metrics
from ledgerlume.operators.graph import kept

FEATURE_SETS = {
    "A": ft.TRANSACTION, "B": ft.NETWORK, "C": (*ft.TRANSACTION, *ft.NETWORK), "D": (*ft.TRANSACTION, *ft.NETWORK, *ft.TEMPORAL),
    "E": (*ft.TRANSACTION, *ft.NETWORK, *ft.TEMPORAL, *ft.DELTA), "F": (*ft.TRANSACTION, *ft.NETWORK, *ft.TEMPORAL, *ft.DELTA, *ft.INDICATORS),
}
CLASS_WEIGHTS = (0.025, 0.05, 0.1, 0.25, 0.5, 1.0)


def assembled(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    own = list(columns)
    filled = df.withColumns({f"__{c}": F.coalesce(F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double")), F.lit(0.0)) for c in own})
    return VectorAssembler(inputCols=[f"__{c}" for c in own], outputCol="features").transform(filled).drop(*[f"__{c}" for c in own])


def class_sizes(df: DataFrame) -> tuple[int, int]:
    r = df.agg(F.coalesce(F.sum((F.col("y") == 1).cast("int")), F.lit(0)), F.coalesce(F.sum((F.col("y") != 1).cast("int")), F.lit(0))).first()
    return int(r[0]), int(r[1])


def balanced(df: DataFrame) -> DataFrame:
    pos, neg = class_sizes(df)
    if not pos:
        raise ValueError("there are no positive rows to fit on")
    n = pos + neg
    return df.withColumn("w", F.when(F.col("y") == 1, n / (2.0 * pos)).otherwise(n / (2.0 * max(neg, 1))))


def _scored(model, df: DataFrame) -> DataFrame:
    return model.transform(df).withColumn("score", vector_to_array("probability")[1]).drop("rawPrediction", "probability", "prediction", "features", "scaled")


@dataclass
class Behavioural:
    """Standardised, balanced logistic regression."""

    columns: tuple[str, ...] = ft.TRANSACTION
    scaler: object = None
    model: object = None

    def fit(self, df: DataFrame) -> Behavioural:
        data = balanced(assembled(df, self.columns))
        self.scaler = StandardScaler(inputCol="features", outputCol="scaled", withMean=True).fit(data)
        self.model = LogisticRegression(featuresCol="scaled", labelCol="y", weightCol="w", maxIter=100).fit(self.scaler.transform(data))
        return self

    def predict(self, df: DataFrame) -> DataFrame:
        return _scored(self.model, self.scaler.transform(assembled(df, self.columns)))


@dataclass
class Temporal:
    """Balanced random forest."""

    columns: tuple[str, ...] = (*ft.TEMPORAL, *ft.DELTA)
    trees: int = 300
    depth: int = 8
    seed: int = 42
    model: object = None

    def fit(self, df: DataFrame) -> Temporal:
        self.model = RandomForestClassifier(featuresCol="features", labelCol="y", weightCol="w", numTrees=self.trees, maxDepth=self.depth, seed=self.seed).fit(balanced(assembled(df, self.columns)))
        return self

    def predict(self, df: DataFrame) -> DataFrame:
        return _scored(self.model, assembled(df, self.columns))

    def importances(self) -> list[tuple[str, float]]:
        return sorted(zip(self.columns, map(float, self.model.featureImportances.toArray()), strict=True), key=lambda x: (-x[1], x[0]))


@dataclass
class Boosted:
    """Gradient boosting; positives weigh max(negatives / positives * multiplier, 1)."""

    columns: tuple[str, ...] = ft.ALL
    rounds: int = 300
    depth: int = 5
    rate: float = 0.05
    multiplier: float = 0.5
    seed: int = 42
    model: object = None
    info: dict = field(default_factory=dict)

    def fit(self, df: DataFrame) -> Boosted:
        if self.multiplier <= 0:
            raise ValueError("multiplier must be positive")
        data = assembled(df, self.columns)
        pos, neg = class_sizes(data)
        if not pos or not neg:
            raise ValueError("both classes are needed to fit on")
        weight = max(neg / pos * self.multiplier, 1.0)
        self.info = {"positives": pos, "negatives": neg, "scale_pos_weight": weight, "n_features": len(self.columns)}
        w = data.withColumn("w", F.when(F.col("y") == 1, weight).otherwise(1.0))
        self.model = GBTClassifier(featuresCol="features", labelCol="y", weightCol="w", maxIter=self.rounds, maxDepth=self.depth, stepSize=self.rate, subsamplingRate=0.8, featureSubsetStrategy="0.8", seed=self.seed).fit(w)
        return self

    def predict(self, df: DataFrame) -> DataFrame:
        return _scored(self.model, assembled(df, self.columns))


def _harmonic(n: float) -> float:
    return 0.0 if n <= 1 else 2 * (log(n - 1) + 0.5772156649015329) - 2 * (n - 1) / n


def grow_isolation(x: np.ndarray, r: np.random.Generator, depth: int) -> tuple:
    """A tree as nested (feature, threshold, left, right) or (size,)."""
    spread = x.max(axis=0) - x.min(axis=0) if len(x) else np.zeros(x.shape[1])
    if depth == 0 or len(x) <= 1 or not spread.any():
        return (len(x),)
    f = int(r.choice(np.flatnonzero(spread)))
    t = float(r.uniform(x[:, f].min(), x[:, f].max()))
    left = x[:, f] <= t
    return (f, t, grow_isolation(x[left], r, depth - 1), grow_isolation(x[~left], r, depth - 1))


def isolation_depths(tree: tuple, x: np.ndarray, depth: float = 0) -> np.ndarray:
    if len(tree) == 1:
        return np.full(len(x), depth + _harmonic(tree[0]))
    f, t, a, b = tree
    left = x[:, f] <= t
    out = np.empty(len(x))
    out[left], out[~left] = isolation_depths(a, x[left], depth + 1), isolation_depths(b, x[~left], depth + 1)
    return out


@dataclass
class Isolation:
    """Isolation forest. Each tree is grown on `sample` rows; trees * sample rows are drawn and
    no more, so fitting is bounded whatever the table. Scores are rescaled within the scored set."""

    columns: tuple[str, ...] = ft.NETWORK
    trees: int = 200
    sample: int = 256
    seed: int = 42
    forest: list = field(default_factory=list)

    def fit(self, df: DataFrame) -> Isolation:
        own = [F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in self.columns]
        keys = [c for c in ft.KEYS if c in df.columns]
        drawn = df.select(*own, F.xxhash64(*keys, F.lit(self.seed)).alias("__d")).orderBy("__d").limit(min(self.trees * self.sample, 20_000)).drop("__d").toPandas().to_numpy()
        r = np.random.default_rng(self.seed)
        self.forest = [grow_isolation(drawn[r.choice(len(drawn), min(self.sample, len(drawn)), replace=False)], r, int(np.ceil(np.log2(max(self.sample, 2))))) for _ in range(self.trees)] if len(drawn) else []
        return self

    def predict(self, df: DataFrame) -> DataFrame:
        forest, norm = self.forest, _harmonic(self.sample) or 1.0

        @F.pandas_udf("double")
        def anomaly(x: pd.Series) -> pd.Series:
            rows = np.stack(x.to_numpy()) if len(x) else np.zeros((0, 1))
            mean = sum((isolation_depths(t, rows) for t in forest), np.zeros(len(rows))) / max(len(forest), 1)
            return pd.Series(2.0 ** (-mean / norm))

        raw = df.withColumn("raw", anomaly(F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in self.columns])))
        ends = raw.agg(F.min("raw").alias("lo"), F.max("raw").alias("hi"))
        scale = F.when(F.col("hi") > F.col("lo"), (F.col("raw") - F.col("lo")) / (F.col("hi") - F.col("lo"))).otherwise(0.0)
        return raw.crossJoin(F.broadcast(ends)).withColumn("score", scale).drop("raw", "lo", "hi")  # one row


def _held(df: DataFrame) -> DataFrame:
    """df written once, by columns; fitting and each metric read it again and again."""
    return kept(df, "model-table")


def _measured(model, train: DataFrame, test: DataFrame) -> DataFrame:
    return metrics.evaluate(_held(model.fit(train).predict(test).select(*ft.KEYS, "y", "score")), 0.5, (10,), *ft.KEYS)


def compare(table: DataFrame, models: dict[str, object]) -> DataFrame:
    """Fits on split train, evaluates on test: a row for each model."""
    table = _held(table)
    train, test = table.where("split = 'train'"), table.where("split = 'test'")
    out = None
    for name, m in models.items():
        row = _measured(m, train, test).withColumn("model", F.lit(name))
        out = row if out is None else out.unionByName(row)
    return out


def class_weight_experiment(table: DataFrame, make, weights: Iterable[float] = CLASS_WEIGHTS) -> DataFrame:
    """A row for each multiplier, on split validation; the best first."""
    table = _held(table)
    train, held = table.where("split = 'train'"), table.where("split = 'validation'")
    out = None
    for w in weights:
        row = _measured(make(w), train, held).withColumn("multiplier", F.lit(float(w)))
        out = row if out is None else out.unionByName(row)
    return out.orderBy(F.desc_nulls_last("pr_auc"), F.desc_nulls_last("f1"), F.desc_nulls_last("precision"))


def ablation(table: DataFrame, make, sets: dict[str, tuple[str, ...]] | None = None) -> DataFrame:
    """A row for each feature set; one that can't be fitted has a note and no figures."""
    table = _held(table)
    train, test = table.where("split = 'train'"), table.where("split = 'test'")
    pos, neg = class_sizes(train)
    rows = []
    for name, columns in (sets or FEATURE_SETS).items():
        there = tuple(c for c in columns if c in table.columns)
        if not pos or not neg or not there:
            rows.append((name, len(there), None, None, "skipped: both classes and a feature are needed"))
            continue
        r = _measured(make(there), train, test).first()
        rows.append((name, len(there), r["pr_auc"], r["roc_auc"], r["note"]))
    return table.sparkSession.createDataFrame(rows, "config string, n_features int, pr_auc double, roc_auc double, note string")


def leaves_of(tree) -> list[tuple[float, list[tuple[int, bool, float, float]]]]:
    """(value, conditions (feature, goes left, threshold, share of the node's rows)) of each leaf."""
    out = []

    def walk(node, path) -> None:
        if node.getClass().getSimpleName() == "LeafNode":
            out.append((node.prediction(), list(path)))
            return
        n = max(node.impurityStats().count(), 1e-12)
        split = node.split()
        for child, left in ((node.leftChild(), True), (node.rightChild(), False)):
            walk(child, [*path, (split.featureIndex(), left, split.threshold(), child.impurityStats().count() / n)])

    walk(tree._call_java("rootNode"), [])
    return out


def tree_shapley(leaves: list, x: np.ndarray, weight: float = 1.0) -> np.ndarray:
    """Exact path-dependent Shapley values of one tree: for each leaf the features on its path
    are players of a product game, so a leaf costs 2 ** (its features) terms for all rows at once."""
    out = np.zeros(x.shape)
    for value, path in leaves:
        passed: dict[int, np.ndarray] = {}
        share: dict[int, float] = {}
        for f, left, t, s in path:
            ok = (x[:, f] <= t) == left
            passed[f] = passed[f] & ok if f in passed else ok
            share[f] = share.get(f, 1.0) * s
        d = len(passed)
        for f in passed:
            others = [g for g in passed if g != f]
            total = np.zeros(len(x))
            for k in range(d):
                for inside in combinations(others, k):
                    term = np.full(len(x), factorial(k) * factorial(d - k - 1) / factorial(d))
                    for g in others:
                        term = term * (passed[g] if g in inside else share[g])
                    total += term
            out[:, f] += weight * value * total * (passed[f] - share[f])
    return out


def shapley(boosted: Boosted, df: DataFrame) -> DataFrame:
    """df's keys with phi, the Shapley values of the boosted margin, by feature."""
    trees = [(float(w), leaves_of(t)) for w, t in zip(boosted.model.treeWeights, boosted.model.trees, strict=True)]
    n = len(boosted.columns)

    @F.pandas_udf("array<double>")
    def phi(x: pd.Series) -> pd.Series:
        rows = np.stack(x.to_numpy()) if len(x) else np.zeros((0, n))
        return pd.Series(list(sum((tree_shapley(leaves, rows, w) for w, leaves in trees), np.zeros(rows.shape))))

    return df.select(*ft.KEYS, phi(F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in boosted.columns])).alias("phi"))


def shapley_global(values: DataFrame, columns: Iterable[str], top: int = 20) -> DataFrame:
    """(feature, importance): mean absolute value, the largest first."""
    own = list(columns)
    means = values.agg(*[F.avg(F.abs(F.get("phi", i))).alias(c) for i, c in enumerate(own)])
    rows = means.select(F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).alias("importance")) for c in own])).alias("x")).select("x.*")
    return rows.orderBy(F.desc("importance"), "feature").limit(top)


def shapley_local(values: DataFrame, columns: Iterable[str], top: int = 8) -> DataFrame:
    """keys with the features that raise and lower the score most."""
    pairs = F.zip_with(F.array(*map(F.lit, columns)), "phi", lambda c, v: F.struct((-F.abs(v)).alias("k"), c.alias("feature"), v.alias("value")))
    best = values.select(*ft.KEYS, F.slice(F.array_sort(pairs), 1, top).alias("b"))
    part = lambda up: F.transform(F.filter("b", lambda x: (x["value"] > 0) if up else (x["value"] < 0)), lambda x: F.struct(x["feature"].alias("feature"), x["value"].alias("value")))
    return best.select(*ft.KEYS, part(True).alias("raising"), part(False).alias("lowering"))

"""Boosted trees for conditional quantiles: each round lowers the pinball loss.

A round fits a regression tree to the sign of the residuals, which gives the structure, and then sets every
leaf to the exact quantile of the residuals in it, which is the constant of least pinball loss there. A leaf may hold any
share of the rows: its quantile is found by narrowing a bracket around it with mergeable sketches and
counts, so no task ever holds a leaf's residuals.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from math import ceil

import numpy as np
import pandas as pd
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import DecisionTreeRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS, DEPTH, STEP, SUBSAMPLE = 15, 3, 0.4, 0.8
SKETCH = 10_000
ROWS_PER_PART = 250_000


def few_group_quantiles(df: DataFrame, group: str, value: str, prob: float, sketch: int = SKETCH) -> dict:
    """The smallest value of each group that at least ``prob`` of its rows do not exceed, exactly.

    For few groups (the leaves of a tree) of any size. A sketch proposes a value inside each open
    bracket, a count tells its rank; a wrong proposal becomes one end of a bracket that holds a share of some
    1 / ``sketch`` of the rows before it.
    """
    kept = df.filter(F.col(group).isNotNull() & F.col(value).isNotNull()).select(group, value)
    first = kept.groupBy(group).agg(F.count("*").alias("n"), F.percentile_approx(value, prob, sketch).alias("q")).collect()
    n, guess = {r[group]: r["n"] for r in first}, {r[group]: r["q"] for r in first}
    want = {g: min(max(ceil(prob * k - 1e-9), 1), k) for g, k in n.items()}
    # rank of the last row at or below the bracket, rows in it, and its open ends
    open_ = {g: (0, k, None, None) for g, k in n.items()}
    found: dict = {}
    g, v = F.col(group), F.col(value)

    def chosen(by_group: dict, kind: str) -> Column:
        arms = F
        for key, x in by_group.items():
            arms = arms.when(g == key, F.lit(x).cast(kind))
        return arms.otherwise(F.lit(None).cast(kind))

    while open_:
        low = {k: o[2] for k, o in open_.items() if o[2] is not None}
        high = {k: o[3] for k, o in open_.items() if o[3] is not None}
        inside = kept.filter(g.isin(list(open_)))
        if low or high:
            inside = inside.filter(
                F.coalesce(v > chosen(low, "double"), F.lit(True)) & F.coalesce(v < chosen(high, "double"), F.lit(True))
                if low and high
                else F.coalesce(v > chosen(low, "double") if low else v < chosen(high, "double"), F.lit(True))
            )
        shares = {k: (want[k] - o[0]) / o[1] for k, o in open_.items()}
        several = sorted(set(shares.values()))
        if low or high:
            sketched = inside.groupBy(group).agg(F.percentile_approx(value, F.array(*map(F.lit, several)), sketch).alias("q")).collect()
            guess = {r[group]: r["q"][several.index(shares[r[group]])] for r in sketched}
        at = chosen(guess, "double")
        for r in inside.groupBy(group).agg(F.count_if(v < at).alias("below"), F.count_if(v <= at).alias("upto")).collect():
            k = r[group]
            before, rows, lo, hi = open_[k]
            if before + r["below"] < want[k] <= before + r["upto"]:
                found[k] = guess[k]
                del open_[k]
            elif want[k] <= before + r["below"]:
                open_[k] = (before, r["below"], lo, guess[k])
            else:
                open_[k] = (before + r["upto"], rows - r["upto"], guess[k], hi)
    return found


@dataclass
class Tree:
    """Nodes as arrays; ``left`` is -1 at a leaf."""

    feature: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray

    def leaf(self, x: np.ndarray) -> np.ndarray:
        at = np.zeros(len(x), dtype=np.int64)
        rows = np.arange(len(x))
        while True:
            inner = self.left[at] >= 0
            if not inner.any():
                return at
            goes = np.where(x[rows, np.maximum(self.feature[at], 0)] <= self.cut[at], self.left[at], self.right[at])
            at = np.where(inner, goes, at)


@dataclass
class QuantileModel:
    """Start value and trees of one quantile."""

    prob: float
    start: float
    trees: list[Tree] = field(default_factory=list)

    def predict(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.start)
        for tree in self.trees:
            out += tree.value[tree.leaf(x)]
        return out


def structure(model) -> Tree:
    """The nodes of a fitted tree, breadth first."""
    nodes, at = [model._java_obj.rootNode()], 0
    feature, cut, left, right = [], [], [], []
    while at < len(nodes):
        node = nodes[at]
        at += 1
        if node.getClass().getSimpleName() == "LeafNode":
            feature.append(-1), cut.append(0.0), left.append(-1), right.append(-1)
        else:
            feature.append(node.split().featureIndex()), cut.append(node.split().threshold())
            left.append(len(nodes)), right.append(len(nodes) + 1)
            nodes += [node.leftChild(), node.rightChild()]
    return Tree(np.array(feature), np.array(cut), np.array(left), np.array(right), np.zeros(len(nodes)))


def _matrix(vectors: pd.Series) -> np.ndarray:
    return np.stack(vectors.to_numpy()).astype("float64") if len(vectors) else np.zeros((0, 0))


def predicted(model: QuantileModel, vector: str = "features") -> Column:
    """The model's quantile as a column over a vector column."""

    @F.pandas_udf("double")
    def apply(x: pd.Series) -> pd.Series:
        return pd.Series(model.predict(_matrix(x)))

    return apply(vector_to_array(vector))


def leaves(tree: Tree, vector: str = "features") -> Column:
    """The node number of the leaf that a vector falls into."""

    @F.pandas_udf("int")
    def leaf(x: pd.Series) -> pd.Series:
        return pd.Series(tree.leaf(_matrix(x)).astype("int32"))

    return leaf(vector_to_array(vector))


def compact(rows: DataFrame, n: int, per_part: int = ROWS_PER_PART) -> DataFrame:
    """As few partitions as ``n`` rows need: a fit passes over them many times."""
    return rows.coalesce(max(1, -(-n // per_part)))


def fit(
    rows: DataFrame,
    prob: float,
    rounds: int = ROUNDS,
    depth: int = DEPTH,
    step: float = STEP,
    subsample: float = SUBSAMPLE,
    seed: int = 42,
    label: str = "label",
    vector: str = "features",
) -> QuantileModel:
    """Boost the ``prob`` quantile of ``label``. ``rows`` should be stored and compact; no rows give the constant 0."""
    start = few_group_quantiles(rows.select(F.lit(0).alias("_g"), F.col(label).alias("_v")), "_g", "_v", prob)
    model = QuantileModel(prob, float(start.get(0, 0.0)))
    if not start:
        return model
    grower = DecisionTreeRegressor(featuresCol=vector, labelCol="_slope", maxDepth=depth, minInstancesPerNode=5, seed=seed)
    for k in range(rounds):
        missed = F.col(label) - predicted(model, vector)
        current = rows.sample(subsample, seed + k) if subsample < 1 else rows
        current = current.select(vector, missed.alias("_missed")).withColumn("_slope", F.when(F.col("_missed") > 0, prob).otherwise(prob - 1)).persist()
        try:
            tree = structure(grower.fit(current.select(vector, "_slope")))
            best = few_group_quantiles(current.select(leaves(tree, vector).alias("_leaf"), "_missed"), "_leaf", "_missed", prob)
        finally:
            current.unpersist()
        for leaf, value in best.items():
            tree.value[leaf] = step * value
        model.trees.append(tree)
    return model

"""Per-row feature contributions (path-dependent tree Shapley values).

A saved tree model is a table of nodes. A leaf contributes to a coalition of features its value
times, for each feature on its path, either "the row passes" (feature known) or the share of
training rows that passes (unknown). Over all coalitions of one size these products are a coefficient of
the polynomial with a factor (share + passes t) for each feature: it is multiplied up once for a leaf, and
dividing by one factor leaves what the Shapley value of that feature weighs by size. That takes
steps in the square of the path's features, where listing coalitions takes a power of two. Rows
that pass the same cuts of a leaf share its values.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce
from math import factorial

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cloudtally.functions.numeric import half_up
from cloudtally.runtime import new_folder

WAYS = 8  # features; with more, numbers of passed cuts are too many for a table, and leaves go one by one
LEAVES, ROWS = 64, 256  # in one look-up
TASKS = 1  # for each core


def _leaves(nodes: pd.DataFrame, weights: dict[int, float], classifier: bool) -> list[tuple]:
    """(weighted value, share of rows, {feature: (low, high, share)}) per leaf of every tree."""
    out = []
    for number, tree in nodes.groupby("treeID"):
        by_id = {r.id: r for r in tree.itertuples()}

        def cover(n):
            return float(sum(n.impurityStats)) if classifier else float(n.impurityStats[0])

        stack = [(by_id[0], {}, 1.0)]
        while stack:
            node, path, share = stack.pop()
            if node.leftChild < 0:
                stats = np.asarray(node.impurityStats, dtype="float64")
                value = stats / stats.sum() if classifier else np.array([node.prediction])
                out.append((weights[number] * value, share, path))
                continue
            f, cut = node.featureIndex, node.threshold
            low, high, part = path.get(f, (-np.inf, np.inf, 1.0))
            for child, bounds in (
                (by_id[node.leftChild], (low, min(high, cut))),
                (by_id[node.rightChild], (max(low, cut), high)),
            ):
                p = cover(child) / cover(node)
                stack.append((child, {**path, f: (*bounds, part * p)}, share * p))
    return out


def _shapley(passes: np.ndarray, shares: Sequence) -> np.ndarray:
    """Shapley values (rows, features) of a leaf of value 1, from which cuts each row passes (0 or 1).

    A share may be one for all rows or one for each, where rows belong to different leaves.
    """
    n, m = passes.shape
    whole = np.zeros((m + 1, n))
    whole[0] = 1.0
    for i in range(m):  # multiply by (share + passes t)
        whole[1 : i + 2] = shares[i] * whole[1 : i + 2] + passes[:, i] * whole[: i + 1]
        whole[0] *= shares[i]
    weight = [factorial(k) * factorial(m - k - 1) / factorial(m) for k in range(m)]
    out = np.empty((n, m))
    for i in range(m):
        own, share = passes[:, i], shares[i]
        total, above = np.zeros(n), np.zeros(n)
        for k in range(m - 1, -1, -1):  # coefficients of the quotient, from the highest
            above = np.where(own > 0, whole[k + 1] - share * above, whole[k] / share)
            total += weight[k] * above
        out[:, i] = total * (own - share)
    return out


def _leaf_shapley(x: np.ndarray, path: dict) -> dict[int, np.ndarray]:
    """Shapley value of each path feature in the game of one leaf of value 1, for all rows."""
    feats, m = list(path), len(path)
    if not m:
        return {}
    shares = [path[f][2] for f in feats]
    passes = np.stack([(x[:, f] > path[f][0]) & (x[:, f] <= path[f][1]) for f in feats], axis=1)
    if 1 << m <= len(x):  # fewer ways to pass than rows
        ways = (np.arange(1 << m)[:, None] >> np.arange(m)) & 1
        told = _shapley(ways.astype("float64"), shares)[passes @ (1 << np.arange(m))]
    else:
        told = _shapley(passes.astype("float64"), shares)
    return {f: told[:, i] for i, f in enumerate(feats)}


class Boxes:
    """The leaves of all trees as boxes: the features whose cuts a row passes on the way to a leaf are the bits of a number.

    Features that are not on a leaf's path count as passed by all rows, which changes no Shapley value.
    """

    def __init__(self, leaves: Sequence[tuple], features: int) -> None:
        n = len(leaves)
        low, high, self.shares = np.full((n, features), -np.inf), np.full((n, features), np.inf), np.ones((n, features))
        for i, (_, _, path) in enumerate(leaves):
            for f, (a, b, share) in path.items():
                low[i, f], high[i, f], self.shares[i, f] = a, b, share
        self.values = np.array([np.atleast_1d(v) for v, _, _ in leaves])
        self.cuts, self.bits = [], []
        for f in range(features):
            ends = np.concatenate([low[:, f], high[:, f]])
            cut = np.unique(ends[np.isfinite(ends)])
            # a bin lies between two cuts and holds the upper one
            above, upto = np.append(-np.inf, cut)[:, None], np.append(cut, np.inf)[:, None]
            self.cuts.append(cut)
            self.bits.append(((above >= low[:, f]) & (upto <= high[:, f])).astype(np.uint8) << f)

    def told(self, own: slice) -> np.ndarray:
        """Shapley values (leaf, number, feature) of some leaves of value 1, by the features whose cuts are passed."""
        shares = self.shares[own]
        m = shares.shape[1]
        ways = ((np.arange(1 << m)[:, None] >> np.arange(m)) & 1).astype("float64")
        n = len(shares) << m
        passes = np.broadcast_to(ways, (len(shares), *ways.shape)).reshape(n, m)
        return _shapley(passes, np.repeat(shares, 1 << m, axis=0).T).reshape(len(shares), 1 << m, m)

    def shapley(self, x: np.ndarray, at: np.ndarray | None) -> np.ndarray:
        """Sums over all leaves (rows, features, outputs); with ``at`` the one output of each row (rows, features)."""
        places = [np.searchsorted(cut, x[:, f]) for f, cut in enumerate(self.cuts)]
        m, outputs = len(places), self.values.shape[1]
        total = np.zeros((len(x), m, outputs))
        rows = [np.arange(len(x))] * outputs if at is None else [np.flatnonzero(at == k) for k in range(outputs)]
        for start in range(0, len(self.values), LEAVES):
            own = slice(start, start + LEAVES)
            alone = self.told(own)
            first = np.arange(len(alone)) << m
            for k, some in enumerate(rows):
                valued = (alone * self.values[own, k, None, None]).reshape(-1, m).T.copy()
                for part in range(0, len(some), ROWS):
                    r = some[part : part + ROWS]
                    number = reduce(np.bitwise_or, [bit[:, own].take(place[r], axis=0) for bit, place in zip(self.bits, places, strict=True)])
                    at_leaf = first + number
                    for f in range(m):
                        total[r, f, k] += valued[f].take(at_leaf).sum(axis=1)
        return total if at is None else total.sum(axis=2)


def node_table(model) -> DataFrame:
    """The model's nodes: at most trees x 2^(depth+1) rows, whatever the training data."""
    spark = SparkSession.getActiveSession()
    path = new_folder(spark)
    model.write().save(path)
    n = F.col("nodeData")
    return spark.read.parquet(f"{path}/data").select(
        "treeID",
        n["id"].alias("id"),
        n["prediction"].alias("prediction"),
        n["impurityStats"].alias("impurityStats"),
        n["leftChild"].alias("leftChild"),
        n["rightChild"].alias("rightChild"),
        n["split"]["featureIndex"].alias("featureIndex"),
        F.get(n["split"]["leftCategoriesOrThreshold"], F.lit(0)).alias("threshold"),
    )


def contributions(
    model,
    rows: DataFrame,
    features: Sequence[str],
    outputs: Sequence[str],
    ident: Sequence[str],
    classifier: bool = True,
    only: str | None = None,
) -> DataFrame:
    """(ident, output, base_value, prediction, contributions) for every row and model output.

    ``contributions`` maps a feature to its value; base plus their sum is the prediction. ``only`` names
    a column of ``ident`` that holds the one output to explain in a row.
    """
    nodes = node_table(model).toArrow().to_pandas()
    trees = sorted(nodes["treeID"].unique())
    # a forest averages its trees, boosting adds them up with weights
    shares = [1.0 / len(trees)] * len(trees) if classifier else list(model.treeWeights)
    # every row meets all leaves: rows are spread over all cores, however few they are
    spread = rows.repartition(TASKS * rows.sparkSession.sparkContext.defaultParallelism)
    return node_contributions(nodes, dict(zip(trees, shares, strict=True)), spread, features, outputs, ident, classifier, only)


def node_contributions(
    nodes: pd.DataFrame,
    weights: dict[int, float],
    rows: DataFrame,
    features: Sequence[str],
    outputs: Sequence[str],
    ident: Sequence[str],
    classifier: bool = True,
    only: str | None = None,
) -> DataFrame:
    """``contributions`` for trees given as nodes in the form of ``node_table``, with a weight for each tree."""
    leaves = _leaves(nodes, weights, classifier)
    base = sum(v * s for v, s, _ in leaves)
    kinds = dict(rows.dtypes)
    names, feats, labels = list(ident), list(features), list(outputs)
    boxes = Boxes(leaves, len(feats)) if len(feats) <= WAYS else None
    leaves = leaves if boxes is None else []
    sent = rows.sparkSession.sparkContext.broadcast(boxes)

    def told(pdf: pd.DataFrame, output, start, phi: np.ndarray) -> pd.DataFrame:
        out = pdf[names].copy()
        out["output"], out["base_value"], out["prediction"] = output, start, start + phi.sum(axis=1)
        out["contributions"] = [dict(zip(feats, map(float, r))) for r in phi]
        return out

    def explain(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            x = pdf[feats].to_numpy("float64")
            if only is not None:
                at = pd.Index(labels).get_indexer(pdf[only])
                phi = np.zeros((len(x), len(feats))) if sent.value is None else sent.value.shapley(x, at)
                for value, _, path in leaves:
                    for f, part in _leaf_shapley(x, path).items():
                        phi[:, f] += part * value[at]
                yield told(pdf, pdf[only], base[at], phi)[at >= 0]
                continue
            phi = np.zeros((len(x), len(feats), len(labels))) if sent.value is None else sent.value.shapley(x, None)
            for value, _, path in leaves:
                for f, part in _leaf_shapley(x, path).items():
                    phi[:, f, :] += part[:, None] * value[None, :]
            for k, label in enumerate(labels):
                yield told(pdf, label, base[k], phi[:, :, k])

    schema = ", ".join(f"{c} {kinds[c]}" for c in names)
    filled = rows.select(*names, *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in feats])
    return filled.mapInPandas(
        explain,
        f"{schema}, output string, base_value double, prediction double, contributions map<string,double>",
    )


def top_contributions(explained: DataFrame, k: int = 5) -> DataFrame:
    """The ``k`` strongest features per row and output, with direction and a short text."""
    pairs = F.transform(
        F.map_entries("contributions"),
        lambda e: F.struct(
            (-F.abs(e["value"])).alias("order"),
            e["key"].alias("feature"),
            half_up(e["value"], 4).alias("value"),
        ),
    )
    text = F.transform(
        F.slice("top", 1, 3),
        lambda e: F.concat(
            F.replace(e["feature"], F.lit("_"), F.lit(" ")),
            F.when(e["value"] > 0, F.lit(" +")).otherwise(F.lit(" -")),
            F.format_string("%.2f", F.abs(e["value"])),
        ),
    )
    return (
        explained.withColumn("top", F.slice(F.array_sort(pairs), 1, k))
        .withColumn("narrative", F.array_join(text, ", "))
        .withColumn("top_features", F.to_json(F.map_from_entries(F.transform("top", lambda e: F.struct(e["feature"], e["value"])))))
        .drop("top", "contributions")
    )

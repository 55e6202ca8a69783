"""Random forests on bins, all trees grown a level at a time, whatever the number of rows.

A tree tells rows apart only by the bins that the cuts of each feature make, so rows of equal bins and label are one cell with a
count: a bootstrap sample gives every row a Poisson draw of mean 1, and the draws of a cell's n rows add up to one of mean n.
Cells lie in blocks. A task takes a block and some of the trees; for one tree after the other it draws, finds the open node of
each cell and adds the draws up by node, bin and label, so the table that it adds into is that of one tree. What the blocks have
counted for a tree meets in one task, which chooses the cuts of its open nodes. Draws depend on seed, tree and block only.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable, Iterable, Iterator, Sequence
from functools import cached_property, reduce
from math import ceil, exp, factorial, sqrt

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.ml.classification import RandomForestClassificationModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cloudtally.runtime import durable, new_folder

BINS = 32
PROBES = 1_024  # quantiles that are looked at for the cuts of a feature
BLOCK = 2_000_000  # cells; a task holds some 150 bytes for each
TRIPLE = 3  # features whose bins make up one number
WORD = 64  # nodes in a mask
CHUNK = 1 << 16  # cells at once, at least
CHOICE = "tree int, node int, feature int, cut int, gain double, lower array<bigint>, upper array<bigint>"
#: The number of draws by 16 random bits.
DRAWS = np.searchsorted(np.cumsum([exp(-1) / factorial(k) for k in range(12)]), (np.arange(1 << 16) + 0.5) / (1 << 16)).astype(np.uint8)


def summary(values: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """All values with their counts where they are few, else ``PROBES`` quantiles, each for an equal share of the counts.

    What is not a number lies above all cuts and makes none.
    """
    known = ~np.isnan(values)
    if not known.all():
        values, counts = values[known], None if counts is None else counts[known]
    order = np.argsort(values, kind="stable") if counts is not None else None
    values = np.sort(values) if order is None else values[order]
    first = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]])) if len(values) else np.zeros(0, dtype=np.intp)
    total = np.arange(1, len(values) + 1, dtype="float64") if order is None else counts[order].cumsum()
    if len(first) <= BINS:
        return values[first], np.diff(np.concatenate([[0.0], total[np.append(first[1:], len(values))[: len(first)] - 1]]))
    at = np.searchsorted(total, (np.arange(PROBES) + 0.5) / PROBES * total[-1])
    return values[at], np.full(PROBES, total[-1] / PROBES)


def cut_points(rows: DataFrame, features: Sequence[str], label: str) -> tuple[list[np.ndarray], dict[int, int]]:
    """Cuts of each feature, between all of its values where they are few, else at quantiles, and the rows of each label.

    A value at a cut lies below it. The quantiles are those of the summaries of all tasks, which are off by a
    ``PROBES``-th of the rows at most.
    """
    names = list(features)

    def summarize(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = list(batches)
        if not sum(b.num_rows for b in kept):
            return
        told = [summary(_column(kept, c)) for c in names]
        told.append(np.unique(_column(kept, label), return_counts=True))
        yield _summaries(range(len(told)), told)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, list] = {}
        for batch in batches:
            for r in batch.to_pylist():
                have = found.setdefault(r["feature"], [])
                have.append((np.array(r["value"]), np.array(r["rows"])))
                if len(have) == PROBES:  # so many tasks' summaries are one
                    have[:] = [_merged(have)]
        if found:
            yield _summaries(found, [_merged(have) for have in found.values()])

    kind = "feature int, value array<double>, rows array<double>"
    parts = rows.select(*names, F.col(label).cast("double").alias(label)).mapInArrow(summarize, kind)
    told = {r.feature: r for r in parts.repartition(len(names) + 1, "feature").mapInArrow(merge, kind).collect()}
    cuts = []
    for f in range(len(names)):
        values, counts = (np.array(told[f].value), np.array(told[f].rows)) if told else (np.zeros(0), np.zeros(0))
        if len(values) > BINS:
            at = np.searchsorted(counts.cumsum(), np.arange(1, BINS) / BINS * counts.sum())
            own = np.unique(values[at])
            own = own[own < values[-1]]
        else:
            own = (values[:-1] + values[1:]) / 2
        cuts.append(own[np.isfinite(own)])
    sizes = told[len(names)] if told else None
    return cuts, dict(zip(map(int, sizes.value), map(int, sizes.rows), strict=True)) if sizes else {}


def _column(batches: Sequence[pa.RecordBatch], name: str) -> np.ndarray:
    return np.concatenate([b.column(name).to_numpy(zero_copy_only=False) for b in batches])


def _merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    return summary(np.concatenate([v for v, _ in parts]), np.concatenate([n for _, n in parts]))


def _summaries(features: Iterable[int], told: Sequence[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    doubles = [pa.array([np.asarray(t[k], dtype="float64") for t in told], pa.list_(pa.float64())) for k in (0, 1)]
    return pa.RecordBatch.from_arrays([pa.array(list(features), pa.int32()), *doubles], ["feature", "value", "rows"])


def triples(bins: Sequence[int]) -> list[range]:
    return [range(i, min(i + TRIPLE, len(bins))) for i in range(0, len(bins), TRIPLE)]


def cells(rows: DataFrame, features: Sequence[str], label: str, cuts: Sequence[np.ndarray], labels: Sequence[int]) -> DataFrame:
    """The distinct (bins, label) of each task's rows with their counts; the bins of three features are one number.

    ``labels`` are those that occur, in order: a label's place among them stands for it.
    """
    bins, names = [len(c) + 1 for c in cuts], list(features)
    named = [*(f"t{k}" for k in range(len(triples(bins)))), "label", "n"]
    present = np.array(labels)

    def bin_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = list(batches)
        if not sum(b.num_rows for b in kept):
            return
        each = [np.searchsorted(cut, _column(kept, c)) for c, cut in zip(names, cuts, strict=True)]
        codes = [reduce(lambda code, f: code * bins[f] + each[f], own[1:], each[own[0]]) for own in triples(bins)]
        yield _cells(named, *_added([*codes, np.searchsorted(present, _column(kept, label))], None))

    return rows.select(*names, F.col(label).cast("int").alias(label)).mapInArrow(bin_up, ", ".join(f"{c} {'long' if c == 'n' else 'int'}" for c in named))


def _added(keys: Sequence[np.ndarray], counts: np.ndarray | None) -> tuple[list[np.ndarray], np.ndarray]:
    """Distinct keys in order with the sums of their counts."""
    order = np.lexsort(keys[::-1])
    keys = [k[order] for k in keys]
    new = np.concatenate([[True], reduce(np.logical_or, [k[1:] != k[:-1] for k in keys])])
    first = np.flatnonzero(new)
    n = np.diff(np.append(first, len(new))) if counts is None else np.add.reduceat(counts[order], first)
    return [k[first] for k in keys], n


def _cells(named: Sequence[str], keys: Sequence[np.ndarray], counts: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*(pa.array(k.astype(np.int32)) for k in keys), pa.array(counts.astype(np.int64))], list(named))


def blocks(found: DataFrame) -> DataFrame:
    """``cells`` in blocks of some ``BLOCK`` at most, a row each with its columns as bytes; cells of one row come first."""
    named = found.columns
    stored = durable(found)
    parts = max(1, -(-stored.count() // BLOCK))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = list(batches)
        if not sum(b.num_rows for b in kept):
            return
        keys, n = _added([_column(kept, c) for c in named[:-1]], _column(kept, "n"))
        order = np.argsort(n > 1, kind="stable")
        row = {"block": [TaskContext.get().partitionId()]} | {c: [k[order].tobytes()] for c, k in zip(named, [*keys, n], strict=True)}
        yield pa.RecordBatch.from_pydict(row, schema=pa.schema([("block", pa.int32()), *((c, pa.binary()) for c in named)]))

    return durable(stored.repartition(parts, *named[:-1]).mapInArrow(pack, ", ".join(["block int", *(f"{c} binary" for c in named)])))


class Open:
    """The open nodes of a tree: their boxes of bins (half open) and the features that each may be cut by."""

    def __init__(self, ids: list[int], low: np.ndarray, high: np.ndarray, seed: int, tree: int) -> None:
        k = low.shape[1]
        tried = ceil(sqrt(k))
        self.ids, self.low, self.high = ids, low, high
        self.tried = np.array([np.sort(np.random.default_rng([seed, tree, i]).permutation(k)[:tried]) for i in ids])

    def masks(self, bins: Sequence[int]) -> list[list[np.ndarray]]:
        """For each word of nodes and each triple the nodes whose boxes hold a number of the triple, as bits."""
        out = []
        for start in range(0, len(self.ids), WORD):
            held = _held(self.low[start : start + WORD], self.high[start : start + WORD], bins)
            out.append([reduce(lambda a, f: (a[:, None] & held[f]).ravel(), own[1:], held[own[0]]) for own in triples(bins)])
        return out


class Block:
    """A block's cells as look-up numbers."""

    def __init__(self, row: dict, bins: Sequence[int], labels: int) -> None:
        self.number, self.bins, self.labels = row["block"], bins, labels
        own = triples(bins)
        self.codes = [np.frombuffer(row[f"t{k}"], np.int32).astype(np.intp) for k in range(len(own))]
        counts = np.frombuffer(row["n"], np.int64)
        self.ones = int(np.searchsorted(counts > 1, True))
        self.many = counts[self.ones :].astype("float64")
        label = np.frombuffer(row["label"], np.int32)
        each = []
        for code, fs in zip(self.codes, own, strict=True):
            for f in fs:
                each.append(code // int(np.prod([bins[g] for g in fs if g > f])) % bins[f])
        # two features side by side: one sum serves both
        self.pairs = []
        for f in range(0, len(bins), 2):
            g = f + 1 if f + 1 < len(bins) else None
            code = each[f] if g is None else each[f] * bins[g] + each[g]
            self.pairs.append((f, g, code * labels + label))

    def drawn(self, seed: int | None, tree: int) -> np.ndarray:
        if seed is None:
            return np.concatenate([np.ones(self.ones), self.many])
        rng = np.random.Generator(np.random.SFC64([seed, tree, self.number]))
        out = np.empty(self.ones + len(self.many))
        random = rng.integers(0, 1 << 64, -(-self.ones // 4), dtype=np.uint64).view(np.uint16)
        out[: self.ones] = DRAWS.take(random[: self.ones])
        out[self.ones :] = rng.poisson(self.many)
        return out

    def nodes(self, masks: list[list[np.ndarray]], start: int, end: int) -> np.ndarray:
        """The open node of each of some cells; numbers beyond them for cells in none."""
        at = None
        for w, word in enumerate(masks):
            held = word[0].take(self.codes[0][start:end])
            for mask, code in zip(word[1:], self.codes[1:], strict=True):
                held &= mask.take(code[start:end])
            held -= np.uint64(1)  # ones below the only bit, or all ones
            here = np.bitwise_count(held).astype(np.intp)
            at = np.where(at < w * WORD, at, w * WORD + here) if w else here
        return at

    def counts(self, tree: Open, draws: np.ndarray) -> np.ndarray:
        """Draws by open node, feature that is tried, bin and label."""
        n, width, masks = len(tree.ids), max(self.bins), tree.masks(self.bins)
        each = [self.bins[f] * (1 if g is None else self.bins[g]) * self.labels for f, g, _ in self.pairs]
        sums = [np.zeros((n + 1) * size) for size in each]
        step = max(CHUNK, len(sums[0]))  # as many cells as numbers to add them to
        for start in range(0, len(draws), step):
            own = slice(start, start + step)
            at = self.nodes(masks, start, start + step)
            np.minimum(at, n, out=at)
            for total, size, (_, _, code) in zip(sums, each, self.pairs, strict=True):
                place = at * size
                place += code[own]
                total += np.bincount(place, draws[own], len(total))
        every = np.zeros((n, len(self.bins), width, self.labels))
        for total, size, (f, g, _) in zip(sums, each, self.pairs, strict=True):
            nf, ng = self.bins[f], 1 if g is None else self.bins[g]
            both = total[: n * size].reshape(n, nf, ng, self.labels)
            every[:, f, :nf] = both.sum(axis=2)
            if g is not None:
                every[:, g, :ng] = both.sum(axis=1)
        return every[np.arange(n)[:, None], tree.tried].astype(np.int64)


def choose(counts: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, ...]:
    """For each node the place among those tried, the last bin below the cut, the gain, and the draws below and above it by
    label; place -1 where nothing is gained."""
    n, _, width, labels = counts.shape
    below = counts.cumsum(axis=2)
    total = below[:, :1, -1:]
    below = below[:, :, :-1]
    above = total - below
    low, high, whole = below * weights, above * weights, total * weights
    mass = whole.sum(-1)
    with np.errstate(divide="ignore", invalid="ignore"):
        purity = ((low**2).sum(-1) / low.sum(-1) + (high**2).sum(-1) / high.sum(-1)) / mass
        gain = purity - (whole**2).sum(-1) / mass**2
    gain = np.where((below.sum(-1) > 0) & (above.sum(-1) > 0), gain, -1.0).reshape(n, -1)
    best, rows = gain.argmax(axis=1) if width > 1 else np.zeros(n, dtype=int), np.arange(n)
    if width == 1:
        return np.full(n, -1), best, np.zeros(n), total.reshape(n, labels), np.zeros((n, labels), dtype=np.int64)
    place, cut = best // (width - 1), best % (width - 1)
    useless = gain[rows, best] <= 1e-12
    lower, upper = below[rows, place, cut], above[rows, place, cut]
    lower[useless], upper[useless] = total[useless, 0, 0], 0
    return np.where(useless, -1, place), cut, gain[rows, best], lower, upper


def fit(
    rows: DataFrame,
    features: Sequence[str],
    label: str,
    labels: int,
    trees: int,
    depth: int,
    seed: int,
    groups: Callable[[int, int], Sequence[int]] = lambda n, trees: [trees],
    bootstrap: bool = True,
) -> RandomForestClassificationModel:
    """Spark's model of a forest on ``rows`` (read twice), whose ``label`` is a number below ``labels``.

    Labels weigh the same together, whatever their rows. Gini impurity, a square root of the features tried at each node,
    leaves where nothing is gained. The trees are dealt out to as many tasks for each block as ``groups`` makes of its cells
    and the trees; to more where blocks are few. That changes no result.
    """
    spark, k = rows.sparkSession, len(features)
    cuts, sizes = cut_points(rows, features, label)
    if not sizes or not 0 <= min(sizes) <= max(sizes) < labels:
        raise ValueError(f"no forest for the labels {sorted(sizes)}")
    bins, total = [len(c) + 1 for c in cuts], sum(sizes.values())
    present = sorted(sizes)
    factor = np.array([total / (len(sizes) * sizes[c]) for c in present])
    stored = blocks(cells(rows, features, label, cuts, present))
    several, largest = stored.select((F.length("n") / 8).cast("long").alias("n")).agg(F.count("*"), F.max("n")).first()
    cores = spark.sparkContext.defaultParallelism
    shares = min(trees, max(len(groups(largest, trees)), -(-2 * cores // several)))
    offered = reduce(DataFrame.unionAll, [stored.withColumn("share", F.lit(s)) for s in range(shares)])
    found: dict[int, dict[int, dict]] = {t: {} for t in range(trees)}
    whole = lambda: (np.zeros((1, k), dtype=np.int64), np.array([bins], dtype=np.int64))
    todo = {t: Open([0], *whole(), seed, t) for t in range(trees)}
    for level in range(depth):
        for r in _level(offered, shares, todo, bins, factor, seed if bootstrap else None, 2 * cores).collect():
            here = todo[r.tree]
            i, lower, upper = here.ids[r.node], np.array(r.lower), np.array(r.upper)
            if not (lower + upper).any():  # no row was drawn: all labels alike
                lower = np.ones(len(present), dtype=np.int64)
            found[r.tree].setdefault(i, {})["counts"] = lower + upper
            if r.feature >= 0:
                found[r.tree][i] |= {"feature": r.feature, "cut": r.cut, "gain": r.gain, "box": (here.low[r.node], here.high[r.node])}
                found[r.tree][2 * i + 1], found[r.tree][2 * i + 2] = {"counts": lower}, {"counts": upper}
        if level + 1 < depth:
            todo = {t: o for t in range(trees) if (o := _opened(found[t], level, seed, t))}
        if not todo:
            break
    return _model(spark, found, cuts, present, labels, factor, depth, seed)


def _level(
    offered: DataFrame, shares: int, todo: dict[int, Open], bins: Sequence[int], weights: np.ndarray, seed: int | None, parts: int
) -> DataFrame:
    """The best cut of every open node; without a seed every row counts once."""
    labels, width = len(weights), max(bins)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                block = Block(row, bins, labels)
                for t in range(row["share"], max(todo) + 1, shares):
                    if t in todo:
                        own = block.counts(todo[t], block.drawn(seed, t)).tobytes()
                        yield pa.RecordBatch.from_pydict({"tree": pa.array([t], pa.int32()), "counts": pa.array([own], pa.binary())})

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for t, own in zip(batch.column("tree").to_pylist(), batch.column("counts"), strict=True):
                more = np.frombuffer(own.as_buffer(), np.int64)
                total[t] = total[t] + more if t in total else more
        for t, counts in total.items():
            here = todo[t]
            place, cut, gain, lower, upper = choose(counts.reshape(len(here.ids), -1, width, labels), weights)
            feature = np.where(place < 0, -1, here.tried[np.arange(len(place)), place])
            yield pa.RecordBatch.from_pydict(
                {
                    "tree": pa.array([t] * len(place), pa.int32()),
                    "node": pa.array(range(len(place)), pa.int32()),
                    "feature": pa.array(feature, pa.int32()),
                    "cut": pa.array(cut, pa.int32()),
                    "gain": pa.array(gain, pa.float64()),
                    "lower": pa.array(lower.tolist(), pa.list_(pa.int64())),
                    "upper": pa.array(upper.tolist(), pa.list_(pa.int64())),
                }
            )

    return offered.mapInArrow(count, "tree int, counts binary").repartition(parts, "tree").mapInArrow(decide, CHOICE)


def _opened(nodes: dict[int, dict], level: int, seed: int, tree: int) -> Open | None:
    """The children of a level's cut nodes that hold more than one label."""
    ids, low, high = [], [], []
    for i in range(2**level - 1, 2 ** (level + 1) - 1):
        node = nodes.get(i)
        if node is None or "feature" not in node:
            continue
        for child in (2 * i + 1, 2 * i + 2):
            if (nodes[child]["counts"] > 0).sum() > 1:
                a, b = (side.copy() for side in node["box"])
                (b if child % 2 else a)[node["feature"]] = node["cut"] + 1
                ids.append(child), low.append(a), high.append(b)
    return Open(ids, np.array(low), np.array(high), seed, tree) if ids else None


def _model(
    spark: SparkSession, found: dict[int, dict[int, dict]], cuts: Sequence[np.ndarray], present: Sequence[int], labels: int,
    weights: np.ndarray, depth: int, seed: int,
) -> RandomForestClassificationModel:
    """The nodes as a saved forest, which Spark loads: nodes of a tree are numbered in the order parent, left, right."""
    cols: dict[str, list] = {c: [] for c in ("treeID", "id", "counts", "gain", "left", "right", "feature", "threshold")}
    for t, nodes in found.items():
        order, todo = [], [0]
        while todo:
            i = todo.pop()
            order.append(i)
            if "feature" in nodes[i]:
                todo += [2 * i + 2, 2 * i + 1]
        place = {i: n for n, i in enumerate(order)}
        for n, i in enumerate(order):
            node = nodes[i]
            inner = "feature" in node
            values = (t, n, node["counts"], node["gain"] if inner else -1.0, place[2 * i + 1] if inner else -1, place[2 * i + 2] if inner else -1,
                      node["feature"] if inner else -1, [float(cuts[node["feature"]][node["cut"]])] if inner else [])
            for c, v in zip(cols, values, strict=True):
                cols[c].append(v)
    counts = np.array(cols["counts"])
    stats = np.zeros((len(counts), labels))
    stats[:, present] = counts * weights
    mass = stats.sum(axis=1, keepdims=True)
    impurity = 1 - ((stats / np.where(mass > 0, mass, 1)) ** 2).sum(axis=1)
    table = pa.table(
        {
            "treeID": pa.array(cols["treeID"], pa.int32()),
            "id": pa.array(cols["id"], pa.int32()),
            "prediction": pa.array(stats.argmax(axis=1).astype("float64")),
            "impurity": pa.array(impurity),
            "impurityStats": pa.array(stats.tolist(), pa.list_(pa.float64())),
            "rawCount": pa.array(counts.sum(axis=1), pa.int64()),
            "gain": pa.array(cols["gain"], pa.float64()),
            "leftChild": pa.array(cols["left"], pa.int32()),
            "rightChild": pa.array(cols["right"], pa.int32()),
            "featureIndex": pa.array(cols["feature"], pa.int32()),
            "threshold": pa.array(cols["threshold"], pa.list_(pa.float64())),
        }
    )
    path, kind = new_folder(spark), "org.apache.spark.ml.classification."

    def meta(name: str, uid: str, params: dict, **more) -> str:
        told = {"class": kind + name, "timestamp": int(time.time() * 1000), "sparkVersion": spark.version, "uid": f"{uid}_{uuid.uuid4().hex[:12]}"}
        return json.dumps(told | {"paramMap": params, "defaultParamMap": {}} | more)

    params, sizes = {"maxDepth": depth, "seed": seed, "impurity": "gini"}, {"numFeatures": len(cuts), "numClasses": labels}
    forest = meta("RandomForestClassificationModel", "RandomForestClassifier", params | {"numTrees": len(found)}, **sizes, numTrees=len(found))
    spark.createDataFrame([(forest,)], "value string").coalesce(1).write.text(f"{path}/metadata")
    own = [(t, meta("DecisionTreeClassificationModel", "dtc", params), 1.0) for t in found]
    spark.createDataFrame(own, "_1 int, _2 string, _3 double").coalesce(1).write.parquet(f"{path}/treesMetadata")
    split = F.struct("featureIndex", F.col("threshold").alias("leftCategoriesOrThreshold"), F.lit(-1).alias("numCategories")).alias("split")
    node = ("id", "prediction", "impurity", "impurityStats", "rawCount", "gain", "leftChild", "rightChild", split)
    spark.createDataFrame(table).select("treeID", F.struct(*node).alias("nodeData")).coalesce(1).write.parquet(f"{path}/data")
    return RandomForestClassificationModel.load(path)


class Leaves:
    """The trees of a forest as masks of leaves: a row's leaf in a tree is the one that the bins of all features leave.

    Made from the node table, so it is as large as the forest; masks are made where they are used.
    """

    def __init__(self, nodes: pa.Table, features: int) -> None:
        cols = {c: nodes.column(c).to_numpy() for c in ("treeID", "id", "leftChild", "rightChild", "featureIndex", "threshold")}
        stats = np.array(nodes.column("impurityStats").to_pylist(), dtype="float64")
        inner = cols["leftChild"] >= 0
        self.cuts = [np.unique(cols["threshold"][inner & (cols["featureIndex"] == f)]) for f in range(features)]
        self.trees = []
        for t in np.unique(cols["treeID"]):
            own = np.flatnonzero(cols["treeID"] == t)
            at = {int(i): n for i, n in zip(cols["id"][own], own, strict=True)}
            low, high, leaves, todo = [], [], [], [(0, [0] * features, [len(c) + 1 for c in self.cuts])]
            while todo:
                i, a, b = todo.pop()
                n = at[i]
                if not inner[n]:
                    low.append(a), high.append(b), leaves.append(n)
                    continue
                f = int(cols["featureIndex"][n])
                cut = int(np.searchsorted(self.cuts[f], cols["threshold"][n])) + 1
                todo.append((int(cols["leftChild"][n]), a, [min(x, cut) if g == f else x for g, x in enumerate(b)]))
                todo.append((int(cols["rightChild"][n]), [max(x, cut) if g == f else x for g, x in enumerate(a)], b))
            value = stats[leaves]
            self.trees.append((np.array(low), np.array(high), value / value.sum(axis=1, keepdims=True)))

    @cached_property
    def masks(self) -> list[list[list[np.ndarray]]]:
        """For each tree, word of leaves and feature pair the leaves that a pair of bins leaves, as bits."""
        out = []
        for low, high, _ in self.trees:
            words = []
            for start in range(0, len(low), WORD):
                held = _held(low[start : start + WORD], high[start : start + WORD], [len(c) + 1 for c in self.cuts])
                words.append([(held[f][:, None] & held[f + 1]).ravel() if f + 1 < len(held) else held[f] for f in range(0, len(held), 2)])
            out.append(words)
        return out

    def probability(self, x: np.ndarray) -> np.ndarray:
        """Mean of the trees' shares of the labels for each row of feature values."""
        at = [np.searchsorted(cut, x[:, f]) for f, cut in enumerate(self.cuts)]
        code = [at[f] * (len(self.cuts[f + 1]) + 1) + at[f + 1] if f + 1 < len(at) else at[f] for f in range(0, len(at), 2)]
        total = np.zeros((len(x), self.trees[0][2].shape[1]))
        for words, (_, _, value) in zip(self.masks, self.trees, strict=True):
            leaf = None
            for w, word in enumerate(words):
                held = word[0].take(code[0])
                for mask, own in zip(word[1:], code[1:], strict=True):
                    held &= mask.take(own)
                held -= np.uint64(1)  # ones below the only bit, or all ones
                here = np.bitwise_count(held).astype(np.intp)
                leaf = np.where(leaf < w * WORD, leaf, w * WORD + here) if w else here
            total += value.take(leaf, axis=0)
        return total / len(self.trees)


def _held(low: np.ndarray, high: np.ndarray, bins: Sequence[int]) -> list[np.ndarray]:
    """For each feature the boxes that hold a bin, as bits."""
    bit = np.left_shift(np.uint64(1), np.arange(len(low), dtype=np.uint64))
    inside = lambda f, n: (low[:, f, None] <= np.arange(n)) & (np.arange(n) < high[:, f, None])
    return [np.bitwise_or.reduce(np.where(inside(f, n), bit[:, None], np.uint64(0)), axis=0) for f, n in enumerate(bins)]

"""Isolation forests per dimension (Liu, Ting, Zhou 2008), grown and applied in parallel.

Every (dimension, tree) is one small group of at most 256 sampled rows, so growing is a grouped
map over bounded groups; the node table is bounded by the settings and travels to the scorers.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from functools import cached_property
from math import ceil, gcd, log2

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cloudtally import fixed_values as fv
from cloudtally.functions.numeric import no_nan, scaled
from cloudtally.functions.skew import sized_join
from cloudtally.operators import anomaly
from cloudtally.runtime import durable

NODE = (
    "dimension string, tree int, points int, node int, feature int, cut double, left int, right int, length double"
)
OFFER = "array<struct<dimension:string,tree:int,value:double,zscore:double>>"
SAMPLE = 256
LEAST_ROWS = 10  # dimensions with fewer known values get no forest
SPARE = 1.3  # a tree is offered so many times its sample, since draws vary


def _mean_path(n: float) -> float:
    """Average search depth in a random binary tree of n points."""
    if n <= 1:
        return 0.0
    return 1.0 if n == 2 else 2.0 * (np.log(n - 1) + np.euler_gamma) - 2.0 * (n - 1) / n


def _grow(points: np.ndarray, rng: np.random.Generator) -> list[tuple]:
    limit = ceil(log2(max(len(points), 2)))
    nodes, todo = [], [(0, points, 0)]
    made = 1
    while todo:
        me, pts, depth = todo.pop()
        span = pts.max(axis=0) - pts.min(axis=0) if len(pts) else np.zeros(2)
        usable = np.flatnonzero(span > 0)
        if depth >= limit or len(pts) <= 1 or not len(usable):
            nodes.append((me, -1, 0.0, -1, -1, depth + _mean_path(len(pts))))
            continue
        f = int(rng.choice(usable))
        cut = float(rng.uniform(pts[:, f].min(), pts[:, f].max()))
        low = pts[:, f] <= cut
        nodes.append((me, f, cut, made, made + 1, 0.0))
        todo += [(made, pts[low], depth + 1), (made + 1, pts[~low], depth + 1)]
        made += 2
    return nodes


def _known(d: str) -> tuple[Column, Column]:
    """Value and z-score of a dimension, both null unless both are there."""
    value, z = no_nan(F.col(d).cast("double")), no_nan(F.col(f"{d}_zscore").cast("double"))
    both = value.isNotNull() & z.isNotNull()
    return F.when(both, value), F.when(both, z)


def _offer(d: str, first: Column, step: Column, trees: int, value: Column, score: Column) -> Callable[[Column], Column]:
    """The j-th draw of a row as a struct."""
    tree = lambda j: F.pmod(first + j * step, F.lit(trees)).cast("int")
    return lambda j: F.struct(F.lit(d).alias("dimension"), tree(j).alias("tree"), value.alias("value"), score.alias("zscore"))


def _dimensions(z: DataFrame, dimensions: Sequence[str]) -> list[str]:
    return [d for d in dimensions if {d, f"{d}_zscore"} <= set(z.columns)]


def fit(
    z: DataFrame,
    ident: Sequence[str],
    trees: int = 150,
    sample: int = SAMPLE,
    seed: int = 42,
    dimensions: Sequence[str] = tuple(fv.INCIDENT_WEIGHTS),
) -> DataFrame:
    """Node table of one forest per dimension; those with fewer than ``LEAST_ROWS`` rows get none.

    One rule for any number of rows: a row goes to k different trees, where k is the expected
    number of trees per row, rounded up or down by the row's hash. Its first tree and the step from one
    to the next come from hashes too, so a tree is offered about 1.3 samples and keeps one.
    """
    present = _dimensions(z, dimensions)
    if not present:
        return z.sparkSession.createDataFrame([], NODE)
    sizes = z.agg(*[F.count(_known(d)[0]).alias(d) for d in present]).first().asDict()
    steps = F.array(*[F.lit(k) for k in range(1, trees + 1) if gcd(k, trees) == 1])
    offers = []
    for d in present:
        if sizes[d] < LEAST_ROWS:
            continue
        value, score = _known(d)
        hashed = lambda k, d=d: F.pmod(F.xxhash64(*ident, F.lit(d), F.lit(seed + k)), F.lit(1 << 30))
        expected = min(float(trees), SPARE * trees * sample / sizes[d])
        draws = F.when(value.isNotNull(), F.floor(F.lit(expected) + hashed(0) / float(1 << 30)).cast("int"))
        step = F.element_at(steps, (F.pmod(hashed(1), F.size(steps)) + 1).cast("int"))
        one = _offer(d, hashed(2), step, trees, value, score)
        offers.append(F.when(draws > 0, F.transform(F.sequence(F.lit(0), draws - 1), one)).otherwise(F.array().cast(OFFER)))
    if not offers:
        return z.sparkSession.createDataFrame([], NODE)
    order = F.xxhash64(*ident, "o.tree", F.lit(seed + 3)).alias("_order")
    drawn = z.select(*ident, F.explode(F.flatten(F.array(*offers))).alias("o")).select("o.*", order)

    def grow(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        dim, tree = key
        pts = pdf.sort_values(["_order", "value"]).head(sample)[["value", "zscore"]].to_numpy("float64")
        rng = np.random.default_rng([seed, int(tree), sum(dim.encode())])
        nodes = pd.DataFrame(_grow(pts, rng), columns=["node", "feature", "cut", "left", "right", "length"])
        nodes.insert(0, "points", len(pts))
        nodes.insert(0, "tree", tree)
        nodes.insert(0, "dimension", dim)
        return nodes

    return drawn.groupBy("dimension", "tree").applyInPandas(grow, NODE)


def path_lengths(tree: np.recarray, x: np.ndarray) -> np.ndarray:
    """Depth at which each row (value, z-score) ends in a tree."""
    at = np.zeros(len(x), dtype="int64")
    while True:
        f = tree.feature[at]
        inner = f >= 0
        if not inner.any():
            return tree.length[at]
        v = x[np.arange(len(x)), np.maximum(f, 0)]
        at = np.where(inner, np.where(v <= tree.cut[at], tree.left[at], tree.right[at]), at)


class Cells:
    """The trees of one dimension as grids: a row's ranks among a tree's cuts name the leaf that it ends in.

    A tree's cuts divide the plane of value and z-score into at most 256 stretches each way, so a row needs its rank
    among all cuts once, and then three look-ups for each tree instead of a walk from node to node.
    """

    def __init__(self, trees: list[np.recarray]) -> None:
        self.count = len(trees)
        self.cuts = [[np.unique(t.cut[t.feature == f]) for t in trees] for f in (0, 1)]
        self.grids = [self._grid(t, self.cuts[0][k], self.cuts[1][k]) for k, t in enumerate(trees)]

    @staticmethod
    def _grid(tree: np.recarray, *cuts: np.ndarray) -> np.ndarray:
        """The depth of the leaf for every pair of ranks, a rank being the number of cuts below a number."""
        grid = np.empty([len(c) + 1 for c in cuts])
        todo = [(0, (0, 0), grid.shape)]
        while todo:
            node, low, high = todo.pop()
            f = tree.feature[node]
            if f < 0:
                grid[low[0] : high[0], low[1] : high[1]] = tree.length[node]
                continue
            # at or below the cut: no more cuts lie below the number than below the cut itself
            at = min(max(int(np.searchsorted(cuts[f], tree.cut[node])) + 1, low[f]), high[f])
            todo.append((tree.left[node], low, tuple(at if i == f else high[i] for i in (0, 1))))
            todo.append((tree.right[node], tuple(at if i == f else low[i] for i in (0, 1)), high))
        return grid

    @cached_property
    def ranks(self) -> list[tuple[np.ndarray, np.ndarray]]:
        """For value and z-score all cuts, and by a rank among them each tree's own; made where they are used."""
        made = []
        for cuts in self.cuts:
            every = np.unique(np.concatenate(cuts))
            own = np.stack([np.concatenate([np.searchsorted(c, every), [len(c)]]) for c in cuts]).astype(np.uint16)
            made.append((every, own))
        return made

    def total(self, x: np.ndarray) -> np.ndarray:
        """Sum over the trees of the depths at which each row (value, z-score) ends."""
        at = [np.searchsorted(every, x[:, f]) for f, (every, _) in enumerate(self.ranks)]
        out = np.zeros(len(x))
        for k, grid in enumerate(self.grids):
            value, score = (own[k].take(at[f]) for f, (_, own) in enumerate(self.ranks))
            out += grid.ravel().take(value.astype(np.intp) * grid.shape[1] + score)
        return out


def raw_scores(
    z: DataFrame, forest: DataFrame, ident: Sequence[str], dimensions: Sequence[str] = tuple(fv.INCIDENT_WEIGHTS)
) -> DataFrame:
    """Identity and raw_<dimension>, 2^(-mean depth / expected depth); higher is stranger.

    All dimensions of a row are scored side by side. The expected depth is that of the points a
    tree was really grown from, as in trees of a small dimension.
    """
    forests: dict[str, list[np.recarray]] = {}
    # dimensions x trees x at most 511 nodes
    for (dim, _), nodes in forest.toPandas().groupby(["dimension", "tree"]):
        forests.setdefault(dim, []).append(nodes.sort_values("node").to_records(index=False))
    expected = {d: float(np.mean([_mean_path(t.points[0]) for t in ts])) for d, ts in forests.items()}
    present = _dimensions(z, dimensions)
    sent = z.sparkSession.sparkContext.broadcast({d: Cells(ts) for d, ts in forests.items() if d in present})

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cells = sent.value
        for pdf in batches:
            out = pdf[list(ident)].copy()
            for d in present:
                x = pdf[[f"_v_{d}", f"_z_{d}"]].to_numpy("float64")
                raw, known = np.full(len(x), np.nan), ~np.isnan(x).any(axis=1)
                if d in cells and known.any():
                    raw[known] = np.exp2(-cells[d].total(x[known]) / cells[d].count / expected[d])
                out[f"raw_{d}"] = raw
            yield out

    kinds = dict(z.dtypes)
    schema = ", ".join([*(f"{c} {kinds[c]}" for c in ident), *(f"raw_{d} double" for d in present)])
    cut = z.select(*ident, *[c.alias(f"_{n}_{d}") for d in present for n, c in zip("vz", _known(d), strict=True)])
    return cut.mapInPandas(score, schema)


def detect(
    z: DataFrame,
    forest: DataFrame,
    ident: Sequence[str],
    tenant: Sequence[str] = ("organization_id",),
) -> DataFrame:
    """Dimension scores scaled to 0-100 per tenant and dimension, incident score and severity.

    Identity must contain the tenant.
    """
    return from_raw(durable(raw_scores(z, forest, ident)), ident, tenant)  # read for the range and for the scores


def from_raw(scored: DataFrame, ident: Sequence[str], tenant: Sequence[str] = ("organization_id",)) -> DataFrame:
    """Incident scores from raw scores: one range per tenant for all dimensions, one join."""
    present = [c[4:] for c in scored.columns if c.startswith("raw_")]
    raw = {d: no_nan(F.col(f"raw_{d}")) for d in present}
    span = scored.groupBy(*tenant).agg(
        *[f(c).alias(f"_{n}_{d}") for d, c in raw.items() for n, f in (("lo", F.min), ("hi", F.max))]
    )
    hundred = {d: scaled(c, F.col(f"_lo_{d}"), F.col(f"_hi_{d}")) * 100 for d, c in raw.items()}
    wide = sized_join(scored, span, list(tenant)).select(*ident, *[c.alias(f"anomaly_score_{d}") for d, c in hundred.items()])
    missing = [F.lit(None).cast("double").alias(f"anomaly_score_{d}") for d in fv.INCIDENT_WEIGHTS if d not in present]
    return anomaly.fuse(wide.select("*", *missing))

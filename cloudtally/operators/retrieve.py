"""Nearest guidance passages by vector, and tagging of free-text questions."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cloudtally import fixed_values as fv
from cloudtally.functions.numeric import half_up
from cloudtally.functions.text import intent, mention
from cloudtally.runtime import durable

QUERY_BYTES = 64 << 20
SCORES = 1 << 21  # scores made at once, whatever the number of queries: 16 MB
PARTS = 256  # parts of a corpus that meets blocks of queries


class Best:
    """Running best ``k`` of every query of a block, kept while a task reads its part of the corpus."""

    def __init__(self, matrix: np.ndarray, k: int) -> None:
        self.matrix, self.k = matrix, k
        self.scores = np.full((len(matrix), k), -np.inf)
        self.keys = np.full((len(matrix), k), -1, dtype="int64")

    def add(self, vectors: np.ndarray, keys: np.ndarray, of: np.ndarray | None = None) -> None:
        """Meet some vectors with all queries or with those numbered ``of``, a bounded number of scores at a time."""
        of = np.arange(len(self.matrix)) if of is None else of
        if not len(of) or not len(vectors):
            return
        step = max(1, SCORES // len(of))
        for at in range(0, len(vectors), step):
            part = slice(at, at + step)
            self._merge(of, self.matrix[of] @ vectors[part].T, keys[part])

    def _merge(self, of: np.ndarray, scores: np.ndarray, keys: np.ndarray) -> None:
        # what is below the k-th best of either side can be left out; ties with it cannot
        floor = self.scores[of, self.k - 1]
        if scores.shape[1] > self.k:
            floor = np.maximum(floor, np.partition(scores, -self.k, axis=1)[:, -self.k])
        row, col = np.nonzero(scores >= floor[:, None])
        row = np.concatenate([row, np.repeat(np.arange(len(of)), self.k)])
        score = np.concatenate([scores[row[: len(col)], col], self.scores[of].reshape(-1)])
        key = np.concatenate([keys[col], self.keys[of].reshape(-1)])
        order = np.lexsort((key, -score, row))  # equal scores: the smaller id
        row, score, key = row[order], score[order], key[order]
        place = np.arange(len(row)) - np.searchsorted(row, row)
        kept = place < self.k
        self.scores[of[row[kept]], place[kept]], self.keys[of[row[kept]], place[kept]] = score[kept], key[kept]

    def found(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Number of the query, key and score of what was kept."""
        row, col = np.nonzero(self.scores > -np.inf)
        return row, self.keys[row, col], self.scores[row, col]


def top_k(
    queries: DataFrame,
    corpus: DataFrame,
    k: int = 3,
    vector: str = "embedding",
    ident: str = "vec_id",
    query_bytes: int = QUERY_BYTES,
) -> DataFrame:
    """The ``k`` corpus rows with the largest inner product per query (cosine on unit vectors).

    Exact. The corpus stays where it is and is read once: while the queries take at most
    ``query_bytes`` they travel to its tasks as one array, and each task sends on k rows per query.
    More queries are dealt into blocks of that size, each paired with every part of the corpus by
    a join on the block number, so that neither side is ever in one place. Rows without a vector neither ask nor answer.
    """
    queries = queries.filter(F.col(vector).isNotNull())
    size = queries.select(F.sum(F.size(vector)).alias("n")).first()[0] or 0
    kind, other = dict(queries.dtypes)["query_id"], dict(corpus.dtypes)[ident]
    out = f"query_id {kind}, {ident} {other}, score double"
    if 8 * size <= query_bytes:
        told = queries.select("query_id", vector).toArrow()
        ids = told["query_id"].to_pylist()
        sent = queries.sparkSession.sparkContext.broadcast(np.array(told[vector].to_pylist(), dtype="float64").reshape(len(ids), -1))

        def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            best = Best(sent.value, k)
            for pdf in batches:
                if len(pdf):
                    best.add(np.stack(pdf[vector].to_numpy()).astype("float64"), pdf[ident].to_numpy())
            yield _told([ids[r] for r in best.found()[0]], best, ident)

        found = corpus.filter(F.col(vector).isNotNull()).select(ident, vector).mapInPandas(scan, out)
    else:
        blocks = -(-8 * size // query_bytes)
        asked = queries.select("query_id", F.col(vector).alias("_q"), F.pmod(F.xxhash64("query_id"), F.lit(blocks)).alias("_block"))
        held = corpus.filter(F.col(vector).isNotNull()).select(
            F.col(ident), F.col(vector), F.pmod(F.xxhash64(ident), F.lit(PARTS)).alias("_part")
        )
        left = asked.withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))))
        right = held.withColumn("_block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))

        def meet(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
            if a.empty or b.empty:
                return pd.DataFrame({"query_id": [], ident: [], "score": []})
            best = Best(np.stack(a["_q"].to_numpy()).astype("float64"), k)
            best.add(np.stack(b[vector].to_numpy()).astype("float64"), b[ident].to_numpy())
            return _told(a["query_id"].to_numpy()[best.found()[0]], best, ident)

        found = left.groupBy("_block", "_part").cogroup(right.groupBy("_block", "_part")).applyInPandas(meet, out)
    return _ranked(found, k, ident)


def _told(query_ids, best: Best, ident: str) -> pd.DataFrame:
    _, keys, scores = best.found()
    return pd.DataFrame({"query_id": query_ids, ident: keys, "score": scores})


def _ranked(found: DataFrame, k: int, ident: str) -> DataFrame:
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc(ident))
    return (
        found.withColumn("rank", F.row_number().over(w))
        .filter(F.col("rank") <= k)
        .withColumn("score", half_up(F.col("score"), 6))
    )


def tag_questions(questions: DataFrame, text: str = "question") -> DataFrame:
    """Intent and the region, service and metric a question mentions."""
    q = F.col(text)
    tagged = questions.withColumn("intent", intent(q))
    asked = F.col("intent") != fv.INTENT_FLOOR
    return tagged.withColumns(
        {
            "region": F.when(asked, mention(q, fv.REGION_PATTERN)),
            "service": F.when(asked, F.upper(mention(q, fv.SERVICE_PATTERN))),
            "metric": F.when(asked, mention(q, fv.METRIC_PATTERN)),
        }
    )


# --- inverted lists -----------------------------------------------------------------------------------
MOST_LISTS, SAMPLE_PER_LIST, LEAST_SAMPLE = 4_096, 25, 2_000


@dataclass
class Lists:
    """A corpus dealt into lists around centroids: the stored rows, and the centre, radius and size of each list."""

    rows: DataFrame
    centres: np.ndarray
    radius: np.ndarray
    sizes: np.ndarray


def fit_centres(corpus: DataFrame, n_lists: int | None = None, vector: str = "embedding", ident: str = "vec_id", rounds: int = 10, seed: int = 7) -> np.ndarray:
    """Centres from at most 25 rows a list (2,000 at least; some 100,000 at most), taken in the order of a hash of the id.

    There are as many lists as the square root of the rows, at most 4,096. Only the centres depend on the sample.
    """
    held = corpus.filter(F.col(vector).isNotNull())
    n_lists = n_lists or max(1, min(MOST_LISTS, int(held.count() ** 0.5)))
    taken = held.orderBy(F.xxhash64(ident), ident).limit(max(LEAST_SAMPLE, SAMPLE_PER_LIST * n_lists)).select(vector).toArrow()
    x = np.array(taken[vector].to_pylist(), dtype="float64")
    if not len(x):
        return np.zeros((0, 0))
    centres = x[np.random.default_rng(seed).permutation(len(x))[:n_lists]]
    for _ in range(rounds):
        own = _closest(x, centres)[0]
        n = np.bincount(own, minlength=len(centres))
        total = np.zeros_like(centres)
        np.add.at(total, own, x)
        centres = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], centres)
    return centres


def _closest(x: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centre of every row, and how far it is."""
    own, far = np.empty(len(x), dtype="int64"), np.empty(len(x))
    norms, step = (centres**2).sum(axis=1), max(1, SCORES // max(len(centres), 1))
    for at in range(0, len(x), step):
        part = x[at : at + step]
        own[at : at + step] = (norms - 2 * part @ centres.T).argmin(axis=1)
        far[at : at + step] = np.sqrt(((part - centres[own[at : at + step]]) ** 2).sum(axis=1))
    return own, far


def build_lists(corpus: DataFrame, centres: np.ndarray, vector: str = "embedding", ident: str = "vec_id") -> Lists:
    """Every row of the corpus in the list of its nearest centre; rows without a vector are left out."""
    sent = corpus.sparkSession.sparkContext.broadcast(centres)
    held = corpus.filter(F.col(vector).isNotNull()).select(ident, vector)

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                own, far = _closest(np.stack(pdf[vector].to_numpy()).astype("float64"), sent.value)
                yield pdf.assign(list=own, far=far)

    kinds = dict(held.dtypes)
    rows = durable(held.mapInPandas(place, f"{ident} {kinds[ident]}, {vector} {kinds[vector]}, list long, far double"))
    radius, sizes = np.zeros(len(centres)), np.zeros(len(centres), dtype="int64")
    for r in rows.groupBy("list").agg(F.max("far").alias("r"), F.count("*").alias("n")).collect():  # a row for each list
        radius[r["list"]], sizes[r["list"]] = r["r"], r["n"]
    return Lists(rows, centres, radius, sizes)


def _promising(q: np.ndarray, lists: Lists) -> np.ndarray:
    """For every query the lists by their centre's product with it, empty ones last."""
    promise = q @ lists.centres.T
    promise[:, lists.sizes == 0] = -np.inf
    return np.argsort(-promise, axis=1, kind="stable")


def calibrate(
    queries: DataFrame, lists: Lists, k: int = 3, target: float = 0.95, sample: int = 200, vector: str = "embedding", ident: str = "vec_id"
) -> int:
    """How many lists a query must meet for a share ``target`` of its exact neighbours.

    Learnt from the exact neighbours of at most ``sample`` queries, those with the smallest hashes of their ids.
    """
    some = durable(queries.filter(F.col(vector).isNotNull()).orderBy(F.xxhash64("query_id"), "query_id").limit(sample))
    told = some.select("query_id", vector).toArrow()
    if not len(told) or not len(lists.centres):
        return 1
    exact = search_lists(some, lists, k, vector=vector, ident=ident).select("query_id", ident)
    held = lists.rows.select(ident, "list").join(F.broadcast(exact), ident).collect()  # k rows for each of the sampled queries
    order = np.argsort(_promising(np.array(told[vector].to_pylist(), dtype="float64"), lists), axis=1)
    place = {x: i for i, x in enumerate(told["query_id"].to_pylist())}
    ranks = np.sort([order[place[r["query_id"]], r["list"]] for r in held])
    return int(ranks[min(int(np.ceil(target * len(ranks))), len(ranks)) - 1]) + 1


def search_lists(
    queries: DataFrame,
    lists: Lists,
    k: int = 3,
    probes: int = 4,
    exact: bool = True,
    vector: str = "embedding",
    ident: str = "vec_id",
    query_bytes: int = QUERY_BYTES,
) -> DataFrame:
    """The ``k`` rows with the largest inner product per query, found in the lists that can hold them.

    Each query first meets the ``probes`` lists that promise most. No row of a list scores more than the
    query's product with the centre plus its length times the radius. With ``exact`` the lists whose bound reaches the
    k-th score found so far are met as well, so the result is that of ``top_k``; without it the first lists decide.
    Queries go to the tasks in blocks of ``query_bytes``.
    """
    size = queries.select(F.sum(F.size(vector)).alias("n")).first()[0] or 0
    kind, other = dict(queries.dtypes)["query_id"], dict(lists.rows.dtypes)[ident]
    n_blocks, out = max(1, -(-8 * size // query_bytes)), f"query_id {kind}, {ident} {other}, score double"
    spark, results = queries.sparkSession, []
    for block in range(n_blocks):
        own = queries.filter(F.col(vector).isNotNull() & (F.pmod(F.xxhash64("query_id"), F.lit(n_blocks)) == block))
        told = own.select("query_id", vector).toArrow()
        ids = told["query_id"].to_pylist()
        if not ids or not len(lists.centres):
            continue
        q = np.array(told[vector].to_pylist(), dtype="float64")
        order = _promising(q, lists)
        bound = q @ lists.centres.T + np.linalg.norm(q, axis=1)[:, None] * lists.radius + 1e-9
        first = np.zeros(bound.shape, dtype=bool)
        np.put_along_axis(first, order[:, :probes], True, axis=1)
        found = durable(_meet(spark, lists, ids, q, first, k, vector, ident, out))
        if exact:
            place = {x: i for i, x in enumerate(ids)}
            least = np.full(len(ids), -np.inf)
            for r in found.groupBy("query_id").agg(F.sort_array(F.collect_list("score"), asc=False).alias("s")).collect():
                least[place[r["query_id"]]] = r["s"][k - 1] if len(r["s"]) >= k else -np.inf
            rest = (bound >= least[:, None]) & ~first & (lists.sizes > 0)
            if rest.any():
                found = found.union(_meet(spark, lists, ids, q, rest, k, vector, ident, out))
        results.append(_ranked(found, k, ident))
    if not results:
        return _ranked(spark.createDataFrame([], out), k, ident)
    return reduce(DataFrame.union, results if n_blocks == 1 else [durable(r) for r in results])


def _meet(spark, lists: Lists, ids: list, q: np.ndarray, asks: np.ndarray, k: int, vector: str, ident: str, out: str) -> DataFrame:
    """The best rows of the lists that each query asks for; rows of lists that nobody asks for are not read into Python."""
    sent = spark.sparkContext.broadcast((q, asks))
    wanted = np.flatnonzero(asks.any(axis=0)).tolist()

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        q, asks = sent.value
        best = Best(q, k)
        for pdf in batches:
            for own, part in pdf.groupby("list"):
                best.add(np.stack(part[vector].to_numpy()).astype("float64"), part[ident].to_numpy(), np.flatnonzero(asks[:, own]))
        yield _told([ids[r] for r in best.found()[0]], best, ident)

    return lists.rows.filter(F.col("list").isin(wanted)).select(ident, vector, "list").mapInPandas(scan, out)


def recall(found: DataFrame, exact: DataFrame, ident: str = "vec_id") -> DataFrame:
    """The share of the exact results that were found, and their number."""
    both = exact.select("query_id", ident).join(found.select("query_id", ident).withColumn("_hit", F.lit(1)), ["query_id", ident], "left")
    return both.agg(F.count("*").alias("n_exact"), F.count("_hit").alias("n_found"), half_up(F.count("_hit") / F.count("*"), 4).alias("recall"))

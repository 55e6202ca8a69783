"""Benchmark decontamination: rare n-gram seeds find passages, local alignment decides.

Every test item is cut into word n-grams. How many documents of the whole corpus hold each of them is
counted first. Seeds are those in at most one of ``rare`` documents, and the rarer half of the item's
others that occur: common phrases find nothing but noise, while a leaked item keeps seeds however often it leaked.
The passage around the seeds a document shares with an item is aligned with the item by Smith-Waterman
over words, so replaced, inserted and dropped words cost a little and reordered text costs much.
A document is contaminated where a passage reaches ``limit`` of the score of the item itself.

Items are far fewer than documents; while their n-grams and texts take ``broadcast_bytes`` at most they go to all
tasks, and documents are read in place. Beyond that the items are cut into blocks of that size, which pass the
driver one after another: the scores of a block are stored before the next one is looked at. An item of fewer than
``n`` words is one n-gram. Items without words match nothing, null texts neither. Every row of ``items`` is an
item of its own, whatever its id: texts that share an id are all aligned, and those without one are found too, with
a null in the place of the id. Repeated items and rows get the same answers each.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cloudtally.llm import arrow
from cloudtally.runtime import durable

NGRAM = 3
RARE, RARE_DOCS = 1_000, 100  # n-grams in one of so many documents, or in so few, are rare
LIMIT = 0.5
MATCH, MISMATCH, GAP = 2, -1, -1
BROADCAST_BYTES = 64 << 20
AT_ONCE = 1 << 22  # cells of alignments made together
ODD = np.uint64(0x9E3779B97F4A7C15)
_WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+").findall


def codes(data: bytes) -> np.ndarray:
    """A number for every word, without regard to A-Z or a-z and to ASCII punctuation."""
    words = _WORD(data.lower())
    return np.frombuffer(b"".join(map(xxhash.xxh64_digest, words)), dtype="<u8")


def ngrams(words: np.ndarray, n: int) -> np.ndarray:
    if not len(words):
        return words
    n = min(n, len(words))
    out = np.zeros(len(words) - n + 1, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for k in range(n):
            out = out * ODD + words[k : k + len(out)]
        out = (out ^ (out >> np.uint64(31))) * ODD
        return out ^ (out >> np.uint64(29))


def grams_of_items(items: DataFrame, n: int = NGRAM) -> DataFrame:
    """Row number of the item and gram (a long), distinct."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [np.unique(ngrams(codes(t), n)).view(np.int64) for t in arrow.raw(batch.column("text"))]
            rows = batch.column("row").take(pa.array(np.repeat(np.arange(len(made)), [len(m) for m in made])))
            grams = np.concatenate(made) if made else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([rows, pa.array(grams)], ["row", "gram"])

    return items.select("row", "text").mapInArrow(run, "row long, gram long")


def _found(sorted_: np.ndarray, values: np.ndarray) -> np.ndarray:
    """The place of each value in a sorted array, -1 where it is missing."""
    if not len(sorted_):
        return np.full(len(values), -1)
    at = np.minimum(np.searchsorted(sorted_, values), len(sorted_) - 1)
    return np.where(sorted_[at] == values, at, -1)


def frequencies(docs: DataFrame, grams: np.ndarray, n: int = NGRAM) -> DataFrame:
    """gram and the number of documents (rows) that hold it, for those of the given n-grams that occur."""
    sent = docs.sparkSession.sparkContext.broadcast(np.unique(grams))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = sent.value.view(np.uint64)
        order = np.argsort(known)
        known = known[order]
        total = np.zeros(len(known), dtype=np.int64)
        for batch in batches:
            for part in arrow.slices(batch, "text"):
                for text in arrow.raw(part.column("text")):
                    at = _found(known, ngrams(codes(text), n))
                    total[np.unique(at[at >= 0])] += 1
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(known[seen].view(np.int64)), pa.array(total[seen])], ["gram", "n"])

    return docs.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))


def align(items: list[np.ndarray], passages: list[np.ndarray]) -> np.ndarray:
    """Smith-Waterman scores of pairs, as shares of the score of the item with itself.

    All pairs advance together by one word of their items; a row's gaps are closed by a running maximum.
    """
    score = np.zeros(len(items))
    order = np.argsort([len(p) for p in passages], kind="stable")
    at = 0
    while at < len(order):
        width = len(passages[order[at]])
        stop = at + 1
        while stop < len(order) and (stop - at + 1) * len(passages[order[stop]]) <= AT_ONCE // 64:
            width, stop = len(passages[order[stop]]), stop + 1
        some = order[at:stop]
        at, width = stop, max(len(passages[k]) for k in some)
        deep = max(len(items[k]) for k in some)
        a, b = np.zeros((len(some), deep), np.uint64), np.zeros((len(some), width), np.uint64)
        own, other = np.zeros((len(some), deep), bool), np.zeros((len(some), width), bool)
        for r, k in enumerate(some):
            a[r, : len(items[k])], own[r, : len(items[k])] = items[k], True
            b[r, : len(passages[k])], other[r, : len(passages[k])] = passages[k], True
        slope = np.arange(width, dtype=np.int32) * -GAP
        h, best = np.zeros((len(some), width), np.int32), np.zeros(len(some), np.int32)
        for i in range(deep):
            same = (b == a[:, i, None]) & other & own[:, i, None]
            diagonal = np.concatenate([np.zeros((len(some), 1), np.int32), h[:, :-1]], axis=1) + np.where(same, MATCH, MISMATCH).astype(np.int32)
            now = np.maximum(np.maximum(diagonal, h + GAP), 0)
            h = np.maximum.accumulate(now + slope, axis=1) - slope
            best = np.maximum(best, h.max(axis=1))
        score[some] = best / np.array([MATCH * len(items[k]) for k in some])
    return score


class Seeds:
    """The items of a block by row number: ids, words, seeds, and which items have each seed."""

    def __init__(self, ids: dict[int, int | None], words: dict[int, np.ndarray], pairs: np.ndarray) -> None:
        self.ids, self.words = ids, words
        order = np.argsort(pairs[:, 1].view(np.uint64), kind="stable")
        self.item, gram = pairs[order, 0], pairs[order, 1].view(np.uint64)
        self.gram, self.first, self.count = np.unique(gram, return_index=True, return_counts=True)

    def passages(self, text: np.ndarray, n: int) -> Iterator[tuple[int, int, int]]:
        """item, start and end of the passages worth aligning."""
        at = _found(self.gram, ngrams(text, n))
        where = np.flatnonzero(at >= 0)
        spots: dict[int, list[int]] = {}
        for p, g in zip(where.tolist(), at[where].tolist(), strict=True):
            for item in self.item[self.first[g] : self.first[g] + self.count[g]].tolist():
                spots.setdefault(item, []).append(p)
        for item, ps in spots.items():
            size = len(self.words[item])
            start, end = ps[0] - size, ps[0] + 2 * size
            for p in ps[1:]:
                if p - size > end:
                    yield item, max(start, 0), min(end, len(text))
                    start = p - size
                end = p + 2 * size
            yield item, max(start, 0), min(end, len(text))


def blocks(items: DataFrame, docs: DataFrame, n: int, rare: int, broadcast_bytes: int) -> Iterator[tuple[Seeds, bool]]:
    """The items with their seeds in blocks of a bounded size, and whether it is the last one."""
    cut = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    numbered = durable(cut.withColumn("row", F.monotonically_increasing_id()))
    grams = durable(grams_of_items(numbered, n))
    # words are kept as eight bytes each, about what they take as text
    size = 16 * grams.count() + (numbered.agg(F.sum(F.octet_length("text") + 64)).first()[0] or 0)
    n_blocks, n_docs = max(1, -(-size // broadcast_bytes)), docs.count()
    for k in range(n_blocks):
        block = lambda df: df.filter(F.pmod(F.xxhash64("row"), F.lit(n_blocks)) == k)  # noqa: B023, E731
        own, told = block(grams).toPandas(), block(numbered).collect()
        counted = frequencies(docs, own["gram"].to_numpy(np.int64), n).toPandas()
        own = own.merge(counted, on="gram")
        half = own.groupby("row")["n"].transform("median")
        own = own[own["n"] <= np.maximum(half, max(RARE_DOCS, n_docs / rare))]
        words = {r.row: codes((r.text or "").encode()) for r in told}
        yield Seeds({r.row: r.item_id for r in told}, words, own[["row", "gram"]].to_numpy(np.int64)), k == n_blocks - 1


def better(one: tuple[int | None, float], other: tuple[int | None, float]) -> tuple[int | None, float]:
    """The higher score; of equal ones that of the smaller id, and of an id rather than none."""
    key = lambda x: (x[1], x[0] is not None, -(x[0] or 0))
    return one if key(one) >= key(other) else other


def judge(texts: list[bytes], seeds: Seeds, n: int) -> list[tuple[int | None, float]]:
    """The best item of every text and its score; null and 0 where nothing was worth aligning."""
    items, passages, owner, name = [], [], [], []
    for t, text in enumerate(texts):
        words = codes(text)
        for item, start, end in seeds.passages(words, n):
            items.append(seeds.words[item])
            passages.append(words[start:end])
            owner.append(t)
            name.append(item)
    best: list[tuple[int | None, float]] = [(None, 0.0)] * len(texts)
    for t, item, s in zip(owner, name, align(items, passages), strict=True):
        best[t] = better(best[t], (seeds.ids[item], float(s)))
    return best


def score(
    docs: DataFrame,
    items: DataFrame,
    n: int = NGRAM,
    rare: int = RARE,
    broadcast_bytes: int = BROADCAST_BYTES,
    names: tuple[str, str] = ("item_id", "score"),
) -> DataFrame:
    """The documents, all columns as they are, with the best item and its alignment score.

    Of items with equal scores the one with the smaller id is named. The two new columns are called ``names``, with an
    underscore in front for as long as the documents have such a column.
    """
    while {x.lower() for x in names} & {c.lower() for c in docs.columns}:
        names = (f"_{names[0]}", f"_{names[1]}")
    out, first = docs, True
    for seeds, last in blocks(items, docs, n, rare, broadcast_bytes):
        out = _scored(out, seeds, n, names, first)
        out, first = out if last else durable(out), False
    return out


def _scored(docs: DataFrame, seeds: Seeds, n: int, names: tuple[str, str], first: bool) -> DataFrame:
    sent = docs.sparkSession.sparkContext.broadcast(seeds)
    kept = docs.columns if first else [c for c in docs.columns if c not in names]
    schema = docs.select(*kept).schema.add(names[0], "long").add(names[1], "double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in arrow.slices(batch, "text"):
                found = judge(arrow.raw(part.column("text")), sent.value, n)
                if not first:
                    before = zip(part.column(names[0]).to_pylist(), part.column(names[1]).to_pylist(), strict=True)
                    found = [better(a, b) for a, b in zip(before, found, strict=True)]
                columns = [part.column(c) for c in kept]
                columns += [pa.array([f[0] for f in found], pa.int64()), pa.array([f[1] for f in found], pa.float64())]
                yield pa.RecordBatch.from_arrays(columns, names=[*kept, *names])

    return docs.mapInArrow(run, schema)

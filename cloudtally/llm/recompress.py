"""Removal of long repeated passages, found by recompression.

A text is a row of symbols, at first its words. Each round names two things: maximal runs of one
symbol, then pairs of a left and a right symbol (which side a symbol is on depends on its name and the
round). A name is a hash of what it stands for, so all tasks of all machines give equal passages
equal names without asking each other; a round is a few array steps on many documents at once.

With every symbol goes its context, the words that made it what it is. A symbol whose context lies
inside a window of words is found wherever these words occur again. Hence the symbols of the last
round divide the work: Spark counts their names, and a window that holds a symbol of which the whole
corpus has one occurs once itself. Only the windows whose symbols are all shared are verified, by
counting 96-bit hashes of their words; those found alone are told to their documents, and the others
are repeats. No key gathers rows: every count combines before its shuffle.

The names of shared symbols go to all tasks while they take ``broadcast_bytes`` at most; beyond that
a join brings each document its own. Both ways give the same windows.

Words end at ASCII white space; null texts have none. Every row is a document: repeated rows repeat
each other's passages; rows of one doc_id (or of none) are told apart by 64 bits of their texts. Texts shorter than a window lose nothing, and no text is too long.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cloudtally.llm import arrow
from cloudtally.runtime import durable

WINDOW = 35
ROUNDS = 6
FAR = 1 << 40  # a context that reaches beyond the document
BROADCAST_BYTES = 64 << 20
SLICE = 4 << 20
M1, M2, M3 = (np.uint64(x) for x in (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53, 0x9E3779B97F4A7C15))


def mix(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(33))) * M1
        x = (x ^ (x >> np.uint64(29))) * M2
        return x ^ (x >> np.uint64(32))


def word_names(words: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(map(xxhash.xxh64_digest, words)), dtype="<u8")


class Symbols:
    """Rows of symbols of many documents: names, words covered, contexts, and the document of each."""

    def __init__(self, names: np.ndarray, doc: np.ndarray) -> None:
        self.words = names
        n = len(names)
        self.name, self.doc = names, doc
        self.start, self.end = np.arange(n), np.arange(1, n + 1)
        self.lo, self.hi = self.start.copy(), self.end.copy()

    def _joined(self) -> np.ndarray:
        """Whether each symbol is followed by another one of its document."""
        return self.doc[1:] == self.doc[:-1]

    def runs(self) -> None:
        if len(self.name) < 2:
            self.lo, self.hi = self.lo - FAR, self.hi + FAR
            return
        joined = self._joined()
        same = joined & (self.name[1:] == self.name[:-1])
        first = np.flatnonzero(np.concatenate([[True], ~same]))
        last = np.append(first[1:], len(self.name)) - 1
        size = last - first + 1
        name, start, end = self.name[first], self.start[first], self.end[last]
        # what stands beside a run must be known to differ from it: mostly one word is enough
        left = np.concatenate([[False], joined])[first]
        right = np.concatenate([joined, [False]])[last]
        before, after = np.maximum(first - 1, 0), np.minimum(last + 1, len(self.name) - 1)
        w = self.words
        near_l = w[self.end[before] - 1] != w[self.end[first] - 1]
        near_r = w[self.start[after]] != w[self.start[last]]
        lo_l = np.where(left, np.where(near_l, start - 1, self.lo[before]), start - FAR)
        hi_r = np.where(right, np.where(near_r, end + 1, self.hi[after]), end + FAR)
        self.lo = np.minimum(np.minimum.reduceat(self.lo, first), lo_l)
        self.hi = np.maximum(np.maximum.reduceat(self.hi, first), hi_r)
        with np.errstate(over="ignore"):
            self.name = np.where(size > 1, mix(name * M3 + size.astype(np.uint64)), name)
        self.start, self.end, self.doc = start, end, self.doc[first]

    def pairs(self, round_: int) -> None:
        if len(self.name) < 2:
            self.lo, self.hi = self.lo - FAR, self.hi + FAR
            return
        side = mix(self.name ^ np.uint64(0xA5A5 + round_)) & np.uint64(1) == 1  # true: left
        joined = self._joined()
        pair = joined & side[:-1] & ~side[1:]
        head, tail = np.append(pair, False), np.concatenate([[False], pair])
        hi_next = np.append(np.where(joined, self.hi[1:], self.end[:-1] + FAR), self.end[-1] + FAR)
        lo_prev = np.concatenate([[self.start[0] - FAR], np.where(joined, self.lo[:-1], self.start[1:] - FAR)])
        lo = np.where(~side & ~tail, np.minimum(self.lo, lo_prev), self.lo)
        hi = np.where(side & ~head, np.maximum(self.hi, hi_next), self.hi)
        at = np.flatnonzero(pair)
        with np.errstate(over="ignore"):
            name = self.name.copy()
            name[at] = mix(self.name[at] * M3 + mix(self.name[at + 1]) + np.uint64(1))
        lo[at] = np.minimum(lo[at], lo[at + 1])
        hi[at] = np.maximum(hi[at], hi[at + 1])
        end = self.end.copy()
        end[at] = self.end[at + 1]
        keep = ~tail
        self.name, self.start, self.end, self.doc = name[keep], self.start[keep], end[keep], self.doc[keep]
        self.lo, self.hi = lo[keep], hi[keep]


def recompress(names: np.ndarray, doc: np.ndarray, rounds: int = ROUNDS) -> Symbols:
    row = Symbols(names, doc)
    for r in range(rounds):
        row.runs()
        row.pairs(r)
    return row


class Slice:
    """The words and the last symbols of some documents."""

    def __init__(self, batch: pa.RecordBatch, window: int, rounds: int) -> None:
        self.batch, self.window = batch, window
        self.words = [t.split() for t in arrow.raw(batch.column("text"))]
        sizes = np.array([len(w) for w in self.words], dtype=np.int64)
        self.base = np.concatenate([[0], np.cumsum(sizes)])
        self.doc = np.repeat(np.arange(len(sizes)), sizes)
        self.names = word_names([w for ws in self.words for w in ws])
        self.symbols = recompress(self.names, self.doc, rounds)
        s = self.symbols
        self.usable = np.flatnonzero((s.lo >= 0) & (s.hi <= len(self.names)) & (s.hi - s.lo <= window))

    def anchors(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Names, documents and first words (within the document) of the symbols that can stand in a window."""
        s, u = self.symbols, self.usable
        return s.name[u].view(np.int64), s.doc[u], s.start[u] - self.base[s.doc[u]]

    def candidates(self, shared: np.ndarray) -> np.ndarray:
        """Starts of the windows without any usable symbol that is not ``shared``."""
        n, w, s = len(self.names), self.window, self.symbols
        alone = self.usable[~shared]
        edge = np.zeros(n + 1, dtype=np.int64)
        np.add.at(edge, np.maximum(s.hi[alone] - w, 0), 1)
        np.add.at(edge, s.lo[alone] + 1, -1)
        inside = np.arange(n) + w <= self.base[self.doc + 1] if n else np.zeros(0, dtype=bool)
        return np.flatnonzero(inside & (np.cumsum(edge[:-1]) == 0))

    def hashes(self, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """A 64-bit and a 32-bit hash of the words of each window."""
        out = []
        with np.errstate(over="ignore"):
            for odd in (M1, M2):
                power, size, total, done, at = odd, 1, None, 0, self.names
                # windows of 1, 2, 4, ... words, put together as the bits of the window's length say
                left = self.window
                while left:
                    if left & 1:
                        part = at[np.minimum(starts + done, len(at) - 1)]
                        total = part if total is None else total * power + part
                        done += size
                    left >>= 1
                    if left:
                        at = at[:-size] * power + at[size:] if len(at) > size else at
                        power, size = power * power, 2 * size
                out.append(mix(total))
        return out[0].view(np.int64), (out[1] >> np.uint64(32)).astype(np.uint32).view(np.int32)

    def kept(self, repeats: np.ndarray) -> tuple[list[int], list[str]]:
        """Words removed and the text of the others, document by document."""
        edge = np.zeros(len(self.names) + 1, dtype=np.int64)
        np.add.at(edge, repeats, 1)
        np.add.at(edge, repeats + self.window, -1)
        gone = np.cumsum(edge[:-1]) > 0
        removed, texts = [], []
        for i, words in enumerate(self.words):
            own = gone[self.base[i] : self.base[i + 1]]
            n = int(own.sum())
            removed.append(n)
            texts.append(b" ".join([words[k] for k in np.flatnonzero(~own)] if n else words).decode())
        return removed, texts


def _is_in(sorted_: np.ndarray, values: np.ndarray) -> np.ndarray:
    if not len(sorted_):
        return np.zeros(len(values), dtype=bool)
    return sorted_[np.minimum(np.searchsorted(sorted_, values), len(sorted_) - 1)] == values


def _slices(batches: Iterator[pa.RecordBatch], window: int, rounds: int) -> Iterator[Slice]:
    for batch in batches:
        for part in arrow.slices(batch, "text", SLICE):
            yield Slice(part, window, rounds)


def _flags(part: Slice, names: np.ndarray | None) -> np.ndarray:
    """Which usable symbols are shared: by the names at hand, or by the list that came with the document."""
    name, doc, at = part.anchors()
    if names is not None:
        return _is_in(names, name)
    listed = part.batch.column("_shared").to_pylist()
    where = np.sort(np.array([part.base[d] + k for d, own in enumerate(listed) for k in own or ()], dtype=np.int64))
    return _is_in(where, part.base[doc] + at)


def remove_repeats(docs: DataFrame, window: int = WINDOW, rounds: int = ROUNDS, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """doc_id, n_words, n_removed and text (the words left, joined by one space) of every row.

    A word goes if a window of ``window`` words over it has words that also start elsewhere.
    """
    spark = docs.sparkSession
    rows = arrow.texts(docs).withColumn("_text", F.xxhash64("text"))  # tells apart rows of one doc_id

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _slices(batches, window, rounds):
            name, n = np.unique(part.anchors()[0], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(name), pa.array(n)], ["name", "n"])

    counted = rows.select("text").mapInArrow(count, "name long, n long")
    shared = durable(counted.groupBy("name").agg(F.sum("n").alias("n")).filter("n > 1").select("name"))
    small = 8 * shared.count() <= broadcast_bytes
    names = spark.sparkContext.broadcast(np.sort(shared.toArrow()["name"].to_numpy())) if small else None
    if not small:

        def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part in _slices(batches, window, rounds):
                name, doc, at = part.anchors()
                ids, text = (part.batch.column(c).take(pa.array(doc)) for c in ("doc_id", "_text"))
                yield pa.RecordBatch.from_arrays([pa.array(name), ids, text, pa.array(at)], ["name", "_id", "_t", "at"])

        found = rows.mapInArrow(places, "name long, _id long, _t long, at long").join(shared, "name", "left_semi")
        lists = found.groupBy("_id", "_t").agg(F.collect_set("at").alias("_shared"))
        rows = durable(rows.join(lists, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_text") == F.col("_t")), "left").drop("_id", "_t"))

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _slices(batches, window, rounds):
            starts = part.candidates(_flags(part, names.value if names else None))
            doc = part.doc[starts]
            h, g = part.hashes(starts) if len(starts) else (np.zeros(0, np.int64), np.zeros(0, np.int32))
            ids, text = (part.batch.column(c).take(pa.array(doc)) for c in ("doc_id", "_text"))
            at = pa.array((starts - part.base[doc]).astype(np.int32))
            yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(g), ids, text, at], ["h", "g", "_id", "_t", "at"])

    seen = rows.mapInArrow(verify, "h long, g int, _id long, _t long, at int")
    alone = seen.groupBy("h", "g").agg(F.count("*").alias("n"), *[F.max(c).alias(c) for c in ("_id", "_t", "at")]).filter("n = 1")
    lists = alone.groupBy("_id", "_t").agg(F.collect_list("at").alias("_alone"))
    told = rows.join(lists, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_text") == F.col("_t")), "left").drop("_id", "_t")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _slices(batches, window, rounds):
            starts = part.candidates(_flags(part, names.value if names else None))
            once = [part.base[d] + k for d, own in enumerate(part.batch.column("_alone").to_pylist()) for k in own or ()]
            removed, texts = part.kept(starts[~_is_in(np.sort(np.array(once, dtype=np.int64)), starts)])
            n = [len(w) for w in part.words]
            yield pa.RecordBatch.from_arrays(
                [part.batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(texts, pa.string())],
                ["doc_id", "n_words", "n_removed", "text"],
            )

    return told.mapInArrow(cut, "doc_id long, n_words long, n_removed long, text string")

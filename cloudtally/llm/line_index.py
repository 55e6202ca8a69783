"""Line de-duplication through a sharded minimal perfect hash.

Lines are counted once by 128-bit hashes, with map-side combining. What must lose its lines goes into
an index of shards of some 65,000 lines: a minimal perfect hash gives each line of a shard its own
slot, and slots hold a 64-bit fingerprint, the number of documents and the document that keeps the
line, in compact arrays. Documents probe these arrays where they are read, so no text is shuffled.
An index beyond ``broadcast_bytes`` is not sent out: the documents' line hashes then go to the tasks that hold
the arrays of their shards, which read one shard at a time; a shard that more than ``PROBES`` hashes ask for is
copied, each copy for a part of them. What is to be dropped goes back to the documents in a join.

A line's key is the line without the white space around it, with A-Z in lower case; keys under
``min_chars`` code points are never dropped. Every row is a document, so rows that repeat a doc_id
count apart (told apart by a hash of their texts) and, if theirs is the largest doc_id, all keep the line. A null doc_id is smaller than
any other. Null texts count as empty and stay null. Lines are joined again as they were, whatever
their length; a document may end up empty.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cloudtally.llm import arrow
from cloudtally.runtime import durable

MIN_CHARS, MIN_DOCS = 20, 3
SHARD_LINES = 65_536
BROADCAST_BYTES = 64 << 20
SPACE = b" \t\n\r\x0b\x0c"
NOBODY = -(1 << 63)
LEVELS = 40
PROBES = 1_000_000  # hashes that ask one copy of a shard
_CONTINUED = bytes(range(0x80, 0xC0))


def line_keys(data: bytes, min_chars: int) -> list[bytes | None]:
    """The key of every line, None for those that are too short to count."""
    keys: list[bytes | None] = []
    for line in data.lower().split(b"\n"):
        key = line.strip(SPACE)
        n = len(key)
        if n >= min_chars and (n >= 4 * min_chars or key.isascii() or len(key.translate(None, _CONTINUED)) >= min_chars):
            keys.append(key)
        else:
            keys.append(None)
    return keys


def hashes(keys: list[bytes]) -> np.ndarray:
    """Two 64-bit numbers for every key."""
    return np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, keys)), dtype="<u8").reshape(-1, 2)


def _mix(x: np.ndarray, level: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ np.uint64(level * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)) * np.uint64(0xFF51AFD7ED558CCD)
        x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
        return x ^ (x >> np.uint64(33))


class PerfectHash:
    """Slots 0..n-1 for n pairs of 64-bit numbers.

    On every level each remaining pair marks a bit; pairs alone on theirs are placed there and
    their slot is the number of marks before it. The few that never separate are listed.
    """

    def __init__(self, bits: list[np.ndarray], sizes: list[int], rest: np.ndarray) -> None:
        self.bits, self.sizes, self.rest = bits, sizes, rest
        self.ranks, start = [], 0
        for b in bits:
            ones = np.bitwise_count(b).astype(np.int64)
            self.ranks.append(start + np.concatenate([[0], np.cumsum(ones)[:-1]]))
            start += int(ones.sum())
        self.placed = start
        self.listed = {(int(a), int(b)): start + k for k, (a, b) in enumerate(rest)}

    @classmethod
    def build(cls, pairs: np.ndarray) -> PerfectHash:
        bits, sizes, left = [], [], pairs
        for level in range(LEVELS):
            if not len(left):
                break
            m = -(-max(64, int(1.5 * len(left))) // 64) * 64
            at = (_mix(left[:, 0] ^ _mix(left[:, 1], 0), level) % np.uint64(m)).astype(np.int64)
            alone = np.bincount(at, minlength=m) == 1
            bits.append(np.packbits(alone, bitorder="little").view(np.uint64))
            sizes.append(m)
            left = left[~alone[at]]
        return cls(bits, sizes, left)

    def slots(self, pairs: np.ndarray) -> np.ndarray:
        """The slot of every pair; pairs that were never placed get any slot or -1."""
        out = np.full(len(pairs), -1, dtype=np.int64)
        open_ = np.arange(len(pairs))
        for level, (b, m, ranks) in enumerate(zip(self.bits, self.sizes, self.ranks, strict=True)):
            if not len(open_):
                break
            at = (_mix(pairs[open_, 0] ^ _mix(pairs[open_, 1], 0), level) % np.uint64(m)).astype(np.int64)
            word, bit = b[at >> 6], (at & 63).astype(np.uint64)
            here = (word >> bit) & np.uint64(1) == 1
            below = np.bitwise_count(word & ((np.uint64(1) << bit) - np.uint64(1)))
            out[open_[here]] = ranks[at[here] >> 6] + below[here]
            open_ = open_[~here]
        if self.listed:
            for i in open_:
                out[i] = self.listed.get((int(pairs[i, 0]), int(pairs[i, 1])), -1)
        return out


class Index:
    """The shards that have come to this task."""

    def __init__(self, rows: list, n_shards: int) -> None:
        self.n_shards, self.shards = n_shards, {}
        for r in rows:
            sizes, at, bits = list(r["sizes"]), 0, []
            words = np.frombuffer(r["bits"], dtype=np.uint64)
            for m in sizes:
                bits.append(words[at : at + m // 64])
                at += m // 64
            rest = np.frombuffer(r["rest"], dtype=np.uint64).reshape(-1, 2)
            self.shards[r["shard"]] = (
                PerfectHash(bits, sizes, rest),
                np.frombuffer(r["fingerprints"], dtype=np.uint64),
                np.frombuffer(r["keepers"], dtype=np.int64),
            )

    def keepers(self, pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Whether each pair is in the index, and the document that keeps it."""
        found, keeper = np.zeros(len(pairs), dtype=bool), np.full(len(pairs), NOBODY)
        shard = pairs[:, 0].view(np.int64) % self.n_shards
        order = np.argsort(shard, kind="stable")
        for part in np.split(order, np.flatnonzero(np.diff(shard[order])) + 1):
            if not len(part) or int(shard[part[0]]) not in self.shards:
                continue
            perfect, prints, keeps = self.shards[int(shard[part[0]])]
            slot = perfect.slots(pairs[part])
            same = (slot >= 0) & (prints[slot] == pairs[part, 1])
            found[part], keeper[part] = same, np.where(same, keeps[slot], NOBODY)
        return found, keeper


def _doc_keys(batch: pa.RecordBatch, min_chars: int) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """Row number and hash pair of the distinct keys of every document in a batch."""
    keys, sizes = [], []
    for data in arrow.raw(batch.column("text")):
        own = {k for k in line_keys(data, min_chars) if k is not None}
        keys.extend(own)
        sizes.append(len(own))
    return np.repeat(np.arange(batch.num_rows), sizes), hashes(keys), sizes


def line_hashes(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """h1, h2 and doc_id of the distinct counted lines of every document."""

    def make() -> Callable[[pa.RecordBatch], pa.RecordBatch]:
        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            row, pairs, _ = _doc_keys(batch, min_chars)
            signed = pairs.view(np.int64)
            return pa.RecordBatch.from_arrays(
                [pa.array(signed[:, 0]), pa.array(signed[:, 1]), batch.column("doc_id").take(pa.array(row))], ["h1", "h2", "doc_id"]
            )

        return work

    return arrow.per_slice(arrow.texts(docs), "h1 long, h2 long, doc_id long", make, "text")


def shard_probes(docs: DataFrame, index: DataFrame, n_shards: int, min_chars: int, probes: int = PROBES) -> DataFrame:
    """doc, tag (a hash of the text) and h2 of every line that its row must drop, found in the shards' arrays."""

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in arrow.slices(whole, "text"):
                row, pairs, _ = _doc_keys(batch, min_chars)
                signed = pairs.view(np.int64)
                ids, tags = (batch.column(c).take(pa.array(row)) for c in ("doc_id", "tag"))
                yield pa.RecordBatch.from_arrays([pa.array(signed[:, 0] % n_shards), pa.array(signed[:, 0]), pa.array(signed[:, 1]), ids, tags], ["shard", "h1", "h2", "doc", "tag"])

    keyed = arrow.texts(docs).select(F.coalesce("doc_id", F.lit(NOBODY)).alias("doc_id"), "text", F.xxhash64("text").alias("tag"))
    asked = durable(keyed.mapInArrow(ask, "shard long, h1 long, h2 long, doc long, tag long"))  # counted, then asked
    copies = asked.groupBy("shard").agg(F.ceil(F.count("*") / probes).cast("int").alias("copies")).filter("copies > 1")
    spread = lambda df: df.join(F.broadcast(copies), "shard", "left").withColumn("copies", F.coalesce("copies", F.lit(1)))
    held = spread(index.drop("counts")).withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("copies") - 1))).drop("copies")
    dealt = spread(asked).withColumn("copy", F.pmod(F.xxhash64("doc", "tag", "h1"), F.col("copies")).cast("int")).drop("copies")
    both = held.withColumn("kind", F.lit(0)).unionByName(dealt.withColumn("kind", F.lit(1)), allowMissingColumns=True)
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    met = both.repartition(parts, "shard", "copy").sortWithinPartitions("shard", "copy", "kind")

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, place = None, None
        for batch in batches:
            shard, copy, kind = (batch.column(c).to_numpy() for c in ("shard", "copy", "kind"))
            cuts = np.flatnonzero((np.diff(shard) != 0) | (np.diff(copy) != 0) | (np.diff(kind) != 0)) + 1
            for start, stop in zip([0, *cuts.tolist()], [*cuts.tolist(), len(shard)], strict=True):
                part = batch.slice(start, stop - start)
                if not len(part):
                    continue
                if kind[start] == 0:
                    here, place = Index(part.slice(0, 1).to_pylist(), n_shards), (shard[start], copy[start])
                elif place == (shard[start], copy[start]):  # a shard without repeated lines has no arrays
                    pairs = np.stack([part.column(c).to_numpy(zero_copy_only=False) for c in ("h1", "h2")], axis=1).astype(np.int64).view(np.uint64)
                    found, keeper = here.keepers(pairs)
                    lost = np.flatnonzero(found & (part.column("doc").to_numpy(zero_copy_only=False) < keeper))
                    yield part.select(["doc", "tag", "h2"]).take(pa.array(lost))

    return met.mapInArrow(answer, "doc long, tag long, h2 long")


def repeated_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """h1, h2, number of documents and keeper of every line in at least ``min_docs`` documents."""
    counted = line_hashes(docs, min_chars).groupBy("h1", "h2").agg(F.count("*").alias("n"), F.max("doc_id").alias("keeper"))
    return durable(counted.filter(F.col("n") >= min_docs).withColumn("keeper", F.coalesce("keeper", F.lit(NOBODY))))


def _shard(rows: pd.DataFrame) -> pd.DataFrame:
    pairs = rows[["h1", "h2"]].to_numpy(np.int64).view(np.uint64)
    perfect = PerfectHash.build(pairs)
    slot = perfect.slots(pairs)
    prints, counts, keepers = np.empty(len(rows), np.uint64), np.empty(len(rows), np.uint32), np.empty(len(rows), np.int64)
    prints[slot] = pairs[:, 1]
    counts[slot] = np.minimum(rows["n"].to_numpy(), (1 << 32) - 1)
    keepers[slot] = rows["keeper"].to_numpy()
    bits = np.concatenate(perfect.bits) if perfect.bits else np.empty(0, np.uint64)
    one = [int(rows["shard"].iloc[0]), perfect.sizes, *(x.tobytes() for x in (bits, perfect.rest, prints, counts, keepers))]
    return pd.DataFrame([one], columns=["shard", "sizes", "bits", "rest", "fingerprints", "counts", "keepers"])


def build_index(lines: DataFrame, shard_lines: int = SHARD_LINES) -> tuple[DataFrame, int]:
    """One row of arrays for every shard, and the number of shards."""
    n_shards = max(1, -(-lines.count() // shard_lines))
    schema = "shard long, sizes array<long>, bits binary, rest binary, fingerprints binary, counts binary, keepers binary"
    return durable(lines.withColumn("shard", F.pmod("h1", F.lit(n_shards)).cast("long")).groupBy("shard").applyInPandas(_shard, schema)), n_shards


def _rewrite(batch: pa.RecordBatch, drop: Callable[[np.ndarray, np.ndarray], np.ndarray], min_chars: int) -> tuple:
    """New texts, lines and dropped lines of a batch. ``drop`` is asked about all its counted lines at once."""
    kept_lines, per_line, at, where = [], [], [], []
    data = arrow.raw(batch.column("text"))
    for i, text in enumerate(data):
        for j, key in enumerate(line_keys(text, min_chars)):
            if key is not None:
                per_line.append(key)
                at.append(i)
                where.append(j)
    rows = np.array(at, dtype=np.int64)
    lost = drop(rows, hashes(per_line)) if per_line else np.zeros(0, dtype=bool)
    gone: dict[int, set[int]] = {}
    for k in np.flatnonzero(lost):
        gone.setdefault(at[k], set()).add(where[k])
    n_lines, n_dropped = [], []
    for i, text in enumerate(data):
        n_lines.append(text.count(b"\n") + 1)
        out = gone.get(i)
        n_dropped.append(len(out) if out else 0)
        if out:
            text = b"\n".join(x for j, x in enumerate(text.split(b"\n")) if j not in out)
        kept_lines.append(text.decode())
    nulls = batch.column("text").is_null().to_pylist()
    return [None if z else x for x, z in zip(kept_lines, nulls, strict=True)], n_lines, n_dropped


def _free(name: str, taken: list[str]) -> str:
    """A column name that is not taken."""
    while name.lower() in {c.lower() for c in taken}:
        name = f"_{name}"
    return name


def dedup(
    docs: DataFrame,
    min_chars: int = MIN_CHARS,
    min_docs: int = MIN_DOCS,
    broadcast_bytes: int = BROADCAST_BYTES,
    counts: tuple[str, str] | None = None,
) -> DataFrame:
    """The documents without their repeated lines, all other columns as they are.

    ``counts`` names two columns to add: lines before, and lines dropped, with underscores in front where the documents have them.
    """
    lines = repeated_lines(docs, min_chars, min_docs)
    index, n_shards = build_index(lines)
    size = index.agg(F.sum(sum(F.length(c) for c in ("bits", "rest", "fingerprints", "keepers")))).first()[0] or 0
    added = [T.StructField(_free(c, docs.columns), T.LongType()) for c in counts or ()]
    schema = T.StructType([*(T.StructField("text", T.StringType()) if f.name == "text" else f for f in docs.schema), *added])
    own_columns, all_columns, spread, lists = docs.columns, schema.names, docs, ""
    if size <= broadcast_bytes:
        shards = docs.sparkSession.sparkContext.broadcast([r.asDict() for r in index.drop("counts").collect()])
    else:
        shards = None
        doc, tag, lists = (_free(c, docs.columns) for c in ("doc", "tag", "lost"))
        lost = shard_probes(docs, index, n_shards, min_chars).groupBy("doc", "tag").agg(F.collect_set("h2").alias(lists))
        lost = lost.select(F.col("doc").alias(doc), F.col("tag").alias(tag), lists)
        own = (F.coalesce(docs["doc_id"].cast("long"), F.lit(NOBODY)) == lost[doc]) & (F.xxhash64(docs["text"].cast("string")) == lost[tag])
        spread = docs.join(lost, own, "left").drop(doc, tag)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(shards.value, n_shards) if shards is not None else None
        for whole in batches:
            for batch in arrow.slices(whole, "text"):
                ids = batch.column("doc_id").cast(pa.int64()).fill_null(NOBODY).to_numpy(zero_copy_only=False)

                def drop(rows: np.ndarray, pairs: np.ndarray) -> np.ndarray:
                    if index is not None:
                        found, keeper = index.keepers(pairs)
                        return found & (keeper != ids[rows])
                    own = [set(x or ()) for x in batch.column(lists).to_pylist()]
                    return np.array([h in own[r] for r, h in zip(rows, pairs[:, 1].view(np.int64).tolist(), strict=True)], dtype=bool)

                text, n_lines, n_dropped = _rewrite(batch, drop, min_chars)
                columns = [pa.array(text, pa.string()) if c == "text" else batch.column(c) for c in own_columns]
                columns += [pa.array(x, pa.int64()) for x in (n_lines, n_dropped)][: 2 * bool(counts)]
                yield pa.RecordBatch.from_arrays(columns, names=all_columns)

    return spread.mapInArrow(run, schema)

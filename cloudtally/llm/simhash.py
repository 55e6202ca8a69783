"""Near-duplicates by SimHash, compared bit by bit.

Fingerprints that share a key form a group. A group's fingerprints are stored as bit planes: the same
bit of 64 fingerprints in one machine word. Distances of a fingerprint to 64 others grow together in
carry-save counters, one plane at a time, and a block of 64 is abandoned as soon as all of its
distances exceed the radius. Links inside a group leave the task as a forest (a row per fingerprint
at most, never all pairs), and the links of all groups meet in connected components.

``exact_links`` finds every pair within a small radius: of ``radius + 2`` blocks of bits two must be
equal, so groups share two blocks. A group too large to compare at once is divided by two more
blocks of the remaining bits, which is as exact and bounds a group by 2**16 distinct fingerprints.

``near_classes`` joins documents whose shingle sets are alike. Groups share the smallest hashes of the
sets; wide fingerprints propose pairs, by a radius that no pair at the limit is likely to exceed, and
the exact Jaccard similarity of the two sets decides. The first two bands compare chunks of their
groups; the components found there are not compared again when all bands compare what is left.

Texts lower A-Z only and words end at ASCII white space. Null and empty texts have fingerprint zero,
linked like any other. Repeated rows are linked like copies. No text is cut.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cloudtally.llm import arrow
from cloudtally.llm.components import components
from cloudtally.runtime import durable

SEED, WIDTH = 42, 64
AT_ONCE = 1 << 15  # shingles whose bits are counted together
GROUP_ROWS = 8_192  # larger groups are divided
PAIR_GROUP = 48  # in groups up to this size every pair is a lane of its own
TILE = 64  # fingerprints compared with all others of a group at a time
BANDS, BAND_ROWS = 20, 3  # a pair at a similarity of 0.8 shares no band once in 1.7 million
FIRST_BANDS = 2  # of chunks by themselves; mixed differently in each, so that a large group grows together
GROUP_SHINGLES = 2 << 20  # in a chunk
SIGMAS = 6.5  # of the distance, by which the radius lies beyond the widest mean
SET_SLICE = 2 << 20  # text whose shingle sets a task makes at once
BROADCAST_BYTES = 64 << 20  # of ids to drop that go to all tasks; more are joined


# --- fingerprints -----------------------------------------------------------------------------


def shingles(data: bytes, k: int) -> list[bytes]:
    """Runs of ``k`` words joined by one space; all words where there are fewer."""
    words = data.lower().split()
    if len(words) <= k:
        return [b" ".join(words)] if words else []
    line = b" ".join(words)
    sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    ends = starts + sizes - 1
    return [line[a:b] for a, b in zip(starts[: len(words) - k + 1].tolist(), ends[k - 1 :].tolist(), strict=True)]


def shingle_hashes(data: bytes, k: int) -> np.ndarray:
    """XXH64 of every shingle, as rows of 8 bytes with the highest first."""
    digest = xxhash.xxh64_digest
    return np.frombuffer(b"".join([digest(s, SEED) for s in shingles(data, k)]), dtype=np.uint8).reshape(-1, 8)


def majority(rows: np.ndarray) -> np.ndarray:
    """The bits set in over half of the rows of bytes, as bytes."""
    n = len(rows)
    votes = np.zeros(8 * rows.shape[1], dtype=np.int64)
    for at in range(0, n, AT_ONCE):
        votes += np.unpackbits(rows[at : at + AT_ONCE], axis=1).sum(axis=0, dtype=np.int64)
    return np.packbits(2 * votes > n)


def fingerprints(docs: DataFrame, k: int = 3) -> DataFrame:
    """doc_id and the 64-bit fingerprint (a long) of every row."""

    def make() -> Callable[[pa.RecordBatch], pa.RecordBatch]:
        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            made = [majority(shingle_hashes(t, k)).tobytes() for t in arrow.raw(batch.column("text"))]
            prints = np.frombuffer(b"".join(made), dtype=">i8").astype(np.int64)
            return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(prints)], ["doc_id", "fp"])

        return work

    return arrow.per_slice(arrow.texts(docs), "doc_id long, fp long", make, "text")


# --- comparison -------------------------------------------------------------------------------


def planes(prints: np.ndarray) -> np.ndarray:
    """Bit planes of fingerprints (rows of words): plane b holds bit b of 64 fingerprints in each word."""
    n, words = prints.shape
    bits = np.unpackbits(prints.view(np.uint8).reshape(n, 8 * words), axis=1, bitorder="little")
    padded = np.zeros((64 * words, -(-n // 64) * 64), dtype=np.uint8)
    padded[:, :n] = bits.T
    return np.packbits(padded, axis=1, bitorder="little").view(np.uint64)


class Counters:
    """Carry-save counters of 64 lanes in each word, and which lanes have passed the radius."""

    def __init__(self, cells: int, radius: int) -> None:
        self.radius = radius
        self.bits = np.zeros((radius.bit_length(), cells), dtype=np.uint64)
        self.over = np.zeros(cells, dtype=np.uint64)

    def add(self, carry: np.ndarray) -> None:
        for row in self.bits:
            carry, row[:] = row & carry, row ^ carry
        self.over |= carry

    def passed(self) -> np.ndarray:
        """Lanes whose count exceeds the radius."""
        more, same = np.zeros_like(self.over), ~np.zeros_like(self.over)
        for k in range(len(self.bits) - 1, -1, -1):
            if self.radius >> k & 1:
                same = same & self.bits[k]
            else:
                more |= same & self.bits[k]
                same = same & ~self.bits[k]
        return self.over | more

    def keep(self, cells: np.ndarray) -> None:
        self.bits, self.over = self.bits[:, cells], self.over[cells]


def lanes_within(rows: np.ndarray, which: Callable[[int, np.ndarray], np.ndarray], cells: int, radius: int, every: int = 8) -> tuple[np.ndarray, np.ndarray]:
    """Cells and their lanes (as bits) whose distance is at most ``radius``.

    ``which(b, cells)`` gives the differing bits of plane b. Cells whose lanes have all passed the
    radius are left out of the remaining planes.
    """
    counters, open_ = Counters(cells, radius), np.arange(cells)
    for n, b in enumerate(rows, 1):
        counters.add(which(b, open_))
        if n > radius and n % every == 0:
            alive = np.flatnonzero(~counters.passed())
            if len(alive) < len(open_):
                counters.keep(alive)
                open_ = open_[alive]
                if not len(open_):
                    break
    return open_, ~counters.passed()


def _lanes(words: np.ndarray) -> np.ndarray:
    return np.unpackbits(words.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(bool)


def pairs_within(a: np.ndarray, b: np.ndarray, radius: int) -> np.ndarray:
    """Numbers of the given pairs of fingerprints whose distance is at most ``radius``; each is a lane."""
    if not len(a):
        return np.empty(0, dtype=np.int64)
    diff = planes(a ^ b)
    cells, lanes = lanes_within(np.arange(len(diff)), lambda p, c: diff[p, c], diff.shape[1], radius)
    row, lane = np.nonzero(_lanes(lanes))
    found = cells[row] * 64 + lane
    return found[found < len(a)]


def tile_within(all_planes: np.ndarray, query: np.ndarray, radius: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (query, member) within the radius, of a few queries against a whole group."""
    width = all_planes.shape[1]
    asked = np.unpackbits(query.view(np.uint8).reshape(len(query), -1), axis=1, bitorder="little").astype(np.uint64)
    masks = np.uint64(0) - asked  # all ones where the query has the bit
    cells, lanes = lanes_within(
        np.arange(len(all_planes)), lambda p, c: all_planes[p, c % width] ^ masks[c // width, p], len(query) * width, radius
    )
    row, lane = np.nonzero(_lanes(lanes))
    member = (cells[row] % width) * 64 + lane
    inside = member < n
    return (cells[row] // width)[inside], member[inside]


class Forest:
    """Components of numbered items, each under its smallest."""

    def __init__(self, n: int) -> None:
        self.parent = np.arange(n)

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            x, y = self.parent[a], self.parent[b]
            apart = x != y
            a, b, x, y = a[apart], b[apart], x[apart], y[apart]
            np.minimum.at(self.parent, np.maximum(x, y), np.minimum(x, y))
            while not np.array_equal(up := self.parent[self.parent], self.parent):
                self.parent = up


Check = Callable[[np.ndarray, np.ndarray], np.ndarray]


def link_groups(prints: np.ndarray, group: np.ndarray, radius: int, check: Check | None = None) -> np.ndarray:
    """Parent of every fingerprint after joining those within the radius in the same group.

    ``group`` is sorted. ``check`` says which of the pairs found count; it is given one fingerprint and
    others at a time, without those that are joined already.
    """
    forest = Forest(len(prints))

    def join(i: np.ndarray, j: np.ndarray) -> None:
        if check is None:
            forest.join(i, j)
            return
        for part in np.split(np.arange(len(i)), np.flatnonzero(np.diff(i)) + 1):
            part = part[forest.parent[i[part]] != forest.parent[j[part]]]
            if len(part):
                part = part[check(i[part], j[part])]
                forest.join(i[part], j[part])

    edges = np.concatenate([[0], np.flatnonzero(np.diff(group)) + 1, [len(group)]])
    starts, sizes = edges[:-1], np.diff(edges)
    for size in np.unique(sizes[(sizes > 1) & (sizes <= PAIR_GROUP)]):
        first = starts[sizes == size]
        a, b = np.triu_indices(size, 1)
        for part in np.array_split(first, -(-len(first) * len(a) // 65_536)):
            i, j = (part[:, None] + a).ravel(), (part[:, None] + b).ravel()
            near = pairs_within(prints[i], prints[j], radius)
            join(i[near], j[near])
    for start, size in zip(starts[sizes > PAIR_GROUP], sizes[sizes > PAIR_GROUP], strict=True):
        own = prints[start : start + size]
        stored = planes(own)
        for at in range(0, size, TILE):
            i, j = tile_within(stored, own[at : at + TILE], radius, size)
            later = i + at < j
            join(i[later] + at + start, j[later] + start)
    return forest.parent


def _grouped(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Whole groups of rows that come sorted by ``keys``, many small ones together."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        rows = pa.Table.from_batches(held)
        number = _numbers(rows, keys)
        cut = int(np.searchsorted(number, number[-1]))
        if cut:
            yield rows.slice(0, cut), number[:cut]
            held = rows.slice(cut).combine_chunks().to_batches()
    if held:
        rows = pa.Table.from_batches(held)
        yield rows, _numbers(rows, keys)


def _numbers(rows: pa.Table, keys: list[str]) -> np.ndarray:
    new = np.zeros(len(rows), dtype=bool)
    for k in keys:
        values = rows.column(k).to_numpy()
        new[1:] |= values[1:] != values[:-1]
    return np.cumsum(new)


# --- all pairs within a small radius ----------------------------------------------------------


def block_masks(bits: list[int], radius: int) -> list[int]:
    """Masks of two of ``radius + 2`` blocks of the given bits: within the radius some two blocks agree."""
    blocks = np.array_split(np.array(bits), radius + 2)
    return [sum(1 << int(b) for blk in two for b in blk) for two in combinations(blocks, 2)]


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def exact_links(prints: DataFrame, radius: int = 2, group_rows: int = GROUP_ROWS) -> DataFrame:
    """Links (a, b) that join all fingerprints within ``radius`` bits, from distinct ones in column fp."""
    masks = block_masks(list(range(64)), radius)
    finer = [block_masks([b for b in range(64) if not m >> b & 1], radius) for m in masks]
    fp = F.col("fp")
    key = lambda t, m: F.struct(F.lit(t).alias("t"), fp.bitwiseAND(F.lit(_signed(m))).alias("key"))
    keyed = prints.select("fp", F.explode(F.array(*[key(t, m) for t, m in enumerate(masks)])).alias("k")).select("fp", "k.*")
    sizes = keyed.groupBy("t", "key").agg(F.count("*").alias("n")).filter("n > 1")
    met = keyed.join(sizes, ["t", "key"])
    parts: Column = F.array(F.struct(F.lit(-1).alias("sub"), F.lit(0).cast("long").alias("more")))
    for t, inner in enumerate(finer):
        cut = F.array(*[F.struct(F.lit(s).alias("sub"), fp.bitwiseAND(F.lit(_signed(m))).alias("more")) for s, m in enumerate(inner)])
        parts = F.when((F.col("t") == t) & (F.col("n") > group_rows), cut).otherwise(parts)
    names = ["t", "key", "sub", "more"]
    rows = met.select("fp", "t", "key", F.explode(parts).alias("p")).select("fp", "t", "key", "p.*")
    rows = rows.repartition(*names).sortWithinPartitions(*names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, group in _grouped(batches, names):
            own = table.column("fp").to_numpy()
            parent = link_groups(np.ascontiguousarray(own).view(np.uint64).reshape(-1, 1), group, radius)
            moved = np.flatnonzero(parent != np.arange(len(own)))
            yield pa.RecordBatch.from_arrays([pa.array(own[moved]), pa.array(own[parent[moved]])], ["a", "b"])

    return rows.mapInArrow(run, "a long, b long")


def classes(docs: DataFrame, k: int = 3, radius: int = 2, group_rows: int = GROUP_ROWS) -> DataFrame:
    """doc_id, fp and component_id of every row: the smallest doc_id that links of at most ``radius`` bits reach.

    A null doc_id is ignored in the minimum; a component of such rows only has a null component_id.
    """
    prints = durable(fingerprints(docs, k))
    distinct = durable(prints.groupBy("fp").agg(F.min("doc_id").alias("first")))
    joined = components(exact_links(distinct, radius, group_rows))
    member = distinct.join(joined, distinct["fp"] == joined["node"], "left").select(
        "fp", "first", F.coalesce("component", "fp").alias("root")
    )
    low = member.groupBy("root").agg(F.min("first").alias("component_id"))
    named = member.join(low, "root").select("fp", "component_id")
    return prints.join(named, "fp", "left").select("doc_id", "fp", "component_id")


# --- similar shingle sets ---------------------------------------------------------------------


def _scatter(x: np.ndarray, k: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ np.uint64((k * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF)) * np.uint64(0xFF51AFD7ED558CCD)
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xC4CEB9FE1A85EC53)
        return x ^ (x >> np.uint64(29))


def shingle_set(data: bytes, k: int) -> np.ndarray:
    """The different shingles' hashes in order."""
    return np.unique(shingle_hashes(data, k).view(">u8").astype(np.uint64).ravel())


def wide_print(hashed: np.ndarray, words: int) -> np.ndarray:
    """A fingerprint of 64 * ``words`` bits of a shingle set."""
    if not len(hashed):
        return np.zeros(words, dtype=np.uint64)
    return np.concatenate([majority(_scatter(hashed, w).view(np.uint8).reshape(-1, 8)) for w in range(words)]).view(np.uint64)


def band_keys(hashed: np.ndarray, odd: np.ndarray) -> np.ndarray:
    """A key of the smallest hashes for each band."""
    low = np.full(len(odd), np.iinfo(np.uint64).max, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for at in range(0, len(hashed), 4096):
            low = np.minimum(low, (hashed[at : at + 4096, None] * odd).min(axis=0))
    keys = [xxhash.xxh64_intdigest(low[b * BAND_ROWS : (b + 1) * BAND_ROWS].tobytes(), b) for b in range(BANDS)]
    return np.array(keys, dtype=np.uint64).view(np.int64)


def sketches(docs: DataFrame, k: int) -> DataFrame:
    """doc_id, number of shingles, a digest of the shingle set and band keys of every row."""

    def make() -> Callable[[pa.RecordBatch], pa.RecordBatch]:
        odd = np.random.default_rng(SEED).integers(0, 1 << 63, BANDS * BAND_ROWS).astype(np.uint64) * np.uint64(2) + np.uint64(1)

        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            made = [shingle_set(t, k) for t in arrow.raw(batch.column("text"))]
            return pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array([len(m) for m in made], pa.int64()),
                    pa.array([xxhash.xxh3_128_digest(m.tobytes()) for m in made], pa.binary()),
                    pa.array([band_keys(m, odd) for m in made], pa.list_(pa.int64())),
                ],
                ["doc_id", "size", "same", "keys"],
            )

        return work

    return arrow.per_slice(arrow.texts(docs), "doc_id long, size long, same binary, keys array<long>", make, "text", SET_SLICE)


def shingle_sets(docs: DataFrame, k: int, words: int) -> DataFrame:
    """id (doc_id), the digest, the fingerprint and the hashes of every row's shingle set."""

    def make() -> Callable[[pa.RecordBatch], pa.RecordBatch]:
        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            made = [shingle_set(t, k) for t in arrow.raw(batch.column("text"))]
            return pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array([xxhash.xxh3_128_digest(m.tobytes()) for m in made], pa.binary()),
                    pa.array([wide_print(m, words).tobytes() for m in made], pa.binary()),
                    pa.array([m.tobytes() for m in made], pa.binary()),
                ],
                ["id", "same", "fp", "hashes"],
            )

        return work

    return arrow.per_slice(arrow.texts(docs), "id long, same binary, fp binary, hashes binary", make, "text", SET_SLICE)


def _chances(n: int) -> np.ndarray:
    """Chances of 0 to n heads in n throws."""
    return np.array([math.comb(n, h) / 2**n for h in range(n + 1)])


@lru_cache
def widest(similarity: float, shared: int = 60) -> float:
    """The largest chance that a bit differs in the fingerprints of two sets of at least that similarity.

    All sets of up to ``shared`` common shingles are gone through, with the ties of even sets; of larger
    sets it is near the angle between two equally large ones.
    """
    worst = math.acos(2 * similarity / (1 + similarity)) / math.pi
    for c in range(1, shared + 1):
        common, heads = _chances(c), np.arange(c + 1)
        own = math.floor(c / similarity + 1e-9) - c
        # chance of a set bit, by the heads among the common shingles
        over = [((2 * (heads[:, None] + np.arange(x + 1)) > c + x) * _chances(x)).sum(axis=1) for x in range(own + 1)]
        for x in range(own + 1):
            for y in range(x, own - x + 1):
                worst = max(worst, float((common * (over[x] + over[y] - 2 * over[x] * over[y])).sum()))
    return worst


def wide_radius(similarity: float, bits: int) -> int:
    """A distance that fingerprints of sets of at least that similarity do not exceed but by SIGMAS errors."""
    p = widest(similarity)
    return min(bits - 1, math.ceil(bits * p + SIGMAS * math.sqrt(bits * p * (1 - p))))


def overlaps(hashes: list[bytes], similarity: float) -> Check:
    """A check of one set (i is the same in all pairs) against others by their exact Jaccard similarity."""
    size = np.array([len(h) // 8 for h in hashes])
    ends = np.cumsum(size)
    different, number = np.unique(np.frombuffer(b"".join(hashes), dtype=np.uint64), return_inverse=True)
    mark = np.zeros(len(different), dtype=bool)

    def check(i: np.ndarray, j: np.ndarray) -> np.ndarray:
        own, found = number[ends[i[0]] - size[i[0]] : ends[i[0]]], np.zeros(len(j), dtype=bool)
        mark[own] = True
        few, many = np.minimum(size[i], size[j]), np.maximum(size[i], size[j])
        for at in np.flatnonzero(few / np.maximum(many, 1) >= similarity):
            x = j[at]
            both = np.count_nonzero(mark[number[ends[x] - size[x] : ends[x]]])
            found[at] = both / max(len(own) + size[x] - both, 1) >= similarity
        mark[own] = False
        return found

    return check


TILE_KEYS = ["band", "key", "lo", "hi"]


def near_links(rows: DataFrame, sets: DataFrame, words: int, similarity: float) -> DataFrame:
    """Links (a, b) of similar sets in the same tile, but not inside a known component or, of two chunks, inside one.

    ``rows`` has id, same, the tile (band, key, lo, hi), the chunk (part) and the component (known).
    """
    radius = wide_radius(similarity, 64 * words)
    rows = rows.join(sets, ["id", "same"]).repartition(*TILE_KEYS).sortWithinPartitions(*TILE_KEYS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, group in _grouped(batches, TILE_KEYS):
            ids, part, known = (table.column(c).to_numpy() for c in ("id", "part", "known"))
            whole = table.column("lo").to_numpy() == table.column("hi").to_numpy()
            prints = np.frombuffer(b"".join(table.column("fp").to_pylist()), dtype=np.uint64).reshape(-1, words)
            exact = overlaps(table.column("hashes").to_pylist(), similarity)

            def check(i: np.ndarray, j: np.ndarray) -> np.ndarray:
                good = (known[i] != known[j]) & (whole[i] | (part[i] != part[j]))
                if good.any():
                    good[good] = exact(i[good], j[good])
                return good

            parent = link_groups(prints, group, radius, check)
            moved = np.flatnonzero(parent != np.arange(len(ids)))
            yield pa.RecordBatch.from_arrays([pa.array(ids[moved]), pa.array(ids[parent[moved]])], ["a", "b"])

    return rows.mapInArrow(run, "a long, b long")


def _chunks(n: Column, size: Column, group_rows: int) -> Column:
    return F.greatest(F.ceil(n / group_rows), F.ceil(size / GROUP_SHINGLES)).cast("int")


def own_tiles(met: DataFrame, group_rows: int) -> DataFrame:
    """Rows of the first bands in the tile of their own chunk only."""
    part = F.pmod(F.xxhash64("id", "band"), _chunks(F.col("n"), F.col("total"), group_rows)).cast("int")
    cut = met.filter(F.col("band") < FIRST_BANDS).withColumn("part", part)
    return cut.select("id", "same", "band", "key", F.col("part").alias("lo"), F.col("part").alias("hi"), "part", F.col("id").alias("known"))


def open_tiles(met: DataFrame, group_rows: int) -> DataFrame:
    """Rows of groups of several components, in the tiles of every two chunks that may hold a link.

    Chunks of the component with the most rows are not compared with each other.
    """
    each = met.groupBy("band", "key", "known").agg(F.count("*").alias("n"), F.sum("size").alias("total"))
    top = F.max(F.struct("n", "known", "total")).alias("top")
    groups = each.groupBy("band", "key").agg(F.sum("n").alias("n"), F.sum("total").alias("total"), F.count("*").alias("parts"), top)
    n, total, largest = F.col("n"), F.col("total"), F.col("top")
    groups = groups.filter("parts > 1").select(
        "band",
        "key",
        (_chunks(n, total, group_rows) <= 1).alias("small"),
        F.greatest(_chunks(largest["n"], largest["total"], group_rows), F.lit(1)).alias("inner"),
        F.greatest(_chunks(n - largest["n"], total - largest["total"], group_rows), F.lit(1)).alias("outer"),
        largest["known"].alias("main"),
    )
    inner, outer = F.col("inner"), F.col("outer")
    is_main, mixed = F.col("known") == F.col("main"), F.xxhash64("id")
    part = F.when(F.col("small"), 0).when(is_main, F.pmod(mixed, inner)).otherwise(inner + F.pmod(mixed, outer)).cast("int")
    first, last = F.when(is_main & ~F.col("small"), inner).otherwise(0), F.when(F.col("small"), 0).otherwise(inner + outer - 1)
    mine = F.col("part")
    tiles = F.transform(F.sequence(first, last), lambda c: F.struct(F.least(c, mine).alias("lo"), F.greatest(c, mine).alias("hi")))
    cut = met.select("id", "same", "band", "key", "known").join(groups, ["band", "key"]).withColumn("part", part)
    return cut.select("id", "same", "band", "key", "part", "known", F.explode(tiles).alias("t")).select("id", "same", "band", "key", "t.*", "part", "known")


def near_classes(docs: DataFrame, k: int = 5, similarity: float = 0.8, words: int = 8, group_rows: int = GROUP_ROWS) -> DataFrame:
    """doc_id and component_id (smallest doc_id of its group) of every row with a doc_id.

    Links are documents whose shingle sets have a Jaccard similarity of at least ``similarity``.
    """
    docs = docs.filter(F.col("doc_id").isNotNull())
    made = durable(sketches(docs, k))
    kept = durable(made.groupBy("size", "same").agg(F.min("doc_id").alias("id"), F.first("keys").alias("keys")))
    keyed = kept.select("id", "same", "size", F.posexplode("keys").alias("band", "key"))
    sizes = keyed.groupBy("band", "key").agg(F.count("*").alias("n"), F.sum("size").alias("total")).filter("n > 1")
    met = durable(keyed.join(sizes, ["band", "key"]))
    ids = durable(met.select(F.col("id").alias("doc_id")).distinct())
    small = 8 * ids.count() <= BROADCAST_BYTES
    texts = arrow.texts(docs).join(F.broadcast(ids) if small else ids, "doc_id", "left_semi")
    sets = durable(shingle_sets(texts, k, words))
    links = durable(near_links(own_tiles(met, group_rows), sets, words, similarity))
    first = components(links)
    known = durable(met.drop("n", "total").join(first, met["id"] == first["node"], "left").select("id", "same", "size", "band", "key", F.coalesce("component", "id").alias("known")))
    joined = components(links.union(near_links(open_tiles(known, group_rows), sets, words, similarity)))
    root = kept.join(joined, kept["id"] == joined["node"], "left").select("size", "same", F.coalesce("component", "id").alias("component_id"))
    return made.join(root, ["size", "same"]).select("doc_id", "component_id")


def keep_one(docs: DataFrame, k: int = 5, similarity: float = 0.8, **more) -> DataFrame:
    """The documents, as they are, without all but the one with the smallest doc_id of each group.

    Rows without a doc_id stay; of rows that repeat a doc_id that stays one is kept.
    """
    found = near_classes(docs, k, similarity, **more)
    ids = durable(found.groupBy("doc_id").agg(F.min("component_id").alias("_low"), F.count("*").alias("_n")))
    # only what goes is told: a small part of the ids, which texts need not be shuffled for while it is small
    gone = durable(ids.filter("doc_id <> _low").select("doc_id"))
    small = 8 * gone.count() <= BROADCAST_BYTES
    kept = docs.join(F.broadcast(gone) if small else gone, "doc_id", "left_anti").select(*docs.columns)
    if ids.filter("_n > 1").isEmpty():
        return kept
    return kept.filter(F.col("doc_id").isNotNull()).dropDuplicates(["doc_id"]).union(kept.filter(F.col("doc_id").isNull()))

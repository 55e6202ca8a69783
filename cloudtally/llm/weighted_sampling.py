"""Document fingerprints by consistent weighted sampling.

A text's terms are its runs of ``k`` words, weighted by how often they occur. For each of ``samples`` draws
every term has numbers of its own, made from its hash: r and c from the Gamma(2, 1) distribution
and b uniform. With weight w the term stands at level t = floor(ln w / r + b), and the smallest
ln c - r (t - b + 1) wins the draw; the fingerprint holds 16 bits of each winner's term and level.
Two texts agree in a draw with a probability that equals their generalised Jaccard similarity, the sum of the smaller
weights over that of the larger ones.

The gamma numbers come from tables of quantiles in single precision, and all that follows adds and multiplies:
every machine gives equal texts equal fingerprints.

``edited`` also compares each document with the next smaller doc_id. Rows are dealt by quantiles of the doc_id, so
texts are shuffled once and neighbours meet in order; each part is also given the one text that follows its
smallest doc_id. Rows of one doc_id share the next document; it is read from the least text of its rows. A doc_id
of many rows fills several parts of its own. A null doc_id counts as the smallest number.

Words end at ASCII white space. Fewer than ``k`` words are one term, none give a fingerprint of zeros, which is
like itself and nothing else. Null texts count as empty; a document that is alone follows itself. Any length is
hashed whole. Only ``doc_id`` and ``text`` are read, so other columns cannot clash.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cloudtally.llm import arrow

WORDS, SAMPLES = 2, 64
SLICE = 1 << 20
LEAST = -(1 << 63)
M1, M2, M3 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93))
FINE = 11  # bits behind the leading one that choose a quantile of c


def gamma_quantile(p: np.ndarray) -> np.ndarray:
    """x with 1 - exp(-x) (1 + x) = p, by Newton steps on ln x."""
    x = np.where(p < 0.5, np.sqrt(2 * p), 1 - np.log1p(-p))
    for _ in range(40):
        # 1 - exp(-x)(1 + x) without cancellation where x is small
        have = np.where(x < 1e-3, x * x / 2 - x**3 / 3, -np.expm1(-x) - x * np.exp(-x))
        x = x * np.exp(np.clip((p - have) / (x * x * np.exp(-x)), -1, 1))
    return x


@lru_cache(maxsize=1)
def tables() -> tuple[np.ndarray, np.ndarray]:
    """Quantiles of r by 16 bits, and of ln c by the leading one of 32 bits and the bits behind it."""
    r = gamma_quantile((np.arange(1 << 16) + 0.5) / (1 << 16))
    power, rest = np.divmod(np.arange(33 << FINE), 1 << FINE)
    c = gamma_quantile(np.minimum((1 + (rest + 0.5) / (1 << FINE)) * 2.0**power / 2.0**32, 1 - 2.0**-33))
    return r.astype(np.float32), np.log(c).astype(np.float32)


def _scramble(x: np.ndarray, seed: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ np.uint64(seed * 0xA24BAED4963EE407 & 0xFFFFFFFFFFFFFFFF)) * M1
        x ^= x >> np.uint64(32)
        x *= M2
        x ^= x >> np.uint64(29)
    return x


def terms(texts: list[bytes], k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash and weight of the distinct terms of every text, and how many each text has."""
    words = [t.split() for t in texts]
    sizes = np.array([len(w) for w in words], dtype=np.int64)
    one = np.frombuffer(b"".join(xxhash.xxh64_digest(w) for own in words for w in own), dtype="<u8")
    n_terms = np.where(sizes >= k, sizes - k + 1, np.minimum(sizes, 1))
    doc = np.repeat(np.arange(len(texts)), n_terms)
    first = np.repeat(np.cumsum(sizes) - sizes, n_terms) + np.arange(len(doc)) - np.repeat(np.cumsum(n_terms) - n_terms, n_terms)
    length = np.minimum(sizes, k)[doc]
    hashed = np.zeros(len(doc), dtype=np.uint64)
    for j in range(k):
        with np.errstate(over="ignore"):
            on = length > j
            hashed[on] = _scramble(hashed[on] * M3 + one[first[on] + j], j + 1)
    order = np.lexsort((hashed, doc))
    hashed, doc = hashed[order], doc[order]
    new = np.flatnonzero(np.concatenate([[True], (hashed[1:] != hashed[:-1]) | (doc[1:] != doc[:-1])])) if len(doc) else np.zeros(0, np.int64)
    return hashed[new], np.diff(np.append(new, len(doc))), np.bincount(doc[new], minlength=len(texts))


def draws(hashed: np.ndarray, weight: np.ndarray, sizes: np.ndarray, samples: int) -> np.ndarray:
    """A row of ``samples`` 16-bit numbers for every text of at least one term."""
    of_r, of_c = tables()
    out = np.zeros((len(sizes), samples), dtype=np.uint16)
    some = np.flatnonzero(sizes)
    if not len(some):
        return out
    starts, own = (np.cumsum(sizes) - sizes)[some], np.repeat(np.arange(len(some)), sizes[some])
    often = np.flatnonzero(weight > 1)
    log_w = np.log(weight[often]).astype(np.float32)
    for j in range(samples):
        bits = _scramble(hashed, j + 101)
        half, quarter = bits.view(np.uint32)[0::2], bits.view(np.uint16)
        r = of_r[quarter[3::4]]
        b = (quarter[2::4].astype(np.float32) + np.float32(0.5)) * np.float32(2.0**-16)
        place = (half.astype(np.float32).view(np.int32) >> (23 - FINE)) - (127 << FINE)
        ln_c = of_c[np.maximum(place, 0)]
        value = ln_c - r * (np.float32(1) - b)  # a weight of one stands at level 0
        level = np.floor(log_w / r[often] + b[often])
        value[often] = ln_c[often] - r[often] * (level - b[often] + np.float32(1))
        least = np.minimum.reduceat(value, starts)
        at = np.flatnonzero(value == least[own])
        winner = at[np.concatenate([[True], own[at][1:] != own[at][:-1]])]  # the first of equals, in order of hashes
        stood = np.zeros(len(hashed), dtype=np.uint64)
        stood[often] = level.astype(np.int64).view(np.uint64)
        out[some, j] = (_scramble(hashed[winner] + stood[winner], j + 50_001) >> np.uint64(48)).astype(np.uint16)
    return out


def signatures(texts: list[bytes], k: int = WORDS, samples: int = SAMPLES) -> np.ndarray:
    """The fingerprints of some texts as rows of 16-bit numbers."""
    hashed, weight, sizes = terms(texts, k)
    return draws(hashed, weight, sizes, samples)


def _shown(rows: np.ndarray) -> list[str]:
    return [r.tobytes().hex() for r in rows.astype(">u2")]


def likeness(a: Column, b: Column) -> Column:
    """The share of equal draws of two fingerprints."""
    n = F.length(a) / 4
    same = F.filter(F.sequence(F.lit(0), (n - 1).cast("int")), lambda i: F.substr(a, 4 * i + 1, F.lit(4)) == F.substr(b, 4 * i + 1, F.lit(4)))
    return F.size(same) / n


def fingerprints(docs: DataFrame, k: int = WORDS, samples: int = SAMPLES) -> DataFrame:
    """doc_id and fingerprint (four hexadecimal digits a draw) of every row."""

    def make() -> Callable[[pa.RecordBatch], pa.RecordBatch]:
        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            shown = _shown(signatures(arrow.raw(batch.column("text")), k, samples))
            return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(shown, pa.string())], ["doc_id", "fingerprint"])

        return work

    return arrow.per_slice(arrow.texts(docs), "doc_id long, fingerprint string", make, "text")


def _dealt(docs: DataFrame) -> DataFrame:
    """The rows by part, each part behind the document that follows its smallest one; columns part, guest, key, doc_id, text."""
    spark = docs.sparkSession
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    rows = arrow.texts(docs).withColumn("key", F.coalesce("doc_id", F.lit(LEAST))).withColumn("text", F.coalesce("text", F.lit("")))
    cuts = [F.lit(i / parts) for i in range(1, parts)]
    # a quantile sketch of a size that the number of parts sets, not the number of rows
    bounds = rows.agg(F.percentile_approx("key", F.array(*cuts), 20 * parts).alias("b")).first()["b"] if cuts else []
    sorted_bounds = np.array(bounds or [], dtype=np.int64)

    @F.pandas_udf("int")
    def part_of(key: pd.Series, row: pd.Series) -> pd.Series:
        low, high = (np.searchsorted(sorted_bounds, key.to_numpy(), side=s) for s in ("left", "right"))
        # a key that is several bounds at once has the parts between them to itself
        spread = np.where(high - low > 1, 1 + row.to_numpy() % np.maximum(high - low - 1, 1), 0)
        return pd.Series((low + spread).astype(np.int32))

    rows = rows.withColumn("part", part_of("key", F.monotonically_increasing_id()))
    ends = sorted((r["low"], r["high"], r["part"]) for r in rows.groupBy("part").agg(F.min("key").alias("low"), F.max("key").alias("high")).collect())
    highs = sorted(high for _, high, _ in ends)
    guests = []  # one for each part
    for low, _, part in ends:
        below = bisect_left(highs, low)
        guests.append((part, highs[below - 1] if below else highs[-1]))
    wanted = F.broadcast(spark.createDataFrame(guests, "part int, key long"))
    heads = rows.join(F.broadcast(wanted.select("key").distinct()), "key", "left_semi").groupBy("key").agg(F.min("text").alias("text"))
    lent = heads.join(wanted, "key").select("part", F.lit(True).alias("guest"), "key", F.lit(None).cast("long").alias("doc_id"), "text")
    own = rows.select("part", F.lit(False).alias("guest"), "key", "doc_id", "text")
    return own.union(lent).repartitionById(parts, "part").sortWithinPartitions("part", F.desc("guest"), "key", "text")


def edited(docs: DataFrame, k: int = WORDS, samples: int = SAMPLES) -> DataFrame:
    """Per row doc_id, n_chars, the SHA-256 of the edited text, the fingerprints of both texts, and the likeness of the text's
    fingerprint to that of the edited text and to that of the next document.

    The edited text has its last third replaced by the beginning of the next document, in descending order of
    doc_id and around from the last to the first.
    """
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, here, below = None, None, None  # part and key reached; text and draws of this key's head and of the one below
        for batch in batches:
            for part in arrow.slices(batch, "text", SLICE):
                rows = zip(*(part.column(c).to_pylist() for c in ("part", "key", "guest", "doc_id", "text")), strict=True)
                texts, told = [], []
                for at, key, guest, doc_id, text in rows:
                    if (at, key, guest) != place:
                        if place is None or at != place[0]:
                            here = None
                        place, below = (at, key, guest), here
                        here = (text, len(texts))  # its draws take the place of this number below
                    if guest:
                        texts.append(text)
                        continue
                    n = len(text)
                    changed = text[: n - n // 3] + below[0][: n // 3]
                    told.append((doc_id, n, hashlib.sha256(changed.encode()).hexdigest(), len(texts), below[1]))
                    texts += [text, changed]
                rows_of = signatures([t.encode() for t in texts], k, samples)
                own = np.array([x[3] for x in told], dtype=np.int64)
                # draws of the next document: of this slice, or kept from an earlier one
                later = np.array([rows_of[x[4]] if isinstance(x[4], int) else x[4] for x in told], dtype=np.uint16).reshape(-1, samples)
                first, second = rows_of[own], rows_of[own + 1]
                near = [(first == x).mean(axis=1) if len(own) else np.zeros(0) for x in (second, later)]
                head = lambda x: x and (x[0], rows_of[x[1]].copy() if isinstance(x[1], int) else x[1])
                here, below = head(here), head(below)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([x[0] for x in told], pa.int64()), pa.array([x[1] for x in told], pa.int64()), pa.array([x[2] for x in told], pa.string()),
                        pa.array(_shown(first), pa.string()), pa.array(_shown(second), pa.string()), *map(pa.array, near),
                    ],
                    names,
                )

    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return _dealt(docs).mapInArrow(run, schema)

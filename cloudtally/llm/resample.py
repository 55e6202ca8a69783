"""Importance resampling of documents toward a target text collection.

A document's features are its runs of one to ``longest`` words, hashed into buckets. Buckets that the target
uses more than the corpus have a positive gain; a document's weight is the mean gain of its features,
rounded down. Gumbel noise seeded by the doc_id is added, so taking the highest scores is a weighted draw
without replacement that comes out alike in every run.

Texts become words by Arrow kernels: lower case, split, flatten, dictionary. A run of words is a pair of
dictionary indices, the run before its last word and that word; the checksum of a distinct pair carries on
from that of its first part, and gains are taken by index and summed per document. A task keeps one count
per bucket; counts of all documents meet in as many rows as there are buckets. The ranks come from a
range partitioning of scores, numbered inside partitions and shifted by the rows before.

Null and empty texts have no features, weight 0 and too few words to be drawn. Every row is a document: rows
that repeat a doc_id are all counted and drawn apart, in any order among equal scores. A null doc_id is
hashed as an empty one and comes before all others of its score. An empty target leaves every count of it
at zero; an empty corpus gives no rows. Only ``doc_id`` and ``text`` are read, so other columns cannot clash.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cloudtally.llm import arrow
from cloudtally.runtime import durable

#: Fixed values of the weighting: what separates words after A-Z have become a-z.
BETWEEN_WORDS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
LONGEST, BUCKETS, SCALE = 2, 10_000, 1_000
MIN_WORDS, PERCENT, SEED = 20, 25, 7


class Features:
    """The features of some documents: bucket and document of each, and every document's number of words."""

    def __init__(self, texts: pa.Array, longest: int, buckets: int) -> None:
        lists = pc.split_pattern_regex(pc.ascii_lower(texts.fill_null("")), pattern=BETWEEN_WORDS)
        flat, doc = pc.list_flatten(lists), pc.list_parent_indices(lists)
        real = pc.not_equal(flat, "")
        coded = flat.filter(real).dictionary_encode()
        doc = doc.filter(real).to_numpy(zero_copy_only=False)
        words = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        spelled = coded.dictionary.cast(pa.binary()).to_pylist()
        self.n_words = np.bincount(doc, minlength=len(texts))
        sums = np.fromiter(map(zlib.crc32, spelled), np.uint32, len(spelled))
        found, docs = [sums[words] % buckets], [doc]
        runs = words  # for every word, the distinct run that ends in front of the next one
        for k in range(2, longest + 1):
            inside = doc[k - 1 :] == doc[: len(doc) - k + 1]
            pairs = pa.array(runs[: len(inside)] * len(spelled) + words[k - 1 :]).dictionary_encode()
            distinct = pairs.dictionary.to_numpy()
            spaced = np.fromiter(map(zlib.crc32, [b" "] * len(sums), sums.tolist()), np.uint32, len(sums))
            first, last = np.divmod(distinct, max(len(spelled), 1))
            sums = np.fromiter(map(zlib.crc32, map(spelled.__getitem__, last.tolist()), spaced[first].tolist()), np.uint32, len(distinct))
            runs = pairs.indices.to_numpy().astype(np.int64)
            found.append((sums[runs] % buckets)[inside])
            docs.append(doc[k - 1 :][inside])
        self.bucket = np.concatenate(found)
        self.doc = np.concatenate(docs)

    def weights(self, gains: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number of features and floored mean gain of every document."""
        n = np.bincount(self.doc, minlength=len(self.n_words))
        order = np.argsort(self.doc, kind="stable")
        taken = gains[self.bucket[order]]
        total = np.zeros(len(n), dtype=np.int64)
        some = np.flatnonzero(n)
        if len(some):
            total[some] = np.add.reduceat(taken, (np.cumsum(n) - n)[some])
        return n, total // np.maximum(n, 1)


def _features(batches: Iterator[pa.RecordBatch], longest: int, buckets: int) -> Iterator[tuple[pa.RecordBatch, Features]]:
    for batch in batches:
        for part in arrow.slices(batch, "text"):
            yield part, Features(part.column("text"), longest, buckets)


def bucket_counts(docs: DataFrame, longest: int = LONGEST, buckets: int = BUCKETS) -> DataFrame:
    """bucket and number of features in it, over all texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(buckets, dtype=np.int64)
        for _, own in _features(batches, longest, buckets):
            seen += np.bincount(own.bucket, minlength=buckets)
        at = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(seen[at])], ["bucket", "n"])

    texts = docs.select(F.col("text").cast("string").alias("text"))
    return texts.mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def _vector(counts: DataFrame, buckets: int) -> np.ndarray:
    """At most ``buckets`` rows, whatever the corpus."""
    told = counts.toArrow()
    out = np.zeros(buckets)
    out[told["bucket"].to_numpy()] = told["n"].to_numpy()
    return out


def bucket_gains(docs: DataFrame, target: DataFrame, longest: int = LONGEST, buckets: int = BUCKETS) -> np.ndarray:
    """The logarithm of how much more often the target uses each bucket, in thousandths, rounded down."""
    s, t = (_vector(bucket_counts(x, longest, buckets), buckets) for x in (docs, target))
    ratio = (t + 1) * (s.sum() + buckets) / ((s + 1) * (t.sum() + buckets))
    return np.floor(SCALE * np.log(ratio)).astype(np.int64)


def scores(docs: DataFrame, target: DataFrame, longest: int = LONGEST, buckets: int = BUCKETS, seed: int = SEED) -> DataFrame:
    """doc_id, n_words, n_features, weight and score (weight and noise) of every row."""
    gains = docs.sparkSession.sparkContext.broadcast(bucket_gains(docs, target, longest, buckets))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, own in _features(batches, longest, buckets):
            n, weight = own.weights(gains.value)
            columns = [part.column("doc_id"), *(pa.array(x.astype(np.int64)) for x in (own.n_words, n, weight))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_words", "n_features", "weight"])

    weighed = arrow.texts(docs).mapInArrow(run, "doc_id long, n_words long, n_features long, weight long")
    code = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(code, 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-SCALE * F.log(-F.log((h + 0.5) / 4294967296.0)))
    return weighed.withColumn("score", (F.col("weight") + noise).cast("long"))


def resample(
    docs: DataFrame,
    target: DataFrame,
    percent: int = PERCENT,
    min_words: int = MIN_WORDS,
    longest: int = LONGEST,
    buckets: int = BUCKETS,
    seed: int = SEED,
) -> DataFrame:
    """doc_id, n_features, weight, score and rank of every row; the rank is null where a row is not drawn.

    Of the rows with ``min_words`` words or more, ``percent`` in a hundred are drawn.
    """
    scored = durable(scores(docs, target, longest, buckets, seed))
    fits = F.col("n_words") >= min_words
    drawn = percent * scored.filter(fits).count() // 100
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # the row number keeps many rows of one id and score from meeting in one partition
    order = [fits.desc(), F.desc("score"), F.asc_nulls_first("doc_id"), F.asc("_row")]
    rows = scored.withColumn("_row", F.monotonically_increasing_id())
    sorted_ = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).drop("_row")
    # partition in the upper bits, place in the partition in the lower 33
    placed = durable(sorted_.withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftright("_at", 33)
    before, total = {}, 0
    for r in sorted(placed.groupBy(part.alias("part")).count().collect()):  # a row for each partition
        before[r["part"]], total = total, total + r["count"]
    if not before:
        return placed.select("doc_id", "n_features", "weight", "score", F.lit(None).cast("long").alias("rank"))
    shifts = F.array(*[F.lit(before.get(k, 0)).cast("long") for k in range(max(before) + 1)])
    rank = F.element_at(shifts, (part + 1).cast("int")) + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    return placed.select("doc_id", "n_features", "weight", "score", F.when(fits & (rank <= drawn), rank).alias("rank"))

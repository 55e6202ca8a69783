"""From raw documents to tokens in five stages, each a training-data operator over all that the last one kept.

A stage takes (spark, docs, sf_dir) and returns a DataFrame, which is stored before the next one reads it.
All but the last return the columns of ``docs``. Texts go to Python in Arrow batches of at most ``BATCH_BYTES``, or one
row: Spark's 10,000 rows of long texts would be in the executor, on their way and in the worker at the same time.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cloudtally.llm import bpe, decontaminate, line_index, simhash, toxicity
from cloudtally.runtime import durable


BATCH_BYTES = 4 << 20


def _in_small_batches(stage: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    """The stage, with the setting for its own jobs and for the one that stores its result."""

    @wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
        return stage(spark, docs, sf_dir)

    return run


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score is below one half."""
    return toxicity.accepted(docs, toxicity.fit(docs, _table(spark, sf_dir, "labels")))


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the lines that three or more documents share, except in the one that keeps them."""
    kept = line_index.dedup(docs)
    if "n_chars" in docs.columns:
        kept = kept.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return kept


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five-word shingles, a similarity of 0.8 or more."""
    return simhash.keep_one(docs, k=5, similarity=0.8)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    names = ("_leaked_item", "_leaked_score")
    while set(names) & set(docs.columns):
        names = tuple(f"_{n}" for n in names)
    found = decontaminate.score(docs, _table(spark, sf_dir, "benchmark"), names=names)
    return found.filter(F.col(names[1]) < decontaminate.LIMIT).drop(*names)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids, and digests of the ids and of the text decoded from them."""
    return bpe.digests(docs, public_tokenizers.path("byte_bpe_50k.json"), with_ids=True)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", _in_small_batches(reject_toxic)),
    ("line_dedup", _in_small_batches(drop_lines)),
    ("near_dedup", _in_small_batches(drop_near_copies)),
    ("decontaminate", _in_small_batches(drop_leaks)),
    ("bpe", _in_small_batches(tokenize)),
]

#: The classifier, fingerprints, alignments and tokens have no SQL form; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order over ``documents``."""
    docs = _table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = durable(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)

"""Joins and orderings that hold when one key owns a large share of the rows."""

from __future__ import annotations

from collections.abc import Sequence
from math import ceil, log

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cloudtally.runtime import durable

BROADCAST_ROWS = 200_000  # narrow rows of a few dozen bytes: some 20 MB at most
HOT_ROWS = 5_000_000
SALTS = 64  # parts that a key of HOT_ROWS rows is cut into; larger keys get more in proportion
CELL_ROWS = 1_000_000


def match_null_safe(left: DataFrame, right: DataFrame, on: Sequence[str]) -> Column:
    cond = F.lit(True)
    for c in on:
        cond = cond & left[c].eqNullSafe(right[c])
    return cond


def hot_keys(df: DataFrame, on: Sequence[str], min_rows: int = HOT_ROWS, salts: int = SALTS) -> DataFrame:
    """Keys of at least ``min_rows`` rows, with the number of parts each is cut into.

    There are at most rows / ``min_rows`` of them (200,000 in 10^12 rows), so they can be broadcast.
    """
    parts = F.ceil(F.col("count") / min_rows * salts).cast("int")
    return df.groupBy(*on).count().filter(F.col("count") >= min_rows).select(*on, parts.alias("_parts"))


def spread_join(
    big: DataFrame,
    other: DataFrame,
    on: Sequence[str],
    how: str = "inner",
    min_rows: int = HOT_ROWS,
    salts: int = SALTS,
) -> DataFrame:
    """Equi-join in which the rows of hot keys of ``big`` are spread over many tasks: ``salts`` for a
    key of ``min_rows`` rows, and more for larger ones.

    ``other`` is copied only for those keys. ``how`` may be inner, left, left_semi or left_anti.
    """
    on = list(on)
    big = durable(big)  # read for the counts and for the join
    hot = F.broadcast(hot_keys(big, on, min_rows, salts))
    plain = [c for c in big.columns if big.schema[c].dataType.typeName() not in ("map", "variant")]
    salted = big.join(hot, on, "left").withColumn(
        "_salt",
        F.when(F.col("_parts").isNotNull(), F.pmod(F.xxhash64(*plain), F.col("_parts")).cast("int")).otherwise(
            F.lit(0)
        ),
    )
    copies = other.join(hot, on, "left").withColumn(
        "_salt",
        F.explode(
            F.when(F.col("_parts").isNotNull(), F.sequence(F.lit(0), F.col("_parts") - 1)).otherwise(
                F.array(F.lit(0))
            )
        ),
    )
    return salted.drop("_parts").join(copies.drop("_parts"), [*on, "_salt"], how).drop("_salt")


def sized_join(
    big: DataFrame,
    summary: DataFrame,
    on: Sequence[str],
    how: str = "left",
    max_rows: int = BROADCAST_ROWS,
) -> DataFrame:
    """Join a per-key summary back: broadcast when its measured row count allows, else spread.

    The summary is computed once into the shared folder, so counting it reads file footers
    only and the big side is never shuffled just to find out that the other one is small.
    """
    summary = durable(summary)
    if summary.count() <= max_rows:
        return big.join(F.broadcast(summary), list(on), how)
    return spread_join(big, summary, on, how)


def hashed_rank(df: DataFrame, group: Sequence[str], ident: Column, name: str = "position") -> DataFrame:
    """Position of every row inside its group in md5 order of ``ident``, for groups of any size.

    Equivalent to ``row_number() over (partition by group order by md5(ident))``, but no task
    sees more than one cell of some ``CELL_ROWS`` rows at most; ``group_rows`` is the size of the group.
    """
    group = list(group)
    largest = df.groupBy(*group).count().agg(F.max("count")).first()[0] or 1
    digits = max(2, ceil(log(largest / CELL_ROWS, 16)) + 1)
    coded = df.withColumn("_code", F.md5(ident)).withColumn("_cell", F.substring("_code", 1, digits))
    cells = coded.groupBy(*group, "_cell").agg(F.count("*").alias("_n"))
    whole = Window.partitionBy(*group)
    earlier = whole.orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    offsets = cells.select(
        *group,
        "_cell",
        F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"),
        F.sum("_n").over(whole).alias("group_rows"),
    )
    inside = Window.partitionBy(*group, "_cell").orderBy("_code")
    return (
        coded.join(offsets, [*group, "_cell"])
        .withColumn(name, (F.col("_before") + F.row_number().over(inside)).cast("long"))
        .drop("_code", "_cell", "_before")
    )


def running_counts(
    counts: DataFrame, keys: Sequence[str], value: str, measures: Sequence[str]
) -> DataFrame:
    """Running totals of ``measures`` over ascending ``value`` inside each key, for any key size.

    ``counts`` must hold one row per (keys, value). Rows are range-partitioned on
    (keys, value), so a heavy key covers many partitions; each partition is summed on its own
    and shifted by the totals of the partitions before it. Adds ``cum_*`` and ``all_*``.
    """
    keys, measures = list(keys), list(measures)
    spark = counts.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = durable(
        counts.repartitionByRange(parts, *keys, value).withColumn("_part", F.spark_partition_id())
    )
    totals = ranged.groupBy(*keys, "_part").agg(*[F.sum(m).alias(f"_t_{m}") for m in measures])
    whole = Window.partitionBy(*keys)
    earlier = whole.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        *keys,
        "_part",
        *[F.coalesce(F.sum(f"_t_{m}").over(earlier), F.lit(0)).alias(f"_o_{m}") for m in measures],
        *[F.sum(f"_t_{m}").over(whole).alias(f"all_{m}") for m in measures],
    )
    inside = (
        Window.partitionBy(*keys, "_part")
        .orderBy(value)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    return ranged.join(offsets, [*keys, "_part"]).select(
        *keys,
        value,
        *measures,
        *[(F.col(f"_o_{m}") + F.sum(m).over(inside)).alias(f"cum_{m}") for m in measures],
        *[f"all_{m}" for m in measures],
    )


def quantile_from_counts(
    running: DataFrame, keys: Sequence[str], value: str, measure: str, probs: Sequence[float]
) -> DataFrame:
    """Exact linearly interpolated quantiles as one array per key, from ``running_counts``.

    Each order statistic is the smallest value whose running count passes its rank, so this is
    one map-side-combined aggregate whatever the size of a key.
    """
    at, total = F.col(f"cum_{measure}"), F.col(f"all_{measure}")
    aggs = []
    for i, p in enumerate(probs):
        spot = (total - 1) * F.lit(float(p))
        for side, rank in (("lo", F.floor(spot)), ("hi", F.ceil(spot))):
            aggs.append(F.min(F.when(at > rank, F.col(value))).alias(f"_{side}{i}"))
        aggs.append(F.max(spot - F.floor(spot)).alias(f"_w{i}"))
    picked = running.filter(F.col(measure) > 0).groupBy(*keys).agg(*aggs)
    return picked.select(
        *keys,
        F.array(
            *[
                F.col(f"_lo{i}") + (F.col(f"_hi{i}") - F.col(f"_lo{i}")) * F.col(f"_w{i}")
                for i in range(len(probs))
            ]
        ).alias("quantiles"),
    )

"""Ordered per-resource computation.

A daily table has one row per (tenant, resource, day), so a series is never longer than the
calendar and a plain window is right. Tables without that guarantee go through ``positions``
and fixed-length stretches with an overlap, so that a resource holding a third of all rows is
still spread over many tasks.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

SERIES = ("organization_id", "resource_id")
SLICES = 64
STRETCH_ROWS = 8_192
LONGEST_SERIES = 1_000_000
LAST_DAY = "9999-12-31"


def series_keys(df: DataFrame, keys: Sequence[str] = SERIES) -> list[str]:
    """The key columns the table actually has (single-tenant uploads carry no tenant)."""
    return [k for k in keys if k in df.columns]


def fits_plain_window(df: DataFrame, keys: Sequence[str] = SERIES, limit: int = LONGEST_SERIES) -> bool:
    """Whether every series is short enough for one task, measured by one aggregate over the keys."""
    keys = series_keys(df, keys)
    longest = df.groupBy(*keys).count().agg(F.max("count")).first()[0]
    return (longest or 0) <= limit


TIES = (
    "account_id", "service", "instance_type", "region", "cost", "usage_hours", "cpu_avg_pct", "memory_avg_pct",
    "disk_io", "network_io",
)


def default_ties(df: DataFrame, keys: Sequence[str], order: str = "date") -> list[str]:
    """What orders rows of one day: the billing columns that are there, which no feature step changes."""
    own = [c for c in TIES if c in df.columns and c not in keys and c != order]
    return own or [c for c, kind in df.dtypes if c not in keys and c != order and not kind.startswith(("map", "variant"))]


def total_order(df: DataFrame, keys: Sequence[str], order: str = "date", ties: Sequence[str] | None = None) -> list[Column]:
    """Day, slice of a row hash, time and ties: the same order in a plain window as in ``positions``."""
    ties = list(ties) if ties else default_ties(df, keys, order)
    day = F.coalesce(F.to_date(F.col(order)), F.lit(LAST_DAY).cast("date"))
    cell = F.pmod(F.xxhash64(*ties), F.lit(SLICES)) if ties else F.lit(0).cast("long")
    return [day, cell, F.col(order).asc_nulls_last(), *[F.col(t) for t in ties]]


def in_order(df: DataFrame, keys: Sequence[str], order: str = "date", ties: Sequence[str] | None = None) -> WindowSpec:
    """A plain window over each series in ``total_order``."""
    return Window.partitionBy(*keys).orderBy(*total_order(df, keys, order, ties))


def by_day(keys: Sequence[str], order: str = "date") -> WindowSpec:
    """For series that are aggregated to one row per day."""
    return Window.partitionBy(*keys).orderBy(F.col(order).asc_nulls_last())


def back(w: WindowSpec, rows: int, last: int = 0) -> WindowSpec:
    """The ``rows`` rows that end ``last`` rows after the current one (0: at it, -1: before it)."""
    return w.rowsBetween(last - rows + 1, last)


def positions(
    df: DataFrame,
    keys: Sequence[str],
    order: str = "date",
    ties: Sequence[str] | None = None,
    name: str = "position",
) -> DataFrame:
    """1-based position in each series without one task per series.

    Rows are counted per (series, day, slice of a row hash); the counts are accumulated, and
    numbering happens inside a slice only. Same-day rows are ordered by slice, then ``ties``.
    """
    keys = list(keys)
    ties = list(ties) if ties else default_ties(df, keys, order)
    cell = ["_at", "_slice"]
    cut = df.withColumns(
        {
            "_at": F.coalesce(F.to_date(F.col(order)), F.lit(LAST_DAY).cast("date")),
            "_slice": F.pmod(F.xxhash64(*ties), F.lit(SLICES)) if ties else F.lit(0).cast("long"),
        }
    )
    earlier = Window.partitionBy(*keys).orderBy(*cell).rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        cut.groupBy(*keys, *cell)
        .agg(F.count("*").alias("_n"))
        .select(*keys, *cell, F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    )
    inside = Window.partitionBy(*keys, *cell).orderBy(F.col(order).asc_nulls_last(), *ties)
    return (
        cut.join(offsets, [*keys, *cell])
        .withColumn(name, (F.col("_before") + F.row_number().over(inside)).cast("long"))
        .drop(*cell, "_before")
    )


def with_lookback(
    df: DataFrame,
    build: Callable[[WindowSpec], Mapping[str, Column]],
    *,
    lookback: int,
    keys: Sequence[str] = SERIES,
    order: str = "date",
    one_row_per_day: bool = True,
    ties: Sequence[str] | None = None,
    stretch_rows: int = STRETCH_ROWS,
    walk: Callable[[DataFrame], DataFrame] = lambda ordered: ordered,
) -> DataFrame:
    """Add the columns of ``build(window)``, which may look at most ``lookback`` rows back.

    ``walk`` maps the result while every partition still holds whole series or stretches in the order of the window.
    """
    keys = series_keys(df, keys)
    if one_row_per_day:
        return walk(df.withColumns(dict(build(in_order(df, keys, order, ties)))))
    if lookback >= stretch_rows:
        raise ValueError("a stretch must be longer than the lookback")
    placed = positions(df, keys, order, ties, name="_pos")
    home = F.floor((F.col("_pos") - 1) / stretch_rows)
    tail = F.pmod(F.col("_pos") - 1, F.lit(stretch_rows)) >= stretch_rows - lookback
    copied = placed.withColumn("_home", home).withColumn(
        "_stretch",
        F.explode(
            F.when(tail, F.array(F.col("_home"), F.col("_home") + 1)).otherwise(
                F.array(F.col("_home"))
            )
        ),
    )
    w = Window.partitionBy(*keys, "_stretch").orderBy("_pos")
    return (
        walk(copied.withColumns(dict(build(w))))
        .filter(F.col("_home") == F.col("_stretch"))
        .drop("_pos", "_home", "_stretch")
    )


def latest_rows(
    df: DataFrame, keys: Sequence[str], order: str = "date", keep_ties: bool = False
) -> DataFrame:
    """The newest row per key; with ``keep_ties`` every row of the newest day.

    Without ties this is one map-side-combined aggregate (no window, no self join).
    """
    keys = list(keys)
    if keep_ties:
        newest = df.groupBy(*keys).agg(F.max(order).alias(order))
        return df.join(newest, [*keys, order], "left_semi")
    rest = [c for c in df.columns if c not in keys]
    return (
        df.filter(F.col(order).isNotNull())
        .groupBy(*keys)
        .agg(F.max_by(F.struct(*rest), F.col(order)).alias("_row"))
        .select(*keys, *[F.col(f"_row.{c}").alias(c) for c in rest])
        .select(*df.columns)
    )


def top_rows(df: DataFrame, group: Sequence[str], order: Sequence[Column], k: int) -> DataFrame:
    """First ``k`` rows per group. Spark prunes to k per task before the shuffle (window group limit)."""
    w = Window.partitionBy(*group).orderBy(*order)
    return df.withColumn("_rank", F.row_number().over(w)).filter(F.col("_rank") <= k).drop("_rank")

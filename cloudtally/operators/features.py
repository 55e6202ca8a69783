"""Per-resource features: time, I/O, utilisation, rolling, lagged and business columns."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from cloudtally import fixed_values as fv
from cloudtally.functions.numeric import MONEY, clamp, pct_change
from cloudtally.functions.skew import sized_join
from cloudtally.operators.series import SERIES, back, by_day, in_order, positions, series_keys, with_lookback
from cloudtally.runtime import dealt


def time_features(df: DataFrame, date: str = "date") -> DataFrame:
    d = F.col(date)
    return df.withColumns(
        {
            "hour_of_day": F.hour(d.cast("timestamp")),
            "day_of_week": F.weekday(d),  # Monday is 0
            "day_of_month": F.dayofmonth(d),
            "month": F.month(d),
            "is_weekend": (F.weekday(d) >= 5).cast("int"),
        }
    )


def _pair_or(df: DataFrame, a: str, b: str, single: str, join) -> Column | None:
    """``join(a, b)`` when both raw columns exist, else the ready-made one, else nothing."""
    if {a, b} <= set(df.columns):
        return join(F.col(a), F.col(b))
    return F.col(single) if single in df.columns else None


def _present(df: DataFrame, columns: dict[str, Column | None]) -> DataFrame:
    return df.withColumns({k: c for k, c in columns.items() if c is not None})


def io_features(df: DataFrame) -> DataFrame:
    def add(a, b):
        return a + b

    return _present(
        df,
        {
            "total_disk_io": _pair_or(df, "Disk_Read_KBps", "Disk_Write_KBps", "disk_io", add),
            "total_network_io": _pair_or(
                df, "Network_Received_KBps", "Network_Transmitted_KBps", "network_io", add
            ),
        },
    )


def utilization_ratios(df: DataFrame) -> DataFrame:
    def share(used, of):
        return clamp(F.try_divide(used, of), 0.0, 1.0)

    def pct(name):
        return clamp(F.col(name) / 100.0, 0.0, 1.0) if name in df.columns else None

    have = set(df.columns)
    cpu = (
        share(F.col("CPU_Usage_MHz"), F.col("CPU_Capacity_MHz"))
        if {"CPU_Usage_MHz", "CPU_Capacity_MHz"} <= have
        else pct("cpu_avg_pct")
    )
    memory = (
        share(F.col("Memory_Usage_KB"), F.col("Memory_Provisioned_KB"))
        if {"Memory_Usage_KB", "Memory_Provisioned_KB"} <= have
        else pct("memory_avg_pct")
    )
    return _present(df, {"cpu_utilization_ratio": cpu, "memory_utilization_ratio": memory})


def rolling_lag(
    df: DataFrame, keys: Sequence[str] = SERIES, one_row_per_day: bool = True
) -> DataFrame:
    """7- and 30-row means and 1- and 7-row lags; all share one window, hence one shuffle and sort."""
    plan = {"cost": ("cost", (1, 7)), "cpu_avg_pct": ("cpu", (1,)), "memory_avg_pct": ("memory", (1,))}

    def build(w):
        out = {}
        for column, (short, lags) in plan.items():
            if column not in df.columns:
                continue
            for days in (7, 30):
                out[f"rolling_avg_{short}_{days}d"] = F.avg(column).over(back(w, days))
            for days in lags:
                out[f"lag_{short}_{days}d"] = F.lag(column, days).over(w)
        return out

    return with_lookback(df, build, lookback=30, keys=keys, one_row_per_day=one_row_per_day)


def growth(
    df: DataFrame,
    keys: Sequence[str] = SERIES,
    keep_inf: bool = False,
    one_row_per_day: bool = True,
) -> DataFrame:
    """``cost_growth_rate`` against the previous row and ``runtime_days`` (position in the series)."""
    keys = series_keys(df, keys)

    if one_row_per_day:
        w = in_order(df, keys)
        out = df.withColumns({"runtime_days": F.row_number().over(w), "_prev": F.lag("cost").over(w)})
    else:
        out = with_lookback(
            positions(df, keys, name="runtime_days"),
            lambda w: {"_prev": F.lag("cost").over(w)},
            lookback=1,
            keys=keys,
            one_row_per_day=False,
        )
    rate = pct_change(F.col("cost"), F.col("_prev"), keep_inf)
    return out.withColumns(
        {"runtime_days": F.col("runtime_days").cast("int"), "cost_growth_rate": rate}
    ).drop("_prev")


def business_features(
    df: DataFrame,
    keys: Sequence[str] = SERIES,
    keep_inf: bool = False,
    one_row_per_day: bool = True,
) -> DataFrame:
    have, keys = set(df.columns), series_keys(df, keys)
    per = {}
    for column, short in (("cpu_avg_pct", "cpu"), ("memory_avg_pct", "memory")):
        if {"cost", column} <= have:
            # a floor of 1 % keeps near-idle machines from exploding the ratio
            per[f"cost_per_{short}_utilization"] = F.col("cost") / clamp(F.col(column), low=1.0)
    out = growth(df.withColumns(per), keys, keep_inf, one_row_per_day)
    if one_row_per_day:
        first = F.min("date").over(Window.partitionBy(*keys))
        return out.withColumn("resource_age_days", F.datediff("date", first))
    seen = df.groupBy(*keys).agg(F.min("date").alias("_first"))
    return (
        sized_join(out, seen, keys)
        .withColumn("resource_age_days", F.datediff("date", "_first"))
        .drop("_first")
    )


def engineer(df: DataFrame, keys: Sequence[str] = SERIES, one_row_per_day: bool = True) -> DataFrame:
    """The whole feature set; every windowed column shares one partitioning."""
    out = utilization_ratios(io_features(time_features(df)))
    out = rolling_lag(out, keys, one_row_per_day)
    return business_features(out, keys, one_row_per_day=one_row_per_day)


def idle_days(
    df: DataFrame,
    keys: Sequence[str] = SERIES,
    threshold: float = fv.IDLE_CPU_PCT,
    rows: int = fv.IDLE_WINDOW_ROWS,
    one_row_per_day: bool = True,
) -> DataFrame:
    low = F.when(F.col("cpu_avg_pct") < threshold, 1).otherwise(0)
    return with_lookback(
        df,
        lambda w: {"idle_days": F.sum(low).over(back(w, rows))},
        lookback=rows,
        keys=keys,
        one_row_per_day=one_row_per_day,
    )


def lagged_zscore(
    df: DataFrame,
    dimensions: Sequence[str] = tuple(fv.INCIDENT_WEIGHTS),
    keys: Sequence[str] = SERIES,
    one_row_per_day: bool = True,
) -> DataFrame:
    """Distance of today's value from the series' own baseline that ended a week ago.

    ``lag(7)`` over a 30-row frame is the frame of rows -36..-7, so no nested window is needed. Spark numbers the rows
    of each series; the frames are worked out batch by batch in that order (``baselines``).
    """
    present = [d for d in dimensions if d in df.columns]
    if not present:
        return df
    based = with_lookback(
        df,
        lambda w: {"_at": F.row_number().over(w)},
        lookback=fv.ZSCORE_ROWS + fv.ZSCORE_LAG,
        keys=keys,
        one_row_per_day=one_row_per_day,
        walk=lambda ordered: baselines(ordered, present, "_at", fv.ZSCORE_ROWS, fv.ZSCORE_LAG, fv.ZSCORE_MIN_ROWS),
    )

    def z(d):
        raw = F.when(F.col(f"_std_{d}") > 0, (F.col(d) - F.col(f"_avg_{d}")) / F.col(f"_std_{d}"))
        return F.greatest(F.lit(-fv.ZSCORE_CLIP), F.least(F.lit(fv.ZSCORE_CLIP), F.coalesce(raw, F.lit(0.0))))

    return based.select(*df.columns, *[z(d).alias(f"{d}_zscore") for d in present])


def baselines(ordered: DataFrame, names: Sequence[str], at: str, rows: int, lag: int, least: int) -> DataFrame:
    """Add mean and sample deviation (``_avg_``, ``_std_``) over the ``rows`` rows that end ``lag`` rows back.

    Partitions hold whole series in order, ``at`` is the 1-based row of a series. Both are null with fewer than ``least``
    known values. One pass over a batch for each row of the frame, oldest first, with the steps of Spark's own ``avg``
    and ``stddev_samp``, so the values are theirs; Spark would walk through the frame again for every row. A batch
    needs no more of the last one than its final ``rows + lag - 1`` rows.
    """
    back = rows + lag - 1
    new = [f"_{kind}_{d}" for d in names for kind in ("avg", "std")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = {d: (np.zeros(back), np.zeros(back, bool)) for d in names}
        for batch in batches:
            m, made = batch.num_rows, []
            row = batch.column(at).to_numpy(zero_copy_only=False)
            for d in names:
                column = batch.column(d).cast(pa.float64())
                own = column.fill_null(0.0).to_numpy(zero_copy_only=False), column.is_valid().to_numpy(zero_copy_only=False)
                value, known = (np.concatenate(pair) for pair in zip(last[d], own, strict=True))
                last[d] = value[-back:], known[-back:]
                n, total, mean, m2 = (np.zeros(m) for _ in range(4))
                with np.errstate(all="ignore"):
                    for k in range(back, lag - 1, -1):
                        x, used = value[back - k : back - k + m], known[back - k : back - k + m] & (row > k)
                        n += used
                        gap = np.where(used, x - mean, 0.0)
                        step = np.divide(gap, n, out=np.zeros(m), where=used)
                        mean += step
                        m2 += gap * (gap - step)
                        total += np.where(used, x, 0.0)
                    few = n < max(least, 2)
                    made += [pa.array(total / n, mask=few), pa.array(np.sqrt(m2 / (n - 1)), mask=few)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *made], [*batch.schema.names, *new])

    added = StructType([StructField(c, DoubleType()) for c in new])
    return ordered.mapInArrow(run, StructType([*ordered.schema.fields, *added.fields]))


def daily_series(df: DataFrame, org: str = "organization_id") -> DataFrame:
    """Daily cost and active resources at tenant level (``service`` NULL) and per service, in one job.

    Rows are dealt out once, by day and resource, and both levels collapse them there: per (day, service, resource)
    and per (day, resource), so a resource is counted once and no row is carried once for each level.
    """
    base = df.filter(F.col("date").isNotNull() & F.col("service").isNotNull())
    own = dealt(base.select(org, "date", "service", "resource_id", "cost"), org, "date", "resource_id")
    # the service is used at both levels: with the same columns they read one shuffle
    summed = F.sum(F.col("cost").cast(MONEY)).alias("_cost"), F.max(F.length("service")).alias("_named")
    slim = own.groupBy(org, "date", "service", "resource_id").agg(*summed)
    whole = own.groupBy(org, "date", "resource_id").agg(*summed)

    def level(rows: DataFrame, name: str, service: Column, *keys: str) -> DataFrame:
        counted = rows.groupBy(org, "date", *keys).agg(
            F.sum("_cost").cast("double").alias("cost"),
            F.count(F.when(F.col("_named").isNotNull(), F.col("resource_id"))).alias("active_resource_count"),
        )
        return counted.select(org, "date", F.lit(name).alias("level"), service.alias("service"), "cost", "active_resource_count")

    total = level(whole, "org_total", F.lit(None).cast(df.schema["service"].dataType))
    return total.unionByName(level(slim, "per_service", F.col("service"), "service"))


def supervised(
    daily: DataFrame, keys: Sequence[str] = ("service",), include_current: bool = False
) -> DataFrame:
    """Forecast features per daily series.

    By default the rolling means end on the previous day: with the current day inside, the
    target leaks into its own features. ``include_current`` restores that older behaviour.
    """
    last = 0 if include_current else -1
    w = by_day(keys)
    return daily.withColumns(
        {
            "day_of_week": F.weekday("date"),
            "day_of_month": F.dayofmonth("date"),
            "rolling_avg_7d": F.avg("cost").over(back(w, 7, last)),
            "rolling_avg_30d": F.avg("cost").over(back(w, 30, last)),
            "lag_1d": F.lag("cost", 1).over(w),
            "lag_7d": F.lag("cost", 7).over(w),
        }
    )

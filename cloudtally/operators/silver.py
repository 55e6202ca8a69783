"""Raw telemetry and price rows to clean silver tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cloudtally.functions.numeric import clamp
from cloudtally.functions.text import os_family, zone_to_region

METRICS = (
    "cpu_cores", "cpu_capacity_mhz", "cpu_usage_mhz", "cpu_usage_percent",
    "memory_provisioned_kb", "memory_usage_kb", "disk_read_kbps", "disk_write_kbps",
    "network_received_kbps", "network_transmitted_kbps",
)
CRITICAL = ("cpu_usage_percent", "memory_usage_kb")


def keep_first(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The first row per key in ``order``: an aggregate, so copies combine before the shuffle."""
    rest = [c for c in df.columns if c not in keys]
    return (
        df.groupBy(*keys)
        .agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_row"))
        .select(*keys, *[F.col(f"_row.{c}").alias(c) for c in rest])
    )


def fill_gaps(
    df: DataFrame, metrics: Sequence[str] = METRICS, vm: str = "vm_id", ts: str = "ts"
) -> DataFrame:
    """Carry the last known value forward, then the next one backward, per machine.

    Each machine-hour is filled on its own; what crosses an hour comes from a one-row-per-hour
    summary, whose series is bounded by the calendar. No task holds a whole machine.
    """
    hour = df.withColumn("_hour", F.date_trunc("hour", F.col(ts)))

    def known(fn, c):
        return fn(F.when(F.col(c).isNotNull(), F.col(c)), F.when(F.col(c).isNotNull(), F.col(ts)))

    edges = hour.groupBy(vm, "_hour").agg(
        *[known(F.max_by, c).alias(f"_l_{c}") for c in metrics],
        *[known(F.min_by, c).alias(f"_f_{c}") for c in metrics],
    )
    # looking ahead is looking back in reverse order: a growing frame costs one step per row,
    # a frame that ends at the last row would be walked again for every row
    past = (Window.unboundedPreceding, -1)
    before = Window.partitionBy(vm).orderBy("_hour").rowsBetween(*past)
    after = Window.partitionBy(vm).orderBy(F.desc("_hour")).rowsBetween(*past)
    carried = edges.select(
        vm,
        "_hour",
        *[F.last(f"_l_{c}", ignorenulls=True).over(before).alias(f"_p_{c}") for c in metrics],
        *[F.last(f"_f_{c}", ignorenulls=True).over(after).alias(f"_n_{c}") for c in metrics],
    )
    inside = Window.partitionBy(vm, "_hour")
    to_here = inside.orderBy(ts).rowsBetween(Window.unboundedPreceding, 0)
    from_here = inside.orderBy(F.desc(ts)).rowsBetween(Window.unboundedPreceding, 0)
    filled = {
        c: F.coalesce(
            F.last(c, ignorenulls=True).over(to_here),
            F.col(f"_p_{c}"),
            F.last(c, ignorenulls=True).over(from_here),
            F.col(f"_n_{c}"),
        )
        for c in metrics
    }
    joined = hour.join(carried, [vm, "_hour"])
    return joined.withColumns(filled).select(*df.columns)


def clean(
    bronze: DataFrame,
    vm: str = "vm_id",
    ts: str = "ts",
    order: Sequence[str] = ("src", "event_id"),
) -> DataFrame:
    """Readable timestamps, first row per (machine, time), gaps filled, units and ratios added."""
    parsed = bronze.withColumn(ts, F.try_to_timestamp(F.col(ts).cast("string"))) if dict(
        bronze.dtypes
    )[ts] == "string" else bronze
    unique = keep_first(parsed.filter(F.col(ts).isNotNull() & F.col(vm).isNotNull()), [vm, ts], order)
    filled = fill_gaps(unique, vm=vm, ts=ts).dropna(subset=list(CRITICAL))
    return filled.withColumns(
        {
            "memory_provisioned_mb": F.col("memory_provisioned_kb") / 1024,
            "memory_usage_mb": F.col("memory_usage_kb") / 1024,
            "memory_utilization_ratio": clamp(
                F.try_divide("memory_usage_kb", "memory_provisioned_kb"), 0.0, 1.0
            ),
            "cpu_utilization_ratio": clamp(
                F.try_divide("cpu_usage_mhz", "cpu_capacity_mhz"), 0.0, 1.0
            ),
        }
    )


MEANS = (
    "cpu_capacity_mhz", "cpu_usage_mhz", "cpu_usage_percent", "memory_provisioned_kb",
    "memory_usage_kb", "memory_provisioned_mb", "memory_usage_mb", "memory_utilization_ratio",
    "cpu_utilization_ratio",
)
SUMS = ("disk_read_kbps", "disk_write_kbps", "network_received_kbps", "network_transmitted_kbps")


def daily(cleaned: DataFrame, vm: str = "vm_id", ts: str = "ts") -> DataFrame:
    """One row per machine and day: means, I/O sums, first known core count."""
    return (
        cleaned.groupBy(vm, F.to_date(ts).alias("date"))
        .agg(
            F.min_by("cpu_cores", F.when(F.col("cpu_cores").isNotNull(), F.col(ts))).alias("cpu_cores"),
            *[F.avg(c).alias(c) for c in MEANS],
            *[F.sum(c).alias(c) for c in SUMS],
        )
        .filter(F.col("cpu_usage_percent").isNotNull())
    )


def manifest(
    bronze: DataFrame,
    vm: str = "vm_id",
    ts: str = "ts",
    order: Sequence[str] = ("src", "event_id"),
) -> DataFrame:
    """Row counts after each cleaning step as (step, row_count, dropped).

    Every count comes from one aggregate per (machine, time) and one over those: the deduplicated
    count is the number of groups, and a machine stays fillable if it has the value anywhere.
    """
    readable = F.col(ts).isNotNull()
    groups = (
        bronze.withColumn("_ok", readable)
        .groupBy(vm, "_ok", ts)
        .agg(
            F.count("*").alias("_rows"),
            *[
                F.min_by(F.col(c).isNotNull(), F.struct(*order)).alias(f"_has_{c}")
                for c in CRITICAL
            ],
        )
    )
    per_vm = groups.groupBy(vm).agg(
        F.sum("_rows").alias("loaded"),
        F.sum(F.when(F.col("_ok"), F.col("_rows")).otherwise(0)).alias("parsed"),
        F.count_if("_ok").alias("unique_rows"),
        *[F.max(F.col("_ok") & F.col(f"_has_{c}")).alias(f"_fill_{c}") for c in CRITICAL],
        F.count_distinct(F.when(F.col("_ok"), F.to_date(ts))).alias("days"),
    )
    usable = F.col(f"_fill_{CRITICAL[0]}") & F.col(f"_fill_{CRITICAL[1]}")
    totals = per_vm.agg(
        F.sum("loaded").alias("loaded"),
        F.sum("parsed").alias("parsed"),
        F.sum("unique_rows").alias("unique_rows"),
        F.sum(F.when(usable, F.col("unique_rows")).otherwise(0)).alias("filled"),
        F.sum(F.when(usable, F.col("days")).otherwise(0)).alias("days"),
    )
    steps = (
        ("load_bronze", "loaded", None),
        ("parse_datetime", "parsed", "loaded"),
        ("drop_duplicates", "unique_rows", "parsed"),
        ("handle_missing_values", "filled", "unique_rows"),
        ("resample_daily", "days", None),
    )
    rows = F.array(
        *[
            F.struct(
                F.lit(step).alias("step"),
                F.col(now).alias("row_count"),
                (F.col(was) - F.col(now) if was else F.lit(None).cast("long")).alias("dropped"),
            )
            for step, now, was in steps
        ]
    )
    return totals.select(F.explode(rows).alias("s")).select("s.step", "s.row_count", "s.dropped")


PRICE_POINT = (
    "instance_type", "region_raw", "os", "pricing_type", "effective_date", "hourly_rate",
)


def prices(bronze: DataFrame) -> DataFrame:
    """Canonical price rows: region and OS normalised, invalid rates out, price points unique.

    Uniqueness is per file and on the raw zone: two zones of one region are distinct price points.
    """
    return (
        bronze.withColumns(
            {
                "instance_type": F.trim("instance_type"),
                "region_raw": F.trim("region_raw"),
                "os": os_family(F.col("os_raw")),
                "hourly_rate": F.col("hourly_rate").cast("double"),
            }
        )
        .filter(F.col("instance_type").isNotNull() & (F.col("hourly_rate") > 0))
        .dropDuplicates([*PRICE_POINT, "source_file"])
        .select(*PRICE_POINT, "source_file")
        .withColumn("region", zone_to_region(F.col("region_raw")))
    )

"""Stored tables: feature upserts, model outputs, uploads, purges and exports."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FEATURE_KEY = ("organization_id", "resource_id", "date", "feature_version")
NOT_FEATURES = {"organization_id", "resource_id", "date", "dataset_id"}


def feature_rows(df: DataFrame, version: str = "v1") -> DataFrame:
    """Engineered columns packed into one map per (tenant, resource, day); NULLs stay as NULL values."""
    names = [c for c in df.columns if c not in NOT_FEATURES and c not in FEATURE_KEY]
    numeric = [c for c in names if df.schema[c].dataType.typeName() not in ("string", "date", "array", "map", "struct")]
    pairs = [x for c in numeric for x in (F.lit(c), F.col(c).cast("double"))]
    return df.filter(F.col("date").isNotNull() & F.col("resource_id").isNotNull()).select(
        "organization_id",
        "resource_id",
        "date",
        F.lit(version).alias("feature_version"),
        F.create_map(*pairs).alias("features"),
        F.current_timestamp().alias("created_at"),
    )


def upsert(existing: DataFrame, incoming: DataFrame, key: Sequence[str] = FEATURE_KEY) -> DataFrame:
    """Last write per key wins; at equal times the incoming row does.

    An aggregate instead of a window: repeated keys combine before the shuffle.
    """
    both = existing.withColumn("_batch", F.lit(0)).unionByName(incoming.withColumn("_batch", F.lit(1)))
    rest = [c for c in existing.columns if c not in key]
    return (
        both.groupBy(*key)
        .agg(F.max_by(F.struct(*rest), F.struct("created_at", "_batch")).alias("_row"))
        .select(*key, *[F.col(f"_row.{c}").alias(c) for c in rest])
    )


def write_partitions(df: DataFrame, path: str, by: Sequence[str]) -> None:
    """Replace exactly the partitions present in ``df``. Re-running is harmless; two writers at once are not."""
    (
        df.repartition(*by)
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(*by)
        .parquet(path)
    )


def append(df: DataFrame, path: str, by: Sequence[str]) -> None:
    df.write.mode("append").partitionBy(*by).parquet(path)


def read_features(
    store: DataFrame,
    names: Sequence[str],
    version: str = "v1",
    organization_id: str | None = None,
    resource_ids: Sequence[str] | None = None,
) -> DataFrame:
    """Selected features as columns again."""
    rows = store.filter(F.col("feature_version") == version)
    if organization_id is not None:
        rows = rows.filter(F.col("organization_id") == organization_id)
    if resource_ids:
        rows = rows.filter(F.col("resource_id").isin(list(resource_ids)))
    return rows.select(
        "organization_id",
        "resource_id",
        "date",
        *[F.try_element_at("features", F.lit(n)).alias(n) for n in names],
    )


def load_upload(table: DataFrame, path: str, mode: str) -> None:
    """``new_analysis`` replaces the tenant's telemetry, ``continuous`` adds to it.

    Rows without a date cannot be stored; they belong in the failure report.
    """
    keep = table.filter(F.col("date").isNotNull())
    if mode == "new_analysis":
        write_partitions(keep, path, ["organization_id"])
    elif mode == "continuous":
        append(keep, path, ["organization_id"])
    else:
        raise ValueError(f"unknown upload mode {mode!r}")


def tenant_scan(spark: SparkSession, path: str, organization_id: str | None = None) -> DataFrame:
    """All tenants, or one by partition pruning."""
    df = spark.read.parquet(path)
    return df if organization_id is None else df.filter(F.col("organization_id") == organization_id)


def purge_counts(tables: Mapping[str, DataFrame], tenant: str = "organization_id") -> DataFrame:
    """How many rows of each table a tenant purge would delete."""
    parts = [df.select(tenant, F.lit(name).alias("table_name")) for name, df in tables.items()]
    return reduce(DataFrame.unionByName, parts).groupBy(tenant, "table_name").agg(F.count("*").alias("n"))


def purge(table: DataFrame, organization_id: str) -> DataFrame:
    """The table without the tenant's rows."""
    return table.filter(~F.col("organization_id").eqNullSafe(F.lit(organization_id)))


def export_rows(rows: DataFrame, path: str, kind: str) -> None:
    """Report rows as CSV with a header, or as JSON lines."""
    writer = rows.write.mode("overwrite")
    if kind == "csv":
        writer.option("header", True).csv(path)
    elif kind == "json":
        writer.json(path)
    else:
        raise ValueError(f"unknown export kind {kind!r}")

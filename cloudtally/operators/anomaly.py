"""Incident score, severity and roll-ups over 0-100 dimension scores."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cloudtally import fixed_values as fv
from cloudtally.functions.numeric import banded, half_up, no_nan
from cloudtally.functions.skew import sized_join


def severity(score):
    return banded(score, fv.SEVERITY_BANDS, fv.SEVERITY_FLOOR)


def fuse(
    df: DataFrame,
    prefix: str = "anomaly_score_",
    weights: Mapping[str, float] = fv.INCIDENT_WEIGHTS,
) -> DataFrame:
    """Weighted mean of the dimension scores present, missing values counting as 0."""
    usable = {d: w for d, w in weights.items() if prefix + d in df.columns}
    whole = sum(usable.values())
    total = F.lit(0.0)
    for d, w in usable.items():
        total = total + F.coalesce(no_nan(F.col(prefix + d)), F.lit(0.0)) * F.lit(w / whole)
    return df.withColumn("incident_score", half_up(total, 2)).withColumn(
        "severity", severity(F.col("incident_score"))
    )


def latest_day(
    df: DataFrame, tenant: Sequence[str] = ("organization_id",), source: DataFrame | None = None
) -> DataFrame:
    """Rows of each tenant's newest date, the slice that inference stores.

    ``source`` is a cheaper table with the same dates, such as the billing behind the scores.
    """
    dated = df if source is None else source
    newest = dated.groupBy(*tenant).agg(F.max("date").alias("date"))
    return sized_join(df, newest, [*tenant, "date"], "left_semi")


def incident_daily(df: DataFrame, tenant: Sequence[str] = ("organization_id",)) -> DataFrame:
    return df.groupBy(*tenant, "date").agg(
        half_up(F.avg("incident_score"), 2).alias("avg_incident_score"),
        F.count_if(F.col("severity").isin("high", "critical")).alias("high_severity_count"),
    )


def history_counts(
    df: DataFrame, windows: DataFrame, key: str = "resource_id", tenant: Sequence[str] = ("organization_id",)
) -> DataFrame:
    """How many labelled incidents each tenant's resource has had, 0 when none."""
    keys = [*(t for t in tenant if t in df.columns or t in windows.columns), key]
    counted = windows.groupBy(*keys).agg(F.count("*").alias("_n"))
    return sized_join(df, counted, keys).withColumn(
        "anomaly_history_count", F.coalesce("_n", F.lit(0)).cast("int")
    ).drop("_n")

"""Waste score and buckets."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cloudtally import fixed_values as fv
from cloudtally.functions.numeric import banded, below, clamp, half_up, no_nan, scaled
from cloudtally.functions.skew import sized_join
from cloudtally.operators.features import idle_days
from cloudtally.operators.series import SERIES
from cloudtally.runtime import durable

NEEDS = {
    "cpu": "cpu_avg_pct",
    "memory": "memory_avg_pct",
    "growth": "cost_growth_rate",
    "idle": "cpu_avg_pct",
    "history": "anomaly_history_count",
}


def weights_for(columns: Iterable[str]) -> dict[str, float]:
    """Weights of the terms whose source column exists, rescaled to 1."""
    columns = set(columns)
    usable = {t: w for t, w in fv.WASTE_WEIGHTS.items() if NEEDS[t] in columns}
    total = sum(usable.values())
    return {t: w / total for t, w in usable.items()}


def bucket(score):
    return banded(score, fv.WASTE_BANDS, fv.WASTE_FLOOR)


def growth_span(df: DataFrame, tenant: Sequence[str] = ("organization_id",)) -> DataFrame:
    """Smallest and largest growth per tenant; store it to keep scores comparable across runs."""
    g = no_nan(F.col("cost_growth_rate"))
    return df.groupBy(*tenant).agg(F.min(g).alias("growth_lo"), F.max(g).alias("growth_hi"))


def min_max(
    df: DataFrame, column: str, out: str, tenant: Sequence[str] = ("organization_id",)
) -> DataFrame:
    """Scale a column into [0, 1] within its tenant (two passes, no window over a whole tenant)."""
    c = no_nan(F.col(column))
    span = df.groupBy(*tenant).agg(F.min(c).alias("_lo"), F.max(c).alias("_hi"))
    return (
        sized_join(df, span, tenant)
        .withColumn(out, scaled(c, F.col("_lo"), F.col("_hi")))
        .drop("_lo", "_hi")
    )


def waste_score(
    df: DataFrame,
    keys: Sequence[str] = SERIES,
    tenant: Sequence[str] = ("organization_id",),
    span: DataFrame | None = None,
    one_row_per_day: bool = True,
) -> DataFrame:
    """Add ``idle_days`` (where computable), ``waste_score`` and ``bucket``."""
    weights = weights_for(df.columns)
    terms = {}
    if "cpu" in weights:
        df = idle_days(df, keys, one_row_per_day=one_row_per_day)
        terms["cpu"] = (100 - F.col("cpu_avg_pct")) / 100
        terms["idle"] = clamp(F.col("idle_days") / 30, 0.0, 1.0)
    if "memory" in weights:
        terms["memory"] = (100 - F.col("memory_avg_pct")) / 100
    if "growth" in weights:
        if span is None:
            df = durable(df)  # read for the span and for the scores: its windows are worked out once
            span = growth_span(df, tenant)
        df = sized_join(df, span, tenant)
        terms["growth"] = scaled(
            no_nan(F.col("cost_growth_rate")), F.col("growth_lo"), F.col("growth_hi")
        )
    if "history" in weights:
        terms["history"] = F.when(F.col("anomaly_history_count") > 0, 1.0).otherwise(0.0)
    total = F.lit(0.0)
    for name, weight in weights.items():
        total = total + F.coalesce(terms[name], F.lit(0.0)) * F.lit(weight)
    return (
        df.withColumn("waste_score", half_up(total * 100, 2))
        .withColumn("bucket", bucket(F.col("waste_score")))
        .drop("growth_lo", "growth_hi")
    )


def observed_label(df: DataFrame, days: int = 30, tenant: Sequence[str] = ("organization_id",)) -> DataFrame:
    """Label of each resource from its mean CPU over the tenant's trailing window."""
    newest = df.groupBy(*tenant).agg(F.max("date").alias("_last"))
    return (
        sized_join(df, newest, tenant)
        .filter(F.col("date") >= F.date_sub("_last", days))
        .groupBy(*tenant, "resource_id")
        .agg(F.avg("cpu_avg_pct").alias("_cpu"), F.avg("memory_avg_pct").alias("_mem"))
        .select(
            *tenant,
            "resource_id",
            half_up(F.col("_cpu"), 2).alias("avg_cpu_pct"),
            half_up(F.col("_mem"), 2).alias("avg_memory_pct"),
            below(F.col("_cpu"), fv.LABEL_BANDS, "Healthy").alias("waste_label"),
        )
    )

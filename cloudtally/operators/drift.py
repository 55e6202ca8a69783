"""Feature drift between a reference period and a new one, and the retraining policy."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cloudtally import fixed_values as fv
from cloudtally.functions.numeric import half_up
from cloudtally.functions.skew import (
    hashed_rank,
    quantile_from_counts,
    running_counts,
    sized_join,
)
from cloudtally.operators.series import LAST_DAY
from cloudtally.runtime import durable

TENANT = ("organization_id",)
FEATURES = ("cost", "cpu_avg_pct", "memory_avg_pct")


def split_by_time(
    df: DataFrame,
    tenant: Sequence[str] = TENANT,
    share: float = 0.8,
    order: str = "date",
    ident: Sequence[str] = ("resource_id",),
) -> DataFrame:
    """Mark the first ``share`` of each tenant's rows in time order as ``is_train``.

    Rows of one day are ordered by md5 of ``ident``. Days are counted first and accumulated over
    the calendar; only the rows of the day that contains the cut are ranked, cell by cell, to
    find the last reference row. Rows alike in day and ``ident`` stay on one side.
    """
    tenant = list(tenant)
    name = F.concat_ws("|", *[F.col(c).cast("string") for c in ident])
    dated = df.withColumn("_at", F.coalesce(F.col(order), F.lit(LAST_DAY).cast("date")))
    days = dated.groupBy(*tenant, "_at").agg(F.count("*").alias("_n"))
    whole = Window.partitionBy(*tenant)  # one row per day of the calendar
    upto = F.sum("_n").over(whole.orderBy("_at").rowsBetween(Window.unboundedPreceding, 0))
    keep = F.floor(F.sum("_n").over(whole) * F.lit(share).cast("decimal(9,6)"))
    counted = days.withColumns({"_upto": upto, "_keep": keep})
    cut = durable(
        counted.groupBy(*tenant).agg(
            F.min(F.when(F.col("_upto") > F.col("_keep"), F.col("_at"))).alias("_day"),
            (
                F.max("_keep")
                - F.coalesce(F.max(F.when(F.col("_upto") <= F.col("_keep"), F.col("_upto"))), F.lit(0))
            ).alias("_need"),
        )
    )
    split_day = cut.filter("_need > 0").select(*tenant, F.col("_day").alias("_at"), "_need")
    on_day = sized_join(dated.select(*tenant, "_at", *ident), split_day, [*tenant, "_at"], "inner")
    edge = (
        hashed_rank(on_day, tenant, name, "_rank")
        .filter(F.col("_rank") == F.col("_need"))
        .select(*tenant, F.md5(name).alias("_edge"))
    )
    # one row per tenant: everything up to (day, code) is reference
    last = cut.join(edge, tenant, "left").drop("_need")
    before = F.col("_at") < F.col("_day")
    within = (F.col("_at") == F.col("_day")) & (F.md5(name) <= F.coalesce("_edge", F.lit("")))
    return (
        sized_join(dated, last, tenant)
        .withColumn("is_train", F.col("_day").isNull() | before | within)
        .drop("_at", "_day", "_edge")
    )


def value_counts(
    marked: DataFrame, features: Sequence[str] = FEATURES, tenant: Sequence[str] = TENANT
) -> DataFrame:
    """Reference and new row counts per (tenant, feature, value): all tests work on these.

    Features become rows, so one job serves them all; equal values combine before the shuffle.
    """
    present = [f for f in features if f in marked.columns]
    pairs = F.explode(
        F.array(
            *[
                F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("value"))
                for f in present
            ]
        )
    )
    long = marked.select(*tenant, "is_train", pairs.alias("p")).select(
        *tenant, "is_train", F.col("p.feature").alias("feature"), F.col("p.value").alias("value")
    )
    return (
        long.filter(F.col("value").isNotNull() & ~F.isnan("value"))
        .groupBy(*tenant, "feature", "value")
        .agg(
            F.count_if("is_train").alias("n_train"),
            F.count_if(~F.col("is_train")).alias("n_new"),
        )
    )


def prepare(marked: DataFrame, features: Sequence[str] = FEATURES, tenant: Sequence[str] = TENANT) -> DataFrame:
    """Running counts per (tenant, feature), computed once for every test that follows."""
    counts = value_counts(marked, features, tenant)
    keys = [*tenant, "feature"]
    return durable(running_counts(counts, keys, "value", ["n_train", "n_new"]))


def psi(
    running: DataFrame, tenant: Sequence[str] = TENANT, bins: int = fv.PSI_BINS, digits: int = 4
) -> DataFrame:
    """Population stability index over bins cut at the reference quantiles.

    New values outside the reference range are left out of the shares; the last bin is closed.
    """
    keys = [*tenant, "feature"]
    probs = [i / bins for i in range(bins + 1)]
    cuts = quantile_from_counts(running, keys, "value", "n_train", probs).select(
        *keys, F.array_distinct("quantiles").alias("edges")
    )
    top = F.size("edges") - 1
    place = F.size(F.filter("edges", lambda e: e <= F.col("value")))
    inside = (F.col("value") >= F.get("edges", F.lit(0))) & (F.col("value") <= F.get("edges", top))
    binned = (
        sized_join(running, cuts, keys)
        .filter((F.size("edges") >= 3) & inside)
        .groupBy(*keys, F.least(place, top).alias("bin"))
        .agg(F.sum("n_train").alias("t"), F.sum("n_new").alias("n"))
    )
    whole = Window.partitionBy(*keys)  # at most ``bins`` rows per key

    def share(c):
        part = F.col(c) / F.greatest(F.sum(c).over(whole), F.lit(1))
        return F.greatest(part, F.lit(fv.PSI_FLOOR))

    terms = binned.select(*keys, share("t").alias("t"), share("n").alias("n"))
    total = terms.groupBy(*keys).agg(
        F.sum((F.col("n") - F.col("t")) * F.log(F.col("n") / F.col("t"))).alias("_psi")
    )
    both = running.groupBy(*keys).agg(F.max("all_n_new").alias("_n"))
    value = F.when(F.col("_n") > 0, F.col("_psi"))
    return both.join(total, keys, "left").select(
        *keys, half_up(F.coalesce(value, F.lit(0.0)), digits).alias("psi")
    )


def _kolmogorov(x: Column, terms: int = 100) -> Column:
    """Upper tail of the Kolmogorov distribution as its alternating series."""
    k = F.sequence(F.lit(1), F.lit(terms))
    parts = F.transform(
        k, lambda i: F.when(i % 2 == 1, 1.0).otherwise(-1.0) * F.exp(-2.0 * i * i * x * x)
    )
    total = F.aggregate(parts, F.lit(0.0), lambda acc, v: acc + v)
    # below 0.2 the series needs more terms than it is worth: the tail is 1 to 12 digits
    return F.when(x < 0.2, F.lit(1.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), 2.0 * total)))


def ks(running: DataFrame, tenant: Sequence[str] = TENANT) -> DataFrame:
    """Two-sample Kolmogorov-Smirnov statistic, and its p-value in the large-sample limit."""
    keys = [*tenant, "feature"]
    gap = F.abs(F.col("cum_n_train") / F.col("all_n_train") - F.col("cum_n_new") / F.col("all_n_new"))
    a, b = F.col("_a"), F.col("_b")
    stat = (
        running.filter((F.col("all_n_train") > 0) & (F.col("all_n_new") > 0))
        .groupBy(*keys)
        .agg(
            F.max(gap).alias("_d"),
            F.max("all_n_train").cast("double").alias("_a"),
            F.max("all_n_new").cast("double").alias("_b"),
        )
    )
    return stat.select(
        *keys,
        half_up(F.col("_d"), 4).alias("ks_statistic"),
        half_up(_kolmogorov(F.col("_d") * F.sqrt(a * b / (a + b))), 6).alias("ks_pvalue"),
    )


def drift_report(
    marked: DataFrame, features: Sequence[str] = FEATURES, tenant: Sequence[str] = TENANT
) -> DataFrame:
    """PSI and KS per (tenant, feature) with their flags."""
    running = prepare(marked, features, tenant)
    keys = [*tenant, "feature"]
    return psi(running, tenant).join(ks(running, tenant), keys, "left").select(
        *keys,
        "psi",
        (F.col("psi") > fv.PSI_LIMIT).alias("psi_drift_detected"),
        "ks_statistic",
        "ks_pvalue",
        (F.col("ks_pvalue") < fv.KS_PVALUE_LIMIT).alias("ks_drift_detected"),
    )


def retraining_policy(
    report: DataFrame, state: DataFrame, tenant: Sequence[str] = TENANT
) -> DataFrame:
    """Whether and why each tenant should retrain.

    ``state`` has one row per tenant: current_mape, baseline_mape, days_since_last_training and
    manual_trigger, each possibly NULL. The KS flag is reported by ``drift_report`` only.
    """
    drifted = report.filter("psi_drift_detected").groupBy(*tenant).agg(
        F.array_sort(F.collect_set("feature")).alias("_features")  # a handful of feature names
    )
    worse = (F.col("current_mape") - F.col("baseline_mape")) / F.col("baseline_mape") * 100
    names = F.concat(F.lit("['"), F.concat_ws("', '", "_features"), F.lit("']"))
    reasons = F.array_compact(
        F.array(
            F.when(
                F.col("_features").isNotNull(),
                F.concat(F.lit(f"PSI drift > {fv.PSI_LIMIT} on features: "), names),
            ),
            F.when(
                (F.col("baseline_mape") > 0) & (worse > fv.MAPE_INCREASE_LIMIT_PCT),
                F.concat(
                    F.lit("Forecast MAPE increased "),
                    F.format_string("%.1f", worse),
                    F.lit(f"% from baseline (threshold {fv.MAPE_INCREASE_LIMIT_PCT}%)"),
                ),
            ),
            F.when(
                F.col("days_since_last_training") >= fv.RETRAIN_DAYS,
                F.concat(
                    F.lit("Weekly schedule elapsed ("),
                    F.col("days_since_last_training").cast("string"),
                    F.lit(" days since last training)"),
                ),
            ),
            F.when(F.col("manual_trigger"), F.lit("Manual trigger via API")),
        )
    )
    return state.join(drifted, list(tenant), "left").select(
        *tenant, (F.size(reasons) > 0).alias("should_retrain"), reasons.alias("reasons")
    )

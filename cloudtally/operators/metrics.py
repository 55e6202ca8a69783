"""Questions with a fixed shape: period comparisons, KPIs, rankings, chart data, reports.

Everything is per tenant in one job. Conditional aggregates answer several windows in a single
pass, and distinct resources are collapsed before they are counted.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cloudtally import fixed_values as fv
from cloudtally.functions.numeric import MONEY, banded, clamp, half_up, money_sum
from cloudtally.functions.skew import sized_join
from cloudtally.operators.series import latest_rows, top_rows
from cloudtally.runtime import durable

TENANT = ("organization_id",)
WASTEFUL = ("Idle", "Critical Waste", "Underutilized")


def newest_dates(df: DataFrame, tenant: Sequence[str] = TENANT) -> DataFrame:
    """Each tenant's newest date, stored once for every question that is anchored to it."""
    return durable(df.groupBy(*tenant).agg(F.max("date").alias("_last")))


def with_newest(
    df: DataFrame, tenant: Sequence[str] = TENANT, newest: DataFrame | None = None
) -> DataFrame:
    """Attach each tenant's newest date as ``_last``."""
    return sized_join(df, newest_dates(df, tenant) if newest is None else newest, tenant)


def _when_sum(cond: Column, c: Column) -> Column:
    return F.coalesce(F.sum(F.when(cond, c.cast(MONEY))), F.lit(0).cast(MONEY)).cast("double")


def _change_pct(now: Column, then: Column) -> Column:
    return half_up((now / F.greatest(then, F.lit(1e-6)) - 1) * 100, 2)


# --- period comparisons ---------------------------------------------------------------------------
def _thirty_days() -> tuple[Column, Column]:
    """The last 31 calendar days (both ends count) and the 30 before them."""
    d, last = F.col("date"), F.col("_last")
    this = d >= F.date_sub(last, 30)
    return this, (d < F.date_sub(last, 30)) & (d >= F.date_sub(last, 60))


def period_compare(df: DataFrame, tenant: Sequence[str] = TENANT) -> DataFrame:
    this, prev = _thirty_days()
    cost = F.col("cost")
    both = with_newest(df, tenant).filter(this | prev)
    return (
        both.groupBy(*tenant)
        .agg(_when_sum(this, cost).alias("_this"), _when_sum(prev, cost).alias("_prev"))
        .select(
            *tenant,
            half_up(F.col("_this"), 2).alias("this_period_cost"),
            half_up(F.col("_prev"), 2).alias("last_period_cost"),
            _change_pct(F.col("_this"), F.col("_prev")).alias("pct_change"),
        )
        .withColumn(
            "difference", half_up(F.col("this_period_cost") - F.col("last_period_cost"), 2)
        )
    )


def service_delta(df: DataFrame, tenant: Sequence[str] = TENANT, k: int = 3) -> DataFrame:
    """Services whose 30-day cost grew most. A service present in one period only counts as 0."""
    this, prev = _thirty_days()
    sums = (
        with_newest(df.filter(F.col("service").isNotNull()), tenant)
        .filter(this | prev)
        .groupBy(*tenant, "service")
        .agg(
            F.sum(F.when(this, F.col("cost").cast(MONEY))).alias("_a"),
            F.sum(F.when(prev, F.col("cost").cast(MONEY))).alias("_b"),
        )
        .withColumn("increase", half_up(F.coalesce((F.col("_a") - F.col("_b")).cast("double"), F.lit(0.0)), 2))
    )
    order = [F.desc("increase"), F.asc("service")]
    return top_rows(sums.select(*tenant, "service", "increase"), tenant, order, k)


def top_services(
    df: DataFrame,
    tenant: Sequence[str] = TENANT,
    k: int = 3,
    days: int = 7,
    newest: DataFrame | None = None,
) -> DataFrame:
    sums = (
        with_newest(df, tenant, newest)
        .filter((F.col("date") > F.date_sub("_last", days)) & F.col("service").isNotNull())
        .groupBy(*tenant, "service")
        .agg(half_up(money_sum(F.col("cost")), 2).alias("cost"))
    )
    return top_rows(sums, tenant, [F.desc("cost"), F.asc("service")], k)


def _as_map(df: DataFrame, tenant: Sequence[str], key: str, value: str, out: str) -> DataFrame:
    """Few (key, value) rows per tenant as one map column."""
    return df.groupBy(*tenant).agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct(key, value)))).alias(out)
    )


def weekly_snapshot(
    billing: DataFrame,
    waste: DataFrame | None = None,
    anomalies: DataFrame | None = None,
    tenant: Sequence[str] = TENANT,
) -> DataFrame:
    """This week against the one before, per tenant; each week is (start, end] over 7 days."""
    tenant = list(tenant)
    newest = newest_dates(billing, tenant)
    d, last = F.col("date"), F.col("_last")
    this = d > F.date_sub(last, 7)
    prior = (d > F.date_sub(last, 14)) & ~this
    per_resource = (
        with_newest(billing, tenant, newest)
        .filter(this | prior)
        .groupBy(*tenant, "_last", "resource_id")
        .agg(
            F.sum(F.when(this, F.col("cost").cast(MONEY))).alias("_this"),
            F.sum(F.when(prior, F.col("cost").cast(MONEY))).alias("_prior"),
            F.max(this).alias("_active"),
        )
    )
    zero = F.lit(0).cast(MONEY)
    out = (
        per_resource.groupBy(*tenant, "_last")
        .agg(
            half_up(F.coalesce(F.sum("_this"), zero).cast("double"), 2).alias("this_week_total_cost"),
            half_up(F.coalesce(F.sum("_prior"), zero).cast("double"), 2).alias("prior_week_total_cost"),
            F.count_if(F.col("_active") & F.col("resource_id").isNotNull()).alias(
                "active_resource_count"
            ),
        )
        .select(
            *tenant,
            F.date_sub("_last", 7).alias("period_start"),
            F.col("_last").alias("period_end"),
            "this_week_total_cost",
            "prior_week_total_cost",
            _change_pct(F.col("this_week_total_cost"), F.col("prior_week_total_cost")).alias(
                "pct_change_vs_prior_week"
            ),
            "active_resource_count",
        )
    )
    # one row per tenant on both sides from here on: at most 3 services, 4 buckets, 4 severities
    ranked = top_services(billing, tenant, newest=newest)
    out = out.join(_as_map(ranked, tenant, "service", "cost", "top_services_by_cost"), tenant, "left")
    if waste is not None:
        recent = with_newest(waste, tenant, newest).filter(this)
        counts = recent.groupBy(*tenant, "bucket").agg(F.count("*").alias("n"))
        out = out.join(_as_map(counts, tenant, "bucket", "n", "waste_bucket_counts"), tenant, "left")
    if anomalies is not None:
        recent = with_newest(anomalies, tenant, newest).filter(this)
        counts = recent.groupBy(*tenant, "severity").agg(F.count("*").alias("n"))
        by_severity = _as_map(counts, tenant, "severity", "n", "anomalies_by_severity")
        total = F.aggregate(F.map_values("anomalies_by_severity"), F.lit(0).cast("long"), lambda x, n: x + n)
        out = out.join(by_severity, tenant, "left").withColumn(
            "anomaly_count_this_week", F.coalesce(total, F.lit(0).cast("long"))
        )
    return out


def latest_insights(insights: DataFrame, tenant: Sequence[str] = TENANT, order: str = "created_at") -> DataFrame:
    """The newest insight of every dataset."""
    return latest_rows(insights, [*tenant, "dataset_id"], order)


def dataset_history(datasets: DataFrame, tenant: Sequence[str] = TENANT, order: str = "created_at") -> DataFrame:
    """Uploads with their place in the tenant's history, the newest first."""
    w = Window.partitionBy(*tenant).orderBy(F.desc(order), F.desc("dataset_id"))
    return datasets.withColumn("position", F.row_number().over(w))


def as_report(snapshot: DataFrame, tenant: Sequence[str] = TENANT) -> DataFrame:
    """Snapshot rows in stored form: tenant, period and the metrics as JSON."""
    skip = {*tenant, "period_start", "period_end"}
    metrics = F.to_json(F.struct(*[c for c in snapshot.columns if c not in skip]))
    return snapshot.select(*tenant, "period_start", "period_end", metrics.alias("metrics_snapshot"))


def report_rows(reports: DataFrame, tenant: Sequence[str] = TENANT) -> DataFrame:
    """Stored reports as (metric, value) rows for export."""
    pairs = F.from_json("metrics_snapshot", "map<string,string>")
    return reports.select(*tenant, "period_start", F.explode(pairs).alias("metric", "value"))


def spend_trend(reports: DataFrame, tenant: Sequence[str] = TENANT) -> DataFrame:
    def number(name):
        return F.coalesce(
            F.get_json_object("metrics_snapshot", f"$.{name}").cast("double"), F.lit(0.0)
        )

    return reports.select(
        *tenant,
        F.date_format("period_start", "MM-dd").alias("period"),
        number("this_week_total_cost").alias("spend"),
        number("prior_week_total_cost").alias("prior"),
    ).orderBy(*tenant, "period")


# --- rankings and lists -------------------------------------------------------------------------------
def terminate_candidates(scored: DataFrame, tenant: Sequence[str] = TENANT, k: int = 5) -> DataFrame:
    cols = [c for c in ("resource_id", "waste_score", "bucket", "cpu_avg_pct") if c in scored.columns]
    idle = scored.filter(F.col("bucket").isin("Critical Waste", "Idle")).select(*tenant, *cols)
    return top_rows(idle, tenant, [F.desc_nulls_last("waste_score"), F.asc("resource_id")], k)


def top_metric(df: DataFrame, metric: str, tenant: Sequence[str] = TENANT) -> DataFrame:
    """The resource-day with the highest non-null value of a metric, ties to the earliest id and day."""
    return top_metrics(df, [metric], tenant)


def top_metrics(df: DataFrame, wanted: Sequence[str], tenant: Sequence[str] = TENANT) -> DataFrame:
    """``top_metric`` for several metrics in one pass: a row per tenant and metric that has a value."""
    columns = list(dict.fromkeys(fv.METRIC_COLUMNS.get(m, "cpu_avg_pct") for m in wanted))
    for column in columns:
        if column not in df.columns:
            raise ValueError(f"column {column} is not available")

    def best(column):
        rank = F.struct(-F.col(column), F.col("resource_id"), F.col("date"))
        row = F.struct(F.lit(column).alias("metric"), "resource_id", "date", half_up(F.col(column), 2).cast("double").alias("value"))
        return F.min_by(row, F.when(F.col(column).isNotNull(), rank)).alias(f"_{column}")

    found = df.groupBy(*tenant).agg(*[best(c) for c in columns])
    rows = F.explode(F.array_compact(F.array(*[f"_{c}" for c in columns])))
    return found.select(*tenant, rows.alias("_b")).select(*tenant, "_b.*")


def idle_list(scored: DataFrame, tenant: Sequence[str] = TENANT, k: int = 20) -> DataFrame:
    """First ``k`` idle resources by id with their newest score, and how many there are in all."""
    tenant = list(tenant)
    idle = scored.filter(F.col("bucket").isin("Idle", "Critical Waste"))
    newest = latest_rows(
        idle.select(*tenant, "resource_id", "date", "bucket", "waste_score"), [*tenant, "resource_id"]
    )
    totals = newest.groupBy(*tenant).agg(F.count("*").alias("idle_resource_count"))
    listed = top_rows(newest.drop("date"), tenant, [F.asc("resource_id")], k)
    return sized_join(listed, totals, tenant)


def top_anomalies(
    anomalies: DataFrame, severity: str | None = None, limit: int = 100, tenant: Sequence[str] = TENANT
) -> DataFrame:
    """Highest incident scores per tenant, at most 1000 as the listing allows."""
    if not 1 <= limit <= 1000:
        raise ValueError("limit must be between 1 and 1000")
    rows = anomalies if severity is None else anomalies.filter(F.col("severity") == severity)
    order = [F.desc("incident_score"), F.asc("resource_id"), F.asc("date")]
    return top_rows(rows, tenant, order, limit)


def top_flagged(anomalies: DataFrame, tenant: Sequence[str] = TENANT, k: int = 5) -> DataFrame:
    counts = anomalies.groupBy(*tenant, "resource_id").agg(F.count("*").alias("anomalies"))
    return top_rows(counts, tenant, [F.desc("anomalies"), F.asc("resource_id")], k)


def top_wasted(scored: DataFrame, tenant: Sequence[str] = TENANT, k: int = 5) -> DataFrame:
    cols = scored.select(*tenant, "resource_id", "date", "waste_score", "bucket")
    return top_rows(cols, tenant, [F.desc("waste_score"), F.asc("resource_id"), F.asc("date")], k)


# --- counts for charts -----------------------------------------------------------------------------------
def counts_by(df: DataFrame, *columns: str, out: str = "n") -> DataFrame:
    return df.groupBy(*columns).agg(F.count("*").alias(out))


def score_bands(df: DataFrame, score: str, kind: str, tenant: Sequence[str] = TENANT) -> DataFrame:
    bands, floor = {
        "incident": (fv.INCIDENT_CHART_BANDS, fv.INCIDENT_CHART_FLOOR),
        "waste": (fv.WASTE_CHART_BANDS, fv.WASTE_CHART_FLOOR),
    }[kind]
    band = banded(F.col(score), bands, floor).alias("band")
    return df.groupBy(*tenant, band).agg(F.count("*").alias("n"))


def anomalies_by_prefix(anomalies: DataFrame, tenant: Sequence[str] = TENANT) -> DataFrame:
    prefix = F.upper(F.split_part("resource_id", F.lit("-"), F.lit(1)))
    name = F.when(prefix != "", prefix).otherwise(F.lit("OTHER")).alias("prefix")
    return anomalies.groupBy(*tenant, name).agg(F.count("*").alias("n"))


# --- recommendations ----------------------------------------------------------------------------------------
def tier_savings(recs: DataFrame, tenant: Sequence[str] = TENANT) -> DataFrame:
    return recs.groupBy(*tenant, "impact_tier").agg(
        half_up(money_sum(F.col("estimated_savings")), 2).alias("savings"),
        F.count("*").alias("n"),
        F.count_if(F.col("status") == "open").alias("open_n"),
        F.count_if(F.col("status") == "accepted").alias("accepted_n"),
    )


def recommendation_metrics(
    recs: DataFrame, waste_latest: DataFrame, tenant: Sequence[str] = TENANT
) -> DataFrame:
    """Coverage of wasteful resources, mean savings and confidence, sizes."""
    base = waste_latest.groupBy(*tenant).agg(
        F.count_if(F.col("bucket").isin(*WASTEFUL)).alias("_wasteful"),
        F.count("*").alias("total_analyzed_resources"),
    )
    made = recs.groupBy(*tenant).agg(
        F.count("*").alias("_n"),
        money_sum(F.col("estimated_savings")).alias("_savings"),
        money_sum(F.col("confidence")).alias("_confidence"),
    )
    n = F.coalesce("_n", F.lit(0))

    def mean(c):
        return half_up(F.coalesce(F.col(c) / F.nullif(n, F.lit(0)), F.lit(0.0)), 2)

    return base.join(made, list(tenant), "left").select(
        *tenant,
        half_up(n / F.greatest(F.col("_wasteful"), F.lit(1)) * 100, 2).alias(
            "recommendation_coverage_pct"
        ),
        mean("_savings").alias("avg_estimated_monthly_savings"),
        mean("_confidence").alias("avg_confidence"),
        n.alias("total_recommendations"),
        "total_analyzed_resources",
    )


def idle_savings(recs: DataFrame, waste_latest: DataFrame, tenant: Sequence[str] = TENANT) -> DataFrame:
    """Savings of the recommendations whose resource is idle or critical now."""
    keys = [*tenant, "resource_id"]
    idle = waste_latest.filter(F.col("bucket").isin("Idle", "Critical Waste")).select(*keys).distinct()
    return recs.join(idle, keys, "left_semi").groupBy(*tenant).agg(
        half_up(money_sum(F.col("estimated_savings")), 2).alias("idle_savings"),
        F.count("*").alias("n"),
    )


# --- KPI rows -------------------------------------------------------------------------------------------------
def spend(billing: DataFrame, tenant: Sequence[str] = TENANT) -> DataFrame:
    """Total and trailing-30-day spend with distinct resources, one row per tenant."""
    recent = F.col("date") >= F.date_sub("_last", 30)
    per_resource = (
        with_newest(billing, tenant)
        .groupBy(*tenant, "resource_id")
        .agg(
            F.sum(F.col("cost").cast(MONEY)).alias("_all"),
            F.sum(F.when(recent, F.col("cost").cast(MONEY))).alias("_recent"),
        )
    )
    zero = F.lit(0).cast(MONEY)
    return per_resource.groupBy(*tenant).agg(
        half_up(F.coalesce(F.sum("_all"), zero).cast("double"), 2).alias("total_spend"),
        half_up(F.coalesce(F.sum("_recent"), zero).cast("double"), 2).alias("spend_30d"),
        F.count("resource_id").alias("active_resource_count"),
    )


def newest_forecast(forecasts: DataFrame, tenant: Sequence[str] = TENANT) -> DataFrame:
    org = forecasts.filter(F.col("level") == "org_total")
    return org.groupBy(*tenant).agg(
        half_up(F.max_by("forecast", "forecast_date"), 2).alias("forecast_next_period")
    )


def dashboard(
    billing: DataFrame,
    anomalies: DataFrame,
    forecasts: DataFrame,
    recs: DataFrame,
    tenant: Sequence[str] = TENANT,
) -> DataFrame:
    """Headline KPIs per tenant. Totals and true 30-day figures are separate columns."""
    tenant = list(tenant)
    flagged = anomalies.groupBy(*tenant).agg(F.count("*").alias("_anomalies"))
    saved = recs.filter(F.col("status") == "open").groupBy(*tenant).agg(
        money_sum(F.col("estimated_savings")).alias("_saved")
    )
    return (
        spend(billing, tenant)
        .join(newest_forecast(forecasts, tenant), tenant, "left")
        .join(flagged, tenant, "left")
        .join(saved, tenant, "left")
        .select(
            *tenant,
            "total_spend",
            "spend_30d",
            "forecast_next_period",
            F.coalesce("_anomalies", F.lit(0)).alias("anomaly_count"),
            half_up(F.coalesce("_saved", F.lit(0.0)), 2).alias("savings_identified"),
            "active_resource_count",
        )
    )


def _pct(a: Column, b: Column, digits: int = 1) -> Column:
    return half_up(F.coalesce(a / F.nullif(b, F.lit(0)) * 100, F.lit(0.0)), digits)


def business_kpis(
    billing: DataFrame,
    waste: DataFrame,
    anomalies: DataFrame,
    recs: DataFrame,
    registry: DataFrame | None = None,
    tenant: Sequence[str] = TENANT,
    per_classification: bool = False,
) -> DataFrame:
    """Savings, coverage, opportunity, confidence, reduction potential and health per tenant.

    Coverage and reduction divide resources by resources. ``per_classification`` divides by
    stored classification rows instead, which shrinks as nightly rows pile up.
    """
    tenant = list(tenant)
    resources = billing.select(*tenant, "resource_id").distinct().groupBy(*tenant).agg(
        F.count("resource_id").alias("_resources")
    )
    per_resource = waste.groupBy(*tenant, "resource_id").agg(
        F.count_if(F.col("bucket").isin(*WASTEFUL)).alias("_w"),
        F.count_if(F.col("bucket").isin("Idle", "Critical Waste")).alias("_i"),
    )
    wasteful = per_resource.groupBy(*tenant).agg(
        F.sum("_w").alias("_waste_rows"),
        F.count_if(F.col("_w") > 0).alias("_waste_resources"),
        F.sum("_i").alias("_idle_rows"),
        F.count_if(F.col("_i") > 0).alias("_idle_resources"),
    )
    advised = (
        recs.filter(F.col("status") == "open")
        .groupBy(*tenant, "resource_id")
        .agg(
            F.sum(F.col("estimated_savings").cast(MONEY)).alias("_s"),
            F.sum(F.col("confidence").cast(MONEY)).alias("_c"),
            F.count("confidence").alias("_cn"),
            F.max(F.col("action").ilike("%terminat%")).alias("_t"),
        )
        .groupBy(*tenant)
        .agg(
            F.sum("_s").cast("double").alias("_savings"),
            F.sum("_c").cast("double").alias("_conf"),
            F.sum("_cn").alias("_conf_n"),
            F.count("resource_id").alias("_advised"),
            F.count_if("_t").alias("_stops"),
        )
    )
    flagged = anomalies.groupBy(*tenant).agg(F.count("*").alias("_anomalies"))
    joined = resources
    for part in (wasteful, advised, flagged):
        joined = joined.join(part, tenant, "left")

    def col(name):
        return F.coalesce(F.col(name), F.lit(0))

    waste_base = col("_waste_rows" if per_classification else "_waste_resources")
    idle_base = col("_idle_rows" if per_classification else "_idle_resources")
    conf = F.coalesce(F.col("_conf") / F.nullif(col("_conf_n"), F.lit(0)), F.lit(0.0))
    risk = 0.5 * F.coalesce(col("_waste_resources") / F.nullif(col("_resources"), F.lit(0)), F.lit(0.0)) + (
        0.5 * F.least(col("_anomalies") / 50.0, F.lit(1.0))
    )
    out = joined.select(
        *tenant,
        half_up(F.coalesce("_savings", F.lit(0.0)), 2).alias("estimated_monthly_savings"),
        _pct(col("_advised"), waste_base).alias("waste_detection_coverage_pct"),
        _pct(col("_waste_resources"), col("_resources")).alias("optimization_opportunity_rate_pct"),
        half_up(F.when(conf <= 1, conf * 100).otherwise(conf), 1).alias(
            "avg_recommendation_confidence_pct"
        ),
        F.when(idle_base > 0, _pct(col("_stops"), idle_base)).alias(
            "idle_resource_reduction_potential_pct"
        ),
        half_up((1 - risk) * 100, 1).alias("infrastructure_health_score"),
    )
    if registry is None:
        return out
    # one registry row, which serves every tenant: the value travels as a literal, without a join
    best = registry.filter((F.col("model_type") == "forecast") & F.col("is_active")).agg(
        half_up(
            F.max_by(F.try_element_at("evaluation_metrics", F.lit("error_reduction_pct")), "training_date"), 1
        ).alias("forecast_error_reduction_pct")
    )
    value = best.first()[0]
    return out.withColumn("forecast_error_reduction_pct", F.lit(value).cast(best.schema[0].dataType))


def health(
    inputs: DataFrame,
) -> DataFrame:
    """Risk 0-100 from growth, waste ratio and anomaly count, and health as its complement."""
    total = F.lit(0.0)
    for column, (weight, low, high) in fv.RISK_TERMS.items():
        total = total + weight * clamp((F.col(column) - low) / (high - low), 0.0, 1.0)
    return inputs.withColumn("risk_score", half_up(total * 100, 2)).withColumn(
        "infrastructure_health_score", half_up(100 - F.col("risk_score"), 2)
    )


def cost_efficiency(billing: DataFrame, tenant: Sequence[str] = TENANT) -> DataFrame:
    """CPU-hours actually used per unit of money."""
    used = F.col("cpu_avg_pct") / 100 * F.col("usage_hours")
    sums = billing.groupBy(*tenant).agg(money_sum(used).alias("_cpu"), money_sum(F.col("cost")).alias("_cost"))
    score = F.when(F.col("_cost") > 0, F.col("_cpu") / F.col("_cost")).otherwise(F.lit(0.0))
    return sums.select(*tenant, half_up(score, 4).alias("cost_efficiency_score"))


def insight_snapshot(
    billing: DataFrame,
    datasets: DataFrame,
    anomalies: DataFrame,
    waste: DataFrame,
    forecasts: DataFrame,
    recs: DataFrame,
    tenant: Sequence[str] = TENANT,
) -> DataFrame:
    """Figures behind the executive insight, spend restricted to the active dataset."""
    tenant = list(tenant)
    total = in_active_dataset(billing, datasets, tenant).groupBy(*tenant).agg(
        half_up(money_sum(F.col("cost")), 2).alias("total_spend")
    )
    flagged = anomalies.groupBy(*tenant).agg(F.count("*").alias("_a"))
    idle = waste.groupBy(*tenant).agg(F.count_if(F.col("bucket").isin("Idle", "Critical Waste")).alias("_i"))
    saved = recs.filter(F.col("status") == "open").groupBy(*tenant).agg(
        money_sum(F.col("estimated_savings")).alias("_s")
    )
    return (
        total.join(flagged, tenant, "left")
        .join(saved, tenant, "left")
        .join(idle, tenant, "left")
        .join(newest_forecast(forecasts, tenant), tenant, "left")
        .select(
            *tenant,
            "total_spend",
            F.coalesce("_a", F.lit(0)).alias("anomaly_count"),
            half_up(F.coalesce("_s", F.lit(0.0)), 2).alias("potential_savings"),
            F.coalesce("_i", F.lit(0)).alias("idle_resources"),
            F.col("forecast_next_period").alias("forecast_next"),
        )
    )


def insight_text(snapshot: DataFrame) -> DataFrame:
    """The fixed bullet template; a figure that is zero or missing drops its bullet."""

    def money(label, c):
        return F.when(
            F.col(c) != 0, F.concat(F.lit(f"• {label}: $"), F.format_number(F.col(c).cast("decimal(28,2)"), 2))
        )

    lines = F.concat_ws(
        "\n",
        money("Total cloud spend", "total_spend"),
        F.concat(F.lit("• Anomalies detected: "), F.col("anomaly_count").cast("string")),
        money("Potential monthly savings", "potential_savings"),
        money("Forecast (next period)", "forecast_next"),
        F.when(
            F.col("idle_resources") != 0,
            F.concat(F.lit("• Idle/critical waste resources: "), F.col("idle_resources").cast("string")),
        ),
    )
    empty = F.lit("Upload a dataset and run the ML pipeline to generate insights.")
    return snapshot.withColumn("insight_text", F.when(lines == "", empty).otherwise(lines))


def in_active_dataset(df: DataFrame, datasets: DataFrame, tenant: Sequence[str] = TENANT) -> DataFrame:
    """Rows of the tenant's active upload."""
    active = datasets.filter("active_flag").select(*tenant, "dataset_id").distinct()
    return sized_join(df, active, [*tenant, "dataset_id"], "left_semi")


# --- forecasts and models --------------------------------------------------------------------------------------
def forecast_by_service(forecasts: DataFrame, tenant: Sequence[str] = TENANT) -> DataFrame:
    """Newest forecast per service with its interval width in percent of the forecast."""
    newest = F.max_by(F.struct("forecast", "ci_lower", "ci_upper"), "forecast_date")
    width = (F.col("_f.ci_upper") - F.col("_f.ci_lower")) / F.greatest(F.col("_f.forecast"), F.lit(1.0)) * 100
    return (
        forecasts.filter(F.col("level") == "per_service")
        .groupBy(*tenant, "service")
        .agg(newest.alias("_f"), F.max("forecast_date").alias("forecast_date"))
        .select(
            *tenant,
            "service",
            "forecast_date",
            half_up(F.col("_f.forecast"), 2).alias("forecast"),
            half_up(F.col("_f.ci_lower"), 2).alias("ci_lower"),
            half_up(F.col("_f.ci_upper"), 2).alias("ci_upper"),
            half_up(width, 1).alias("ci_width_pct"),
        )
    )


def forecast_lookup(
    forecasts: DataFrame, service: str | None = None, tenant: Sequence[str] = TENANT
) -> DataFrame:
    """Newest forecast of the asked scope, a service or the whole tenant."""
    scope = (
        forecasts.filter(F.col("level") == "org_total")
        if service is None
        else forecasts.filter(F.col("service") == service)
    )
    newest = F.max_by(F.struct("forecast", "ci_lower", "ci_upper"), "forecast_date").alias("_f")
    return scope.groupBy(*tenant).agg(newest).select(
        *tenant,
        F.lit(service or "org_total").alias("service"),
        *[half_up(F.col(f"_f.{c}"), 2).alias(c) for c in ("forecast", "ci_lower", "ci_upper")],
    )

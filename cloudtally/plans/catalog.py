"""Every operator as a query over the given tables, with its check in plain SQL."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cloudtally import fixed_values as fv
from cloudtally.functions.numeric import clamp, half_up
from cloudtally.operators import (
    advice,
    anomaly,
    drift,
    evaluate,
    features,
    gold,
    metrics,
    quality,
    registry,
    retrieve,
    silver,
    waste,
)
from cloudtally.operators.models import attribution, forecast, isolation, quantile_boost, waste_classifier
from cloudtally.operators.series import SERIES, latest_rows
from cloudtally.plans import fixtures as fx
from cloudtally.plans.oracle import ANOM_PARTS, DIMS, SERIES_W, band, clip, money, r, sql
from cloudtally.runtime import durable, new_folder
from cloudtally.sources import csv_upload, pricing, store
from cloudtally.streaming import ingest

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, check: str | None = None):
    def keep(fn):
        QUERIES[name] = fn
        if check is not None:
            ORACLE[name] = sql(check)
        return fn

    return keep


def rounded(df: DataFrame, digits: int, *columns: str) -> DataFrame:
    return df.withColumns({c: half_up(F.col(c), digits) for c in columns})


KEY = "organization_id, resource_id, date"
KEYS = ["organization_id", "resource_id", "date"]


# --- quality and ingest ---------------------------------------------------------------------
@query("validate_failures", "SELECT * FROM fails")
def _(spark, d):
    return quality.failures(fx.upload_rows(spark, d), require_region=True, require_known_type=True)


@query(
    "validate_summary",
    """SELECT rule, count(*) AS failures, (SELECT count(*) FROM up) AS total_rows,
              (SELECT count(*) FROM fails) AS total_failures FROM fails GROUP BY rule""",
)
def _(spark, d):
    rows = fx.upload_rows(spark, d)
    return quality.summary(rows, quality.failures(rows, require_region=True, require_known_type=True))


@query(
    "audit_records",
    """SELECT organization_id, 'validation_failure' AS event_type, severity, row_id, rule, 'csv_upload' AS source_tier FROM fails""",
)
def _(spark, d):
    found = quality.failures(fx.upload_rows(spark, d), require_region=True, require_known_type=True)
    logged = quality.audit_records(found, "csv_upload")
    return logged.select(
        "organization_id",
        "event_type",
        "severity",
        *[F.get_json_object("details", f"$.{c}").alias(c) for c in ("row_id", "rule", "source_tier")],
    )


@query(
    "header_map",
    """SELECT CAST(l_shipdate AS DATE) AS date, concat('svc ', l_returnflag) AS service, concat('vm-', l_suppkey) AS resource_id,
              CASE WHEN l_orderkey % 13 <> 0 THEN l_extendedprice END AS cost, l_quantity AS cpu_avg_pct, l_linestatus AS region
       FROM lineitem WHERE l_orderkey % 11 <> 0
       UNION ALL SELECT NULL, concat('svc ', l_returnflag), concat('vm-', l_suppkey),
              CASE WHEN l_orderkey % 13 <> 0 THEN l_extendedprice END, l_quantity, l_linestatus FROM lineitem WHERE l_orderkey % 11 = 0""",
)
def _(spark, d):
    key = F.col("l_orderkey")
    raw = fx.table(spark, d, "lineitem").select(
        F.when(key % 11 == 0, "soon").otherwise(F.col("l_shipdate").cast("string")).alias("Usage-Date"),
        F.concat(F.lit("svc "), "l_returnflag").alias("service_name"),
        F.concat(F.lit("vm-"), F.col("l_suppkey").cast("string")).alias(" Resource ID"),
        F.when(key % 13 == 0, "n/a").otherwise(F.col("l_extendedprice").cast("string")).alias("amount"),
        F.col("l_quantity").cast("string").alias("CPU Utilization"),
        F.col("l_linestatus").alias("Location"),
        F.col("l_tax").alias("unrelated"),
    )
    return csv_upload.to_internal(raw)


@query(
    "pricing_classify",
    """SELECT concat(lower(p_type), '.csv') AS source_file, count(*) AS n,
              CASE p_type WHEN 'ECONOMY' THEN 'on_demand' WHEN 'SMALL' THEN 'spot' WHEN 'MEDIUM' THEN 'prediction' ELSE 'unknown' END AS classified_as,
              p_type NOT IN ('ECONOMY', 'SMALL', 'MEDIUM') AS needs_manual_mapping,
              CASE p_type WHEN 'ECONOMY' THEN 'Price' WHEN 'SMALL' THEN 'SpotPrice' WHEN 'MEDIUM' THEN 'Price_Prediction' END AS price_column,
              CASE p_type WHEN 'ECONOMY' THEN 'Region' WHEN 'SMALL' THEN 'AvailabilityZone' END AS region_column
       FROM part GROUP BY p_type""",
)
def _(spark, d):
    headers = {
        "ECONOMY": ("InstanceType", "Price", "Region"),
        "SMALL": ("SpotPrice", "AvailabilityZone", "Timestamp"),
        "MEDIUM": ("Instance_Type", "Price_Prediction", "Real_AWS_SpotPrice", "Timestamp"),
    }
    names = F
    for kind, cols in headers.items():
        names = names.when(F.col("p_type") == kind, F.array(*[F.lit(c) for c in cols]))
    files = (
        fx.table(spark, d, "part")
        .groupBy("p_type")
        .agg(F.count("*").alias("n"))
        .withColumn("headers", names.otherwise(F.array(F.lit("foo"), F.lit("cost"))))
    )
    return pricing.classify(files).select(
        F.concat(F.lower("p_type"), F.lit(".csv")).alias("source_file"),
        "n",
        "classified_as",
        "needs_manual_mapping",
        F.col("matched.price").alias("price_column"),
        F.col("matched.region").alias("region_column"),
    )


@query("pricing_silver", "SELECT * FROM prices")
def _(spark, d):
    return silver.prices(fx.price_rows(spark, d))


@query(
    "telemetry_clean",
    f"""SELECT vm_id, ts, event_id, {r('cpu_usage_mhz', 6)} AS cpu_usage_mhz, {r('cpu_usage_percent', 6)} AS cpu_usage_percent,
              memory_usage_mb, {r('memory_utilization_ratio', 6)} AS memory_utilization_ratio,
              {r('cpu_utilization_ratio', 6)} AS cpu_utilization_ratio FROM ready""",
)
def _(spark, d):
    out = silver.clean(fx.telemetry(spark, d)).select(
        "vm_id", F.col("ts").cast("timestamp_ntz").alias("ts"), "event_id", "cpu_usage_mhz", "cpu_usage_percent",
        "memory_usage_mb", "memory_utilization_ratio", "cpu_utilization_ratio",
    )
    return rounded(
        out, 6, "cpu_usage_mhz", "cpu_usage_percent", "memory_utilization_ratio", "cpu_utilization_ratio"
    )


@query(
    "telemetry_daily",
    "SELECT vm_id, date, CAST(cpu_cores AS INT) AS cpu_cores, "
    + ", ".join(f"{r(c, 6)} AS {c}" for c in silver.MEANS + silver.SUMS)
    + " FROM silver",
)
def _(spark, d):
    out = silver.daily(silver.clean(fx.telemetry(spark, d)))
    return rounded(out, 6, *silver.MEANS, *silver.SUMS)


@query(
    "silver_manifest",
    """SELECT 'load_bronze' AS step, (SELECT count(*) FROM f2) AS row_count, CAST(NULL AS BIGINT) AS dropped
       UNION ALL SELECT 'parse_datetime', (SELECT count(*) FROM f2 WHERE ts IS NOT NULL), (SELECT count(*) FROM f2 WHERE ts IS NULL)
       UNION ALL SELECT 'drop_duplicates', (SELECT count(*) FROM f2u), (SELECT count(*) FROM f2) - (SELECT count(*) FROM f2u)
       UNION ALL SELECT 'handle_missing_values', (SELECT count(*) FROM ready), (SELECT count(*) FROM f2u) - (SELECT count(*) FROM ready)
       UNION ALL SELECT 'resample_daily', (SELECT count(*) FROM silver), NULL""",
)
def _(spark, d):
    return silver.manifest(fx.telemetry(spark, d))


@query(
    "null_counts",
    " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, count(*) FILTER ({c} IS NULL) AS nulls FROM f2u" for c in silver.METRICS
    ),
)
def _(spark, d):
    unique = silver.keep_first(fx.telemetry(spark, d), ["vm_id", "ts"], ["src", "event_id"])
    return quality.null_counts(unique, silver.METRICS)


@query(
    "instance_match",
    "SELECT * FROM matched",
)
def _(spark, d):
    return gold.match_instances(gold.footprint(silver.daily(silver.clean(fx.telemetry(spark, d)))))


@query(
    "instance_match_list",
    f"""SELECT vm_id, cpu_cores, ram_gb, CASE WHEN exp(-3 * distance) >= 0.55 THEN instance_type END AS matched_instance_type,
              {r("exp(-3 * distance)", 4)} AS confidence, {r("distance", 4)} AS distance, exp(-3 * distance) < 0.55 AS needs_manual_review
       FROM (SELECT *, row_number() OVER (PARTITION BY vm_id ORDER BY outside, distance, p_partkey) AS rn FROM (
         SELECT m.*, p_partkey, concat('type-', p_partkey) AS instance_type,
                NOT (vcpu / greatest(cpu_cores, 0.01) BETWEEN 0.4 AND 2.5 AND spec_ram / greatest(ram_gb, 0.01) BETWEEN 0.4 AND 2.5) AS outside,
                0.5 * abs(vcpu - cpu_cores) / greatest(vcpu, cpu_cores, 1.0) + 0.5 * abs(spec_ram - ram_gb) / greatest(spec_ram, ram_gb, 1.0) AS distance
         FROM (SELECT s_suppkey AS vm_id, 1.0 + s_suppkey % 90 AS cpu_cores, greatest(s_acctbal, 0.0) / 16 AS ram_gb FROM supplier) m,
              (SELECT p_partkey, CAST(p_size AS DOUBLE) / 2 AS vcpu, (p_retailprice - 900) / 3 AS spec_ram FROM part))) WHERE rn = 1""",
)
def _(spark, d):
    key = F.col("s_suppkey")
    machines = fx.table(spark, d, "supplier").select(
        key.alias("vm_id"), (1.0 + key % 90).alias("cpu_cores"), (F.greatest("s_acctbal", F.lit(0.0)) / 16).alias("ram_gb")
    )
    listed = fx.table(spark, d, "part").select(
        F.col("p_partkey").alias("spec_order"), F.concat(F.lit("type-"), F.col("p_partkey").cast("string")).alias("instance_type"),
        (F.col("p_size").cast("double") / 2).alias("vcpu"), ((F.col("p_retailprice") - 900) / 3).alias("ram_gb"),
    )
    return gold.match_instances(machines, specs=listed)


@query(
    "gold_manifest",
    """SELECT 'load_silver' AS step, 'telemetry_rows' AS measure, count(*) AS n FROM silver
       UNION ALL SELECT 'load_silver', 'pricing_rows', count(*) FROM prices
       UNION ALL SELECT 'instance_matching', 'vms_matched', count(*) FILTER (NOT needs_manual_review) FROM matched
       UNION ALL SELECT 'instance_matching', 'vms_flagged_for_review', count(*) FILTER (needs_manual_review) FROM matched
       UNION ALL SELECT 'write_gold', 'gold_rows', count(*) FROM silver
       UNION ALL SELECT 'write_gold', 'manual_review_rows', count(*) FILTER (needs_manual_review) FROM matched""",
)
def _(spark, d):
    return gold.manifest(durable(silver.daily(silver.clean(fx.telemetry(spark, d)))), silver.prices(fx.price_rows(spark, d)))


@query(
    "latest_insights",
    """SELECT organization_id, dataset_id, concat('i-', month(last)) AS insight_id, last AS created_at
       FROM (SELECT organization_id, concat('ds-', year(date)) AS dataset_id, max(date) AS last FROM f1 GROUP BY 1, 2)""",
)
def _(spark, d):
    made = fx.with_dataset(fx.billing(spark, d)).groupBy("organization_id", "dataset_id", F.month("date").alias("m"))
    insights = made.agg(F.max("date").alias("created_at")).withColumn("insight_id", F.concat(F.lit("i-"), F.col("m").cast("string")))
    return metrics.latest_insights(insights.drop("m"))


@query(
    "dataset_history",
    """SELECT organization_id, dataset_id, CAST(row_number() OVER (PARTITION BY organization_id ORDER BY last DESC, dataset_id DESC) AS INT) AS position
       FROM (SELECT organization_id, concat('ds-', year(date)) AS dataset_id, max(date) AS last FROM f1 GROUP BY 1, 2)""",
)
def _(spark, d):
    uploads = fx.with_dataset(fx.billing(spark, d)).groupBy("organization_id", "dataset_id").agg(F.max("date").alias("created_at"))
    return metrics.dataset_history(uploads).drop("created_at")


@query("rate_lookup", f"SELECT instance_type, {r('hourly_rate', 6)} AS hourly_rate, rate_source FROM rates")
def _(spark, d):
    return rounded(fx.rates(spark, d), 6, "hourly_rate")


@query(
    "gold",
    f"""SELECT date, 'account-1' AS account_id, 'EC2' AS service, CAST(vm_id AS VARCHAR) AS resource_id, matched_instance_type AS instance_type,
              CAST(NULL AS VARCHAR) AS region, {r('24 * hourly_rate', 6)} AS cost, 24.0::DOUBLE AS usage_hours, {r('cpu_usage_percent', 6)} AS cpu_avg_pct,
              {r('memory_utilization_ratio * 100', 2)} AS memory_avg_pct, {r('disk_read_kbps + disk_write_kbps', 6)} AS disk_io,
              {r('network_received_kbps + network_transmitted_kbps', 6)} AS network_io, confidence, rate_source,
              matched_instance_type IS NULL AS needs_manual_pricing,
              CAST(row_number() OVER (PARTITION BY vm_id ORDER BY date) AS INT) AS runtime_days, 0.0::DOUBLE AS cost_growth_rate
       FROM silver LEFT JOIN matched USING (vm_id) LEFT JOIN rates ON instance_type = matched_instance_type""",
)
def _(spark, d):
    days = durable(silver.daily(silver.clean(fx.telemetry(spark, d))))  # the silver stage table
    out = gold.gold(days, silver.prices(fx.price_rows(spark, d)), "account-1")
    return rounded(out, 6, "cost", "cpu_avg_pct", "disk_io", "network_io", "cost_growth_rate")


@query(
    "spec_lookup",
    f"""SELECT row_id, up.instance_type, family, vcpu, ram_gb, {r('hourly_rate', 6)} AS hourly_rate
       FROM up LEFT JOIN specs ON up.instance_type = specs.instance_type LEFT JOIN rates ON up.instance_type = rates.instance_type""",
)
def _(spark, d):
    rows = fx.upload_rows(spark, d).select("row_id", "instance_type")
    return rounded(gold.spec_lookup(rows, silver.prices(fx.price_rows(spark, d))), 6, "hourly_rate")


@query(
    "multi_source_union",
    """SELECT source_file, pricing_type, count(*) AS n, count(DISTINCT region) AS regions FROM prices GROUP BY source_file, pricing_type""",
)
def _(spark, d):
    rows = fx.price_rows(spark, d)
    tiers = [silver.prices(rows.filter(F.col("pricing_type") == t)) for t in fv.RATE_TIERS]
    whole = tiers[0].unionByName(tiers[1]).unionByName(tiers[2])
    return whole.groupBy("source_file", "pricing_type").agg(
        F.count("*").alias("n"), F.count_distinct("region").alias("regions")
    )


@query(
    "min_rows_gate",
    """SELECT organization_id, resource_id, count(*) AS n FROM f1 GROUP BY 1, 2 HAVING count(*) >= 550""",
)
def _(spark, d):
    kept = quality.with_enough_rows(fx.stored_billing(spark, d), list(SERIES), 550)
    return metrics.counts_by(kept, *SERIES)


@query(
    "dataset_scope",
    f"""SELECT organization_id, year(date) AS dataset_year, count(*) AS n, {r(money('cost'), 2)} AS cost FROM f1
       WHERE year(date) = 1994 + CAST(substr(organization_id, 5, 1) AS INT) GROUP BY 1, 2""",
)
def _(spark, d):
    rows = metrics.in_active_dataset(fx.with_dataset(fx.stored_billing(spark, d)), fx.datasets(spark, d))
    return rows.groupBy("organization_id", F.year("date").cast("long").alias("dataset_year")).agg(
        F.count("*").alias("n"), half_up(F.sum(F.col("cost").cast("decimal(28,10)")).cast("double"), 2).alias("cost")
    )


# --- features -----------------------------------------------------------------------------------
@query(
    "time_features",
    f"""SELECT {KEY}, 0 AS hour_of_day, CAST(isodow(date) - 1 AS INT) AS day_of_week, CAST(day(date) AS INT) AS day_of_month,
              CAST(month(date) AS INT) AS month, CASE WHEN isodow(date) >= 6 THEN 1 ELSE 0 END AS is_weekend FROM f1""",
)
def _(spark, d):
    return features.time_features(fx.billing(spark, d).select(*KEYS))


@query("io_features", f"SELECT {KEY}, disk_io AS total_disk_io, network_io AS total_network_io FROM f1")
def _(spark, d):
    out = features.io_features(fx.billing(spark, d))
    return out.select(*KEYS, "total_disk_io", "total_network_io")


@query(
    "util_ratios",
    f"""SELECT {KEY}, {r(clip('cpu_avg_pct / 100', '0.0', '1.0'), 6)} AS cpu_utilization_ratio,
              {r(clip('memory_avg_pct / 100', '0.0', '1.0'), 6)} AS memory_utilization_ratio FROM f1""",
)
def _(spark, d):
    out = features.utilization_ratios(fx.billing(spark, d))
    cols = ("cpu_utilization_ratio", "memory_utilization_ratio")
    return rounded(out.select(*KEYS, *cols), 6, *cols)


ROLLING = [
    (f"rolling_avg_{short}_{n}d", f"avg({c}) OVER ({SERIES_W} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)")
    for c, short in (("cost", "cost"), ("cpu_avg_pct", "cpu"), ("memory_avg_pct", "memory"))
    for n in (7, 30)
]


@query(
    "rolling_lag",
    f"SELECT {KEY}, "
    + ", ".join(f"{r(e, 6)} AS {n}" for n, e in ROLLING)
    + f""", lag(cost, 1) OVER ({SERIES_W}) AS lag_cost_1d, lag(cost, 7) OVER ({SERIES_W}) AS lag_cost_7d,
        lag(cpu_avg_pct, 1) OVER ({SERIES_W}) AS lag_cpu_1d, lag(memory_avg_pct, 1) OVER ({SERIES_W}) AS lag_memory_1d FROM f1""",
)
def _(spark, d):
    out = features.rolling_lag(fx.billing(spark, d))
    names = [n for n, _ in ROLLING]
    return rounded(
        out.select(*KEYS, *names, "lag_cost_1d", "lag_cost_7d", "lag_cpu_1d", "lag_memory_1d"), 6, *names
    )


@query(
    "business_features",
    f"""SELECT {KEY}, {r('cost / greatest(cpu_avg_pct, 1.0)', 6)} AS cost_per_cpu_utilization,
              {r('cost / greatest(memory_avg_pct, 1.0)', 6)} AS cost_per_memory_utilization, {r('cost_growth_rate', 6)} AS cost_growth_rate,
              CAST(runtime_days AS INT) AS runtime_days, CAST(date - min(date) OVER (PARTITION BY organization_id, resource_id) AS INT) AS resource_age_days
       FROM grown""",
)
def _(spark, d):
    out = features.business_features(fx.billing(spark, d))
    per = ("cost_per_cpu_utilization", "cost_per_memory_utilization", "cost_growth_rate")
    return rounded(out.select(*KEYS, *per, "runtime_days", "resource_age_days"), 6, *per)


@query("lagged_zscore", f"SELECT {KEY}, " + ", ".join(f"{r(f'{c}_zscore', 6)} AS {c}_zscore" for c in DIMS) + " FROM z")
def _(spark, d):
    names = [f"{c}_zscore" for c in DIMS]
    return rounded(features.lagged_zscore(fx.billing(spark, d)).select(*KEYS, *names), 6, *names)


@query("idle_days", f"SELECT {KEY}, CAST(idle_days AS BIGINT) AS idle_days FROM idle")
def _(spark, d):
    return features.idle_days(fx.billing(spark, d)).select(*KEYS, "idle_days")


@query(
    "minmax",
    f"""SELECT {KEY}, {r('CASE WHEN hi - lo < 1e-9 THEN 0.0 ELSE greatest(0.0, least(1.0, (cost_growth_rate - lo) / (hi - lo))) END', 6)} AS growth_scaled
       FROM grown JOIN span USING (organization_id)""",
)
def _(spark, d):
    grown = features.growth(fx.stored_billing(spark, d))
    out = waste.min_max(grown, "cost_growth_rate", "growth_scaled")
    return rounded(out.select(*KEYS, "growth_scaled"), 6, "growth_scaled")


@query(
    "daily_series",
    f"SELECT organization_id, date, level, service, {r('cost', 2)} AS cost, active_resource_count FROM series",
)
def _(spark, d):
    return rounded(features.daily_series(fx.billing(spark, d)), 2, "cost")


SUP_W = "PARTITION BY level, service ORDER BY date"
SUP_KEYS = ("level", "service")


def _supervised_sql(last: str) -> str:
    return f"""SELECT date, level, service, cost, active_resource_count, CAST(isodow(date) - 1 AS INT) AS day_of_week, CAST(day(date) AS INT) AS day_of_month,
              {r(f'avg(cost) OVER ({SUP_W} ROWS BETWEEN {6 if last == "CURRENT ROW" else 7} PRECEDING AND {last})', 4)} AS rolling_avg_7d,
              {r(f'avg(cost) OVER ({SUP_W} ROWS BETWEEN {29 if last == "CURRENT ROW" else 30} PRECEDING AND {last})', 4)} AS rolling_avg_30d,
              lag(cost, 1) OVER ({SUP_W}) AS lag_1d, lag(cost, 7) OVER ({SUP_W}) AS lag_7d FROM f4all"""


def _supervised(spark, d, include_current):
    daily = fx.daily_orders(spark, d).drop("organization_id")
    out = features.supervised(daily, SUP_KEYS, include_current=include_current)
    return rounded(out, 4, "rolling_avg_7d", "rolling_avg_30d")


@query("supervised", _supervised_sql("1 PRECEDING"))
def _(spark, d):
    return _supervised(spark, d, False)


@query("supervised_current", _supervised_sql("CURRENT ROW"))
def _(spark, d):
    return _supervised(spark, d, True)


# --- scores ---------------------------------------------------------------------------------------
@query("waste_score", f"SELECT {KEY}, waste_score, bucket FROM scored")
def _(spark, d):
    return fx.scored(spark, d).select(*KEYS, "waste_score", "bucket")


@query("incident_fuse", f"SELECT {KEY}, incident_score, severity FROM anom")
def _(spark, d):
    return fx.anomalies(spark, d).select(*KEYS, "incident_score", "severity")


@query(
    "incident_daily",
    f"""SELECT organization_id, date, {r('avg(incident_score)', 2)} AS avg_incident_score,
              count(*) FILTER (severity IN ('high', 'critical')) AS high_severity_count FROM anom GROUP BY 1, 2""",
)
def _(spark, d):
    return anomaly.incident_daily(fx.anomalies(spark, d))


@query("waste_latest", f"SELECT {KEY}, waste_score, bucket, {r('cost_growth_rate', 6)} AS cost_growth_rate FROM scored_latest")
def _(spark, d):
    out = latest_rows(fx.scored(spark, d).select(*KEYS, "waste_score", "bucket", "cost_growth_rate"), SERIES, keep_ties=True)
    return rounded(out, 6, "cost_growth_rate")


@query("waste_latest_day", f"""SELECT {KEY}, waste_score, bucket FROM scored JOIN last_day USING (organization_id) WHERE date = last_date""")
def _(spark, d):
    st = fx.Stages(spark, d)
    latest = anomaly.latest_day(st.scored, source=st.billing)
    return latest.select(*KEYS, "waste_score", "bucket")


@query("bucket_counts", "SELECT organization_id, service, bucket, count(*) AS n FROM scored_latest GROUP BY 1, 2, 3")
def _(spark, d):
    return metrics.counts_by(fx.scored_latest(spark, d), "organization_id", "service", "bucket")


@query(
    "risk_health",
    f"""SELECT organization_id, risk_score, {r('100 - risk_score', 2)} AS infrastructure_health_score FROM (
         SELECT organization_id, {r('(0.4 * greatest(0.0, least(1.0, (growth + 20) / 70)) + 0.3 * greatest(0.0, least(1.0, ratio / 100)) + 0.3 * greatest(0.0, least(1.0, n / 50))) * 100', 2)} AS risk_score
         FROM (SELECT organization_id, {r('(t / greatest(p, 1e-6) - 1) * 100', 2)} AS growth FROM (
                 SELECT organization_id, coalesce(CAST(sum(CAST(cost AS DECIMAL(28,10))) FILTER (date >= last_date - 30) AS DOUBLE), 0) AS t,
                        coalesce(CAST(sum(CAST(cost AS DECIMAL(28,10))) FILTER (date < last_date - 30 AND date >= last_date - 60) AS DOUBLE), 0) AS p
                 FROM f1_last GROUP BY 1)) g
         JOIN (SELECT organization_id, count(*) FILTER (bucket <> 'Healthy') * 100.0::DOUBLE / count(*) AS ratio FROM scored_latest GROUP BY 1) w USING (organization_id)
         JOIN (SELECT organization_id, CAST(count(*) FILTER (severity = 'critical') AS DOUBLE) AS n FROM anom GROUP BY 1) a USING (organization_id))""",
)
def _(spark, d):
    st = fx.Stages(spark, d)
    growth = metrics.period_compare(st.billing).select(
        "organization_id", F.col("pct_change").alias("forecast_growth_pct")
    )
    ratio = st.latest.groupBy("organization_id").agg(
        (F.count_if(F.col("bucket") != "Healthy") * 100.0 / F.count("*")).alias("waste_ratio_pct")
    )
    hits = st.anomalies.groupBy("organization_id").agg(
        F.count_if(F.col("severity") == "critical").alias("anomaly_count")
    )
    inputs = growth.join(ratio, "organization_id").join(hits, "organization_id")
    return metrics.health(inputs).select("organization_id", "risk_score", "infrastructure_health_score")


@query(
    "cost_efficiency",
    f"SELECT organization_id, {r(money('cpu_avg_pct / 100 * usage_hours') + ' / ' + money('cost'), 4)} AS cost_efficiency_score FROM f1 GROUP BY 1",
)
def _(spark, d):
    return metrics.cost_efficiency(fx.billing(spark, d))


@query(
    "label_window",
    f"""SELECT organization_id, resource_id, {r('avg(cpu_avg_pct)', 2)} AS avg_cpu_pct, {r('avg(memory_avg_pct)', 2)} AS avg_memory_pct,
              CASE WHEN avg(cpu_avg_pct) < 5 THEN 'Critical Waste' WHEN avg(cpu_avg_pct) < 20 THEN 'Idle' WHEN avg(cpu_avg_pct) < 40 THEN 'Underutilized' ELSE 'Healthy' END AS waste_label
       FROM recent30 GROUP BY 1, 2""",
)
def _(spark, d):
    return waste.observed_label(fx.stored_billing(spark, d))


@query(
    "history_count",
    f"""SELECT {KEY}, CAST(coalesce(n, 0) AS INT) AS anomaly_history_count FROM f1
       LEFT JOIN (SELECT organization_id, resource_id, count(*) AS n FROM f6 GROUP BY 1, 2) USING (organization_id, resource_id)""",
)
def _(spark, d):
    return anomaly.history_counts(fx.billing(spark, d).select(*KEYS), fx.label_windows(spark, d))


# --- advice ------------------------------------------------------------------------------------------
REC = "organization_id, resource_id, action, estimated_savings, confidence, reason, impact_score, impact_tier"


@query("recommend", f"SELECT {REC} FROM rec")
def _(spark, d):
    return fx.recommendations(spark, d).select(*REC.split(", ")).orderBy(F.desc("impact_score"))


CITED = ("Critical Waste", "Idle", "Underutilized", "Healthy")  # kinds of questions; the last has none


@query(
    "recommend_cited",
    f"""SELECT organization_id, resource_id, action, coalesce('passage ' || c.vec_id, '{fv.GENERIC_CITATION}') AS supporting_rule, CAST(c.vec_id AS VARCHAR) AS chunks
       FROM (SELECT *, {' '.join(['CASE', *[f"WHEN contains(reason, '({b})') THEN {k + 1}" for k, b in enumerate(CITED[:3])], 'END'])} AS q FROM rec) LEFT JOIN (
         SELECT q.vec_id AS q, c.vec_id, row_number() OVER (PARTITION BY q.vec_id ORDER BY list_inner_product(CAST(q.embedding AS DOUBLE[]), CAST(c.embedding AS DOUBLE[])) DESC, c.vec_id) AS rn
         FROM embeddings q JOIN embeddings c ON q.vec_id BETWEEN 1 AND 2) c ON rec.q = c.q AND rn = 1""".replace("FROM rec)", "FROM rec) rec"),
)
def _(spark, d):
    vectors = fx.table(spark, d, "embeddings")
    recs = fx.recommendations(spark, d)
    kind = F
    for k, b in enumerate(CITED[:3]):
        kind = kind.when(F.contains("reason", F.lit(f"({b})")), F.lit(k + 1).cast("long"))
    asked = vectors.filter("vec_id between 1 and 2").select(F.col("vec_id").alias("query_id"), "embedding")
    passages = vectors.select(F.col("vec_id").alias("chunk_id"), F.concat(F.lit("passage "), F.col("vec_id").cast("string")).alias("title"), "embedding")
    out = advice.cite(recs, kind.otherwise(F.lit(None).cast("long")), asked, passages)
    chunks = F.when(F.size("citation_chunk_ids") > 0, F.array_join(F.transform("citation_chunk_ids", lambda x: x.cast("string")), ","))
    return out.select("organization_id", "resource_id", "action", "supporting_rule", chunks.alias("chunks"))


@query(
    "recommend_new",
    """SELECT organization_id, resource_id, date, bucket FROM scored_latest
       WHERE resource_id NOT IN (SELECT resource_id FROM rec WHERE status = 'open')""",
)
def _(spark, d):
    st = fx.Stages(spark, d)
    out = advice.without_open(st.latest, st.recommendations)
    return out.select("organization_id", "resource_id", "date", "bucket")


@query(
    "rec_tiers",
    f"""SELECT organization_id, impact_tier, {r(money('estimated_savings'), 2)} AS savings, count(*) AS n,
              count(*) FILTER (status = 'open') AS open_n, count(*) FILTER (status = 'accepted') AS accepted_n FROM rec GROUP BY 1, 2""",
)
def _(spark, d):
    return metrics.tier_savings(fx.recommendations(spark, d))


@query(
    "rec_metrics",
    f"""SELECT organization_id, {r('coalesce(n, 0) * 100.0 / greatest(w, 1)', 2)} AS recommendation_coverage_pct, {r('coalesce(s / n, 0)', 2)} AS avg_estimated_monthly_savings,
              {r('coalesce(c / n, 0)', 2)} AS avg_confidence, coalesce(n, 0) AS total_recommendations, total_analyzed_resources
       FROM (SELECT organization_id, count(*) FILTER (bucket <> 'Healthy') AS w, count(*) AS total_analyzed_resources FROM scored_latest GROUP BY 1)
       LEFT JOIN (SELECT organization_id, count(*) AS n, {money('estimated_savings')} AS s, {money('confidence')} AS c FROM rec GROUP BY 1) USING (organization_id)""",
)
def _(spark, d):
    st = fx.Stages(spark, d)
    return metrics.recommendation_metrics(st.recommendations, st.latest)


@query(
    "rec_status",
    """SELECT organization_id, resource_id, recommendation_id,
              CASE WHEN CAST(substr(resource_id, 4) AS INT) % 6 = 0 THEN 'accepted' WHEN CAST(substr(resource_id, 4) AS INT) % 6 = 1 THEN 'dismissed' ELSE 'open' END AS status
       FROM rec""",
)
def _(spark, d):
    key = F.col("s_suppkey")
    wanted = F.when(key % 6 == 0, "accepted").when(key % 6 == 1, "dismissed").when(key % 6 == 2, "archived")
    updates = fx.table(spark, d, "supplier").select(
        F.concat(F.lit("rec-vm-"), key.cast("string")).alias("recommendation_id"),
        wanted.alias("new_status"),
        F.lit("2024-01-02").cast("timestamp").alias("updated_at"),
    )
    # an earlier update to a status that sorts behind the later one, and a later one that is not valid
    earlier = updates.withColumns({"new_status": F.lit("open"), "updated_at": F.lit("2024-01-01").cast("timestamp")})
    later = updates.withColumns({"new_status": F.lit("zzz"), "updated_at": F.lit("2024-01-03").cast("timestamp")})
    updates = updates.union(earlier).union(later)
    recs = fx.recommendations(spark, d).select("organization_id", "resource_id", "recommendation_id", "status")
    return advice.set_status(recs, updates)


@query(
    "savings_confidence",
    f"""SELECT l_orderkey, l_linenumber, l_partkey, s AS estimated_savings, c AS confidence, i AS impact_score, {band('i', fv.IMPACT_BANDS, fv.IMPACT_FLOOR)} AS impact_tier
       FROM (SELECT *, {r('s * c / 100', 2)} AS i FROM (
         SELECT l_orderkey, l_linenumber, l_partkey, {r('greatest(0.0, (l_tax - l_discount) * l_quantity * 10)', 2)} AS s,
           {r('(0.35 * greatest(0.0, least(1.0, l_discount * 12)) + 0.2 * greatest(0.0, least(1.0, l_quantity / 40)) + 0.2 * greatest(0.0, least(1.0, l_tax * 10)) + 0.25 * 0.95) * 100', 2)} AS c FROM lineitem))""",
)
def _(spark, d):
    saved = advice.savings(F.col("l_tax"), F.col("l_discount"), F.col("l_quantity") * 10)
    sure = advice.confidence(
        F.col("l_discount") * 12, F.col("l_quantity") / 40 * 100, F.col("l_tax") * 10, F.lit(0.95)
    )
    out = fx.table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", saved.alias("estimated_savings"), sure.alias("confidence")
    )
    out = out.withColumn("impact_score", advice.impact_score(F.col("estimated_savings"), F.col("confidence")))
    return out.withColumn("impact_tier", advice.impact_tier(F.col("impact_score")))


@query(
    "idle_savings",
    f"""SELECT organization_id, {r(money('estimated_savings'), 2)} AS idle_savings, count(*) AS n FROM rec
       WHERE resource_id IN (SELECT resource_id FROM scored_latest WHERE bucket IN ('Idle', 'Critical Waste')) GROUP BY 1""",
)
def _(spark, d):
    st = fx.Stages(spark, d)
    return metrics.idle_savings(st.recommendations, st.latest)


@query(
    "scenario",
    f"""SELECT organization_id, scenario_id, cur AS current_monthly_cost, proj AS projected_monthly_cost, {r('cur - proj', 2)} AS savings FROM (
         SELECT organization_id, scenario_id, {r('CAST(tot AS DOUBLE) * (30.0 / days)', 2)} AS cur,
                {r('CAST(tot + coalesce(chg, 0) AS DOUBLE) * (30.0 / days)', 2)} AS proj
         FROM (SELECT DISTINCT organization_id, scenario_id FROM f8)
         JOIN (SELECT organization_id, sum(CAST(cost AS DECIMAL(28,10))) AS tot, count(DISTINCT date) AS days FROM recent30 GROUP BY 1) USING (organization_id)
         LEFT JOIN (SELECT organization_id, scenario_id, sum(CAST(CASE WHEN action_type = 'terminate' THEN 0.0 ELSE 24 * new_hourly_rate END AS DECIMAL(28,10)) - CAST(cost AS DECIMAL(28,10))) AS chg
                    FROM recent30 JOIN f8 USING (organization_id, resource_id) WHERE action_type = 'terminate' OR new_hourly_rate IS NOT NULL GROUP BY 1, 2)
           USING (organization_id, scenario_id))""",
)
def _(spark, d):
    return advice.scenarios(fx.stored_billing(spark, d), fx.actions(spark, d))


@query(
    "scenario_log",
    f"""SELECT organization_id, scenario_id, resource_id, action_type, c IS NOT NULL AND (action_type = 'terminate' OR new_hourly_rate IS NOT NULL) AS applied,
              CASE WHEN action_type = 'terminate' OR new_hourly_rate IS NOT NULL THEN {r('c', 2)} END AS cost_before,
              CASE WHEN c IS NOT NULL THEN CASE WHEN action_type = 'terminate' THEN 0.0::DOUBLE ELSE {r('h * new_hourly_rate', 2)} END END AS cost_after,
              CASE WHEN c IS NULL THEN 'resource_id not found in the simulation window'
                   WHEN action_type <> 'terminate' AND new_hourly_rate IS NULL THEN 'new_hourly_rate required for resize action' END AS note
       FROM f8 LEFT JOIN (SELECT organization_id, resource_id, {money('cost')} AS c, sum(usage_hours) AS h FROM recent30 GROUP BY 1, 2) USING (organization_id, resource_id)""",
)
def _(spark, d):
    return advice.scenario_log(fx.stored_billing(spark, d), fx.actions(spark, d))


# --- questions and KPIs --------------------------------------------------------------------------------
PERIODS = """SELECT organization_id, coalesce(CAST(sum(CAST(cost AS DECIMAL(28,10))) FILTER (date >= last_date - 30) AS DOUBLE), 0) AS t,
  coalesce(CAST(sum(CAST(cost AS DECIMAL(28,10))) FILTER (date < last_date - 30 AND date >= last_date - 60) AS DOUBLE), 0) AS p FROM f1_last GROUP BY 1"""


@query(
    "period_compare",
    f"""SELECT *, {r('this_period_cost - last_period_cost', 2)} AS difference FROM (
         SELECT organization_id, {r('t', 2)} AS this_period_cost, {r('p', 2)} AS last_period_cost, {r('(t / greatest(p, 1e-6) - 1) * 100', 2)} AS pct_change FROM ({PERIODS}))""",
)
def _(spark, d):
    return metrics.period_compare(fx.stored_billing(spark, d))


@query(
    "service_delta",
    f"""SELECT organization_id, service, increase FROM (
         SELECT *, row_number() OVER (PARTITION BY organization_id ORDER BY increase DESC, service) AS rn FROM (
           SELECT organization_id, service, {r('coalesce(CAST(a - b AS DOUBLE), 0.0)', 2)} AS increase FROM (
             SELECT organization_id, service, sum(CAST(cost AS DECIMAL(28,10))) FILTER (date >= last_date - 30) AS a,
                    sum(CAST(cost AS DECIMAL(28,10))) FILTER (date < last_date - 30 AND date >= last_date - 60) AS b
             FROM f1_last WHERE date >= last_date - 60 GROUP BY 1, 2))) WHERE rn <= 3""",
)
def _(spark, d):
    return metrics.service_delta(fx.stored_billing(spark, d))


@query(
    "top_services",
    f"""SELECT organization_id, service, cost FROM (SELECT *, row_number() OVER (PARTITION BY organization_id ORDER BY cost DESC, service) AS rn FROM (
         SELECT organization_id, service, {r(money('cost'), 2)} AS cost FROM f1_last WHERE date > last_date - 7 GROUP BY 1, 2)) WHERE rn <= 3""",
)
def _(spark, d):
    return metrics.top_services(fx.stored_billing(spark, d))


WEEK = f"""
  SELECT organization_id, last_date, {r('coalesce(CAST(sum(CAST(cost AS DECIMAL(28,10))) FILTER (date > last_date - 7) AS DOUBLE), 0)', 2)} AS t,
         {r('coalesce(CAST(sum(CAST(cost AS DECIMAL(28,10))) FILTER (date <= last_date - 7 AND date > last_date - 14) AS DOUBLE), 0)', 2)} AS p,
         count(DISTINCT resource_id) FILTER (date > last_date - 7) AS n FROM f1_last GROUP BY 1, 2"""


TOP3 = f"""SELECT organization_id, service, {r('CAST(s AS DOUBLE)', 2)} AS c FROM (
  SELECT organization_id, service, sum(CAST(cost AS DECIMAL(28,10))) AS s, row_number() OVER (PARTITION BY organization_id ORDER BY sum(CAST(cost AS DECIMAL(28,10))) DESC, service) AS rn
  FROM f1_last WHERE date > last_date - 7 GROUP BY 1, 2) WHERE rn <= 3"""


@query(
    "weekly_snapshot",
    f"""SELECT w.organization_id, last_date - 7 AS period_start, last_date AS period_end, t AS this_week_total_cost, p AS prior_week_total_cost,
              {r('(t / greatest(p, 1e-6) - 1) * 100', 2)} AS pct_change_vs_prior_week, n AS active_resource_count, top_services, healthy, underutilized, idle, critical_waste,
              anomaly_count_this_week, critical, high, medium, low
       FROM ({WEEK}) w
       JOIN (SELECT organization_id, string_agg(service || '=' || printf('%.2f', c), ',' ORDER BY service) AS top_services FROM ({TOP3}) GROUP BY 1) USING (organization_id)
       JOIN (SELECT organization_id, count(*) FILTER (bucket = 'Healthy') AS healthy, count(*) FILTER (bucket = 'Underutilized') AS underutilized,
                    count(*) FILTER (bucket = 'Idle') AS idle, count(*) FILTER (bucket = 'Critical Waste') AS critical_waste
             FROM scored JOIN last_day USING (organization_id) WHERE date > last_date - 7 GROUP BY 1) USING (organization_id)
       JOIN (SELECT organization_id, count(*) AS anomaly_count_this_week, count(*) FILTER (severity = 'critical') AS critical,
                    count(*) FILTER (severity = 'high') AS high, count(*) FILTER (severity = 'medium') AS medium, count(*) FILTER (severity = 'low') AS low
             FROM anom JOIN last_day USING (organization_id) WHERE date > last_date - 7 GROUP BY 1) USING (organization_id)""",
)
def _(spark, d):
    st = fx.Stages(spark, d)
    snap = metrics.weekly_snapshot(st.billing, st.scored, st.anomalies)
    names = {"healthy": "Healthy", "underutilized": "Underutilized", "idle": "Idle", "critical_waste": "Critical Waste"}

    def hits(column, key):
        return F.coalesce(F.try_element_at(column, F.lit(key)), F.lit(0)).cast("long")

    return snap.select(
        "organization_id", "period_start", "period_end", "this_week_total_cost", "prior_week_total_cost",
        "pct_change_vs_prior_week", "active_resource_count",
        F.array_join(
            F.transform(
                F.array_sort(F.map_entries("top_services_by_cost")),
                lambda e: F.concat(e["key"], F.lit("="), F.format_string("%.2f", e["value"])),
            ),
            ",",
        ).alias("top_services"),
        *[hits("waste_bucket_counts", v).alias(k) for k, v in names.items()],
        "anomaly_count_this_week",
        *[hits("anomalies_by_severity", s).alias(s) for s in ("critical", "high", "medium", "low")],
    )


def _reports(spark, d):
    return metrics.as_report(metrics.weekly_snapshot(fx.stored_billing(spark, d)))


@query(
    "report_export",
    f"""SELECT organization_id, last_date - 7 AS period_start, unnest(['this_week_total_cost', 'prior_week_total_cost', 'active_resource_count', 'pct_change_vs_prior_week']) AS metric,
              unnest([t, p, CAST(n AS DOUBLE), {r('(t / greatest(p, 1e-6) - 1) * 100', 2)}]) AS value FROM ({WEEK})
       UNION ALL SELECT organization_id, last_date - 7, 'top_services_by_cost.' || service, c FROM ({TOP3}) JOIN last_day USING (organization_id)""",
)
def _(spark, d):
    rows = metrics.report_rows(_reports(spark, d))
    nested = F.col("metric") == "top_services_by_cost"
    one = rows.filter(~nested).withColumn("value", F.col("value").cast("double"))
    costs = rows.filter(nested).select(
        "organization_id", "period_start", F.explode(F.from_json("value", "map<string,double>")).alias("service", "value")
    )
    named = F.concat(F.lit("top_services_by_cost."), "service").alias("metric")
    return one.unionByName(costs.select("organization_id", "period_start", named, "value"))


@query("spend_trend", f"SELECT organization_id, strftime(last_date - 7, '%m-%d') AS period, t AS spend, p AS prior FROM ({WEEK})")
def _(spark, d):
    return metrics.spend_trend(_reports(spark, d))


def _top_metric_sql(metric: str) -> str:
    c = fv.METRIC_COLUMNS[metric]
    return f"""SELECT organization_id, '{c}' AS metric, resource_id, date, {r(c, 2)} AS value FROM (
        SELECT *, row_number() OVER (PARTITION BY organization_id ORDER BY {c} DESC, resource_id, date) AS rn FROM f1) WHERE rn = 1"""


@query("top_metric", " UNION ALL ".join(_top_metric_sql(m) for m in fv.METRIC_COLUMNS))
def _(spark, d):
    return metrics.top_metrics(fx.billing(spark, d), list(fv.METRIC_COLUMNS))


@query(
    "terminate_candidates",
    """SELECT organization_id, resource_id, waste_score, bucket, cpu_avg_pct FROM (SELECT *, row_number() OVER (PARTITION BY organization_id ORDER BY waste_score DESC, resource_id) AS rn
       FROM scored_latest WHERE bucket IN ('Idle', 'Critical Waste')) WHERE rn <= 5""",
)
def _(spark, d):
    return metrics.terminate_candidates(fx.scored_latest(spark, d))


@query(
    "idle_list",
    """SELECT organization_id, resource_id, bucket, waste_score, idle_resource_count FROM (
         SELECT *, row_number() OVER (PARTITION BY organization_id ORDER BY resource_id) AS rk, count(*) OVER (PARTITION BY organization_id) AS idle_resource_count FROM (
           SELECT *, row_number() OVER (PARTITION BY organization_id, resource_id ORDER BY date DESC) AS rn FROM scored WHERE bucket IN ('Idle', 'Critical Waste')) WHERE rn = 1) WHERE rk <= 20""",
)
def _(spark, d):
    return metrics.idle_list(fx.Stages(spark, d).scored)


@query(
    "top_wasted",
    """SELECT organization_id, resource_id, date, waste_score, bucket FROM (SELECT *, row_number() OVER (PARTITION BY organization_id ORDER BY waste_score DESC, resource_id, date) AS rn FROM scored_latest) WHERE rn <= 5""",
)
def _(spark, d):
    return metrics.top_wasted(fx.scored_latest(spark, d))


DASH = f"""
  SELECT organization_id, {r(money('cost'), 2)} AS total_spend,
         {r("CAST(sum(CAST(cost AS DECIMAL(28,10))) FILTER (date >= last_date - 30) AS DOUBLE)", 2)} AS spend_30d,
         count(DISTINCT resource_id) AS active_resource_count FROM f1_last GROUP BY 1"""
NEWEST_FC = f"SELECT organization_id, {r('arg_max(forecast, forecast_date)', 2)} AS forecast_next_period FROM fc WHERE level = 'org_total' GROUP BY 1"
OPEN_SAVED = f"SELECT organization_id, {r(money('estimated_savings'), 2)} AS saved FROM rec WHERE status = 'open' GROUP BY 1"


@query(
    "dashboard_kpis",
    f"""SELECT organization_id, total_spend, spend_30d, forecast_next_period, coalesce(n, 0) AS anomaly_count, coalesce(saved, 0.0) AS savings_identified, active_resource_count
       FROM ({DASH}) LEFT JOIN ({NEWEST_FC}) USING (organization_id) LEFT JOIN ({OPEN_SAVED}) USING (organization_id)
       LEFT JOIN (SELECT organization_id, count(*) AS n FROM anom GROUP BY 1) USING (organization_id)""",
)
def _(spark, d):
    st = fx.Stages(spark, d)
    return metrics.dashboard(st.billing, st.anomalies, st.forecasts, st.recommendations)


def _business_sql(per_row: bool) -> str:
    w, i = ("wr", "ir") if per_row else ("wn", "inn")
    return f"""
       SELECT organization_id, coalesce(s, 0.0) AS estimated_monthly_savings, {r(f'coalesce(coalesce(a, 0) * 100.0 / nullif({w}, 0), 0)', 1)} AS waste_detection_coverage_pct,
              {r('coalesce(wn * 100.0 / nullif(rn, 0), 0)', 1)} AS optimization_opportunity_rate_pct, {r('coalesce(c, 0)', 1)} AS avg_recommendation_confidence_pct,
              CASE WHEN {i} > 0 THEN {r(f'coalesce(tn, 0) * 100.0 / {i}', 1)} END AS idle_resource_reduction_potential_pct,
              {r('(1 - (0.5 * wn / rn + 0.5 * least(coalesce(k, 0) / 50.0, 1.0))) * 100', 1)} AS infrastructure_health_score,
              {r("(SELECT arg_max(error_reduction_pct, training_date) FROM reg WHERE model_type = 'forecast' AND is_active)", 1)} AS forecast_error_reduction_pct
       FROM (SELECT organization_id, count(DISTINCT resource_id) AS rn FROM f1 GROUP BY 1)
       LEFT JOIN (SELECT organization_id, count(*) FILTER (bucket <> 'Healthy') AS wr, count(DISTINCT resource_id) FILTER (bucket <> 'Healthy') AS wn,
                         count(*) FILTER (bucket IN ('Idle', 'Critical Waste')) AS ir, count(DISTINCT resource_id) FILTER (bucket IN ('Idle', 'Critical Waste')) AS inn FROM scored GROUP BY 1) USING (organization_id)
       LEFT JOIN (SELECT organization_id, {r(money('estimated_savings'), 2)} AS s, avg(confidence) AS c, count(DISTINCT resource_id) AS a,
                         count(DISTINCT resource_id) FILTER (action ILIKE '%terminat%') AS tn FROM rec WHERE status = 'open' GROUP BY 1) USING (organization_id)
       LEFT JOIN (SELECT organization_id, count(*) AS k FROM anom GROUP BY 1) USING (organization_id)"""


def _business(spark, d, per_row):
    st = fx.Stages(spark, d)
    return metrics.business_kpis(
        st.billing,
        st.scored,
        st.anomalies,
        st.recommendations,
        fx.registry(spark, d),
        per_classification=per_row,
    )


@query("business_kpis", _business_sql(False))
def _(spark, d):
    return _business(spark, d, False)


@query("business_kpis_per_row", _business_sql(True))
def _(spark, d):
    return _business(spark, d, True)


@query(
    "insight",
    f"""SELECT *, concat_ws(chr(10), CASE WHEN total_spend <> 0 THEN concat('• Total cloud spend: $', format('{{:,.2f}}', total_spend)) END,
              concat('• Anomalies detected: ', anomaly_count), CASE WHEN potential_savings <> 0 THEN concat('• Potential monthly savings: $', format('{{:,.2f}}', potential_savings)) END,
              CASE WHEN forecast_next <> 0 THEN concat('• Forecast (next period): $', format('{{:,.2f}}', forecast_next)) END,
              CASE WHEN idle_resources <> 0 THEN concat('• Idle/critical waste resources: ', idle_resources) END) AS insight_text
       FROM (SELECT organization_id, total_spend, coalesce(n, 0) AS anomaly_count, coalesce(saved, 0.0) AS potential_savings, coalesce(i, 0) AS idle_resources, forecast_next_period AS forecast_next
             FROM (SELECT organization_id, {r(money('cost'), 2)} AS total_spend FROM f1 WHERE year(date) = 1994 + CAST(substr(organization_id, 5, 1) AS INT) GROUP BY 1)
             LEFT JOIN ({NEWEST_FC}) USING (organization_id) LEFT JOIN ({OPEN_SAVED}) USING (organization_id)
             LEFT JOIN (SELECT organization_id, count(*) AS n FROM anom GROUP BY 1) USING (organization_id)
             LEFT JOIN (SELECT organization_id, count(*) AS i FROM scored WHERE bucket IN ('Idle', 'Critical Waste') GROUP BY 1) USING (organization_id))""",
)
def _(spark, d):
    st = fx.Stages(spark, d)
    snap = metrics.insight_snapshot(
        fx.with_dataset(st.billing),
        fx.datasets(spark, d),
        st.anomalies,
        st.scored,
        st.forecasts,
        st.recommendations,
    )
    return metrics.insight_text(snap)


@query(
    "score_bands",
    f"""SELECT organization_id, 'incident' AS kind, {band('incident_score', fv.INCIDENT_CHART_BANDS, fv.INCIDENT_CHART_FLOOR)} AS band, count(*) AS n FROM anom GROUP BY 1, 3
       UNION ALL SELECT organization_id, 'waste', {band('waste_score', fv.WASTE_CHART_BANDS, fv.WASTE_CHART_FLOOR)} AS band, count(*) FROM scored GROUP BY 1, 3""",
)
def _(spark, d):
    st = fx.Stages(spark, d)
    a = metrics.score_bands(st.anomalies, "incident_score", "incident").withColumn("kind", F.lit("incident"))
    b = metrics.score_bands(st.scored, "waste_score", "waste").withColumn("kind", F.lit("waste"))
    return a.unionByName(b)


@query("severity_counts", "SELECT organization_id, severity, count(*) AS n FROM anom GROUP BY 1, 2")
def _(spark, d):
    return metrics.counts_by(fx.anomalies(spark, d), "organization_id", "severity")


@query(
    "anomalies_by_prefix",
    """SELECT organization_id, CASE WHEN upper(split_part(resource_id, '-', 1)) <> '' THEN upper(split_part(resource_id, '-', 1)) ELSE 'OTHER' END AS prefix, count(*) AS n
       FROM anom GROUP BY 1, 2""",
)
def _(spark, d):
    return metrics.anomalies_by_prefix(fx.anomalies(spark, d))


@query(
    "top_flagged",
    """SELECT organization_id, resource_id, anomalies FROM (SELECT *, row_number() OVER (PARTITION BY organization_id ORDER BY anomalies DESC, resource_id) AS rn FROM (
       SELECT organization_id, resource_id, count(*) AS anomalies FROM anom GROUP BY 1, 2)) WHERE rn <= 5""",
)
def _(spark, d):
    return metrics.top_flagged(fx.anomalies(spark, d))


@query(
    "top_anomalies",
    f"""SELECT {KEY}, incident_score, severity FROM (SELECT *, row_number() OVER (PARTITION BY organization_id ORDER BY incident_score DESC, resource_id, date) AS rn FROM anom WHERE severity = 'medium') WHERE rn <= 100""",
)
def _(spark, d):
    return metrics.top_anomalies(fx.anomalies(spark, d).select(*KEYS, "incident_score", "severity"), "medium", 100)


@query(
    "forecast_by_service",
    f"""SELECT organization_id, service, forecast_date, {r('forecast', 2)} AS forecast, {r('ci_lower', 2)} AS ci_lower, {r('ci_upper', 2)} AS ci_upper,
              {r('(ci_upper - ci_lower) / greatest(forecast, 1.0) * 100', 1)} AS ci_width_pct FROM (
         SELECT *, row_number() OVER (PARTITION BY organization_id, service ORDER BY forecast_date DESC) AS rn FROM fc WHERE level = 'per_service') WHERE rn = 1""",
)
def _(spark, d):
    return metrics.forecast_by_service(fx.forecasts(spark, d))


@query(
    "forecast_lookup",
    f"""SELECT organization_id, 'org_total' AS service, {r('arg_max(forecast, forecast_date)', 2)} AS forecast, {r('arg_max(ci_lower, forecast_date)', 2)} AS ci_lower,
              {r('arg_max(ci_upper, forecast_date)', 2)} AS ci_upper FROM fc WHERE level = 'org_total' GROUP BY 1
       UNION ALL SELECT organization_id, service, {r('arg_max(forecast, forecast_date)', 2)}, {r('arg_max(ci_lower, forecast_date)', 2)}, {r('arg_max(ci_upper, forecast_date)', 2)}
       FROM fc WHERE service = 'EC2' GROUP BY 1, 2""",
)
def _(spark, d):
    fc = durable(fx.forecasts(spark, d))
    return metrics.forecast_lookup(fc).unionByName(metrics.forecast_lookup(fc, "EC2"))


# --- evaluation and drift --------------------------------------------------------------------------------
@query(
    "naive_eval",
    f"""SELECT *, {r("coalesce((persistence_mape - last_week_mape) / nullif(persistence_mape, 0) * 100, 0)", 2)} AS last_week_vs_persistence_pct FROM (
         SELECT level, service, count(*) AS n_test_rows,
           {r('avg(abs(cost - l1))', 4)} AS persistence_mae, {r('sqrt(avg((cost - l1) * (cost - l1)))', 4)} AS persistence_rmse, {r('avg(abs((cost - l1) / CASE WHEN cost = 0 THEN 1e-6 ELSE cost END)) * 100', 4)} AS persistence_mape,
           {r('avg(abs(cost - l7))', 4)} AS last_week_mae, {r('sqrt(avg((cost - l7) * (cost - l7)))', 4)} AS last_week_rmse, {r('avg(abs((cost - l7) / CASE WHEN cost = 0 THEN 1e-6 ELSE cost END)) * 100', 4)} AS last_week_mape
         FROM (SELECT *, first_value(lag_1d IGNORE NULLS) OVER ahead AS l1, first_value(lag_7d IGNORE NULLS) OVER ahead AS l7
               FROM (SELECT *, lag(cost, 1) OVER ({SUP_W}) AS lag_1d, lag(cost, 7) OVER ({SUP_W}) AS lag_7d,
                            row_number() OVER ({SUP_W}) > floor(0.8 * count(*) OVER (PARTITION BY level, service)) AS held FROM f4all) WHERE held
               WINDOW ahead AS ({SUP_W} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) GROUP BY level, service)""",
)
def _(spark, d):
    daily = fx.daily_orders(spark, d).drop("organization_id")
    return evaluate.naive_evaluation(features.supervised(daily, SUP_KEYS), SUP_KEYS)


@query(
    "chrono_split",
    f"""SELECT date, level, service, row_number() OVER ({SUP_W}) <= floor(0.8 * count(*) OVER (PARTITION BY level, service)) AS is_train FROM f4all""",
)
def _(spark, d):
    return evaluate.chronological_split(fx.daily_orders(spark, d), SUP_KEYS).select("date", "level", "service", "is_train")


@query(
    "strat_split",
    f"""SELECT {KEY}, bucket, row_number() OVER (PARTITION BY bucket ORDER BY md5(concat_ws('|', organization_id, resource_id, CAST(date AS VARCHAR))))
              <= floor(0.2 * count(*) OVER (PARTITION BY bucket)) AS is_test FROM scored""",
)
def _(spark, d):
    return evaluate.stratified_split(fx.Stages(spark, d).scored.select(*KEYS, "bucket"), "bucket", KEYS)


CPU_LADDER = "CASE WHEN cpu_avg_pct < 5 THEN 'Critical Waste' WHEN cpu_avg_pct < 20 THEN 'Idle' WHEN cpu_avg_pct < 40 THEN 'Underutilized' ELSE 'Healthy' END"


def _predicted(spark, d):
    from cloudtally.functions.numeric import below

    return fx.scored(spark, d).withColumn("predicted_bucket", below(F.col("cpu_avg_pct"), fv.LABEL_BANDS, "Healthy"))


@query("confusion", f"SELECT bucket AS actual, {CPU_LADDER} AS predicted, count(*) AS n FROM scored GROUP BY 1, 2")
def _(spark, d):
    return evaluate.confusion(_predicted(spark, d), "bucket", "predicted_bucket")


@query(
    "classification_report",
    f"""SELECT {r('CAST(sum(h) AS DOUBLE) / sum(s)', 4)} AS accuracy, {r('avg(pr)', 4)} AS precision_macro, {r('avg(re)', 4)} AS recall_macro,
              {r('avg(coalesce(2 * pr * re / nullif(pr + re, 0), 0))', 4)} AS f1_macro, count(*) AS labels
       FROM (SELECT *, coalesce(h / nullif(c, 0), 0.0) AS pr, coalesce(h / nullif(s, 0), 0.0) AS re FROM (
         SELECT label, count(*) FILTER (label = a) AS s, count(*) FILTER (label = p) AS c, count(*) FILTER (label = a AND label = p) AS h
         FROM (SELECT bucket AS a, {CPU_LADDER} AS p FROM scored) JOIN (SELECT bucket AS label FROM scored UNION SELECT {CPU_LADDER} FROM scored) ON label = a OR label = p GROUP BY 1))""",
)
def _(spark, d):
    return evaluate.classification_report(evaluate.confusion(_predicted(spark, d), "bucket", "predicted_bucket"))


@query(
    "anomaly_eval",
    f"""SELECT organization_id, score_threshold, tp AS true_positives, fp AS false_positives, fneg AS false_negatives, tn AS true_negatives,
              {r('pr', 4)} AS precision, {r('re', 4)} AS recall, {r('coalesce(2 * pr * re / nullif(pr + re, 0), 0)', 4)} AS f1
       FROM (SELECT *, coalesce(tp / nullif(tp + fp, 0), 0.0) AS pr, coalesce(tp / nullif(tp + fneg, 0), 0.0) AS re FROM (
         SELECT organization_id, {r('max(thr)', 6)} AS score_threshold, count(*) FILTER (t AND incident_score >= thr) AS tp, count(*) FILTER (NOT t AND incident_score >= thr) AS fp,
                count(*) FILTER (t AND incident_score < thr) AS fneg, count(*) FILTER (NOT t AND incident_score < thr) AS tn
         FROM (SELECT a.*, EXISTS (SELECT 1 FROM f6 WHERE f6.organization_id = a.organization_id AND f6.resource_id = a.resource_id AND a.date BETWEEN start_date AND end_date) AS t FROM anom a)
         JOIN (SELECT organization_id, quantile_cont(incident_score, 0.97) AS thr FROM anom GROUP BY 1) USING (organization_id) GROUP BY 1))""",
)
def _(spark, d):
    # the scores are read twice, for the threshold and for the counts
    out = evaluate.anomaly_evaluation(fx.Stages(spark, d).anomalies, fx.label_windows(spark, d))
    return rounded(out, 6, "score_threshold")


@query(
    "anomaly_sweep",
    f"""SELECT organization_id, percentile, score_threshold, tp AS true_positives, fp AS false_positives, fneg AS false_negatives, tn AS true_negatives,
              {r('pr', 4)} AS precision, {r('re', 4)} AS recall, {r('coalesce(2 * pr * re / nullif(pr + re, 0), 0)', 4)} AS f1
       FROM (SELECT *, coalesce(tp / nullif(tp + fp, 0), 0.0) AS pr, coalesce(tp / nullif(tp + fneg, 0), 0.0) AS re FROM (
         SELECT organization_id, percentile, {r('max(thr)', 6)} AS score_threshold, count(*) FILTER (t AND incident_score >= thr) AS tp, count(*) FILTER (NOT t AND incident_score >= thr) AS fp,
                count(*) FILTER (t AND incident_score < thr) AS fneg, count(*) FILTER (NOT t AND incident_score < thr) AS tn
         FROM (SELECT a.*, EXISTS (SELECT 1 FROM f6 WHERE f6.organization_id = a.organization_id AND f6.resource_id = a.resource_id AND a.date BETWEEN start_date AND end_date) AS t FROM anom a)
         JOIN (SELECT organization_id, CAST(unnest(range(80, 100)) AS INT) AS percentile, unnest(quantile_cont(incident_score, list_transform(range(80, 100), lambda p: p / 100.0))) AS thr FROM anom GROUP BY 1) USING (organization_id) GROUP BY 1, 2))""",
)
def _(spark, d):
    out = evaluate.anomaly_sweep(fx.Stages(spark, d).anomalies, fx.label_windows(spark, d))
    return rounded(out, 6, "score_threshold")


@query(
    "truth_days",
    """SELECT organization_id, count(*) AS n_rows, count(*) FILTER (t) AS true_days FROM (
         SELECT f1.organization_id, EXISTS (SELECT 1 FROM f6 WHERE f6.organization_id = f1.organization_id AND f6.resource_id = f1.resource_id
                AND f1.date BETWEEN start_date AND end_date + CASE WHEN month(start_date) % 2 = 0 THEN 3650 ELSE 0 END::INT) AS t FROM f1) GROUP BY 1""",
)
def _(spark, d):
    """Windows of ten years, which no longer become a row for each of their days."""
    longer = F.when(F.month("start_date") % 2 == 0, F.date_add("end_date", 3650)).otherwise(F.col("end_date"))
    windows = fx.label_windows(spark, d).withColumn("end_date", longer)
    marked = evaluate.mark_truth(fx.billing(spark, d).select(*KEYS), windows)
    return marked.groupBy("organization_id").agg(F.count("*").alias("n_rows"), F.count_if("is_true_anomaly").alias("true_days"))


@query(
    "score_quantiles",
    f"""SELECT organization_id, {r('quantile_cont(incident_score, 0.5)', 6)} AS p50, {r('quantile_cont(incident_score, 0.97)', 6)} AS p97 FROM anom GROUP BY 1""",
)
def _(spark, d):
    q = evaluate.exact_quantile(fx.anomalies(spark, d), "incident_score", [0.5, fv.ANOMALY_PERCENTILE])
    return q.select(
        "organization_id",
        half_up(F.get("quantiles", F.lit(0)), 6).alias("p50"),
        half_up(F.get("quantiles", F.lit(1)), 6).alias("p97"),
    )


@query("drift_split", f"SELECT {KEY}, is_train FROM marked")
def _(spark, d):
    return drift.split_by_time(fx.stored_billing(spark, d)).select(*KEYS, "is_train")


@query("psi", "SELECT * FROM psi")
def _(spark, d):
    return drift.psi(drift.prepare(drift.split_by_time(fx.stored_billing(spark, d))))


@query("ks", "SELECT * FROM ks")
def _(spark, d):
    return drift.ks(drift.prepare(drift.split_by_time(fx.stored_billing(spark, d))))


@query(
    "drift_report",
    """SELECT organization_id, feature, psi, psi > 0.2 AS psi_drift_detected, ks_statistic, ks_pvalue, ks_pvalue < 0.05 AS ks_drift_detected
       FROM psi JOIN ks USING (organization_id, feature)""",
)
def _(spark, d):
    return drift.drift_report(drift.split_by_time(fx.stored_billing(spark, d)))


@query(
    "drift_policy",
    """SELECT organization_id, drifted IS NOT NULL OR days >= 7 OR worse > 15 AS should_retrain,
              concat_ws('; ', CASE WHEN drifted IS NOT NULL THEN concat('PSI drift > 0.2 on features: [''', drifted, ''']') END,
                CASE WHEN worse > 15 THEN concat('Forecast MAPE increased ', format('{:.1f}', worse), '% from baseline (threshold 15.0%)') END,
                CASE WHEN days >= 7 THEN concat('Weekly schedule elapsed (', days, ' days since last training)') END) AS reasons
       FROM (SELECT concat('org-', r_regionkey) AS organization_id, (r_regionkey * 5.0::DOUBLE) AS worse, r_regionkey * 3 AS days FROM region)
       LEFT JOIN (SELECT organization_id, string_agg(feature, ''', ''' ORDER BY feature) AS drifted FROM psi WHERE psi > 0.2 GROUP BY 1) USING (organization_id)""",
)
def _(spark, d):
    report = drift.drift_report(drift.split_by_time(fx.stored_billing(spark, d)))
    key = F.col("r_regionkey")
    state = fx.table(spark, d, "region").select(
        F.concat(F.lit("org-"), key.cast("string")).alias("organization_id"),
        (100.0 + key * 5).alias("current_mape"),
        F.lit(100.0).alias("baseline_mape"),
        (key * 3).alias("days_since_last_training"),
        F.lit(False).alias("manual_trigger"),
    )
    out = drift.retraining_policy(report, state)
    return out.withColumn("reasons", F.concat_ws("; ", "reasons"))


# --- retrieval, questions, stored tables -----------------------------------------------------------------
@query(
    "topk_cosine",
    f"""SELECT query_id, vec_id, {r('score', 6)} AS score, CAST(rank AS INT) AS rank FROM (
         SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(CAST(q.embedding AS DOUBLE[]), CAST(c.embedding AS DOUBLE[])) AS score,
                row_number() OVER (PARTITION BY q.vec_id ORDER BY list_inner_product(CAST(q.embedding AS DOUBLE[]), CAST(c.embedding AS DOUBLE[])) DESC, c.vec_id) AS rank
         FROM embeddings q JOIN embeddings c ON q.vec_id % 20 = 0) WHERE rank <= 3""",
)
def _(spark, d):
    vectors = fx.table(spark, d, "embeddings")
    asked = vectors.filter(F.col("vec_id") % 20 == 0).select(F.col("vec_id").alias("query_id"), "embedding")
    return retrieve.top_k(asked, vectors)


@query("topk_lists", ORACLE["topk_cosine"])
def _(spark, d):
    """The same neighbours through inverted lists: bounds tell which lists must be met beyond the first ones."""
    vectors = fx.table(spark, d, "embeddings")
    asked = vectors.filter(F.col("vec_id") % 20 == 0).select(F.col("vec_id").alias("query_id"), "embedding")
    return retrieve.search_lists(asked, retrieve.build_lists(vectors, retrieve.fit_centres(vectors)))


@query("ann_recall")
def _(spark, d):
    """How many of the exact neighbours the lists give that were calibrated to hold 95 per cent of them."""
    vectors = fx.table(spark, d, "embeddings")
    asked = vectors.filter(F.col("vec_id") % 20 == 0).select(F.col("vec_id").alias("query_id"), "embedding")
    lists = retrieve.build_lists(vectors, retrieve.fit_centres(vectors))
    some = retrieve.search_lists(asked, lists, k=10, probes=retrieve.calibrate(asked, lists, k=10), exact=False)
    return retrieve.recall(some, retrieve.top_k(asked, vectors, k=10))


def _intent_sql() -> str:
    arms = " ".join(f"WHEN regexp_matches(lower(question), '{p}') THEN '{n}'" for p, n in fv.INTENT_PATTERNS)
    return f"CASE {arms} ELSE '{fv.INTENT_FLOOR}' END"


@query(
    "intents",
    f"""SELECT question_id, intent, CASE WHEN intent <> 'general_question' THEN nullif(regexp_extract(lower(question), '{fv.REGION_PATTERN}', 1), '') END AS region,
              CASE WHEN intent <> 'general_question' THEN upper(nullif(regexp_extract(lower(question), '{fv.SERVICE_PATTERN}', 1), '')) END AS service,
              CASE WHEN intent <> 'general_question' THEN nullif(regexp_extract(lower(question), '{fv.METRIC_PATTERN}', 1), '') END AS metric
       FROM (SELECT *, {_intent_sql()} AS intent FROM asked)""",
)
def _(spark, d):
    return retrieve.tag_questions(fx.questions(spark, d)).drop("question")


@query(
    "feature_upsert",
    f"""SELECT {KEY}, CASE WHEN CAST(substr(resource_id, 4) AS INT) % 2 = 1 THEN cost * 2 ELSE cost END AS cost, cpu_avg_pct,
              CASE WHEN CAST(substr(resource_id, 4) AS INT) % 2 = 1 THEN DATE '2024-01-02' ELSE DATE '2024-01-01' END AS written FROM f1""",
)
def _(spark, d):
    first, second = fx.feature_store(spark, d)
    merged = store.upsert(first, second)
    return merged.select(
        *KEYS,
        F.try_element_at("features", F.lit("cost")).alias("cost"),
        F.try_element_at("features", F.lit("cpu_avg_pct")).alias("cpu_avg_pct"),
        F.to_date("created_at").alias("written"),
    )


@query("feature_read", f"SELECT {KEY}, cost, cpu_avg_pct, CAST(NULL AS DOUBLE) AS missing_feature FROM f1 WHERE organization_id = 'org-1'")
def _(spark, d):
    first, _ = fx.feature_store(spark, d)
    return store.read_features(first, ["cost", "cpu_avg_pct", "missing_feature"], organization_id="org-1")


@query(
    "purge_counts",
    """SELECT organization_id, 'processed_telemetry' AS table_name, count(*) AS n FROM f1 GROUP BY 1
       UNION ALL SELECT organization_id, 'anomalies', count(*) FROM anom GROUP BY 1
       UNION ALL SELECT organization_id, 'waste_classifications', count(*) FROM scored GROUP BY 1
       UNION ALL SELECT organization_id, 'recommendations', count(*) FROM rec GROUP BY 1
       UNION ALL SELECT organization_id, 'forecast_results', count(*) FROM fc GROUP BY 1""",
)
def _(spark, d):
    st = fx.Stages(spark, d)
    return store.purge_counts(
        {
            "processed_telemetry": st.billing,
            "anomalies": st.anomalies,
            "waste_classifications": st.scored,
            "recommendations": st.recommendations,
            "forecast_results": st.forecasts,
        }
    )


@query(
    "registry",
    """SELECT model_type, version, training_date, CASE WHEN model_type = 'forecast' THEN version = 'v9' ELSE is_active END AS is_active FROM reg""",
)
def _(spark, d):
    out = registry.promote(fx.registry(spark, d), "forecast", "v9")
    return registry.listing(out).select("model_type", "version", "training_date", "is_active")


@query(
    "active_models",
    """SELECT model_type, arg_max(version, training_date) AS version, max(training_date) AS training_date FROM reg WHERE is_active GROUP BY 1""",
)
def _(spark, d):
    return registry.active(fx.registry(spark, d)).select("model_type", "version", "training_date")


@query("train_gate", "SELECT count(DISTINCT model_type) AS active_types, count(DISTINCT model_type) = 3 AS models_exist FROM reg WHERE is_active")
def _(spark, d):
    return registry.train_gate(fx.registry(spark, d))


@query(
    "model_history",
    """SELECT model_type, concat('v', row_number() OVER (PARTITION BY model_type ORDER BY training_date)) AS point, version, CAST(mape AS DOUBLE) AS value FROM (
         SELECT *, row_number() OVER (PARTITION BY model_type ORDER BY training_date DESC) AS rn FROM reg WHERE mape <> 0) WHERE rn <= 8""",
)
def _(spark, d):
    return registry.history(fx.registry(spark, d), "mape")


# --- models (no SQL form: checked by their invariants in the tests) -------------------------------
@query("waste_clf")
def _(spark, d):
    scored = durable(fx.scored(spark, d).select(*KEYS, "bucket", *fv.CLASSIFIER_FEATURES))
    model, _ = waste_classifier.train_and_evaluate(scored)
    out = waste_classifier.predict(model, latest_rows(scored, SERIES))
    return out.select(*KEYS, "bucket", "predicted_bucket", "classifier_confidence")


@query("waste_clf_report")
def _(spark, d):
    """Accuracy and macro figures on the held-out fifth."""
    scored = durable(fx.scored(spark, d).select(*KEYS, "bucket", *fv.CLASSIFIER_FEATURES))
    return waste_classifier.train_and_evaluate(scored)[1]


@query("attribution")
def _(spark, d):
    scored = durable(fx.scored(spark, d).select(*KEYS, "bucket", *fv.CLASSIFIER_FEATURES))
    model = waste_classifier.fit(scored)
    explained = attribution.contributions(
        model, latest_rows(scored, SERIES), fv.CLASSIFIER_FEATURES, waste_classifier.LABELS, [*KEYS, "bucket"], only="bucket"
    )
    return attribution.top_contributions(explained)


@query("forecast")
def _(spark, d):
    rows = durable(forecast.series_rows(features.daily_series(fx.billing(spark, d))))
    model = forecast.fit(rows)
    return forecast.latest(forecast.predict(model, rows))


@query("forecast_eval")
def _(spark, d):
    """Errors and coverage on held-out days: MAPE against yesterday's cost, and the share of days below each quantile."""
    rows = durable(forecast.series_rows(features.daily_series(fx.billing(spark, d))))
    made = durable(forecast.predict(forecast.fit(rows), rows))
    return forecast.evaluation(made).join(forecast.coverage(made).drop("n_test_rows"), ["organization_id", "level"])


@query("forecast_explained")
def _(spark, d):
    rows = durable(forecast.series_rows(features.daily_series(fx.billing(spark, d))))
    model = forecast.fit(rows, tail_rounds=0)
    return attribution.top_contributions(forecast.explain(model, rows))


@query("iforest")
def _(spark, d):
    z = durable(features.lagged_zscore(fx.billing(spark, d)))
    return isolation.detect(z, durable(isolation.fit(z, KEYS)), KEYS)


@query("iforest_sweep")
def _(spark, d):
    """The best percentile of each tenant for the scores of a forest fitted on the data."""
    z = durable(features.lagged_zscore(fx.billing(spark, d)))
    scored = durable(isolation.detect(z, durable(isolation.fit(z, KEYS)), KEYS))
    return evaluate.best_percentile(evaluate.anomaly_sweep(scored, fx.label_windows(spark, d)))


# the deterministic parts of the models, with SQL
FOREST = [  # dimension, tree, points, node, feature (0 value, 1 z-score), cut, left, right, depth of a leaf
    ("cost", 0, 256, 0, 0, 1000.0, 1, 2, 0.0), ("cost", 0, 256, 1, -1, 0.0, -1, -1, 6.0),
    ("cost", 0, 256, 2, 1, 1.5, 3, 4, 0.0), ("cost", 0, 256, 3, -1, 0.0, -1, -1, 4.0), ("cost", 0, 256, 4, -1, 0.0, -1, -1, 2.0),
    ("cost", 1, 100, 0, 1, -0.5, 1, 2, 0.0), ("cost", 1, 100, 1, -1, 0.0, -1, -1, 3.0), ("cost", 1, 100, 2, -1, 0.0, -1, -1, 7.5),
    ("cpu_avg_pct", 0, 20, 0, 0, 50.0, 1, 2, 0.0), ("cpu_avg_pct", 0, 20, 1, -1, 0.0, -1, -1, 1.0),
    ("cpu_avg_pct", 0, 20, 2, -1, 0.0, -1, -1, 5.0),
]


def _search_depth(n: int) -> str:
    return f"(2.0 * (ln({n} - 1.0) + 0.5772156649015329) - 2.0 * ({n} - 1) / {n})"


FOREST_COST = f"""pow(2.0, -((CASE WHEN cost <= 1000 THEN 6.0 WHEN cost_zscore <= 1.5 THEN 4.0 ELSE 2.0 END
  + CASE WHEN cost_zscore <= -0.5 THEN 3.0 ELSE 7.5 END) / 2) / (({_search_depth(256)} + {_search_depth(100)}) / 2))"""
FOREST_CPU = f"pow(2.0, -(CASE WHEN cpu_avg_pct <= 50 THEN 1.0 ELSE 5.0 END) / {_search_depth(20)})"


@query(
    "iforest_score",
    f"SELECT {KEY}, {r(FOREST_COST, 6)} AS raw_cost, {r(FOREST_CPU, 6)} AS raw_cpu_avg_pct FROM z",
)
def _(spark, d):
    z = features.lagged_zscore(fx.billing(spark, d))
    out = isolation.raw_scores(z, spark.createDataFrame(FOREST, isolation.NODE), KEYS, ["cost", "cpu_avg_pct"])
    return rounded(out, 6, "raw_cost", "raw_cpu_avg_pct")


GIVEN = """(SELECT *, coalesce(service, '') AS service_key, coalesce(lag7, lag1) AS forecast FROM (
  SELECT *, lag(cost, 1) OVER w AS lag1, lag(cost, 7) OVER w AS lag7,
         row_number() OVER w <= floor(0.8 * count(*) OVER (PARTITION BY organization_id, level, service)) AS is_train
  FROM series WINDOW w AS (PARTITION BY organization_id, level, service ORDER BY date)) WHERE lag1 IS NOT NULL)"""


def _given(spark, d):
    """Series with last week's cost in the place of a model's forecast."""
    rows = forecast.series_rows(features.daily_series(fx.billing(spark, d))).filter(F.col("lag_1d").isNotNull())
    return durable(rows.withColumn("forecast", F.coalesce("lag_7d", "lag_1d")))


@query(
    "forecast_band",
    f"""SELECT organization_id, level, service_key, date, {r('forecast', 4)} AS forecast, {r('least(forecast, forecast + lo)', 4)} AS ci_lower, {r('greatest(forecast, forecast + hi)', 4)} AS ci_upper
       FROM {GIVEN} JOIN (SELECT organization_id, level, service_key, quantile_cont(cost - forecast, 0.02) AS lo, quantile_cont(cost - forecast, 0.98) AS hi
         FROM {GIVEN} WHERE is_train GROUP BY ALL) USING (organization_id, level, service_key)""",
)
def _(spark, d):
    out = forecast.with_band(_given(spark, d))
    return rounded(
        out.select("organization_id", "level", "service_key", "date", "forecast", "ci_lower", "ci_upper"), 4, "forecast", "ci_lower", "ci_upper"
    )


def _errors_sql(name: str, value: str) -> str:
    return f"""{r(f'avg(abs(cost - {value}))', 4)} AS {name}_mae, {r(f'sqrt(avg((cost - {value}) * (cost - {value})))', 4)} AS {name}_rmse,
      {r(f'avg(abs((cost - {value}) / CASE WHEN cost = 0 THEN 1e-6 ELSE cost END)) * 100', 4)} AS {name}_mape"""


@query(
    "forecast_errors",
    f"""SELECT *, {r("coalesce((persistence_mape - model_mape) / nullif(persistence_mape, 0) * 100, 0)", 2)} AS error_reduction_pct FROM (
         SELECT organization_id, level, service_key, count(*) AS n_test_rows, {_errors_sql('model', 'forecast')}, {_errors_sql('persistence', 'lag1')}
         FROM {GIVEN} WHERE NOT is_train GROUP BY 1, 2, 3)""",
)
def _(spark, d):
    return forecast.evaluation(_given(spark, d))


QUANTILES = f"""(SELECT *, three[1] AS low, three[2] AS mid, three[3] AS high, is_train AND rn > floor(0.8 * n_train) AS is_calibration FROM (
  SELECT *, list_sort([lag1 * 0.9, forecast, lag1 * 1.05]) AS three, count(*) FILTER (is_train) OVER (PARTITION BY organization_id, level, service_key) AS n_train,
         row_number() OVER (PARTITION BY organization_id, level, service_key ORDER BY date) AS rn FROM {GIVEN}))"""
INTERVAL = f"""(SELECT g.*, least(low - wider, mid + band_low) AS ci_lower, greatest(high + wider, mid + band_high) AS ci_upper
  FROM {QUANTILES} g JOIN (SELECT organization_id, level, service_key, band_low, band_high,
         coalesce(greatest(0, misses[least(ceil((len(misses) + 1) * 0.9), len(misses))::INT]), 0) AS wider FROM (
       SELECT organization_id, level, service_key, quantile_cont(cost - mid, 0.02) FILTER (is_train) AS band_low, quantile_cont(cost - mid, 0.98) FILTER (is_train) AS band_high,
              list_sort(coalesce(list(greatest(low - cost, cost - high)) FILTER (is_calibration), [])) AS misses
       FROM {QUANTILES} GROUP BY ALL)) USING (organization_id, level, service_key))"""


def _given_interval(spark, d):
    """Bands from quantiles that are given by yesterday's and last week's cost, and often cross."""
    rows = forecast.mark_calibration(_given(spark, d)).withColumns(
        {"q_low": F.col("lag_1d") * 0.9, "q_mid": F.col("forecast"), "q_high": F.col("lag_1d") * 1.05}
    )
    return forecast.with_interval(durable(rows.drop("forecast")))


@query(
    "forecast_interval",
    f"""SELECT organization_id, level, service_key, date, {r('mid', 4)} AS forecast, {r('ci_lower', 4)} AS ci_lower, {r('ci_upper', 4)} AS ci_upper FROM {INTERVAL}""",
)
def _(spark, d):
    out = _given_interval(spark, d).select("organization_id", "level", "service_key", "date", "forecast", "ci_lower", "ci_upper")
    return rounded(out, 4, "forecast", "ci_lower", "ci_upper")


@query(
    "forecast_coverage",
    f"""SELECT organization_id, level, count(*) AS n_test_rows, {r('avg(CAST(cost <= lag1 * 0.9 AS INT)) * 100', 2)} AS below_q_low_pct, {r('avg(CAST(cost <= forecast AS INT)) * 100', 2)} AS below_q_mid_pct,
              {r('avg(CAST(cost <= lag1 * 1.05 AS INT)) * 100', 2)} AS below_q_high_pct, {r('avg(CAST(cost BETWEEN ci_lower AND ci_upper AS INT)) * 100', 2)} AS inside_pct,
              {r('avg(ci_upper - ci_lower)', 4)} AS mean_width
       FROM {INTERVAL} WHERE NOT is_train GROUP BY 1, 2""",
)
def _(spark, d):
    return forecast.coverage(_given_interval(spark, d))


PINBALL_LEAF = "CASE WHEN lag1 <= 2000 THEN 1 WHEN month(date) <= 6 THEN 3 ELSE 4 END"
PINBALL_TREE = quantile_boost.Tree(  # yesterday's cost, then the month
    np.array([0, -1, 1, -1, -1]), np.array([2000.0, 0.0, 6.0, 0.0, 0.0]), np.array([1, -1, 3, -1, -1]), np.array([2, -1, 4, -1, -1]), np.zeros(5)
)


@query(
    "pinball_leaves",
    f"""SELECT leaf, quantile, miss AS value FROM (SELECT *, row_number() OVER (PARTITION BY leaf, quantile ORDER BY miss) AS rn, count(*) OVER (PARTITION BY leaf, quantile) AS n FROM (
         SELECT CAST({PINBALL_LEAF} AS INT) AS leaf, cost - lag1 AS miss, unnest([0.05, 0.5, 0.95])::DOUBLE AS quantile FROM {GIVEN})) WHERE rn = greatest(ceil(quantile * n - 1e-9), 1)""",
)
def _(spark, d):
    from pyspark.ml.feature import VectorAssembler

    rows = _given(spark, d).select("lag_1d", F.month("date").cast("double").alias("month"), (F.col("cost") - F.col("lag_1d")).alias("miss"))
    vectors = VectorAssembler(inputCols=["lag_1d", "month"], outputCol="features").transform(rows)
    kept = durable(vectors.select(quantile_boost.leaves(PINBALL_TREE, "features").alias("leaf"), "miss"))
    found = [(leaf, q, v) for q in (0.05, 0.5, 0.95) for leaf, v in quantile_boost.few_group_quantiles(kept, "leaf", "miss", q).items()]
    return spark.createDataFrame(found, "leaf int, quantile double, value double")


EXPLAINED_TREE = pd.DataFrame(  # treeID, id, prediction, impurityStats (rows first), children, feature and cut
    [
        (0, 0, 0.0, [100.0], 1, 2, 4, 0.0), (0, 1, -0.5, [60.0], -1, -1, -1, 0.0), (0, 2, 0.5, [40.0], 3, 4, 0, 4.0),
        (0, 3, 0.3, [30.0], -1, -1, -1, 0.0), (0, 4, 1.2, [10.0], -1, -1, -1, 0.0),
    ],
    columns=["treeID", "id", "prediction", "impurityStats", "leftChild", "rightChild", "featureIndex", "threshold"],
)


@query(
    "explain_forecast",
    f"""SELECT organization_id, level, service_key, date, {r('(-0.09) * s + m', 4)} AS base_value, {r('v_ab * s + m', 4)} AS prediction,
              {r('0.5 * (v_a + 0.09 + v_ab - v_b) * s', 4)} AS lag_1d, {r('0.5 * (v_b + 0.09 + v_ab - v_a) * s', 4)} AS day_of_week
       FROM (SELECT *, CASE WHEN low THEN -0.5 ELSE 0.525 END AS v_a, -0.3 + 0.4 * b AS v_b, CASE WHEN low THEN -0.5 ELSE b END AS v_ab FROM (
         SELECT g.*, m, s, lag1 <= m AS low, CASE WHEN isodow(date) - 1 <= 4 THEN 0.3 ELSE 1.2 END AS b FROM {GIVEN} g
         JOIN (SELECT organization_id, level, service_key, avg(cost) AS m, coalesce(nullif(stddev_samp(cost), 0), 1.0) AS s FROM {GIVEN} WHERE is_train
               GROUP BY ALL HAVING count(*) >= 8) USING (organization_id, level, service_key)))""",
)
def _(spark, d):
    ident = [*forecast.SERIES_KEY, "date", "_mean", "_std"]
    named = forecast.inputs(_given(spark, d), ident)
    told = forecast.in_money(attribution.node_contributions(EXPLAINED_TREE, {0: 1.0}, named, forecast.INPUTS, ["cost"], ident, classifier=False))
    out = told.select(*forecast.SERIES_KEY, "date", "base_value", "prediction", *[F.col("contributions")[c].alias(c) for c in ("lag_1d", "day_of_week")])
    return rounded(out, 4, "base_value", "prediction", "lag_1d", "day_of_week")


@query(
    "forecast_narrative",
    f"""SELECT organization_id, level, service_key, date,
              array_to_string([replace(f.name, '_', ' ') || CASE WHEN f.v > 0 THEN ' +' ELSE ' -' END || format('{{:.2f}}', f.a) FOR f IN told] || ['active resource count -0.00'], ', ') AS narrative,
              array_to_string([f.name FOR f IN told] || ['active_resource_count', 'day_of_month', 'lag_7d'], ',') AS names
       FROM (SELECT *, list_sort([{{'k': -abs(pa), 'name': 'lag_1d', 'v': pa, 'a': {r('abs(pa)', 2)}}}, {{'k': -abs(pb), 'name': 'day_of_week', 'v': pb, 'a': {r('abs(pb)', 2)}}}]) AS told FROM (
         SELECT *, {r('0.5 * (v_a + 0.09 + v_ab - v_b) * s', 4)} AS pa, {r('0.5 * (v_b + 0.09 + v_ab - v_a) * s', 4)} AS pb FROM (
           SELECT *, CASE WHEN low THEN -0.5 ELSE 0.525 END AS v_a, -0.3 + 0.4 * b AS v_b, CASE WHEN low THEN -0.5 ELSE b END AS v_ab FROM (
             SELECT g.*, s, lag1 <= m AS low, CASE WHEN isodow(date) - 1 <= 4 THEN 0.3 ELSE 1.2 END AS b FROM {GIVEN} g
             JOIN (SELECT organization_id, level, service_key, avg(cost) AS m, coalesce(nullif(stddev_samp(cost), 0), 1.0) AS s FROM {GIVEN} WHERE is_train
                   GROUP BY ALL HAVING count(*) >= 8) USING (organization_id, level, service_key)))))""",
)
def _(spark, d):
    """Names, signs and wording of the strongest contributions to a forecast of the fixed tree."""
    ident = [*forecast.SERIES_KEY, "date", "_mean", "_std"]
    named = forecast.inputs(_given(spark, d), ident)
    told = forecast.in_money(attribution.node_contributions(EXPLAINED_TREE, {0: 1.0}, named, forecast.INPUTS, ["cost"], ident, classifier=False))
    names = F.map_keys(F.from_json("top_features", "map<string,double>"))
    return attribution.top_contributions(told).select(*forecast.SERIES_KEY, "date", "narrative", F.array_join(names, ",").alias("names"))


@query("forecast_left_out", f"SELECT organization_id, level, service_key, count(*) AS n_days, count(*) FILTER (is_train) AS n_train_days FROM {GIVEN} GROUP BY ALL HAVING n_train_days < 8")
def _(spark, d):
    return forecast.left_out(_given(spark, d))


@query(
    "attribution_adds_up",
    f"SELECT {KEY}, bucket, true AS adds_up, true AS ordered FROM scored_latest",
)
def _(spark, d):
    from pyspark.ml.functions import vector_to_array

    scored = durable(fx.scored(spark, d).select(*KEYS, "bucket", *fv.CLASSIFIER_FEATURES))
    model, rows = waste_classifier.fit(scored), durable(latest_rows(scored, SERIES))
    # read for the sums and for the strongest
    parts = durable(attribution.contributions(model, rows, fv.CLASSIFIER_FEATURES, waste_classifier.LABELS, [*KEYS, "bucket"], only="bucket"))
    place = F.array_position(F.array(*[F.lit(x) for x in waste_classifier.LABELS]), F.col("bucket")).cast("int")
    told = model.transform(waste_classifier.vectors(rows)).select(*KEYS, F.element_at(vector_to_array("probability"), place).alias("_p"))
    total = F.aggregate(F.map_values("contributions"), F.lit(0.0), lambda a, v: a + v)
    tops = attribution.top_contributions(parts).select(*KEYS, F.from_json("top_features", "map<string,double>").alias("_t"))
    sizes = F.transform(F.map_values("_t"), lambda v: -F.abs(v))
    return parts.join(told, KEYS).join(tops, KEYS).select(
        *KEYS, "bucket", (F.abs(F.col("base_value") + total - F.col("_p")) < 1e-9).alias("adds_up"), (sizes == F.array_sort(sizes)).alias("ordered")
    )


# --- streams ------------------------------------------------------------------------------------------
@query(
    "stream_daily",
    f"""SELECT vm_id, CAST(ts AS DATE) AS date, count(*) AS n, {r('sum(disk_read_kbps)', 6)} AS disk_read_kbps, {r('avg(memory_usage_kb)', 6)} AS memory_usage_kb
       FROM f2 WHERE CAST(ts AS DATE) + INTERVAL 1 DAY <= (SELECT max(ts) FROM f2) - INTERVAL 1 DAY GROUP BY 1, 2""",
)
def _(spark, d):
    raw = ingest.file_stream(spark, d, "events.parquet", fx.SCHEMAS["events"])
    out = ingest.drain_to_table(ingest.daily_rollup(fx.telemetry(spark, d, raw)))
    return rounded(
        out.select("vm_id", "date", "n", "disk_read_kbps", "memory_usage_kb"), 6, "disk_read_kbps", "memory_usage_kb"
    )


@query(
    "stream_corrected",
    f"""SELECT vm_id, CAST(ts AS DATE) AS date, count(*) AS n, {r('sum(disk_read_kbps)', 6)} AS disk_read_kbps, {r('avg(memory_usage_kb)', 6)} AS memory_usage_kb
       FROM f2 WHERE CAST(ts AS DATE) < CAST((SELECT max(ts) FROM f2) - INTERVAL 1 DAY AS DATE) GROUP BY 1, 2""",
)
def _(spark, d):
    """Events that come in three files over the same days: two thirds of them are late, and no day loses them."""
    folder = new_folder(spark)
    events = fx.table(spark, d, "events")
    events.repartitionByRange(3, F.xxhash64("event_id")).write.parquet(folder)
    raw = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(folder)
    issued, _ = ingest.corrected_rollup(fx.telemetry(spark, d, raw))
    out = spark.read.parquet(issued)
    return rounded(
        out.select("vm_id", "date", "n", "disk_read_kbps", "memory_usage_kb"), 6, "disk_read_kbps", "memory_usage_kb"
    )


@query("stream_dedupe", "SELECT vm_id, ts FROM f2u")
def _(spark, d):
    raw = ingest.file_stream(spark, d, "events.parquet", fx.SCHEMAS["events"])
    out = ingest.drain_to_table(ingest.first_seen(fx.telemetry(spark, d, raw)))
    return out.select("vm_id", F.col("ts").cast("timestamp_ntz").alias("ts"))


@query("stream_ingest", "SELECT rule, severity, count(*) AS n FROM fails GROUP BY 1, 2")
def _(spark, d):
    raw = ingest.file_stream(spark, d, "lineitem.parquet", fx.SCHEMAS["lineitem"])
    _, found = ingest.ingest_validated(
        raw, lambda batch: fx.upload_rows(spark, d, batch), require_region=True, require_known_type=True
    )
    return metrics.counts_by(spark.read.parquet(found), "rule", "severity")

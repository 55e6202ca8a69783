"""The given tables projected into the canonical inputs of the operators."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DecimalType

from cloudtally import fixed_values as fv
from cloudtally.functions.numeric import clamp, half_up
from cloudtally.operators import advice, anomaly, features, gold, silver, waste
from cloudtally.operators.series import SERIES, latest_rows
from cloudtally.runtime import dealt, durable

CENTS = DecimalType(12, 2)


SCHEMAS = {  # declared, so that no scan has to open files while planning
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
    "o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
    "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, "
    "l_shipdate timestamp_ntz",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
    "embeddings": "vec_id bigint, embedding array<float>, label int",
    "conversations": "conv_id bigint, turn bigint, role string, text string",
}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[name]).parquet(f"{folder}/{name}.parquet")


TYPE_ARRAY = "array({})".format(", ".join(f"'{n}'" for n, _, _ in fv.INSTANCE_SPECS))


def type_name(order):
    return F.element_at(F.expr(TYPE_ARRAY), order + 1)


def vm(key):
    return F.concat(F.lit("vm-"), (F.col(key) if isinstance(key, str) else key).cast("string"))


def org(key):
    return F.concat(F.lit("org-"), (F.col(key) % 5).cast("string"))


def billing(spark: SparkSession, folder: str) -> DataFrame:
    """Canonical daily billing: one row per (tenant, resource, day).

    Line items are summed per supplier and day before the dimensions are joined, so the joins
    see daily rows only. The dimensions are joined one by one: the size that Spark expects of their own join
    is a product, beside which the daily rows would be sent to all tasks.
    """
    # whole cents times whole percent: exact and order-independent in 64-bit integers
    price = F.rint(F.col("l_extendedprice") * 100).cast("long") * (100 - F.rint(F.col("l_discount") * 100).cast("long"))
    lines = table(spark, folder, "lineitem").withColumn("date", F.to_date("l_shipdate"))
    daily = (
        dealt(lines, "l_suppkey", "date", scanned=True)
        .groupBy("l_suppkey", "date")
        .agg(
            (F.sum(price).cast("double") / 10000).alias("cost"),
            F.avg("l_quantity").alias("_q"),
            F.avg("l_discount").alias("_d"),
            F.sum("l_quantity").alias("disk_io"),
            F.avg("l_tax").alias("_t"),
        )
    )
    owned = (
        daily.join(table(spark, folder, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
        .join(table(spark, folder, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
        .join(table(spark, folder, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    )
    return owned.select(
        org("n_nationkey").alias("organization_id"),
        "date",
        F.col("n_name").alias("account_id"),
        F.expr("element_at(array('EC2', 'S3', 'RDS', 'Lambda'), cast(s_suppkey % 4 + 1 as int))").alias("service"),
        vm("s_suppkey").alias("resource_id"),
        type_name((F.col("s_suppkey") % 33).cast("int")).alias("instance_type"),
        F.col("r_name").alias("region"),
        "cost",
        F.lit(24.0).alias("usage_hours"),
        half_up(F.col("_q") * 2, 2).alias("cpu_avg_pct"),
        half_up(F.col("_d") * 1000, 2).alias("memory_avg_pct"),
        "disk_io",
        half_up(F.col("_t") * 1000, 2).alias("network_io"),
        F.when(F.col("s_suppkey") % 4 == 0, 1).otherwise(0).alias("anomaly_history_count"),
    )


def upload_rows(spark: SparkSession, folder: str, lines: DataFrame | None = None) -> DataFrame:
    """Line items as an unvalidated upload in canonical names, defects included."""
    lines = table(spark, folder, "lineitem") if lines is None else lines
    nation = table(spark, folder, "nation")
    supplier = table(spark, folder, "supplier")
    key, line = F.col("l_orderkey"), F.col("l_linenumber")
    return (
        lines.join(supplier, F.col("l_suppkey") == F.col("s_suppkey"))
        .join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
        .select(
            F.concat(key.cast("string"), F.lit("-"), line.cast("string"), F.lit("-"), F.col("l_partkey").cast("string")).alias("row_id"),
            org("n_nationkey").alias("organization_id"),
            F.when(key % 97 != 0, F.to_date("l_shipdate")).alias("date"),
            vm(F.col("l_suppkey") % 40).alias("resource_id"),  # tenants share ids
            F.when(key % 89 == 0, -F.col("l_extendedprice")).otherwise(F.col("l_extendedprice")).alias("cost"),
            (F.col("l_quantity") * 2.25 - 3).alias("cpu_avg_pct"),
            F.when(F.col("l_discount") == 0, -1.0).otherwise(F.col("l_quantity")).alias("memory_avg_pct"),
            F.when(line == 3, F.lit("  ")).when(line == 5, F.lit(None)).otherwise(F.col("n_name")).alias("region"),
            F.when(F.col("l_suppkey") % 40 == 39, F.lit("m9.huge")).otherwise(
                type_name((F.col("l_suppkey") % 33).cast("int"))
            ).alias("instance_type"),
        )
    )


def telemetry(spark: SparkSession, folder: str, raw: DataFrame | None = None) -> DataFrame:
    """Raw sub-daily machine telemetry with repeated keys and gaps."""
    raw = table(spark, folder, "events") if raw is None else raw
    events = raw.select(
        "event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type", "value", "props"
    )
    again = events.filter(F.col("event_id") % 50 == 0).withColumn("value", F.col("value") + 1)
    both = events.withColumn("src", F.lit(0)).unionByName(again.withColumn("src", F.lit(1)))
    known = F.col("event_type") != "error"

    def only(kind):
        return F.when(F.col("event_type") == kind, F.col("value")).otherwise(0.0)

    return both.select(
        F.col("user_id").alias("vm_id"),
        "ts",
        (1 + F.col("user_id") % 16).cast("int").alias("cpu_cores"),
        F.lit(500.0).alias("cpu_capacity_mhz"),
        F.when(known, F.col("value")).alias("cpu_usage_mhz"),
        F.when(known, F.col("value") / 5).alias("cpu_usage_percent"),
        F.lit(102400.0).alias("memory_provisioned_kb"),
        (F.get_json_object("props", "$.k").cast("int") * 1024.0).alias("memory_usage_kb"),
        only("view").alias("disk_read_kbps"),
        only("click").alias("disk_write_kbps"),
        only("signup").alias("network_received_kbps"),
        only("purchase").alias("network_transmitted_kbps"),
        "src",
        "event_id",
    )


def price_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Vendor price rows, some invalid, with tiers that exist only for some types."""
    key, size = F.col("p_partkey"), F.col("p_size")
    spec = key % 33
    kind = F.col("p_type")
    zone = (
        F.when(size % 4 == 0, "us-east-1")
        .when(size % 4 == 1, "us-west-2")
        .when(size % 4 == 2, "ap-south-1")
        .otherwise("eu-west-1")
    )
    system = (
        F.when(kind == "ECONOMY", "Linux/UNIX")
        .when(kind == "SMALL", "Red Hat Enterprise Linux")
        .when(kind == "MEDIUM", "SUSE Linux")
        .when(kind == "PROMO", "Windows")
        .when(kind == "LARGE", " BSD ")
    )
    tier = (
        F.when((spec % 3 == 2) & (key % 2 == 0), "on_demand")
        .when((spec % 3 >= 1) & (key % 5 < 3), "spot")
        .otherwise("prediction")
    )
    return table(spark, folder, "part").select(
        type_name(spec.cast("int")).alias("instance_type"),
        F.concat(zone, F.substr(F.lit("abc"), (size % 3 + 1).cast("int"), F.lit(1))).alias("region_raw"),
        system.alias("os_raw"),
        tier.alias("pricing_type"),
        F.when(key % 41 == 0, -1.0).otherwise(F.col("p_retailprice") / 1000).alias("hourly_rate"),
        F.date_add(F.lit("2024-01-01").cast("date"), size).alias("effective_date"),
        F.concat(F.lower(kind), F.lit(".csv")).alias("source_file"),
    )


def order_series(spark: SparkSession, folder: str) -> DataFrame:
    """Daily cost and active customers per market segment."""
    orders, customer = table(spark, folder, "orders"), table(spark, folder, "customer")
    rows = orders.join(customer, F.col("o_custkey") == F.col("c_custkey")).select(
        F.to_date("o_orderdate").alias("date"),
        F.col("c_mktsegment").alias("service"),
        F.col("o_custkey").alias("resource_id"),
        F.col("o_totalprice").cast(CENTS).alias("cost"),
        F.lit("org-0").alias("organization_id"),
    )
    return rows


def daily_orders(spark: SparkSession, folder: str) -> DataFrame:
    return features.daily_series(order_series(spark, folder))


def label_windows(spark: SparkSession, folder: str) -> DataFrame:
    """Labelled incidents; another tenant has a machine of each name, with incidents at other times."""
    key, other = F.col("s_suppkey"), F.col("other")
    start = F.date_add(F.lit("1996-01-01").cast("date"), (key * 37 % 1500 + 400 * other).cast("int"))
    return table(spark, folder, "supplier").withColumn("other", F.explode(F.array(F.lit(0), F.lit(1)))).select(
        F.concat(F.lit("org-"), ((F.col("s_nationkey") + other) % 5).cast("string")).alias("organization_id"),
        vm("s_suppkey").alias("resource_id"),
        F.when(key % 3 == 0, "idle_but_billed").when(key % 3 == 1, "spend_spike").otherwise("slow_leak").alias("anomaly_type"),
        start.alias("start_date"),
        F.date_add(start, (7 + key % 14).cast("int")).alias("end_date"),
    )


def actions(spark: SparkSession, folder: str) -> DataFrame:
    """Two what-if scenarios per tenant, each also naming a machine that does not exist."""
    key = F.col("s_suppkey")
    real = table(spark, folder, "supplier").filter(key % 10 < 5).select(
        org("s_nationkey").alias("organization_id"),
        (key % 2).cast("int").alias("scenario_id"),
        vm("s_suppkey").alias("resource_id"),
        F.when(key % 10 < 2, "terminate").otherwise("resize").alias("action_type"),
        F.when((key % 10).between(2, 3), 100.0).alias("new_hourly_rate"),
        F.lit(0).alias("action_order"),
    )
    ghosts = table(spark, folder, "region").select(
        org("r_regionkey").alias("organization_id"),
        F.lit(0).alias("scenario_id"),
        F.lit("vm-unknown").alias("resource_id"),
        F.lit("terminate").alias("action_type"),
        F.lit(None).cast("double").alias("new_hourly_rate"),
        F.lit(0).alias("action_order"),
    )
    return real.unionByName(ghosts)


def questions(spark: SparkSession, folder: str) -> DataFrame:
    """What users said in conversations, and order comments phrased as cost questions."""
    said = table(spark, folder, "conversations").filter(F.col("role") == "user").select(
        F.concat(F.lit("c"), F.col("conv_id").cast("string"), F.lit("-"), F.col("turn").cast("string")).alias("question_id"),
        F.col("text").alias("question"),
    )
    phrases = (
        "Why did my bill increase?",
        "Which instances should I terminate?",
        "Show idle resources",
        "Compare last month vs this month",
        "Which VM had the highest network usage?",
        "Forecast EC2 cost for next week",
        "List unused RDS machines in eu-west-1",
        "What is the weather?",
    )
    asked = table(spark, folder, "orders").select(
        F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("question_id"),
        F.concat(
            F.element_at(F.array(*[F.lit(p) for p in phrases]), (F.col("o_orderkey") % 8 + 1).cast("int")),
            F.lit(" "),
            F.col("o_orderpriority"),
        ).alias("question"),
    )
    return said.unionByName(asked)


def registry(spark: SparkSession, folder: str) -> DataFrame:
    key = F.col("n_nationkey")
    return table(spark, folder, "nation").select(
        F.when(key % 3 == 0, "forecast").when(key % 3 == 1, "anomaly").otherwise("waste_classifier").alias("model_type"),
        F.concat(F.lit("v"), key.cast("string")).alias("version"),
        F.date_add(F.lit("2024-01-01").cast("date"), key).alias("training_date"),
        F.create_map(
            F.lit("mape"), (F.col("n_regionkey") * 1.5),
            F.lit("f1_macro"), (key / 25.0),
            F.lit("error_reduction_pct"), (key * 2.5),
        ).alias("evaluation_metrics"),
        (key >= 22).alias("is_active"),
    )


# --- tables further down the line ----------------------------------------------------------------
def grown(spark: SparkSession, folder: str) -> DataFrame:
    return features.growth(billing(spark, folder))


def stored_billing(spark: SparkSession, folder: str) -> DataFrame:
    """Billing as a stored table, for queries that pass over it more than once."""
    return durable(billing(spark, folder))


def scored(spark: SparkSession, folder: str) -> DataFrame:
    return waste.waste_score(features.growth(stored_billing(spark, folder)))


def scored_latest(spark: SparkSession, folder: str) -> DataFrame:
    return latest_rows(scored(spark, folder), SERIES)


def anomalies(spark: SparkSession, folder: str) -> DataFrame:
    return incidents(billing(spark, folder))


def incidents(base: DataFrame) -> DataFrame:
    """Incident scores over a deterministic stand-in: |z| x 10, at most 100, per dimension."""
    z = features.lagged_zscore(base)
    stand_in = {
        f"anomaly_score_{d}": half_up(clamp(F.abs(F.col(f"{d}_zscore")) * 10, 0.0, 100.0), 6)
        for d in fv.INCIDENT_WEIGHTS
    }
    return anomaly.fuse(z.withColumns(stand_in))


def rates(spark: SparkSession, folder: str) -> DataFrame:
    return gold.rates(silver.prices(price_rows(spark, folder)))


def recommended(latest: DataFrame, rates: DataFrame) -> DataFrame:
    number = F.regexp_extract("resource_id", r"(\d+)", 1).cast("int")
    return advice.recommend(latest, rates).withColumns(
        {
            "recommendation_id": F.concat(F.lit("rec-"), "resource_id"),
            "status": F.when(number % 4 == 0, "dismissed").otherwise("open"),
        }
    )


def recommendations(spark: SparkSession, folder: str) -> DataFrame:
    return recommended(scored_latest(spark, folder), rates(spark, folder))


class Stages:
    """Stage outputs that several parts of one query read, each written once.

    The nightly job stores scores, anomalies and recommendations; KPI queries read what it
    stored. Only the columns that are read later are kept.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    @cached_property
    def billing(self) -> DataFrame:
        return stored_billing(self.spark, self.folder)

    @cached_property
    def scored(self) -> DataFrame:
        keep = (
            *SERIES, "date", "service", "instance_type", "cost", "cpu_avg_pct", "memory_avg_pct",
            "runtime_days", "waste_score", "bucket",
        )
        return durable(waste.waste_score(features.growth(self.billing)).select(*keep))

    @cached_property
    def latest(self) -> DataFrame:
        return durable(latest_rows(self.scored, SERIES))

    @cached_property
    def anomalies(self) -> DataFrame:
        keep = (*SERIES, "date", "incident_score", "severity")
        return durable(incidents(self.billing).select(*keep))

    @cached_property
    def recommendations(self) -> DataFrame:
        return durable(recommended(self.latest, rates(self.spark, self.folder)))

    @cached_property
    def forecasts(self) -> DataFrame:
        return forecasts(self.spark, self.folder, self.billing)


def forecasts(spark: SparkSession, folder: str, base: DataFrame | None = None) -> DataFrame:
    """Yesterday's cost as the forecast of each (tenant, service) day, with a ten-percent band."""
    daily = features.daily_series(billing(spark, folder) if base is None else base)
    sup = features.supervised(daily, keys=("organization_id", "level", "service"))
    return sup.filter(F.col("lag_1d").isNotNull()).select(
        "organization_id", "level", "service",
        F.col("date").alias("forecast_date"),
        F.col("lag_1d").alias("forecast"),
        (F.col("lag_1d") * 0.9).alias("ci_lower"),
        (F.col("lag_1d") * 1.1).alias("ci_upper"),
    )


def with_dataset(df: DataFrame) -> DataFrame:
    return df.withColumn("dataset_id", F.concat(F.lit("ds-"), F.year("date").cast("string")))


def datasets(spark: SparkSession, folder: str) -> DataFrame:
    """One upload per tenant and year; the active one differs by tenant."""
    years = with_dataset(billing(spark, folder)).select("organization_id", "dataset_id").distinct()
    n = F.substring("organization_id", 5, 1).cast("int")
    return years.withColumn(
        "active_flag", F.col("dataset_id") == F.concat(F.lit("ds-"), (F.lit(1994) + n).cast("string"))
    )


def feature_store(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """A first batch of stored features and a later one that overlaps it on odd resources."""
    base = billing(spark, folder)
    number = F.regexp_extract("resource_id", r"(\d+)", 1).cast("int")

    def batch(df, cost, day):
        return df.select(
            "organization_id", "resource_id", "date", F.lit("v1").alias("feature_version"),
            F.create_map(F.lit("cost"), cost, F.lit("cpu_avg_pct"), F.col("cpu_avg_pct")).alias("features"),
            F.lit(day).cast("timestamp").alias("created_at"),
        )

    first = batch(base, F.col("cost"), "2024-01-01")
    second = batch(base.filter(number % 2 == 1), F.col("cost") * 2, "2024-01-02")
    return first, second

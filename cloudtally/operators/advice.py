"""Savings recommendations, their scoring, and what-if repricing."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cloudtally import fixed_values as fv
from cloudtally.functions.numeric import MONEY, banded, clamp, half_up
from cloudtally.functions.skew import sized_join
from cloudtally.operators import retrieve
from cloudtally.runtime import durable

TENANT = ("organization_id",)


# --- formulas -------------------------------------------------------------------------------
def savings(current: Column, target: Column, hours: Column | float) -> Column:
    hours = F.lit(hours) if isinstance(hours, float) else hours
    return half_up(F.greatest(F.lit(0.0), (current - target) * hours), 2)


def confidence(classifier: Column, anomaly: Column, forecast: Column, quality: Column) -> Column:
    """Weighted 0-100 confidence; the anomaly score comes in on a 0-100 scale, the rest on 0-1."""
    w = fv.CONFIDENCE_WEIGHTS
    total = (
        w["classifier"] * clamp(classifier, 0.0, 1.0)
        + w["anomaly"] * clamp(anomaly / 100, 0.0, 1.0)
        + w["forecast"] * clamp(forecast, 0.0, 1.0)
        + w["data_quality"] * clamp(quality, 0.0, 1.0)
    )
    return half_up(total * 100, 2)


def impact_score(monthly_savings: Column, confidence_pct: Column) -> Column:
    return half_up(monthly_savings * confidence_pct / 100, 2)


def impact_tier(score: Column, high: float | None = None, medium: float | None = None) -> Column:
    (h, high_name), (m, medium_name) = fv.IMPACT_BANDS
    bands = ((h if high is None else high, high_name), (m if medium is None else medium, medium_name))
    return banded(score, bands, fv.IMPACT_FLOOR)


def reason(df: DataFrame) -> Column:
    """The signals that look wasteful, how long the resource has run, and its bucket."""

    def pct(c):
        return F.format_string("%.0f", F.bround(F.col(c), 0))

    parts, cpu_text = [], None
    if "cpu_avg_pct" in df.columns:
        cpu_text = F.concat(F.lit("CPU averaged "), pct("cpu_avg_pct"), F.lit("%"))
        parts.append(F.when(F.col("cpu_avg_pct") < 20, cpu_text))
    if "memory_avg_pct" in df.columns:
        text = F.concat(F.lit("memory utilization averaged "), pct("memory_avg_pct"), F.lit("%"))
        parts.append(F.when(F.col("memory_avg_pct") < 20, text))
    signals = F.concat_ws(", ", *parts) if parts else F.lit("")
    if cpu_text is not None:
        signals = F.when(signals == "", F.coalesce(cpu_text, F.lit(""))).otherwise(signals)
    spell = (
        F.coalesce(
            F.concat(F.lit(" over "), F.col("runtime_days").cast("string"), F.lit(" days")), F.lit("")
        )
        if "runtime_days" in df.columns
        else F.lit("")
    )
    return F.concat(signals, spell, F.lit(" ("), F.col("bucket"), F.lit(")"))


# --- recommendations ------------------------------------------------------------------------
def _map_of(pairs: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv])


def recommend(
    scored: DataFrame,
    rates: DataFrame | None = None,
    data_quality: float = fv.CONFIDENCE_DEFAULTS["data_quality"],
    high: float | None = None,
    medium: float | None = None,
    hours: float = fv.MONTH_HOURS,
) -> DataFrame:
    """At most one action per scored row: stop idle machines, shrink underused ones, leave the rest.

    ``rates`` is (instance_type, hourly_rate) with one row per type. Without a listed
    rate the row's own daily cost over 24 h is used, and half of it for a smaller machine.
    Optional inputs ``classifier_confidence``, ``incident_score`` and
    ``forecast_confidence`` raise or lower the confidence; where NULL the defaults apply.
    """
    have = set(scored.columns)
    df = scored if "instance_type" in have else scored.withColumn("instance_type", F.lit(None).cast("string"))
    df = df.filter(F.col("bucket").isin("Idle", "Critical Waste", "Underutilized"))
    df = df.withColumn("target_type", F.try_element_at(_map_of(fv.DOWNSIZE), F.col("instance_type")))
    if rates is not None:
        priced = durable(rates)
        now = priced.select("instance_type", F.col("hourly_rate").alias("_listed"))
        then = priced.select(
            F.col("instance_type").alias("target_type"), F.col("hourly_rate").alias("_target_listed")
        )
        df = sized_join(sized_join(df, now, ["instance_type"]), then, ["target_type"])
    else:
        none = F.lit(None).cast("double")
        df = df.withColumns({"_listed": none, "_target_listed": none})
    stop = F.col("bucket").isin("Idle", "Critical Waste")
    shrink = (F.col("bucket") == "Underutilized") & F.col("target_type").isNotNull()
    current = F.coalesce("_listed", F.col("cost") / 24, F.lit(0.0))
    target = F.when(stop, F.lit(0.0)).otherwise(F.coalesce("_target_listed", current * 0.5))

    def given(name, key):
        default = F.lit(fv.CONFIDENCE_DEFAULTS[key])
        return F.coalesce(F.col(name), default) if name in have else default

    advised = df.filter(stop | shrink).withColumns(
        {
            "action": F.when(stop, F.concat(F.lit("Terminate "), "resource_id")).otherwise(
                F.concat(
                    F.lit("Downsize "), "resource_id", F.lit(" from "), "instance_type",
                    F.lit(" to "), "target_type",
                )
            ),
            "estimated_savings": savings(current, target, hours),
            "confidence": confidence(
                given("classifier_confidence", "classifier"),
                given("incident_score", "anomaly"),
                given("forecast_confidence", "forecast"),
                F.lit(data_quality),
            ),
            "reason": reason(df),
        }
    )
    out = advised.withColumn(
        "impact_score", impact_score(F.col("estimated_savings"), F.col("confidence"))
    ).withColumn("impact_tier", impact_tier(F.col("impact_score"), high, medium))
    lead = [c for c in ("organization_id", "dataset_id") if c in have]
    return out.select(
        *lead, "resource_id", "action", "estimated_savings", "confidence", "reason",
        "impact_score", "impact_tier",
    )


def with_citation(recs: DataFrame, cited: DataFrame) -> DataFrame:
    """Attach the best guidance passage per resource (output of retrieval), else the generic label."""
    keys = [*(t for t in TENANT if t in recs.columns or t in cited.columns), "resource_id"]
    return sized_join(recs, cited, keys).withColumns(
        {
            "supporting_rule": F.coalesce("title", F.lit(fv.GENERIC_CITATION)),
            "citation_chunk_ids": F.array_compact(F.array("chunk_id")),
        }
    ).drop("title", "chunk_id")


def best_citations(asked: DataFrame, guidance: DataFrame) -> DataFrame:
    """query_id, chunk_id and title of the passage that is nearest to each question.

    ``asked`` has a row of query_id and embedding for each kind of question (not for each recommendation), ``guidance``
    one of chunk_id (a number), title and embedding for each passage.
    """
    near = retrieve.top_k(asked, guidance, k=1, ident="chunk_id").select("query_id", "chunk_id")
    return sized_join(guidance.select("chunk_id", "title"), near, ["chunk_id"], "inner").select("query_id", "chunk_id", "title")


def cite(recs: DataFrame, question: Column, asked: DataFrame, guidance: DataFrame) -> DataFrame:
    """Recommendations with the passage for the kind of question each of them asks, else the generic label."""
    found = best_citations(asked, guidance).withColumnRenamed("query_id", "_question")
    return sized_join(recs.withColumn("_question", question), found, ["_question"]).withColumns(
        {
            "supporting_rule": F.coalesce("title", F.lit(fv.GENERIC_CITATION)),
            "citation_chunk_ids": F.array_compact(F.array("chunk_id")),
        }
    ).drop("_question", "title", "chunk_id")


def without_open(scored: DataFrame, recommendations: DataFrame) -> DataFrame:
    """Resources that have no open recommendation yet."""
    keys = [c for c in ("organization_id", "resource_id") if c in recommendations.columns]
    taken = recommendations.filter(F.col("status") == "open").select(*keys).distinct()
    return sized_join(scored, taken, keys, "left_anti")


def set_status(
    recs: DataFrame, updates: DataFrame, key: str = "recommendation_id", order: str = "updated_at"
) -> DataFrame:
    """Apply (id, new_status, updated_at) rows; unknown ids and unknown statuses change nothing.

    Of several updates of one id the last valid one holds (at one time the alphabetically last).
    """
    if order not in updates.columns:
        raise ValueError(f"status updates need the column {order}, which tells their order")
    allowed = F.col("new_status").isin(*fv.RECOMMENDATION_STATUSES)
    last = F.max_by("new_status", F.struct(F.col(order), F.col("new_status")))
    valid = updates.filter(allowed).groupBy(key).agg(last.alias("_new"))
    return (
        sized_join(recs, valid, [key])
        .withColumn("status", F.coalesce("_new", "status"))
        .drop("_new")
        .select(*recs.columns)
    )


# --- what-if ------------------------------------------------------------------------------------
def trailing(df: DataFrame, days: int = 30, tenant: Sequence[str] = TENANT) -> DataFrame:
    """Rows from each tenant's newest date back ``days`` days, both ends included."""
    newest = df.groupBy(*tenant).agg(F.max("date").alias("_last"))
    return (
        sized_join(df, newest, tenant)
        .filter(F.col("date") >= F.date_sub("_last", days))
        .drop("_last")
    )


def _by_resource(window: DataFrame, tenant: Sequence[str]) -> DataFrame:
    """The window collapsed to what scenarios need, one row per (tenant, resource, day)."""
    return window.groupBy(*tenant, "resource_id", "date").agg(
        F.sum(F.col("cost").cast(MONEY)).alias("cost"),
        F.sum(F.coalesce("usage_hours", F.lit(24.0))).alias("hours"),
    )


def _ordered(actions: DataFrame) -> DataFrame:
    if "action_order" not in actions.columns:
        raise ValueError("actions need the column action_order: steps on one resource build on each other")
    return actions


def scenario_log(
    billing: DataFrame, actions: DataFrame, days: int = 30, tenant: Sequence[str] = TENANT
) -> DataFrame:
    """What each action does to its resource inside the window, or why it does nothing.

    ``actions`` is (tenant, scenario_id, resource_id, action_type, new_hourly_rate, action_order).
    Where a scenario touches a resource more than once, each step starts from the cost the
    previous one left behind.
    """
    seen = (
        _by_resource(trailing(billing, days, tenant), tenant)
        .groupBy(*tenant, "resource_id")
        .agg(F.sum("cost").alias("_cost"), F.sum("hours").alias("_hours"))
    )
    found = F.col("_cost").isNotNull()
    stop = F.col("action_type") == "terminate"
    priced = stop | F.col("new_hourly_rate").isNotNull()
    after = F.when(
        F.col("applied"),
        F.when(stop, F.lit(0.0)).otherwise(F.col("_hours") * F.col("new_hourly_rate")),
    )
    steps = (
        Window.partitionBy(*tenant, "scenario_id", "resource_id")
        .orderBy("action_order")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    before = F.coalesce(F.last("_after", ignorenulls=True).over(steps), F.col("_cost").cast("double"))
    return (
        _ordered(actions)
        .join(seen, [*tenant, "resource_id"], "left")
        .withColumn("applied", found & priced)
        .withColumn("_after", after)
        .withColumn("_before", F.when(F.col("applied"), before))
        .select(
            *tenant,
            "scenario_id",
            "resource_id",
            "action_type",
            "applied",
            half_up(F.col("_before"), 2).alias("cost_before"),
            half_up(F.col("_after"), 2).alias("cost_after"),
            F.when(~found, "resource_id not found in the simulation window")
            .when(~priced, "new_hourly_rate required for resize action")
            .alias("note"),
        )
    )


def scenarios(
    billing: DataFrame, actions: DataFrame, days: int = 30, tenant: Sequence[str] = TENANT
) -> DataFrame:
    """Current and projected monthly cost per (tenant, scenario), all scenarios in one job.

    A scenario only changes the days of its own resources, so it is the tenant's total plus the
    changes; the window is never multiplied by the number of scenarios. The last effective
    action on a resource decides.
    """
    rows = _by_resource(trailing(billing, days, tenant), tenant)
    base = (
        rows.groupBy(*tenant, "date")
        .agg(F.sum("cost").alias("_day"))
        .groupBy(*tenant)
        .agg(F.sum("_day").alias("_total"), F.count("*").alias("_days"))
    )
    stop = F.col("action_type") == "terminate"
    effective = (
        _ordered(actions)
        .filter(stop | F.col("new_hourly_rate").isNotNull())
        .groupBy(*tenant, "scenario_id", "resource_id")
        .agg(F.max_by(F.struct("action_type", "new_hourly_rate"), F.col("action_order")).alias("_a"))
        .select(*tenant, "scenario_id", "resource_id", "_a.action_type", "_a.new_hourly_rate")
    )
    new_cost = F.when(stop, F.lit(0.0)).otherwise(F.col("hours") * F.col("new_hourly_rate"))
    change = (
        rows.join(effective, [*tenant, "resource_id"])
        .groupBy(*tenant, "scenario_id")
        .agg(F.sum(new_cost.cast(MONEY) - F.col("cost")).alias("_change"))
    )
    monthly = 30 / F.col("_days")
    now = F.col("_total").cast("double") * monthly
    then = (F.col("_total") + F.coalesce("_change", F.lit(0).cast(MONEY))).cast("double") * monthly
    return (
        actions.select(*tenant, "scenario_id")
        .distinct()
        .join(base, list(tenant))
        .join(change, [*tenant, "scenario_id"], "left")
        .select(
            *tenant,
            "scenario_id",
            half_up(now, 2).alias("current_monthly_cost"),
            half_up(then, 2).alias("projected_monthly_cost"),
        )
        .withColumn(
            "savings",
            half_up(F.col("current_monthly_cost") - F.col("projected_monthly_cost"), 2),
        )
    )

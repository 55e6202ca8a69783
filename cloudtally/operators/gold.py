"""Machine-to-instance matching, hourly rates and the priced gold table."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cloudtally import fixed_values as fv
from cloudtally.functions.numeric import half_up
from cloudtally.functions.skew import BROADCAST_ROWS, sized_join, spread_join
from cloudtally.operators.features import growth
from cloudtally.runtime import durable


def spec_table(spark: SparkSession) -> DataFrame:
    """The instance reference: 33 fixed rows, safe to broadcast."""
    rows = [
        (i, name, name.rsplit(".", 1)[0], vcpu, ram)
        for i, (name, vcpu, ram) in enumerate(fv.INSTANCE_SPECS)
    ]
    return spark.createDataFrame(
        rows, "spec_order int, instance_type string, family string, vcpu int, ram_gb double"
    )


def _gap(spec: Column, have: Column) -> Column:
    return F.abs(spec - have) / F.greatest(spec, have, F.lit(1.0))


def best_spec(cores: Column, ram_gb: Column) -> Column:
    """Struct of the nearest spec. All 33 candidates are weighed inside the row, without a join.

    Candidates outside the size range lose to any inside it, and only win when none is inside;
    equal distances go to the earlier spec.
    """
    low, high = fv.MATCH_SIZE_RANGE

    def candidate(order: int, name: str, vcpu: int, ram: float) -> Column:
        outside = ~(
            (F.lit(float(vcpu)) / F.greatest(cores, F.lit(0.01))).between(low, high)
            & (F.lit(ram) / F.greatest(ram_gb, F.lit(0.01))).between(low, high)
        )
        distance = fv.MATCH_CPU_WEIGHT * _gap(F.lit(float(vcpu)), cores) + (
            fv.MATCH_MEMORY_WEIGHT * _gap(F.lit(ram), ram_gb)
        )
        return F.struct(
            outside.alias("outside"),
            distance.alias("distance"),
            F.lit(order).alias("spec_order"),
            F.lit(name).alias("instance_type"),
        )

    return F.array_min(F.array(*[candidate(i, *s) for i, s in enumerate(fv.INSTANCE_SPECS)]))


def footprint(silver: DataFrame, vm: str = "vm_id") -> DataFrame:
    """First known core count and memory size of each machine."""

    def first(c):
        return F.min_by(c, F.when(F.col(c).isNotNull(), F.col("date")))

    return silver.groupBy(vm).agg(
        first("cpu_cores").cast("double").alias("cpu_cores"),
        (first("memory_provisioned_mb") / 1024).alias("ram_gb"),
    )


#: As wide as the size range and a little more, for rounding: candidates are at most one cell away on either scale.
CELL = math.log(max(fv.MATCH_SIZE_RANGE[1], 1 / fv.MATCH_SIZE_RANGE[0])) * 1.001


def _log_cell(size: Column) -> Column:
    return F.floor(F.log(F.greatest(size, F.lit(0.01))) / F.lit(CELL)).cast("int")


def _best_of(asked: DataFrame, listed: DataFrame, on: list[str], in_range: bool, max_rows: int, share: int) -> DataFrame:
    """The nearest of the types that a footprint meets by ``on``; a type is a row, and no list of them is ever one value.

    Up to ``max_rows`` types go to all tasks; of more, each ``share`` footprints of a key meet a copy in a task of their own.
    They meet twice, for the least distance and for the types at it, so that neither pass has to sort or keep the pairs.
    """
    cores, ram, footprint = F.col("cpu_cores"), F.col("ram_gb"), ["cpu_cores", "ram_gb"]
    asked, listed = durable(asked), durable(listed)
    few = listed.count() <= max_rows
    parts = int(asked.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def met(rows: DataFrame) -> DataFrame:
        if few:
            pairs = rows.repartition(parts, *footprint).join(F.broadcast(listed), on)
        else:
            pairs = spread_join(rows, listed, on, "inner", min_rows=share, salts=1)
        far = fv.MATCH_CPU_WEIGHT * _gap(F.col("vcpu"), cores) + fv.MATCH_MEMORY_WEIGHT * _gap(F.col("spec_ram"), ram)
        if in_range:
            low, high = fv.MATCH_SIZE_RANGE
            pairs = pairs.filter(
                (F.col("vcpu") / F.greatest(cores, F.lit(0.01))).between(low, high)
                & (F.col("spec_ram") / F.greatest(ram, F.lit(0.01))).between(low, high)
            )
        return pairs.withColumn("distance", far)

    least = durable(met(asked).groupBy(*footprint).agg(F.min("distance").alias("_least")))
    nearest = met(asked.join(least, footprint)).filter(F.col("distance") == F.col("_least"))
    return nearest.groupBy(*footprint).agg(F.min(F.struct("distance", "spec_order", "instance_type")).alias("_best"))


def nearest_specs(machines: DataFrame, specs: DataFrame, max_rows: int = BROADCAST_ROWS, share: int = 1_000) -> DataFrame:
    """cpu_cores, ram_gb and ``_best`` (the nearest type of any list) of every distinct footprint of the machines.

    ``specs`` has instance_type, vcpu, ram_gb and spec_order, which decides between equal distances; of types of one size only
    the first can be nearest. Types lie on a grid over the logarithms of cores and memory whose cells are as wide as the
    size range, so those in range of a footprint are in its cell or the eight around it. Each of these nine gets the
    type beforehand. Footprints with none in range meet all sizes. Types are rows of a join whose best is
    kept while they pass, so memory does not grow with their number.
    """
    size = [F.col("vcpu").cast("double").alias("vcpu"), F.col("ram_gb").cast("double").alias("ram_gb")]
    first = F.min(F.struct(F.col("spec_order").cast("long").alias("spec_order"), "instance_type")).alias("first")
    sizes = specs.filter("vcpu is not null and ram_gb is not null").groupBy(*size).agg(first)
    rows = durable(sizes.select("vcpu", F.col("ram_gb").alias("spec_ram"), "first.spec_order", "first.instance_type"))
    steps = F.array(*[F.lit(i) for i in (-1, 0, 1)])
    around = lambda size: F.explode(F.transform(steps, lambda i: _log_cell(size) + i))
    near = rows.select("*", around(F.col("vcpu")).alias("_x")).select("*", around(F.col("spec_ram")).alias("_y"))
    asked = machines.filter("cpu_cores is not null and ram_gb is not null").select("cpu_cores", "ram_gb").distinct()
    asked = durable(asked)
    placed = asked.withColumns({"_x": _log_cell(F.col("cpu_cores")), "_y": _log_cell(F.col("ram_gb"))})
    found = durable(_best_of(placed, near, ["_x", "_y"], True, max_rows, share))
    rest = asked.join(found, ["cpu_cores", "ram_gb"], "left_anti")
    everywhere = F.lit(0).alias("_all")
    return found.union(_best_of(rest.select("*", everywhere), rows.select("*", everywhere), ["_all"], False, max_rows, share))


def match_instances(machines: DataFrame, vm: str = "vm_id", specs: DataFrame | None = None) -> DataFrame:
    """The nearest instance type of each machine, from the built-in list or from ``specs`` (see ``nearest_specs``).

    Machines without cores or memory have no match and, with a list of their own, no distance.
    """
    if specs is None or specs.isEmpty():
        best = machines.withColumn("_best", best_spec(F.col("cpu_cores"), F.col("ram_gb")))
    else:
        best = sized_join(machines, nearest_specs(machines, specs), ["cpu_cores", "ram_gb"])
    confidence = F.exp(-fv.MATCH_DECAY * F.col("_best.distance"))
    unsure = confidence < fv.MATCH_MIN_CONFIDENCE
    return best.select(
        vm,
        "cpu_cores",
        "ram_gb",
        F.when(~unsure, F.col("_best.instance_type")).alias("matched_instance_type"),
        half_up(confidence, 4).alias("confidence"),
        half_up(F.col("_best.distance"), 4).alias("distance"),
        unsure.alias("needs_manual_review"),
    )


def rates(prices: DataFrame) -> DataFrame:
    """One hourly rate per listed instance type: the mean of the best tier it is offered in."""
    typed = prices.withColumn("instance_type", F.lower("instance_type")).filter(F.col("instance_type").isNotNull())
    aggs = [
        F.avg(F.when(F.col("pricing_type") == tier, F.col("hourly_rate"))).alias(tier)
        for tier in fv.RATE_TIERS
    ]
    source = F
    for tier in fv.RATE_TIERS:
        source = source.when(F.col(tier).isNotNull(), F.lit(tier))
    return (
        typed.groupBy("instance_type")
        .agg(*aggs, F.avg("hourly_rate").alias("_any"))
        .select(
            "instance_type",
            F.coalesce(*fv.RATE_TIERS, "_any").alias("hourly_rate"),
            source.otherwise(F.lit("mixed")).alias("rate_source"),
        )
    )


def gold(
    silver: DataFrame,
    prices: DataFrame,
    account_id: str,
    vm: str = "vm_id",
    service: str = "EC2",
) -> DataFrame:
    """Daily rows with matched type, cost of an always-on day and canonical column names."""
    matched = match_instances(footprint(silver, vm), vm).select(
        vm, F.col("matched_instance_type").alias("instance_type"), "confidence"
    )
    base = (
        sized_join(silver.join(matched, vm, "left"), rates(prices), ["instance_type"])
        .select(
            "date",
            F.lit(account_id).alias("account_id"),
            F.lit(service).alias("service"),
            F.col(vm).cast("string").alias("resource_id"),
            "instance_type",
            F.lit(None).cast("string").alias("region"),
            (fv.DAY_HOURS * F.col("hourly_rate")).alias("cost"),
            F.lit(fv.DAY_HOURS).alias("usage_hours"),
            F.col("cpu_usage_percent").alias("cpu_avg_pct"),
            half_up(F.col("memory_utilization_ratio") * 100, 2).alias("memory_avg_pct"),
            (F.col("disk_read_kbps") + F.col("disk_write_kbps")).alias("disk_io"),
            (F.col("network_received_kbps") + F.col("network_transmitted_kbps")).alias("network_io"),
            "confidence",
            "rate_source",
            F.col("instance_type").isNull().alias("needs_manual_pricing"),
        )
    )
    return growth(base, keys=("resource_id",))


def manifest(silver: DataFrame, prices: DataFrame, vm: str = "vm_id") -> DataFrame:
    """Row counts of the gold stage by step: what was loaded, matched, written and left for review.

    Every silver row becomes one gold row; rows of machines without a match go to review as well.
    """
    matched = match_instances(footprint(silver, vm), vm).select(vm, "needs_manual_review")
    machines = matched.agg(
        F.count_if(~F.col("needs_manual_review")).alias("vms_matched"),
        F.count_if("needs_manual_review").alias("vms_flagged_for_review"),
    )
    loaded = silver.agg(F.count("*").alias("n"))
    parts = [
        loaded.select(F.lit("load_silver").alias("step"), F.lit("telemetry_rows").alias("measure"), "n"),
        prices.agg(F.count("*").alias("n")).select(F.lit("load_silver"), F.lit("pricing_rows"), "n"),
        machines.select(F.lit("instance_matching"), F.lit("vms_matched"), "vms_matched"),
        machines.select(F.lit("instance_matching"), F.lit("vms_flagged_for_review"), "vms_flagged_for_review"),
        loaded.select(F.lit("write_gold"), F.lit("gold_rows"), "n"),
        machines.select(F.lit("write_gold"), F.lit("manual_review_rows"), "vms_flagged_for_review"),
    ]
    return reduce(DataFrame.union, parts)


def spec_lookup(df: DataFrame, prices: DataFrame | None = None, key: str = "instance_type") -> DataFrame:
    """Exact-key lookup of spec and rate; unknown types stay NULL, never guessed."""
    out = df.join(F.broadcast(spec_table(df.sparkSession).drop("spec_order")), key, "left")
    if prices is None:
        return out
    return sized_join(out, rates(prices).select(F.col("instance_type").alias(key), "hourly_rate"), [key])

"""Data-quality rules. Rows are reported, never dropped."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cloudtally import fixed_values as fv
from cloudtally.functions.numeric import no_nan
from cloudtally.functions.skew import sized_join
from cloudtally.runtime import durable

KNOWN_TYPES = tuple(name for name, _, _ in fv.INSTANCE_SPECS)


def _text(c: Column) -> Column:
    return c.cast("string")


def row_rules(df: DataFrame, require_region: bool, require_known_type: bool) -> list[tuple]:
    """(rule, severity, predicate, detail) for every rule whose columns the table has."""
    have = set(df.columns)
    rules = []
    if "date" in have:
        rules.append(("missing_timestamp", "error", F.col("date").isNull(), F.lit("date is null")))
    if {"date", "resource_id"} <= have:
        rules.append(
            (
                "duplicated_resource_id",
                "warning",
                F.col("_repeated"),
                F.lit("duplicate (date, resource_id) pair"),
            )
        )
    for column, rule, bad in (
        ("cpu_avg_pct", "impossible_cpu_value", lambda c: (c > 100) | (c < 0)),
        ("memory_avg_pct", "negative_memory", lambda c: c < 0),
        ("cost", "negative_price", lambda c: c < 0),
    ):
        if column in have:
            value = no_nan(F.col(column))
            detail = F.concat(F.lit(f"{column}="), _text(value))
            rules.append((rule, "error", bad(value), detail))
    if require_region and "region" in have:
        blank = F.col("region").isNull() | (F.trim("region") == "")
        rules.append(("missing_region", "warning", blank, F.lit("region is null or empty")))
    if require_known_type and "instance_type" in have:
        unknown = F.col("instance_type").isNotNull() & ~F.col("instance_type").isin(*KNOWN_TYPES)
        detail = F.concat(
            F.lit("instance_type='"), F.col("instance_type"), F.lit("' not in reference table")
        )
        rules.append(("unmappable_instance_type", "warning", unknown, detail))
    return rules


def _coded(keys: Sequence[str]) -> dict[str, Column]:
    """Every key as a non-null string for a join, with a mark of its own for NULL."""
    return {f"_k{i}": F.coalesce(_text(F.col(k)), F.lit("\u0000")) for i, k in enumerate(keys)}


def mark_repeats(df: DataFrame, keys: Sequence[str] = ("date", "resource_id"), tenant: Sequence[str] = ("organization_id",)) -> DataFrame:
    """Flag every member of a repeated key; missing parts of a key count as equal.

    Tenants may use the same ids: where the table has the tenant, it is part of the key.

    The repeated keys come from a map-side-combined count, so copies of one pair never meet
    in a single window; the join back broadcasts them when few and spreads hot ones otherwise.
    """
    if not set(keys) <= set(df.columns):
        return df.withColumn("_repeated", F.lit(False))
    coded = _coded([*(t for t in tenant if t in df.columns), *keys])
    tagged = df.withColumns(coded)
    twice = tagged.groupBy(*coded).count().filter("count > 1").select(*coded, F.lit(True).alias("_twice"))
    return (
        sized_join(tagged, twice, list(coded))
        .withColumn("_repeated", F.coalesce("_twice", F.lit(False)))
        .drop("_twice", *coded)
    )


def failures(
    df: DataFrame,
    row_id: str = "row_id",
    require_region: bool = False,
    require_known_type: bool = False,
) -> DataFrame:
    """One row per (row, broken rule), all rules in a single pass over the table."""
    rules = row_rules(df, require_region, require_known_type)
    found = F.array_compact(
        F.array(
            *[
                F.when(
                    bad,
                    F.struct(
                        F.lit(rule).alias("rule"), F.lit(sev).alias("severity"), detail.alias("detail")
                    ),
                )
                for rule, sev, bad, detail in rules
            ]
        )
    )
    lead = [c for c in ("organization_id", row_id, "resource_id") if c in df.columns]
    return (
        mark_repeats(df)
        .select(*lead, F.explode(found).alias("f"))
        .select(*lead, "f.rule", "f.severity", "f.detail")
    )


def late_repeats(
    rows: DataFrame,
    earlier: DataFrame,
    row_id: str = "row_id",
    keys: Sequence[str] = ("date", "resource_id"),
    tenant: Sequence[str] = ("organization_id",),
) -> DataFrame:
    """Failures of repeated keys that only show once ``rows`` join ``earlier`` ones.

    Rows that already repeat within either table are reported there and left out. Only earlier rows of
    the new rows' range of days are read.
    """
    coded = _coded([*(t for t in tenant if t in rows.columns), *keys])
    low, high = rows.agg(F.min(keys[0]), F.max(keys[0])).first()
    near = F.col(keys[0]).isNull() | F.col(keys[0]).between(F.lit(low), F.lit(high))
    new, old = rows.withColumns(coded), earlier.filter(near).withColumns(coded)
    counts = [t.groupBy(*coded).agg(F.count("*").alias(n)) for t, n in ((new, "_new"), (old, "_old"))]
    both = durable(counts[0].join(counts[1], list(coded)))
    lead = [c for c in ("organization_id", row_id, "resource_id") if c in rows.columns]
    parts = [sized_join(t, both.filter(F.col(n) == 1).select(*coded), list(coded), "left_semi") for t, n in ((new, "_new"), (old, "_old"))]
    told = (F.lit("duplicated_resource_id").alias("rule"), F.lit("warning").alias("severity"), F.lit("duplicate (date, resource_id) pair").alias("detail"))
    return parts[0].select(*lead, *told).unionByName(parts[1].select(*lead, *told))


def audit_records(found: DataFrame, source_tier: str, row_id: str = "row_id") -> DataFrame:
    """Failures in audit-log form, details as JSON."""
    details = F.to_json(
        F.struct(
            F.lit(source_tier).alias("source_tier"),
            F.col(row_id).alias("row_id"),
            "resource_id",
            "rule",
            "detail",
        )
    )
    org = F.col("organization_id") if "organization_id" in found.columns else F.lit(None).cast("string")
    return found.select(
        org.alias("organization_id"),
        F.lit("validation_failure").alias("event_type"),
        "severity",
        details.alias("details"),
        F.current_timestamp().alias("created_at"),
    )


def summary(df: DataFrame, found: DataFrame) -> DataFrame:
    """Failures by rule next to the table's row count and the total of failures."""
    per_rule = found.groupBy("rule").agg(F.count("*").alias("failures")).select(F.struct("rule", "failures").alias("r"), F.lit(0).cast("long").alias("rows"))
    whole = df.agg(F.count("*").alias("rows")).select(F.lit(None).cast(per_rule.schema["r"].dataType).alias("r"), "rows")
    # a row for each rule and one for the table: they meet in a single small aggregate, without a join
    one = per_rule.union(whole).agg(
        F.collect_list("r").alias("rules"), F.sum("rows").alias("total_rows"), F.sum("r.failures").alias("total_failures")
    )
    return one.select(F.explode("rules").alias("r"), "total_rows", "total_failures").select("r.rule", "r.failures", "total_rows", "total_failures")


def null_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Missing values per column in one pass, as (column_name, nulls)."""
    one = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in columns])
    pairs = F.explode(
        F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).alias("nulls")) for c in columns])
    )
    return one.select(pairs.alias("p")).select("p.column_name", "p.nulls")


def require(df: DataFrame, columns: Sequence[str], what: str = "input") -> None:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"{what} is missing required columns: {missing}; found {df.columns}")


def with_enough_rows(df: DataFrame, keys: Sequence[str], at_least: int) -> DataFrame:
    """Rows of the groups that have at least ``at_least`` rows."""
    enough = df.groupBy(*keys).count().filter(F.col("count") >= at_least).select(*keys)
    return sized_join(df, enough, keys, "left_semi")


def only(df: DataFrame, **wanted) -> DataFrame:
    """Equality filters by column; ``None`` means no restriction."""
    for column, value in wanted.items():
        if value is not None:
            df = df.filter(F.col(column) == value)
    return df

"""Model metadata as a small table."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cloudtally import fixed_values as fv


def register(registry: DataFrame, entry: DataFrame) -> DataFrame:
    return registry.unionByName(entry, allowMissingColumns=True)


def promote(registry: DataFrame, model_type: str, version: str) -> DataFrame:
    """Make ``version`` the only active one of its type; other types are untouched."""
    mine = F.col("model_type") == model_type
    return registry.withColumn(
        "is_active", F.when(mine, F.col("version") == version).otherwise(F.col("is_active"))
    )


def active(registry: DataFrame) -> DataFrame:
    """The newest active entry per type."""
    w = Window.partitionBy("model_type").orderBy(F.desc("training_date"), F.desc("version"))
    return (
        registry.filter("is_active")
        .withColumn("_r", F.row_number().over(w))
        .filter("_r = 1")
        .drop("_r")
    )


def listing(registry: DataFrame, model_type: str | None = None) -> DataFrame:
    rows = registry if model_type is None else registry.filter(F.col("model_type") == model_type)
    return rows.orderBy(F.desc("training_date"))


def missing_types(registry: DataFrame) -> DataFrame:
    """Model types without an active entry; training is due while any is missing."""
    have = registry.filter("is_active").select("model_type").distinct()
    needed = registry.sparkSession.createDataFrame([(t,) for t in fv.MODEL_TYPES], "model_type string")
    return needed.exceptAll(have.intersect(needed))


def train_gate(registry: DataFrame) -> DataFrame:
    """One row: how many of the required types are active, and whether that is all of them."""
    hit = F.when(F.col("is_active") & F.col("model_type").isin(*fv.MODEL_TYPES), F.col("model_type"))
    return registry.agg(F.count_distinct(hit).alias("active_types")).withColumn(
        "models_exist", F.col("active_types") == len(fv.MODEL_TYPES)
    )


def history(registry: DataFrame, metric: str, k: int = 8) -> DataFrame:
    """The last ``k`` entries per type that report ``metric``, oldest first as v1, v2, ..."""
    value = F.try_element_at("evaluation_metrics", F.lit(metric))
    newest = Window.partitionBy("model_type").orderBy(F.desc("training_date"), F.desc("version"))
    oldest = Window.partitionBy("model_type").orderBy("training_date", "version")
    return (
        registry.withColumn("value", value)
        .filter(F.col("value").isNotNull() & (F.col("value") != 0))
        .withColumn("_r", F.row_number().over(newest))
        .filter(F.col("_r") <= k)
        .select(
            "model_type",
            F.concat(F.lit("v"), F.row_number().over(oldest).cast("string")).alias("point"),
            "version",
            "value",
        )
    )

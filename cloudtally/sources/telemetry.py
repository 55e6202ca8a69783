"""Folders of raw telemetry files."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cloudtally import fixed_values as fv
from cloudtally.operators.quality import require
from cloudtally.sources.headers import by_header

NUMBERS = tuple(c for c in fv.TELEMETRY_COLUMNS if c not in ("VM_ID", "Datetime"))


def read_folder(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """All files, aligned by column name, with ``source_file``; files sharing a header are one scan."""
    if not paths:
        raise FileNotFoundError("no telemetry files given")
    scans = []
    for names, files in by_header(spark, paths).items():
        schema = ", ".join(f"`{n}` string" for n in names)  # known, so that no scan opens files while planning
        scan = spark.read.option("header", True).schema(schema).csv(files)
        scans.append(scan.withColumn("source_file", F.col("_metadata.file_name")))
    if not scans:
        raise FileNotFoundError("the telemetry files are empty")
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), scans)


def typed(raw: DataFrame) -> DataFrame:
    """Snake-case names and numbers; unreadable values become NULL."""
    require(raw, fv.TELEMETRY_COLUMNS, "telemetry")
    cores = F.col("CPU_Cores").try_cast("double").cast("int").alias("cpu_cores")
    return raw.select(
        F.col("VM_ID").alias("vm_id"),
        F.try_to_timestamp(F.col("Datetime")).alias("ts"),
        cores,
        *[F.col(c).try_cast("double").alias(c.lower()) for c in NUMBERS if c != "CPU_Cores"],
        "source_file",
        F.monotonically_increasing_id().alias("line"),
    )

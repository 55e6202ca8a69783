"""Continuous upload, daily roll-up and de-duplication as Structured Streaming."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cloudtally.operators import quality
from cloudtally.operators.silver import MEANS, SUMS
from cloudtally.runtime import durable, new_folder

DELAY = "1 day"


def file_stream(spark: SparkSession, folder: str, name: str, schema) -> DataFrame:
    """New files of one kind in a folder."""
    return spark.readStream.schema(schema).option("pathGlobFilter", name).parquet(folder)


def daily_rollup(stream: DataFrame, vm: str = "vm_id", ts: str = "ts") -> DataFrame:
    """Per machine and day; a day appears once it can no longer change, later rows are dropped."""
    means = [c for c in MEANS if c in stream.columns]
    sums = [c for c in SUMS if c in stream.columns]
    return (
        stream.withWatermark(ts, DELAY)
        .groupBy(vm, F.window(ts, "1 day"))
        .agg(
            F.count("*").alias("n"),
            *[F.avg(c).alias(c) for c in means],
            *[F.sum(c).alias(c) for c in sums],
        )
        .withColumn("date", F.to_date("window.start"))
        .drop("window")
    )


def first_seen(stream: DataFrame, vm: str = "vm_id", ts: str = "ts") -> DataFrame:
    """One row per (machine, time): repeats inside the watermark delay are dropped."""
    return stream.withWatermark(ts, DELAY).dropDuplicatesWithinWatermark([vm, ts])


def drain_to_table(stream: DataFrame, path: str | None = None, checkpoint: str | None = None) -> DataFrame:
    """Process everything available now into a Parquet table and return the table."""
    spark = stream.sparkSession
    path = path or new_folder(spark)
    q = (
        stream.writeStream.outputMode("append")
        .format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint or new_folder(spark))
        .trigger(availableNow=True)
        .start()
    )
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)


def _present(spark: SparkSession, folder: str, name: str) -> list[str]:
    """Values of the partition column ``name`` that a folder has."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return []
    own = [s.getPath().getName() for s in fs.listStatus(path)]
    return [n[len(name) + 1 :] for n in own if n.startswith(f"{name}=")]


def _by_period(df: DataFrame, folder: str, batch_id: int, period: Column) -> None:
    """Store a batch's rows under their days or months; the same batch again replaces them. One of many rows is cut into several files."""
    dated = df.withColumn("_period", period).withColumn("batch_id", F.lit(batch_id).cast("long"))
    dated.hint("rebalance", "_period").write.partitionBy("_period", "batch_id").mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(folder)


def _of_periods(spark: SparkSession, folder: str, schema: T.StructType, periods: list[str]) -> DataFrame | None:
    """What a folder of ``_by_period`` holds for some of them, with ``batch_id``; no other one's folder is looked at."""
    own = sorted(set(periods) & set(_present(spark, folder, "_period")))
    if not own:
        return None
    whole = T.StructType([*schema.fields, T.StructField("_period", T.StringType()), T.StructField("batch_id", T.LongType())])
    return spark.read.schema(whole).option("basePath", folder).parquet(*[f"{folder}/_period={d}" for d in own]).drop("_period")


def ingest_validated(
    stream: DataFrame,
    to_internal: Callable[[DataFrame], DataFrame],
    path: str | None = None,
    checkpoint: str | None = None,
    **rules,
) -> tuple[str, str]:
    """Map, validate and append each micro-batch; returns the paths of rows and failures.

    A batch owns its ``batch_id`` partition, so a batch that is replayed after a failure
    replaces what it wrote before. Repeats are found across batches: a batch also reports its
    rows whose key an earlier batch holds, and the earlier rows that it makes repeats of. Keys are kept beside the
    rows, in a folder for each month: a batch reads the keys of its own months, however many batches came before.
    """
    spark = stream.sparkSession
    base = path or new_folder(spark)
    rows_path, failures_path, keys_path = f"{base}/rows", f"{base}/failures", f"{base}/keys"

    def handle(batch: DataFrame, batch_id: int) -> None:
        table = to_internal(batch)
        table.write.mode("overwrite").parquet(f"{rows_path}/batch_id={batch_id}")
        written = spark.read.schema(table.schema).parquet(f"{rows_path}/batch_id={batch_id}")
        found = quality.failures(written, **rules)
        if {"date", "resource_id"} <= set(written.columns):
            keys = written.select(*[c for c in ("organization_id", "row_id", "resource_id", "date") if c in written.columns])
            month = F.coalesce(F.date_format(F.to_date("date"), "yyyy-MM"), F.lit("none"))
            months = [r[0] for r in keys.select(month).distinct().collect()]  # as many as the calendar has
            earlier = _of_periods(spark, keys_path, keys.schema, months)
            if earlier is not None:
                earlier = earlier.filter(F.col("batch_id") < batch_id).drop("batch_id")
                found = found.unionByName(quality.late_repeats(written, earlier))
            found = durable(found)  # before the keys change
            _by_period(keys, keys_path, batch_id, month)
        found.write.mode("overwrite").parquet(
            f"{failures_path}/batch_id={batch_id}"
        )

    q = (
        stream.writeStream.foreachBatch(handle)
        .option("checkpointLocation", checkpoint or f"{base}/offsets")
        .trigger(availableNow=True)
        .start()
    )
    q.awaitTermination()
    return rows_path, failures_path


def corrected_rollup(
    stream: DataFrame, path: str | None = None, checkpoint: str | None = None, vm: str = "vm_id", ts: str = "ts", delay_days: int = 1
) -> tuple[str, str]:
    """Daily roll-up in which late rows are not lost; returns the paths of the days issued and of the late rows.

    A day is issued once the newest time seen is ``delay_days`` past its end. A row of a day that was issued
    before its batch is late: it goes to the side table as it is, and its day is issued again, marked as a correction.
    A batch leaves one row of sums and counts per machine and day under that day, so a correction reads the sums of its own
    day and no raw rows. Batches that are replayed replace their own sums, late rows and days. Rows without a time are left out.
    """
    spark = stream.sparkSession
    base = path or new_folder(spark)
    sums_path, issued_path, late_path, seen_path = (f"{base}/{n}" for n in ("sums", "issued", "late", "seen"))
    means, sums = ([c for c in own if c in stream.columns] for own in (MEANS, SUMS))

    def newest_before(batch_id: int) -> dt.datetime | None:
        own = [int(k) for k in _present(spark, seen_path, "batch_id") if int(k) < batch_id]
        return spark.read.parquet(f"{seen_path}/batch_id={max(own)}").first()["newest"] if own else None

    def handle(batch: DataFrame, batch_id: int) -> None:
        rows = durable(batch.filter(F.col(ts).isNotNull()))
        top = rows.agg(F.max(ts).alias("newest")).first()["newest"]
        before = newest_before(batch_id)
        newest = max([x for x in (top, before) if x is not None], default=None)
        if newest is None:
            return
        # the first day that is still open
        open_from = lambda x: (x - dt.timedelta(days=delay_days)).date().isoformat() if x else "0000"
        was, now = open_from(before), open_from(newest)
        rows.filter(F.to_date(ts) < F.lit(was).cast("date") if before else F.lit(False)).write.mode("overwrite").parquet(f"{late_path}/batch_id={batch_id}")
        parts = rows.groupBy(vm, F.to_date(ts).alias("date")).agg(
            F.count("*").alias("n"), *[F.sum(c).alias(f"sum_{c}") for c in (*means, *sums)], *[F.count(c).alias(f"n_{c}") for c in means]
        )
        touched = [str(r[0]) for r in parts.select("date").distinct().collect()]  # as many as the calendar has
        _by_period(parts, sums_path, batch_id, F.col("date").cast("string"))
        due = [d for d in _present(spark, sums_path, "_period") if d < now and (d in touched or d >= was)]
        held = _of_periods(spark, sums_path, parts.schema, due)
        if held is not None:
            day = held.filter(F.col("batch_id") <= batch_id).groupBy(vm, "date").agg(
                F.sum("n").alias("n"),
                *[(F.sum(f"sum_{c}") / F.nullif(F.sum(f"n_{c}"), F.lit(0))).alias(c) for c in means],
                *[F.sum(f"sum_{c}").alias(c) for c in sums],
            )
            told = day.withColumn("issued_by", F.lit(batch_id).cast("long")).withColumn("is_correction", F.col("date").cast("string") < F.lit(was))
            told.withColumn("_period", F.col("date").cast("string")).hint("rebalance", "_period").write.partitionBy("_period").mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(issued_path)
        spark.createDataFrame([(newest,)], "newest timestamp").coalesce(1).write.mode("overwrite").parquet(f"{seen_path}/batch_id={batch_id}")

    q = (
        stream.writeStream.foreachBatch(handle)
        .option("checkpointLocation", checkpoint or f"{base}/offsets")
        .trigger(availableNow=True)
        .start()
    )
    q.awaitTermination()
    return issued_path, late_path

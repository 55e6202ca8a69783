"""First lines of many text files in one job."""

from __future__ import annotations

import csv
import os
from collections import defaultdict
from collections.abc import Iterator, Sequence
from urllib.parse import quote, unquote

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: Stores that tasks can open by themselves; files elsewhere are read by Spark's text reader, to their ends.
OPENED = ("file", "hdfs", "s3", "s3a", "gs", "abfs", "abfss")
FIRST_BYTES = 1 << 14


def first_line(uri: str, more: int = FIRST_BYTES) -> str | None:
    """The first line of a file, of which no more is read than holds it; None for an empty file."""
    if uri.startswith("file://"):
        system, path = pafs.LocalFileSystem(), uri.removeprefix("file://")
    else:
        system, path = pafs.FileSystem.from_uri(quote(uri.replace("s3a://", "s3://", 1), safe=":/%"))
    held, end = b"", -1
    with system.open_input_file(path) as f:
        while end < 0:
            got = f.read(more)
            held += got
            end = min((i for i in (held.find(b"\n"), held.find(b"\r")) if i >= 0), default=-1)
            if not got:
                break
    return held[: end if end >= 0 else None].decode("utf-8", "replace") if held else None


def first_lines(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """path and header of every file that is not empty, whatever their number and length."""
    named = [p if "://" in p else f"file://{os.path.abspath(p.removeprefix('file:'))}" for p in paths]
    if any(p.split("://")[0] not in OPENED for p in named) or any(set("*?{[") & set(p) or p.endswith("/") for p in named):
        return _read_through(spark, paths)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.column("path").to_pylist()
            yield pa.RecordBatch.from_arrays([pa.array(own), pa.array([first_line(p) for p in own], pa.string())], ["path", "header"])

    listed = spark.createDataFrame([(p,) for p in named], "path string").repartition(max(1, min(len(named), 10_000)))
    return listed.mapInArrow(read, "path string, header string").filter("header is not null")


def _read_through(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    lines = spark.read.text(list(paths)).select(
        F.col("_metadata.file_path").alias("path"),
        F.col("_metadata.file_block_start").alias("start"),
        F.monotonically_increasing_id().alias("line"),
        F.col("value").alias("header"),
    )
    return lines.filter("start = 0").groupBy("path").agg(F.min_by("header", "line").alias("header"))


def by_header(spark: SparkSession, paths: Sequence[str]) -> dict[tuple[str, ...], list[str]]:
    """The files of each distinct header; one row per file handed in comes to the driver."""
    groups: dict[tuple[str, ...], list[str]] = defaultdict(list)
    for r in first_lines(spark, paths).orderBy("path").collect():
        names = next(csv.reader([r.header.lstrip("﻿")]), [])
        groups[tuple(names)].append(unquote(r.path))
    return groups

"""Vendor price files: recognised by their headers, never by their names."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cloudtally import fixed_values as fv
from cloudtally.operators import silver
from cloudtally.sources.headers import by_header

CLASSES = ("on_demand", "spot", "prediction", "unknown")
FIELDS = ("instance_type", "price", "region", "os", "date", "actual_price", "confidence")
WORDS = fv.PRICE_HEADER_WORDS


def _bare(c: Column) -> Column:
    return F.regexp_replace(F.lower(F.trim(c)), r"[\s_]+", "")


def _says(word: str) -> Callable[[Column], Column]:
    """Whether a header contains the word; two-letter words must stand alone (``os`` is in ``cost``)."""
    if word in fv.WHOLE_WORD_HEADERS:
        pattern = rf"(^|[^a-z])({word}|{word.upper()}|{word.capitalize()})([^a-z]|$)"
        return lambda header: F.trim(header).rlike(pattern)
    return lambda header: _bare(header).contains(word)


def _find(headers: Column, words: Sequence[str]) -> Column:
    """First header (file order) that contains the first word that occurs at all."""
    return F.coalesce(*[F.get(F.filter(headers, _says(w)), F.lit(0)) for w in words])


def classify(files: DataFrame, headers: str = "headers") -> DataFrame:
    """Add ``classified_as``, ``needs_manual_mapping`` and a ``matched`` struct to a table of files."""
    h = F.col(headers)
    searched = {**WORDS, "place": WORDS["zone"] + WORDS["region"], "plain_date": ("date",)}
    # every search becomes a column once; the rules below only refer to them
    looked = files.withColumns({f"_h_{k}": _find(h, words) for k, words in searched.items()})
    found = {k: F.col(f"_h_{k}") for k in searched}
    place = found["place"]
    plain_price = ~_bare(found["price"]).contains("spot")
    is_prediction = found["prediction"].isNotNull()
    is_on_demand = (
        found["instance_type"].isNotNull()
        & found["price"].isNotNull()
        & found["region"].isNotNull()
        & plain_price
    )
    is_spot = (
        found["spot_price"].isNotNull() & found["zone"].isNotNull() & found["timestamp"].isNotNull()
    )
    kind = (
        F.when(is_prediction, "prediction")
        .when(is_on_demand, "on_demand")
        .when(is_spot, "spot")
        .otherwise("unknown")
    )
    none = F.lit(None).cast("string")
    columns = {
        "prediction": (
            found["instance_type"], found["prediction"], place, found["os"], found["date"],
            found["actual_price"], found["confidence"],
        ),
        "on_demand": (
            found["instance_type"], found["price"], found["region"], found["os"],
            found["plain_date"], none, none,
        ),
        "spot": (
            found["instance_type"], found["spot_price"], found["zone"], found["os"],
            found["timestamp"], none, none,
        ),
    }
    picked = []
    for i, field in enumerate(FIELDS):
        c = F
        for name, cols in columns.items():
            c = c.when(F.col("classified_as") == name, cols[i])
        picked.append(c.alias(field))
    return (
        looked.withColumn("classified_as", kind)
        .withColumn("needs_manual_mapping", F.col("classified_as") == "unknown")
        .withColumn("matched", F.struct(*picked))
        .drop(*[f"_h_{k}" for k in searched])
    )


def read_price_files(spark: SparkSession, paths: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """(bronze price rows, classification). One job reads all headers, and files of one header are one scan."""
    groups = by_header(spark, paths)
    if not groups:
        raise ValueError("no file has a known price-list header")
    named = {tuple(c.strip() for c in names): files for names, files in groups.items()}
    headers = classify(
        spark.createDataFrame(
            [(p, list(names)) for names, files in named.items() for p in files], "path string, headers array<string>"
        )
    )
    rows, known = [], {r.path: r for r in headers.collect()}  # one row per file handed in
    for names, files in named.items():
        r = known[files[0]]
        if r.needs_manual_mapping:
            continue
        schema = ", ".join(f"`{n}` string" for n in names)
        raw = spark.read.option("header", True).schema(schema).csv(files)
        m = r.matched

        def text(field, raw=raw, m=m):
            return F.col(f"`{m[field]}`").cast("string") if m[field] else F.lit(None).cast("string")

        rows.append(
            raw.select(
                F.trim(text("instance_type")).alias("instance_type"),
                F.trim(text("region")).alias("region_raw"),
                text("os").alias("os_raw"),
                text("price").try_cast("double").alias("hourly_rate"),
                F.to_date(F.try_to_timestamp(text("date"))).alias("effective_date"),
                F.lit(r.classified_as).alias("pricing_type"),
                F.col("_metadata.file_name").alias("source_file"),
            )
        )
    if not rows:
        raise ValueError("no file has a known price-list header")
    return reduce(DataFrame.unionByName, rows), headers


def build_prices(spark: SparkSession, paths: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """(silver prices, manifest per file)."""
    bronze, headers = read_price_files(spark, paths)
    kept = silver.prices(bronze)
    per_file = bronze.groupBy("source_file").agg(F.count("*").alias("rows_read"))
    kept_per_file = kept.groupBy("source_file").agg(F.count("*").alias("rows_extracted"))
    manifest = (
        headers.withColumn("source_file", F.element_at(F.split("path", "/"), -1))
        .join(per_file, "source_file", "left")
        .join(kept_per_file, "source_file", "left")
        .select(
            "source_file",
            "classified_as",
            "needs_manual_mapping",
            F.coalesce("rows_extracted", F.lit(0)).alias("rows_extracted"),
            (F.coalesce("rows_read", F.lit(0)) - F.coalesce("rows_extracted", F.lit(0))).alias(
                "rows_dropped_invalid_or_dupe"
            ),
        )
    )
    return kept, manifest

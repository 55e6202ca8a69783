"""Uploaded billing files: free headers to the canonical schema."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cloudtally import fixed_values as fv
from cloudtally.functions.text import bare_header
from cloudtally.operators import quality
from cloudtally.operators.features import growth
from cloudtally.operators.waste import weights_for
from cloudtally.runtime import durable


@dataclass(frozen=True)
class HeaderMap:
    found: dict[str, str]
    missing_required: list[str]
    missing_optional: list[str]


def map_headers(columns: Iterable[str]) -> HeaderMap:
    """Internal name -> header as written; the first alias of a field that occurs wins."""
    written = {bare_header(c): c for c in columns}
    found = {}
    for field, aliases in fv.HEADER_ALIASES.items():
        hit = next((written[a] for a in aliases if a in written), None)
        if hit is not None:
            found[field] = hit
    return HeaderMap(
        found,
        [c for c in fv.REQUIRED_COLUMNS if c not in found],
        [c for c in fv.OPTIONAL_COLUMNS if c not in found],
    )


def read_upload(spark: SparkSession, path: str) -> DataFrame:
    """All columns as text: types are decided by ``to_internal``, no inference pass over the file."""
    return spark.read.option("header", True).csv(path)


def to_internal(raw: DataFrame) -> DataFrame:
    """Rename mapped headers and coerce values; what cannot be read becomes NULL."""
    headers = map_headers(raw.columns)
    if headers.missing_required:
        raise ValueError(
            f"missing required columns {headers.missing_required}; found {raw.columns}"
        )
    out = []
    for field, written in headers.found.items():
        c = F.col(f"`{written}`")
        if field == "date":
            c = F.to_date(F.try_to_timestamp(c.cast("string")))
        elif field in fv.NUMERIC_UPLOAD_COLUMNS:
            number = c.cast("string").try_cast("double")
            c = F.when(~F.isnan(number), number)
        out.append(c.alias(field))
    return raw.select(*out)


@dataclass(frozen=True)
class Upload:
    table: DataFrame
    headers: HeaderMap
    weights: dict[str, float]
    failures: DataFrame


def ingest(spark: SparkSession, path: str, organization_id: str | None = None) -> Upload:
    """Read, map, derive and validate one upload (or a folder of same-header files)."""
    raw = read_upload(spark, path)
    # stored, because rows and failures must see the same ids
    table = durable(to_internal(raw).withColumn("row_id", F.monotonically_increasing_id()))
    if organization_id is not None:
        table = table.withColumn("organization_id", F.lit(organization_id))
    # uploads may repeat a day, so series are not bounded by the calendar here
    table = growth(table, one_row_per_day=False).withColumn("anomaly_history_count", F.lit(0))
    found = quality.failures(
        table,
        require_region="region" in table.columns,
        require_known_type="instance_type" in table.columns,
    )
    weights = {k: round(v, 4) for k, v in weights_for(table.columns).items()}
    return Upload(table, map_headers(raw.columns), weights, found)

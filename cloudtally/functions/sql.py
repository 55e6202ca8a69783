"""The scalar rules as temporary SQL functions, for users who write SQL."""

from __future__ import annotations

from pyspark.sql import SparkSession

from cloudtally import fixed_values as fv


def _case(bands, floor: str) -> str:
    arms = " ".join(f"WHEN x >= {low} THEN '{label}'" for low, label in bands)
    return f"CASE {arms} ELSE '{floor}' END"


def register(spark: SparkSession) -> None:
    """Define ``zone_to_region``, ``os_family``, ``waste_bucket`` and ``incident_severity``."""
    bodies = {
        "zone_to_region(x STRING) RETURNS STRING": f"regexp_replace(trim(x), r'{fv.ZONE_PATTERN}', '$1')",
        "os_family(x STRING) RETURNS STRING": (
            "CASE WHEN x IS NULL THEN 'unknown'"
            " WHEN contains(lower(x), 'red hat') OR contains(lower(x), 'rhel') THEN 'rhel'"
            " WHEN contains(lower(x), 'suse') THEN 'suse'"
            " WHEN contains(lower(x), 'windows') THEN 'windows'"
            " WHEN contains(lower(x), 'linux') OR contains(lower(x), 'unix') THEN 'linux'"
            " ELSE trim(lower(x)) END"
        ),
        "waste_bucket(x DOUBLE) RETURNS STRING": _case(fv.WASTE_BANDS, fv.WASTE_FLOOR),
        "incident_severity(x DOUBLE) RETURNS STRING": _case(fv.SEVERITY_BANDS, fv.SEVERITY_FLOOR),
    }
    for head, body in bodies.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURN {body}")

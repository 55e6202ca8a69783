"""String clean-up expressions for headers, regions, operating systems and questions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from cloudtally import fixed_values as fv


def bare_header(name: str) -> str:
    """Lower case without blanks, underscores and dashes (plan-time twin of ``bare_header_column``)."""
    return re.sub(r"[\s_\-]+", "", name.strip().lower())


def bare_header_column(c: Column) -> Column:
    return F.regexp_replace(F.lower(F.trim(c)), r"[\s_\-]+", "")


def zone_to_region(c: Column) -> Column:
    """``us-east-1b`` -> ``us-east-1``; plain regions pass through."""
    return F.regexp_replace(F.trim(c), fv.ZONE_PATTERN, "$1")


def os_family(c: Column) -> Column:
    low = F.lower(c)
    return (
        F.when(c.isNull(), F.lit("unknown"))
        .when(low.contains("red hat") | low.contains("rhel"), F.lit("rhel"))
        .when(low.contains("suse"), F.lit("suse"))
        .when(low.contains("windows"), F.lit("windows"))
        .when(low.contains("linux") | low.contains("unix"), F.lit("linux"))
        .otherwise(F.trim(low))
    )


def intent(question: Column) -> Column:
    """First matching intent pattern, else the general one."""
    low = F.lower(question)
    out = F
    for pattern, name in fv.INTENT_PATTERNS:
        out = out.when(low.rlike(pattern), F.lit(name))
    return out.otherwise(F.lit(fv.INTENT_FLOOR))


def mention(question: Column, pattern: str) -> Column:
    """First captured mention in the lower-cased question, NULL when absent."""
    found = F.regexp_extract(F.lower(question), pattern, 1)
    return F.when(found != "", found)

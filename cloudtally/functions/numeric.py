"""Null-, NaN- and tie-safe numeric column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DecimalType

MONEY = DecimalType(28, 10)


def no_nan(c: Column) -> Column:
    """NaN becomes NULL, so comparisons treat it as missing (Spark says NaN > 1)."""
    return F.when(~F.isnan(c), c)


def half_up(c: Column, digits: int) -> Column:
    """Round half away from zero; a value within three further digits of a tie counts as the tie.

    Plain double arithmetic, so it stays in generated code. Binary noise cannot decide a tie,
    and the result is the double nearest to the rounded decimal. Values too large to have such
    digits, and NaN, pass through.
    """
    unit = float(10**digits)
    slack = 0.5 + 0.5 * 10.0 ** (digits - max(digits + 3, 8))
    whole = F.floor(F.abs(c) * unit + slack)
    return F.when(F.abs(c) < 9e15 / unit, F.signum(c) * whole / unit).otherwise(c.cast("double"))


def clamp(c: Column, low: float | None = None, high: float | None = None) -> Column:
    """Clip that keeps NULL (``least``/``greatest`` would skip it)."""
    out = c
    if high is not None:
        out = F.least(out, F.lit(high))
    if low is not None:
        out = F.greatest(out, F.lit(low))
    return F.when(c.isNotNull(), out)


def ratio(a: Column, b: Column, otherwise: float | None = None) -> Column:
    """``a / b`` or ``otherwise`` where ``b`` is zero or NULL."""
    return F.when(b != 0, a / b).otherwise(F.lit(otherwise).cast("double"))


def pct_change(cur: Column, prev: Column, keep_inf: bool = False) -> Column:
    """Relative change against the previous row; 0 where undefined.

    A rise from zero is infinite; it maps to 0 unless ``keep_inf`` is set, because one
    infinity would flatten every later min-max scaling.
    """
    from_zero = F.signum(cur) * float("inf") if keep_inf else F.lit(0.0)
    defined = prev.isNotNull() & cur.isNotNull()
    return (
        F.when(defined & (prev != 0), cur / prev - 1)
        .when(defined & (prev == 0) & (cur != 0), from_zero)
        .otherwise(F.lit(0.0))
    )


def banded(c: Column, bands: Sequence[tuple[float, str]], floor: str) -> Column:
    """Label of the highest lower bound reached (bands are given from high to low)."""
    out = F
    for low, label in bands:
        out = out.when(c >= low, F.lit(label))
    return out.otherwise(F.lit(floor))


def below(c: Column, bands: Sequence[tuple[float, str]], floor: str) -> Column:
    """Label of the first upper bound the value stays under (bands from low to high)."""
    out = F
    for high, label in bands:
        out = out.when(c < high, F.lit(label))
    return out.otherwise(F.lit(floor))


def scaled(c: Column, low: Column, high: Column) -> Column:
    """Min-max scaling into [0, 1]; a span under 1e-9 gives 0, NULL stays NULL."""
    span = high - low
    inside = F.when(span < 1e-9, F.lit(0.0)).otherwise(
        F.greatest(F.lit(0.0), F.least(F.lit(1.0), (c - low) / span))
    )
    return F.when(c.isNotNull(), inside)


def money_sum(c: Column) -> Column:
    """Order-independent sum: exact in DECIMAL, returned as DOUBLE."""
    return F.sum(c.cast(MONEY)).cast("double")

"""Number formatting and comparisons with the semantics the rules are written for."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def to_fixed(value: Column, digits: int) -> Column:
    """Fixed-point text that rounds the exact binary value, halves away from zero.

    format_number rounds the exact value but halves to even; only exact halves, which show as an odd remainder of a
    scaled power of two, go through format_string. Made for 1 or 2 digits.
    """
    if digits not in (1, 2):
        raise ValueError("digits must be 1 or 2")
    pattern, scale = ("0.0", 4) if digits == 1 else ("0.00", 8)
    half = F.pmod(F.abs(value) * scale, F.lit(2)) == 1
    return F.when(half, F.format_string(f"%.{digits}f", value)).otherwise(F.call_function("format_number", value, F.lit(pattern)))


def below(value: Column, limit: float) -> Column:
    """value < limit; false for null and NaN."""
    return F.coalesce(~F.isnan(value) & (value < limit), F.lit(False))


def above(value: Column, limit: float) -> Column:
    """value > limit; false for null and NaN, which Spark would order last."""
    return F.coalesce(~F.isnan(value) & (value > limit), F.lit(False))


def both_zeroed(loaded: Column, dispensed: Column) -> list[Column]:
    return [F.coalesce(loaded, F.lit(0.0)).alias("loaded"), F.coalesce(dispensed, F.lit(0.0)).alias("dispensed")]

"""Numeric rules: NaN as missing, float32 scores, half-even rounding, fixed-point text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def nan_to_null(column: Column | str) -> Column:
    """NaN as NULL, so that aggregates skip it."""
    value = F.col(column) if isinstance(column, str) else column
    return F.when(~F.isnan(value), value)


def as_score(column: Column) -> Column:
    """A score held in single precision (ties are float32 ties), NaN instead of NULL."""
    return F.coalesce(column.cast("float"), F.lit(float("nan")).cast("float")).cast("double")


def ratio(numerator: Column, denominator: Column) -> Column:
    """The quotient, or NULL when the denominator is 0 or NULL."""
    return F.when(denominator != 0, numerator / denominator)


def one_decimal(value: Column) -> Column:
    """`value` rounded to one decimal as printf does: on its exact binary value, ties to even.

    NaN stays NaN.

    With m = floor(10 * value), 8 * value - m - 0.5 and the sum with 2 * value are exact in
    double arithmetic, so the sign tells on which side of the tie the value lies.
    """
    m = F.floor(value * 10).cast("double")
    side = (value * 8 - (m + 0.5)) + value * 2
    up = (side > 0) | ((side == 0) & (F.pmod(m, F.lit(2.0)) == 1))
    return F.when(F.isnan(value), value).otherwise(F.when(up, m + 1).otherwise(m) / 10)

"""Rounding, clamping and null-tolerant arithmetic."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

STAGES = ("extract", "denoise", "colorize", "upscale", "interpolate", "encode", "remux")


def col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def as_column(value) -> Column:
    """Accept a column name, a column or a plain number."""
    if isinstance(value, Column):
        return value
    return F.col(value) if isinstance(value, str) else F.lit(value)


def round_half_even(value: Column | str) -> Column:
    """Integer rounding used by the planners: ties go to the even neighbour."""
    return F.bround(col(value).cast("double"), 0).cast("bigint")


def round_half_up(value: Column | str) -> Column:
    """Integer rounding used by the framing preview: ties go up."""
    return F.floor(col(value).cast("double") + F.lit(0.5)).cast("bigint")


def round_dimension(value: Column | str, mode: str = "half_even") -> Column:
    """Video dimension: at least two pixels and even (odd results grow by one)."""
    rounder = {"half_even": round_half_even, "half_up": round_half_up}[mode]
    whole = F.greatest(F.lit(2).cast("bigint"), rounder(value))
    return whole + F.pmod(whole, F.lit(2).cast("bigint"))


def clamp(value: Column, low, high) -> Column:
    return F.least(as_column(high), F.greatest(as_column(low), value))


def clamp_unit(value: Column | str) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), col(value).cast("double")))


def safe_div(numerator: Column | str, denominator: Column | str) -> Column:
    """Quotient, null where the denominator is zero or missing."""
    return F.try_divide(col(numerator).cast("double"), col(denominator).cast("double"))


def positive(value: Column | str) -> Column:
    """The value where it is above zero, else null."""
    return F.when(col(value) > 0, col(value))


def first_positive(*values: Column | str) -> Column:
    return F.coalesce(*[positive(v) for v in values])


def to_long(value: Column | str) -> Column:
    return col(value).cast("bigint")

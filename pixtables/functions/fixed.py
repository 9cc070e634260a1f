"""Rounding that gives the same digits for every order of summation."""
from __future__ import annotations

from pyspark.sql import Column, functions as F

# The tie point is moved off 0.5: means of short decimals often sit exactly on a
# tie, and the last bit of a distributed sum would otherwise decide the digit.
_OFF_TIE = 0.5001234


def fixed(col: Column, digits: int = 6) -> Column:
    scale = float(10**digits)
    return F.floor(col * F.lit(scale) + F.lit(_OFF_TIE)) / F.lit(scale)


def clamp(col: Column, lo: float = 0.0, hi: float = 1.0) -> Column:
    """Bounded value of a column without nulls (the argument is named once, so nested uses stay small)."""
    return F.least(F.greatest(col, F.lit(lo)), F.lit(hi))


def clamp_or_null(col: Column, lo: float = 0.0, hi: float = 1.0) -> Column:
    """Bounded value that stays null where the input is null."""
    return F.when(col.isNotNull(), clamp(col, lo, hi))


def smoothstep(col: Column, lo, hi) -> Column:
    lo = lo if isinstance(lo, Column) else F.lit(float(lo))
    hi = hi if isinstance(hi, Column) else F.lit(float(hi))
    t = clamp((col - lo) / F.greatest(hi - lo, F.lit(1e-12)))
    return t * t * (F.lit(3.0) - F.lit(2.0) * t)

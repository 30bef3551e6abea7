"""Arithmetic of random variables as columns, with IEEE results where Spark would raise or skip NaN."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NAN, INF = float("nan"), float("inf")


def divide(a: Column, b: Column) -> Column:
    """a / b; by zero infinite, or NaN for 0/0."""
    by_zero = F.when((a == 0) | F.isnan(a), F.lit(NAN)).when(a > 0, F.lit(INF)).otherwise(F.lit(-INF))
    return F.when(b == 0, by_zero).otherwise(a / F.when(b == 0, F.lit(1.0)).otherwise(b))


def floor_divide(a: Column, b: Column) -> Column:
    """The greatest whole number not over a / b, as a double; NaN by zero."""
    safe = F.when(b == 0, F.lit(1.0)).otherwise(b)
    whole = (a - floor_modulo(a, b)) / safe
    return F.when(b == 0, F.lit(NAN)).otherwise(F.rint(whole))


def floor_modulo(a: Column, b: Column) -> Column:
    """a modulo b with the sign of b; NaN by zero."""
    safe = F.when(b == 0, F.lit(1.0)).otherwise(b)
    rest = a % safe
    rest = F.when((rest != 0) & ((rest < 0) != (safe < 0)), rest + safe).otherwise(rest)
    return F.when(b == 0, F.lit(NAN)).otherwise(rest)


def minimum(a: Column, b: Column) -> Column:
    """The lesser; NaN if either is."""
    return F.when(F.isnan(a) | F.isnan(b), F.lit(NAN)).otherwise(F.least(a, b))


def maximum(a: Column, b: Column) -> Column:
    """The greater; Spark orders NaN above all, so it comes through."""
    return F.greatest(a, b)

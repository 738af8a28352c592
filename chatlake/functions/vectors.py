"""Vector expressions over ``array<double>``: norm, scaling to int8."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

INT8_STEP = 2.0 / 255.0


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x * x))


def unit(v: Column, floor: float = 1e-6) -> Column:
    """``v`` at length one (vectors shorter than ``floor`` are scaled by it instead)."""
    length = F.greatest(norm(v), F.lit(floor))
    return F.transform(v, lambda x: x / length)


def to_int8(v: Column) -> Column:
    """Components in [-1, 1] to -128..127, cut towards zero like a C cast."""
    return F.transform(v, lambda x: ((x + 1.0) / F.lit(INT8_STEP) - 128.0).cast("int").cast("tinyint"))

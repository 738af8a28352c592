"""Array helpers that keep per-row work inside the row, without a shuffle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def run_lengths(
    df: DataFrame,
    values: Column,
    name: str,
    key: Callable[[Column], Column] = lambda x: x,
    members: Callable[[Column], Column] | None = None,
) -> DataFrame:
    """Add ``name``: array<struct<value, n>> of distinct keys of ``values`` with their counts.

    Sorts the array once and measures the runs, so it is linear after the sort. ``members``
    turns each member of a run into an element of an extra ``members`` array.
    """
    out = df.withColumn("_sorted", F.sort_array(values))
    at = F.col("_sorted")
    size = F.size(at)
    places = F.when(size > 0, F.sequence(F.lit(0), size - 1)).otherwise(F.array().cast("array<int>"))
    starts = F.filter(places, lambda i: (i == 0) | (key(F.get(at, i)) != key(F.get(at, i - 1))))
    out = out.withColumn("_starts", starts)

    def run(s: Column, j: Column) -> Column:
        n = F.coalesce(F.get(F.col("_starts"), j + 1), size) - s
        fields = [key(F.get(at, s)).alias("value"), n.alias("n")]
        if members is not None:
            fields.append(F.transform(F.slice(at, s + 1, n), members).alias("members"))
        return F.struct(*fields)

    return out.withColumn(name, F.transform("_starts", run)).drop("_sorted", "_starts")

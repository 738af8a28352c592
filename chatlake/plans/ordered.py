"""Ordered computations inside groups, safe when one group is huge.

A plain ``Window.partitionBy(chat)`` sends a whole chat to one task. That is the
right plan while every chat fits a task, and the wrong one when a single chat holds
a large share of all rows. ``Ordered`` first counts the groups (a column-pruned scan
with map-side combine). Groups under ``target_rows`` keep the plain plan. Rows of the
larger ones are range-partitioned on (group, order) by Spark's own sampling, which
splits any concentration of keys or times as long as (group, order) is unique, and
checkpointed so that the partition number can serve as a ``_slice`` key. Windows then run
per (group, slice), and the values that cross a slice border come from one row per
(group, slice): at most one more row than there are range partitions per hot group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chatlake.session import durable

TARGET_ROWS = 4_000_000
"""Rows of one group that a single task may hold as a sorted run."""

BROADCAST_ROWS = 500_000
"""Largest list of hot groups or slice borders that is broadcast; beyond it Spark picks the join."""


def bounded_broadcast(df: DataFrame, rows: int) -> DataFrame:
    """Broadcast ``df`` only when its (already known) row count is under the bound."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


class Ordered:
    """``df`` grouped by ``group`` and ordered by ``order`` (which must be unique in a group)."""

    def __init__(
        self,
        df: DataFrame,
        group: list[str],
        order: list[str],
        target_rows: int | None = None,
    ):
        self.group = list(group)
        self.order = list(order)
        limit = target_rows or TARGET_ROWS
        counts = df.groupBy(*self.group).agg(F.count(F.lit(1)).alias("_rows"))
        hot = counts.filter(F.col("_rows") > limit)
        size = hot.agg(F.count(F.lit(1)).alias("groups"), F.sum("_rows").alias("rows")).first()
        self.n_hot = size["groups"]
        if self.n_hot == 0:
            self.df = df.withColumn("_slice", F.lit(-1))
            self.n_borders = 0
        else:
            names = hot.select(*self.group)
            names = bounded_broadcast(names, self.n_hot)
            n_slices = max(2, -(-size["rows"] // limit) * 2)
            big = df.join(names, self.group, "left_semi").repartitionByRange(n_slices, *self.group, *self.order)
            big = durable(big.withColumn("_slice", F.spark_partition_id()))
            small = df.join(names, self.group, "left_anti").withColumn("_slice", F.lit(-1))
            self._big = big
            self.df = small.unionByName(big)
            self.n_borders = n_slices + self.n_hot
        self.keys = [*self.group, "_slice"]
        self.window = Window.partitionBy(*self.keys).orderBy(*self.order)
        self._by_slice = Window.partitionBy(*self.group).orderBy("_slice")

    def _with_borders(self, df: DataFrame, source: DataFrame, aggs: list[Column], carried: list[Column]) -> DataFrame:
        """Join to every hot row what the other slices of its group contribute."""
        per_slice = source.filter(F.col("_slice") >= 0).groupBy(*self.keys).agg(*aggs)
        borders = per_slice.select(*self.keys, *carried)
        return df.join(bounded_broadcast(borders, self.n_borders), self.keys, "left")

    def running_sum(self, df: DataFrame, value: str, name: str) -> DataFrame:
        """Inclusive running sum of ``value`` (an integer column of ``df``, which derives from ``self.df``)."""
        run = self.window.rowsBetween(Window.unboundedPreceding, 0)
        out = df.withColumn(name, F.sum(value).over(run))
        if self.n_hot == 0:
            return out
        before = self._by_slice.rowsBetween(Window.unboundedPreceding, -1)
        out = self._with_borders(
            out,
            df,
            [F.sum(value).alias("_sum")],
            [F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_offset")],
        )
        return out.withColumn(name, F.col(name) + F.coalesce("_offset", F.lit(0))).drop("_offset")

    def row_number(self, df: DataFrame | None = None, name: str = "rn") -> DataFrame:
        """1-based position of each row in its group."""
        df = self.df if df is None else df
        out = df.withColumn(name, F.row_number().over(self.window).cast("long"))
        if self.n_hot == 0:
            return out
        before = self._by_slice.rowsBetween(Window.unboundedPreceding, -1)
        out = self._with_borders(
            out,
            df,
            [F.count(F.lit(1)).alias("_n")],
            [F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset")],
        )
        return out.withColumn(name, F.col(name) + F.coalesce("_offset", F.lit(0))).drop("_offset")

    def last_value(self, value: str, name: str, df: DataFrame | None = None) -> DataFrame:
        """Latest non-NULL ``value`` at or before each row of the group."""
        df = self.df if df is None else df
        run = self.window.rowsBetween(Window.unboundedPreceding, 0)
        out = df.withColumn(name, F.last(value, ignorenulls=True).over(run))
        if self.n_hot == 0:
            return out
        before = self._by_slice.rowsBetween(Window.unboundedPreceding, -1)
        key = F.when(F.col(value).isNotNull(), F.struct(*self.order))
        out = self._with_borders(
            out,
            df,
            [F.max_by(value, key).alias("_held")],
            [F.last("_held", ignorenulls=True).over(before).alias("_carried")],
        )
        return out.withColumn(name, F.coalesce(F.col(name), F.col("_carried"))).drop("_carried")

    def neighbours(self, columns: list[str], prev: str | None = "prev", next: str | None = "next", partitioned: bool = False) -> DataFrame:
        """Add the previous and next row of the group as structs of ``columns`` (NULL at the ends)."""
        row = F.struct(*columns)
        key = F.struct(*self.order)
        out = self.df.repartition(*self.keys) if partitioned else self.df
        if prev:
            out = out.withColumn(prev, F.lag(row).over(self.window))
        if next:
            out = out.withColumn(next, F.lead(row).over(self.window))
        if self.n_hot == 0:
            return out
        out = self._with_borders(
            out,
            self.df,
            [F.max_by(row, key).alias("_last"), F.min_by(row, key).alias("_first")],
            [
                F.lag("_last").over(self._by_slice).alias("_before"),
                F.lead("_first").over(self._by_slice).alias("_after"),
            ],
        )
        if prev:
            out = out.withColumn(prev, F.coalesce(F.col(prev), F.col("_before")))
        if next:
            out = out.withColumn(next, F.coalesce(F.col(next), F.col("_after")))
        return out.drop("_before", "_after")


def top_per_group(df: DataFrame, group: list[str], order: list[Column], k, name: str = "rank") -> DataFrame:
    """First ``k`` rows of each group with their rank.

    The ``row_number <= k`` shape lets Spark keep k rows per group and task before the
    shuffle (window group limit), so a hot group costs k rows per task, not all its rows.
    """
    w = Window.partitionBy(*group).orderBy(*order)
    return df.withColumn(name, F.row_number().over(w)).filter(F.col(name) <= k).withColumn(
        name, F.col(name).cast("long")
    )

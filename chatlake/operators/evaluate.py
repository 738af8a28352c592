"""Search quality and latency measures."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chatlake.plans.ordered import Ordered

SEARCHED = 20
MODES = ["keyword", "hybrid"]


def first_relevant_rank(hits: DataFrame, relevance: DataFrame, searched: int = SEARCHED) -> DataFrame:
    """Rank of each labelled query's first hit inside its relevant set; NULL when there is none.

    ``relevance`` has (query_id, message_id); ``hits`` may carry a ``mode`` next to its ranks.
    """
    by = ["mode", "query_id"] if "mode" in hits.columns else ["query_id"]
    found = (
        hits.filter(F.col("rank") <= searched)
        .join(relevance, ["query_id", "message_id"], "left_semi")
        .groupBy(*by)
        .agg(F.min("rank").alias("first_rank"))
    )
    asked = relevance.select("query_id").distinct()
    if len(by) == 2:
        modes = F.array(*[F.lit(m) for m in MODES])
        asked = asked.select(F.explode(modes).alias("mode"), "query_id")
    return asked.join(found, by, "left")


def topk_totals(ranks: DataFrame, ks: tuple[int, ...] = (1, 5)) -> DataFrame:
    """How many queries have their first relevant hit among the first k."""
    by = ["mode"] if "mode" in ranks.columns else []
    counts = [F.count_if(F.col("first_rank") <= k).alias(f"top_{k}") for k in ks]
    return ranks.groupBy(*by).agg(F.count(F.lit(1)).alias("queries"), *counts)


def latency_percentiles(
    timings: DataFrame, group: str, value: str, run: str, target_rows: int | None = None
) -> DataFrame:
    """p50, p95 and maximum per group: the sorted value at floor((n - 1) * p). ``run`` identifies a row."""
    ordered = Ordered(timings.select(group, value, run), [group], [value, run], target_rows)
    sizes = timings.groupBy(group).agg(F.count(F.lit(1)).alias("n"))
    at = ordered.row_number().join(sizes, group)

    def pick(p: float):
        return F.max(F.when(F.col("rn") == F.floor((F.col("n") - 1) * F.lit(p)) + 1, F.col(value)))

    return at.groupBy(group).agg(pick(0.5).alias("p50"), pick(0.95).alias("p95"), F.max(value).alias("max"))


def nearest_label_accuracy(neighbours: DataFrame, labels: DataFrame) -> DataFrame:
    """Share of rows whose nearest other row carries the same label."""
    best = neighbours.filter("rank = 1").select("query_id", "window_id")
    a = labels.select(F.col("id").alias("query_id"), F.col("label").alias("_a"))
    b = labels.select(F.col("id").alias("window_id"), F.col("label").alias("_b"))
    both = best.join(a, "query_id").join(b, "window_id")
    return both.agg(F.count(F.lit(1)).alias("queries"), F.count_if(F.col("_a") == F.col("_b")).alias("correct"))

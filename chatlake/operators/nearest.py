"""Exact nearest windows by cosine distance, and the message that stands for each window.

Vectors are put into blocks of bounded size near one of ``PIVOTS`` pivot vectors, ordered by their distance to it, and
every block knows the least and largest distance of its vectors to each pivot. Queries are put into blocks likewise. By the
triangle inequality no window of one block is nearer to a query of another than the gap between their distances to any
pivot. Every block of queries first meets the ``FIRST_BLOCKS`` window blocks with the smallest gaps; the k-th distances
found tell which of the other blocks can hold something nearer, and only those are multiplied. Blocks meet by Spark
joins on block numbers; the driver sees nothing of the queries or windows but the pivots, a constant number of vectors.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chatlake.functions import vectors as vector_functions
from chatlake.operators import filters
from chatlake.plans.ordered import top_per_group
from chatlake.session import durable

NEIGHBOURS = 60
SLACK = 0.06
DEFAULT_MAX_DISTANCE = 0.55
GAP_MICROS = 45 * 60_000_000
GAPS_BEFORE = 4
PIVOTS = 16
FIRST_BLOCKS = 3
WINDOW_CELLS = 1 << 17
"""Vector components in a block of windows (1 MB of doubles)."""
QUERY_CELLS = 1 << 15
"""The same in a block of queries."""
QUERY_GROUP_CELLS, WINDOW_GROUP_CELLS = 1 << 21, 1 << 22
"""Vector components that a task holds of queries and of windows (16 and 32 MB of doubles)."""
DIGITS = 9
ANCHOR_BYTES = 280


def narrowed() -> Column:
    """Does a parsed search ask for people, chats or kinds."""
    return (F.size("from_vals") > 0) | (F.size("chat_vals") > 0) | (F.size("has") > 0)


def search_bounds(parsed: DataFrame, k: int = NEIGHBOURS) -> DataFrame:
    """Neighbours to fetch per query and the start times they may have.

    A window starting a few gaps before ``after`` can still hold matches.
    """
    low, high = -(2**62), 2**62
    return parsed.select(
        "query_id",
        F.lit(k).alias("k"),
        F.coalesce(F.unix_micros("after_ts") - GAPS_BEFORE * GAP_MICROS, F.lit(low)).alias("lo"),
        F.coalesce(F.unix_micros("before_ts"), F.lit(high)).alias("hi"),
    )


@dataclass(frozen=True)
class Blocks:
    """Queries and windows in blocks, and which of them meet."""

    queries: DataFrame
    windows: DataFrame
    pairs: DataFrame  # query_block, window_block, gap
    first: DataFrame  # query_block, window_block
    dims: int


def _unit(column: pa.Array) -> np.ndarray:
    block = np.stack(column.to_numpy(zero_copy_only=False)).astype(np.float64)
    return block / np.maximum(np.linalg.norm(block, axis=1, keepdims=True), 1e-12)


def _pivots(vectors: DataFrame) -> np.ndarray:
    """At most PIVOTS of the vectors, chosen by a hash."""
    some = vectors.orderBy(F.xxhash64("id")).limit(PIVOTS).select("v").collect()
    matrix = np.array([r["v"] for r in some], np.float64)
    return matrix / np.maximum(np.linalg.norm(matrix, axis=1, keepdims=True), 1e-12) if len(some) else matrix


_PLACED = "id long, k long, lo long, hi long, cell int, far double, v binary, away array<double>"
_BLOCK = "block long, n int, ids binary, ks binary, los binary, his binary, matrix binary, least array<double>, most array<double>, lo long, hi long, k long"


def _blocks(vectors: DataFrame, pivots: np.ndarray, cells: int) -> DataFrame:
    """One row per block of (id, k, lo, hi, v), see _BLOCK."""

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            unit = _unit(batch.column(4))
            away = np.sqrt(np.maximum((unit * unit).sum(axis=1)[:, None] + (pivots * pivots).sum(axis=1)[None] - 2 * unit @ pivots.T, 0))
            cell = away.argmin(axis=1)
            yield pa.RecordBatch.from_arrays(
                [
                    *batch.columns[:4], pa.array(cell.astype(np.int32)), pa.array(away[np.arange(len(cell)), cell]),
                    pa.array([row.tobytes() for row in unit], pa.binary()), pa.array(list(away), pa.list_(pa.float64())),
                ],
                names=["id", "k", "lo", "hi", "cell", "far", "v", "away"],
            )

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number, held, cell = TaskContext.get().partitionId() << 32, [], None

        def row():
            ids, ks, los, his = (np.array([r[c] for r in held], np.int64) for c in range(4))
            away = np.array([r[7] for r in held])
            return {
                "block": number, "n": len(held), "ids": ids.tobytes(), "ks": ks.tobytes(), "los": los.tobytes(), "his": his.tobytes(),
                "matrix": b"".join(r[6] for r in held), "least": away.min(axis=0).tolist(), "most": away.max(axis=0).tolist(),
                "lo": int(los.min()), "hi": int(his.max()), "k": int(ks.max()),
            }

        for batch in batches:
            for r in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and (r[4] != cell or len(held) * len(r[6]) >= 8 * cells):
                    yield pa.RecordBatch.from_pylist([row()])
                    number, held = number + 1, []
                cell = r[4]
                held.append(r)
        if held:
            yield pa.RecordBatch.from_pylist([row()])

    def shaped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema(
            [("block", pa.int64()), ("n", pa.int32()), *[(c, pa.binary()) for c in ("ids", "ks", "los", "his", "matrix")]]
            + [("least", pa.list_(pa.float64())), ("most", pa.list_(pa.float64())), ("lo", pa.int64()), ("hi", pa.int64()), ("k", pa.int64())]
        )
        for batch in pack(batches):
            yield pa.RecordBatch.from_pylist(batch.to_pylist(), schema=schema)

    placed = vectors.select("id", "k", "lo", "hi", "v").mapInArrow(place, _PLACED)
    ordered = placed.repartitionByRange("cell", "far", "id").sortWithinPartitions("cell", "far", "id")
    return durable(ordered.mapInArrow(shaped, _BLOCK))


def blocks(queries: DataFrame, windows: DataFrame, query_cells: int = QUERY_CELLS, window_cells: int = WINDOW_CELLS) -> Blocks | None:
    """Blocks of (id, k, lo, hi, v); None if there are no windows. Only summaries of blocks are paired, none of their rows."""
    pivots = _pivots(windows)
    if not len(pivots):
        return None
    asked, held = _blocks(queries, pivots, query_cells), _blocks(windows, pivots, window_cells)
    q = asked.select(F.col("block").alias("query_block"), F.arrays_zip("least", "most").alias("_q"), F.col("lo").alias("_from"), F.col("hi").alias("_to"))
    w = held.select(F.col("block").alias("window_block"), F.arrays_zip("least", "most").alias("_w"), F.col("lo").alias("_first"), F.col("hi").alias("_last"))
    apart = F.zip_with("_q", "_w", lambda a, b: F.greatest(b["least"] - a["most"], a["least"] - b["most"], F.lit(0.0)))
    pairs = durable(q.join(w, (F.col("_last") >= F.col("_from")) & (F.col("_first") < F.col("_to"))).select(
        "query_block", "window_block", F.array_max(apart).alias("gap")
    ))
    first = top_per_group(pairs, ["query_block"], [F.col("gap"), F.col("window_block")], FIRST_BLOCKS)
    return Blocks(asked, held, pairs, durable(first.select("query_block", "window_block")), pivots.shape[1])


_NEAR = "query_block long, query_id long, window_id long, distance double"


def _grouped(blocks_: DataFrame, name: str, groups: int) -> DataFrame:
    """(block, group): neighbouring blocks in groups of about equal size. Only the numbers of the blocks are sorted in one task."""
    return blocks_.select(F.col("block").alias(f"{name}_block"), F.ntile(groups).over(Window.orderBy("block")).alias(f"{name}_group"))


def _group_numbers(b: Blocks) -> tuple[int, int]:
    """How many groups of queries and of windows: each small enough for a task, and enough pairs of groups for all cores."""
    cores = b.windows.sparkSession.sparkContext.defaultParallelism

    def figures(blocks_: DataFrame, group_cells: int) -> tuple[int, int]:
        r = blocks_.agg(F.count(F.lit(1)).alias("blocks"), F.sum(F.col("n").cast("long") * b.dims).alias("cells")).first()
        return max(r["blocks"], 1), -(-(r["cells"] or 0) // group_cells)

    (n_q, q), (n_w, w) = figures(b.queries, QUERY_GROUP_CELLS), figures(b.windows, WINDOW_GROUP_CELLS)
    w = min(n_w, max(w, 4))
    return min(n_q, max(q, -(-2 * cores // w))), w


def _multiplied(pairs: DataFrame, b: Blocks, skip_self: bool, edges: DataFrame | None = None) -> DataFrame:
    """The k nearest windows of every query among the blocks that its block is paired with, once per group of window blocks.

    A task gets a group of query blocks and a group of window blocks, so that a block travels once for each group of the
    other side that it meets, not once for each block. Of queries in ``edges`` (query_block, query_id, edge) only windows
    up to that distance count.
    """
    n_q, n_w = _group_numbers(b)
    met = durable(pairs.select("query_block", "window_block").join(_grouped(b.queries, "query", n_q), "query_block").join(_grouped(b.windows, "window", n_w), "window_block"))
    wanted = met.groupBy("query_group", "window_group", "query_block").agg(F.collect_list("window_block").alias("wanted"))
    known = None if edges is None else edges.groupBy("query_block").agg(F.collect_list(F.struct("query_id", "edge")).alias("edges"))
    q = wanted.join(b.queries.select(F.col("block").alias("query_block"), "n", "ids", "ks", "los", "his", "matrix"), "query_block")
    none = F.array().cast("array<struct<query_id:bigint,edge:double>>")
    q = q.withColumn("edges", none) if known is None else q.join(known, "query_block", "left").withColumn("edges", F.coalesce("edges", none))
    w = met.select(F.col("query_group").alias("_asked"), F.col("window_group").alias("_held"), "window_block").distinct().join(
        b.windows.select(F.col("block").alias("window_block"), "n", "ids", "los", "matrix"), "window_block"
    )

    def run(asked: pa.Table, held: pa.Table) -> pa.Table:
        windows = {}
        for r in (row for batch in held.to_batches() for row in _rows(batch)):
            windows[r["window_block"]] = (np.frombuffer(r["ids"], np.int64), np.frombuffer(r["los"], np.int64), np.frombuffer(r["matrix"]).reshape(r["n"], -1))
        found = [_nearest(r, [windows[k] for k in sorted(r["wanted"])], skip_self) for batch in asked.to_batches() for r in _rows(batch)]
        return pa.Table.from_batches(found, schema=_nearest_schema())

    return q.groupBy("query_group", "window_group").cogroup(w.groupBy("_asked", "_held")).applyInArrow(run, _NEAR)


def _rows(batch: pa.RecordBatch) -> Iterator[dict]:
    for k in range(batch.num_rows):
        yield {name: batch.column(name)[k].as_py() for name in batch.schema.names}


def _nearest_schema() -> pa.Schema:
    return pa.schema([("query_block", pa.int64()), ("query_id", pa.int64()), ("window_id", pa.int64()), ("distance", pa.float64())])


def _nearest(row: dict, windows: list[tuple], skip_self: bool) -> pa.RecordBatch:
    """The k nearest of each query of a block by (distance, id); what is held never exceeds a few times that and one product."""
    ids, ks, lo, hi = (np.frombuffer(row[c], np.int64) for c in ("ids", "ks", "los", "his"))
    matrix = np.frombuffer(row["matrix"]).reshape(row["n"], -1)
    edge = np.full(len(ids), np.inf)
    if row["edges"]:
        known = {e["query_id"]: e["edge"] for e in row["edges"]}
        edge = np.array([known.get(int(i), np.inf) for i in ids])
    k = int(ks.max())
    of, keys, distance = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)

    def best(of, keys, distance):
        order = np.lexsort((keys, distance, of))
        of, keys, distance = of[order], keys[order], distance[order]
        place = np.arange(len(of)) - np.searchsorted(of, of)
        last = place == k - 1
        edge[of[last]] = np.minimum(edge[of[last]], distance[last])
        return of[place < k], keys[place < k], distance[place < k]

    for at, start, block in windows:
        product = matrix @ block.T
        floor = 1.0 - edge - 1e-8  # beyond what rounding moves
        if np.isinf(edge).any():
            allowed = (start[None] >= lo[:, None]) & (start[None] < hi[:, None])
            if skip_self:
                allowed &= at[None] != ids[:, None]
            product[~allowed] = -np.inf
            floor = np.maximum(floor, -2.0)
            if k < len(at):
                floor = np.maximum(floor, np.partition(product, len(at) - k, axis=1)[:, len(at) - k] - 1e-8)
        a, c = np.nonzero(product >= floor[:, None])
        far = np.round(1.0 - product[a, c], DIGITS)
        kept = (far <= edge[a]) & (start[c] >= lo[a]) & (start[c] < hi[a])
        if skip_self:
            kept &= at[c] != ids[a]
        of, keys, distance = np.concatenate([of, a[kept]]), np.concatenate([keys, at[c[kept]]]), np.concatenate([distance, far[kept]])
        if len(of) > 4 * k * len(ids) or np.isinf(edge).any():
            of, keys, distance = best(of, keys, distance)
    of, keys, distance = best(of, keys, distance)
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(of), row["query_block"], np.int64)), pa.array(ids[of]), pa.array(keys), pa.array(distance)], schema=_nearest_schema())


def _best(found: DataFrame, b: Blocks) -> DataFrame:
    """The k nearest so far of each query, with ``_k`` and the size ``n`` of its block."""
    order = Window.partitionBy("query_id").orderBy("distance", "window_id")
    asked = b.queries.select(F.col("block").alias("query_block"), "n", F.col("k").alias("_k"))
    return found.join(F.broadcast(asked), "query_block").withColumn("_r", F.row_number().over(order)).filter(F.col("_r") <= F.col("_k"))


def _edges(best: DataFrame) -> DataFrame:
    """(query_block, query_id, edge, n): the k-th distance of queries that have found k."""
    per_query = best.groupBy("query_block", "query_id", "_k", "n").agg(F.count(F.lit(1)).alias("_found"), F.max("distance").alias("edge"))
    return per_query.filter("_found >= _k").select("query_block", "query_id", "edge", "n")


def _open(b: Blocks, edges: DataFrame) -> DataFrame:
    full = edges.groupBy("query_block", "n").agg(F.count(F.lit(1)).alias("_full"), F.max("edge").alias("_edge"))
    floors = full.filter("_full = n").select("query_block", "_edge")  # blocks in which every query has found k
    rest = b.pairs.join(b.first, ["query_block", "window_block"], "left_anti").join(floors, "query_block", "left")
    return rest.filter(F.col("_edge").isNull() | (F.col("gap") * F.col("gap") / 2 <= F.col("_edge") + 1e-8))


def open_pairs(b: Blocks, one: DataFrame) -> DataFrame:
    """Pairs of blocks that have not met and may hold something as near as the k-th found so far."""
    return _open(b, _edges(_best(one, b)))


def knn(
    query_vectors: DataFrame,
    vectors: DataFrame,
    bounds: DataFrame | None = None,
    k: int = NEIGHBOURS,
    column: str = "v",
    skip_self: bool = False,
    query_cells: int | None = None,
    window_cells: int | None = None,
) -> DataFrame:
    """(query_id, window_id, distance, rank): the ``k`` nearest windows of every query, exactly."""
    spark = vectors.sparkSession
    low, high = F.lit(-(2**62)), F.lit(2**62)
    if bounds is None:
        bounds = query_vectors.select("query_id", F.lit(k).alias("k"), low.alias("lo"), high.alias("hi"))
    asked = query_vectors.filter(F.col(column).isNotNull()).select("query_id", F.col(column).cast("array<double>").alias("v")).join(bounds, "query_id")
    asked = asked.select(F.col("query_id").alias("id"), F.col("k").cast("long").alias("k"), F.col("lo").cast("long").alias("lo"), F.col("hi").cast("long").alias("hi"), "v")
    start = F.unix_micros("start_ts") if "start_ts" in vectors.columns else F.lit(0).cast("long")
    held = vectors.filter(F.col(column).isNotNull()).select(
        F.col("window_id").alias("id"), F.lit(0).cast("long").alias("k"), start.alias("lo"), start.alias("hi"), F.col(column).cast("array<double>").alias("v")
    )
    met = blocks(asked, held, query_cells or QUERY_CELLS, window_cells or WINDOW_CELLS)
    if met is None:
        return spark.createDataFrame([], "query_id long, window_id long, distance double, rank long")
    best = durable(_best(_multiplied(met.first, met, skip_self), met).select("query_block", "query_id", "window_id", "distance", "_k", "n"))
    edges = durable(_edges(best))
    two = _multiplied(_open(met, edges), met, skip_self, edges)
    order = Window.partitionBy("query_id").orderBy("distance", "window_id")
    columns = ["query_id", "window_id", "distance"]
    ranked = best.select(*columns).unionByName(two.select(*columns)).withColumn("rank", F.row_number().over(order).cast("long"))
    return ranked.join(bounds.select("query_id", F.col("k").alias("_k")), "query_id").filter("rank <= _k").drop("_k")


def knn_among(
    query_vectors: DataFrame, vectors: DataFrame, allowed: DataFrame, bounds: DataFrame, column: str = "v"
) -> DataFrame:
    """The same for queries that may only have the windows of ``allowed(query_id, window_id)``.

    Filters come first: the distance is worked out for allowed pairs only, so no match is lost to nearer windows
    that the filters would drop, and the work grows with what the filters keep.
    """
    start = F.unix_micros("start_ts") if "start_ts" in vectors.columns else F.lit(0).cast("long")
    unit = lambda name: vector_functions.unit(F.col(name).cast("array<double>"))
    asked = query_vectors.select("query_id", unit(column).alias("_a")).join(bounds, "query_id")
    held = vectors.filter(F.col(column).isNotNull()).select("window_id", start.alias("_start"), unit(column).alias("_b"))
    pairs = allowed.join(held, "window_id").join(asked, "query_id").filter("_start >= lo AND _start < hi")
    product = F.aggregate(F.zip_with("_a", "_b", lambda a, b: a * b), F.lit(0.0), lambda acc, x: acc + x)
    near = pairs.select("query_id", "window_id", F.round(1 - product, DIGITS).alias("distance"), "k")
    w = Window.partitionBy("query_id").orderBy("distance", "window_id")
    return near.withColumn("rank", F.row_number().over(w).cast("long")).filter("rank <= k").drop("k")


def cut(neighbours: DataFrame, max_distance: float = DEFAULT_MAX_DISTANCE, slack: float = SLACK) -> DataFrame:
    """Neighbours no further than the model's limit and no more than ``slack`` behind the best one."""
    best = neighbours.groupBy("query_id").agg(F.min("distance").alias("_best"))
    limit = F.least(F.lit(max_distance), F.col("_best") + slack)
    return neighbours.join(best, "query_id").filter(F.col("distance") <= limit).drop("_best")


def anchors(
    neighbours: DataFrame,
    message_windows: DataFrame,
    messages: DataFrame,
    parsed: DataFrame,
    resolved: filters.Resolved,
    keyword_ranks: DataFrame,
) -> DataFrame:
    """(query_id, message_id, rank): one message per near window, nearest first.

    Among the messages of a window that pass the query's filters, the best keyword hit stands
    for it, else the one sharing most words, then the longer, then the later. A window without
    such a message is skipped; a message standing for two windows keeps the nearer.
    """
    inside = neighbours.select("query_id", "window_id", F.col("rank").alias("window_rank")).join(
        message_windows.select("window_id", "message_id"), "window_id"
    )
    rows = inside.join(messages.filter((F.col("kind") == 0) & ~F.col("unsent")), "message_id")
    rows = filters.keep(rows, resolved)
    said = F.filter(
        F.transform(F.concat("words", "phrases"), F.lower), lambda w: F.length(w) >= 3
    )
    rows = rows.join(parsed.select("query_id", said.alias("_said")), "query_id")
    body = F.lower(F.coalesce("text", F.lit("")))
    rows = rows.withColumn("_body", body).withColumns(
        {
            "overlap": F.size(F.filter("_said", lambda w: F.col("_body").contains(w))),
            "reach": F.least(F.octet_length("_body"), F.lit(ANCHOR_BYTES)),
        }
    )
    ranks = keyword_ranks.select("query_id", "message_id", F.col("rank").alias("keyword_rank"))
    rows = rows.join(ranks, ["query_id", "message_id"], "left")
    order = [
        F.col("keyword_rank").asc_nulls_last(), F.desc("overlap"), F.desc("reach"), F.desc("ts"), F.desc("message_id"),
    ]
    standing = top_per_group(rows, ["query_id", "window_id", "window_rank"], order, 1, "_first")
    once = standing.groupBy("query_id", "message_id").agg(F.min("window_rank").alias("window_rank"))
    # at most one message per neighbour, so a query has few
    order_of = Window.partitionBy("query_id").orderBy("window_rank")
    return once.select("query_id", "message_id", F.row_number().over(order_of).cast("long").alias("rank"))

"""Nearest windows by blocks and pivots against all distances."""

import numpy as np
import pytest

from chatlake.operators import nearest


def vectors(spark, matrix, starts=None, name="window_id"):
    rows = [(k, None if v is None else [float(x) for x in v], 1_000_000 * (starts[k] if starts else 0)) for k, v in enumerate(matrix)]
    frame = spark.createDataFrame(rows, f"{name} long, v array<double>, micros long").repartition(3)
    return frame.selectExpr(name, "v", "timestamp_micros(micros) AS start_ts")


def clustered(seed, n, dims=16, centres=8, spread=0.05):
    rng = np.random.default_rng(seed)
    middle = rng.normal(size=(centres, dims))
    return (middle[rng.integers(centres, size=n)] + spread * rng.normal(size=(n, dims))).tolist()


def expected(asked, held, k, allowed=lambda q, w: True):
    unit = lambda m: np.array(m) / np.maximum(np.linalg.norm(np.array(m), axis=1, keepdims=True), 1e-12)
    keys = [i for i, v in enumerate(held) if v is not None]
    distance = np.round(1 - unit(asked) @ unit([held[i] for i in keys]).T, nearest.DIGITS)
    out = set()
    for q, row in enumerate(distance):
        near = sorted((float(d), w) for d, w in zip(row, keys) if allowed(q, w))[:k]
        out |= {(q, w, r, round(d, 7)) for r, (d, w) in enumerate(near, 1)}
    return out


def rows(df):
    return {(r["query_id"], r["window_id"], r["rank"], round(r["distance"], 7)) for r in df.collect()}


@pytest.mark.parametrize("cells", [(16 * 5, 16 * 9), (nearest.QUERY_CELLS, nearest.WINDOW_CELLS)])
def test_against_all_distances(spark, cells):
    held = clustered(1, 300)
    held[7], held[8], held[9] = None, [0.0] * 16, held[10]  # no vector, no direction, an equal one
    asked = clustered(1, 40)
    got = nearest.knn(vectors(spark, asked, name="query_id"), vectors(spark, held), k=6, query_cells=cells[0], window_cells=cells[1])
    assert rows(got) == expected(asked, held, 6)


def test_bounds_of_time_and_number(spark):
    held, asked = clustered(3, 120), clustered(4, 9)
    starts = list(range(120))
    bounds = spark.createDataFrame([(q, 3 + q, 10_000_000 * q, 90_000_000) for q in range(9)], "query_id long, k int, lo long, hi long")
    got = nearest.knn(vectors(spark, asked, name="query_id"), vectors(spark, held, starts), bounds, query_cells=16 * 4, window_cells=16 * 16)
    want = expected(asked, held, 99, lambda q, w: 10 * q <= w < 90)
    assert rows(got) == {x for x in want if x[2] <= 3 + x[0]}


def test_most_pairs_of_blocks_never_meet(spark):
    held = clustered(5, 2000, spread=0.02)
    one = vectors(spark, held).selectExpr("window_id AS id", "6L AS k", "0L AS lo", "1L AS hi", "v")
    windows = one.selectExpr("id", "0L AS k", "0L AS lo", "0L AS hi", "v")
    met = nearest.blocks(one, windows, 16 * 50, 16 * 50)
    found = nearest.durable(nearest._multiplied(met.first, met, True))
    pairs, left = met.pairs.count(), met.first.count() + nearest.open_pairs(met, found).count()
    assert left < 0.35 * pairs, (left, pairs)


def test_empty_sides(spark):
    held = vectors(spark, clustered(1, 5))
    none = held.filter("1 = 0")
    asked = vectors(spark, clustered(2, 3), name="query_id")
    assert nearest.knn(asked, none).columns == ["query_id", "window_id", "distance", "rank"]
    assert nearest.knn(asked, none).count() == 0 and nearest.knn(asked.filter("1 = 0"), held).count() == 0


def test_results_are_merged_before_they_leave_a_task(spark):
    """A query's k best leave once for each group of window blocks, not for each block; equal vectors too."""
    held = clustered(6, 600, spread=0.02) + [[1.0] * 16] * 200
    one = vectors(spark, held).selectExpr("window_id AS id", "6L AS k", "0L AS lo", "1L AS hi", "v")
    windows = one.selectExpr("id", "0L AS k", "0L AS lo", "0L AS hi", "v")
    met = nearest.blocks(one, windows, 16 * 20, 16 * 20)
    assert met.windows.count() >= 40
    assert nearest._multiplied(met.pairs, met, True).count() <= 800 * 6 * 4

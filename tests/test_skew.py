"""Skewed groups must give the same results as the plain plan; small slices force the other path."""

import random
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from chatlake.operators import evaluate, nearest, views, windows
from chatlake.plans.ordered import Ordered

SLICE = 40


@pytest.fixture(scope="module")
def rows(spark):
    """One chat holds most rows, with many equal times, lines of all sizes and few gaps."""
    rnd = random.Random(7)
    out, t = [], datetime(2024, 1, 1)
    for i in range(900):
        t += timedelta(minutes=rnd.choice([0, 0, 1, 2, 5, 60 if rnd.random() < 0.05 else 1]))
        out.append((rnd.choice([1, 1, 1, 1, 2, 3]), t, i, "x" * rnd.choice([1, 5, 20, 100, 600, 950])))
    return spark.createDataFrame(out, "chat_id long, ts timestamp, message_id long, line string").cache()


def brute_force_windows(data, max_bytes=900, max_messages=16):
    first = {}
    by_chat = {}
    for chat, ts, i, line in data:
        by_chat.setdefault(chat, []).append((ts, i, line))
    for items in by_chat.values():
        n = used = 0
        prev = start = None
        for ts, i, line in sorted(items):
            gap = prev is not None and ts - prev > timedelta(minutes=45)
            if n == 0 or gap or n >= max_messages or used + len(line) > max_bytes:
                n, used, start = 0, 0, i
            n, used, prev = n + 1, used + len(line) + 1, ts
            first[i] = start
    return first


@pytest.mark.parametrize("target", [None, SLICE, 7])
def test_window_caps(rows, target):
    got = {r.message_id: r.first_id for r in windows.assign(rows, target_rows=target).collect()}
    assert got == brute_force_windows([tuple(r) for r in rows.collect()])


@pytest.mark.parametrize("target", [None, SLICE])
def test_short_lines_fill_windows_by_count(spark, target):
    data = [(1, datetime(2024, 1, 1) + timedelta(seconds=i), i, "a") for i in range(300)]
    frame = spark.createDataFrame(data, "chat_id long, ts timestamp, message_id long, line string")
    got = {r.message_id: r.first_id for r in windows.assign(frame, target_rows=target).collect()}
    assert got == brute_force_windows(data)


def test_ordered(rows):
    w = Window.partitionBy("chat_id").orderBy("ts", "message_id")
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    marked = F.when(F.col("message_id") % 9 == 0, F.col("message_id"))
    plain = rows.select(
        "message_id", F.row_number().over(w).alias("rn"), F.sum(F.length("line")).over(run).alias("total"),
        F.lag("message_id").over(w).alias("before"), F.lead("message_id").over(w).alias("after"),
        F.last(marked, True).over(run).alias("held"),
    )
    o = Ordered(rows.withColumns({"size": F.length("line"), "mark": marked}), ["chat_id"], ["ts", "message_id"], SLICE)
    assert o.n_hot >= 1
    n = o.row_number(name="rn").select("message_id", "rn")
    s = o.running_sum(o.df, "size", "total").select("message_id", "total")
    b = o.neighbours(["message_id"]).select("message_id", F.col("prev.message_id").alias("before"), F.col("next.message_id").alias("after"))
    h = o.last_value("mark", "held").select("message_id", "held")
    got = n.join(s, "message_id").join(b, "message_id").join(h, "message_id")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, plain.collect()))


def test_views_on_hot_chats(rows):
    m = rows.withColumns(
        {"from_me": F.col("message_id") % 2 == 0, "handle_id": F.col("chat_id"), "kind": F.lit(0), "unsent": F.lit(False)}
    )
    for make in (
        lambda t: windows.gap_sessions(rows, target_rows=t).select("message_id", "session"),
        lambda t: views.transcript_runs(m, target_rows=t),
        lambda t: views.context(m.filter("message_id > 850"), m, 4, 3, target_rows=t).select("anchor_id", "message_id", "offset"),
        lambda t: views.keyset_page(
            m.filter("message_id > 860").select(
                F.col("message_id").alias("cursor_id"), "chat_id", "ts", "message_id", F.col("from_me").alias("newer")
            ), m, 5, target_rows=t,
        ).select("cursor_id", "message_id"),
        lambda t: evaluate.latency_percentiles(m.withColumn("v", F.length("line")), "chat_id", "v", "message_id", target_rows=t),
    ):
        assert sorted(map(tuple, make(None).collect())) == sorted(map(tuple, make(SLICE).collect()))


def test_knn_in_parts_is_exact(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(400, 8))
    frame = spark.createDataFrame([(i, [float(c) for c in v]) for i, v in enumerate(x)], "window_id long, v array<double>").repartition(5)
    asked = frame.filter("window_id < 50").withColumnRenamed("window_id", "query_id")
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    want = {}
    for i in range(50):
        d = np.round(1 - unit @ unit[i], 9)
        d[i] = 9
        want[i] = [int(j) for j in np.lexsort((np.arange(400), d))[:7]]
    for cells in (None, 64):
        found = nearest.knn(asked, frame, k=7, skip_self=True, query_cells=cells).orderBy("query_id", "rank").collect()
        got = {}
        for r in found:
            got.setdefault(r.query_id, []).append(r.window_id)
        assert got == want

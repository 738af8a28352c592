"""The window stream against one batch over the same messages, cut and shuffled in several ways."""

import random
from datetime import timedelta

import pandas as pd
import pytest
from history import DAY, MESSAGES, START, message, raw
from pyspark.sql import functions as F

from chatlake import schemas
from chatlake.operators import windows
from chatlake.plans import sync
from chatlake.sources import raw as raw_source
from chatlake.sources.tables import History
from chatlake.streaming import sessions

COLUMNS = [f.split()[0] for f in schemas.MESSAGES.split(", ")]


class Held:
    """A state store of one key for the step function alone."""

    def __init__(self):
        self.value = None

    exists = property(lambda self: self.value is not None)
    get = property(lambda self: self.value)

    def update(self, value):
        self.value = value


def greedy(rows, gap, max_bytes, max_messages):
    """First id of each message's window, one message after the other."""
    out, last, n, used, first = {}, None, 0, 0, None
    for ts, i, size in sorted(rows):
        if size is None:
            continue
        if last is None or ts - last > gap or n >= max_messages or used + size > max_bytes:
            n, used, first = 0, 0, i
        last, n, used = ts, n + 1, used + size + 1
        out[i] = first
    return out


@pytest.mark.parametrize("seed", range(60))
def test_placed_rows_are_those_of_one_pass(seed):
    """Whatever order rows come in, each batch without a reopened row continues the windows of one pass over all rows so far."""
    rng = random.Random(seed)
    rows, t = [], 0
    for i in range(rng.randrange(1, 120)):
        t += rng.choice([0, 1, 3, 9, 40])
        rows.append((t, 1000 + i, rng.choice([None, 5, 20, 70, 200])))
    arriving = sorted(rows, key=lambda r: (r[0] + rng.choice([0, 0, rng.randrange(1 + 60 * (seed % 3))]), r[1]))
    step, state, placed, seen = sessions._step(10, 150, 6), Held(), {}, []
    while arriving:
        k = rng.randrange(1, 20)
        part, arriving = arriving[:k], arriving[k:]
        if seed % 5 == 0 and rng.random() < 0.2:
            part = part + part[:1]
        seen += part
        frame = pd.DataFrame(part, columns=["micros", "message_id", "size"])
        frame["size"] = frame["size"].astype("float64")
        frame["packed"] = frame["message_id"].astype(str)
        (out,) = step((1,), iter([frame]), state)
        want = greedy(set(seen), 10, 150, 6)
        if out.reopened.any():  # the history rebuilds from a window that ends within a gap of the change: here, everything
            placed = dict(want)
            continue
        placed.update({int(p): f for p, f, ok in zip(out.packed, out.first_id, out.placed) if ok})
        assert placed == want
        assert not (out.placed & out.reopened).any()
    assert placed == greedy(set(rows), 10, 150, 6)


def test_stream_in_three_parts_equals_batch(spark, tmp_path):
    h = History(spark, str(tmp_path / "h"))
    sync.sync_people(h, raw(spark))
    extra = [message(900 + k, 51, None, START + 90 * DAY + k * timedelta(seconds=50), f"row {k} " + "x" * (k % 90)) for k in range(60)]
    rows = raw_source.messages(raw(spark, MESSAGES + extra)).select(COLUMNS)
    landed, checkpoint = str(tmp_path / "landed"), str(tmp_path / "ck")
    extended = []

    def land(part):
        part.coalesce(1).write.mode("append").parquet(landed)
        sessions.start(h, landed, checkpoint, files_per_batch=1).trigger(availableNow=True).start().awaitTermination()
        extended.append(int(h.state("stream:extended")))
        built = windows.build(windows.assign(windows.lines(h.read("messages"), h.read("handles"))), h.read("chats"))
        key = ["chat_id", "first_id", "last_id", "n_messages", "start_ts", "end_ts", "text"]
        assert sorted(h.read("windows").select(key).collect()) == sorted(built.select(key).collect())

    land(rows.filter("message_id < 930 AND message_id % 10 <> 0"))
    land(rows.filter("message_id BETWEEN 930 AND 944"))  # in order: the open window grows
    late = rows.filter("message_id > 944 OR message_id % 10 = 0").filter("message_id NOT BETWEEN 930 AND 944")
    land(late.withColumn("text", F.when(F.col("message_id") == 100, F.lit("edited")).otherwise(F.col("text"))))
    assert extended[0] > 0 and extended[1] > 0
    assert h.read("messages").count() == len(MESSAGES) + len(extra)
    with pytest.raises(ValueError):
        sessions.start(h, landed, str(tmp_path / "another"))

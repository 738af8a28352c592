"""The window stream over many chats: buckets of chats in the state, and what a batch reads and indexes (F21)."""

import random

import pandas as pd
import pytest
from history import MESSAGES, raw
from pyspark.sql import functions as F
from test_sessions import COLUMNS, Held, greedy

from chatlake import schemas
from chatlake.functions import splitting
from chatlake.plans import stored, sync
from chatlake.sources import raw as raw_source
from chatlake.sources.tables import History
from chatlake.streaming import sessions


@pytest.mark.parametrize("seed", range(30))
def test_chats_of_a_bucket_are_worked_out_as_if_alone(seed):
    """Rows of all chats in one call get what each chat gets in calls of its own, and the windows of one pass."""
    rng = random.Random(seed)
    step, together, alone = sessions._step(10, 150, 6), Held(), {}
    kept, rows, placed, bad = {}, [], {}, set()
    for i in range(300):
        chat, t = rng.randrange(9), i // 3 + (rng.randrange(60) if rng.random() < 0.02 * (seed % 3) else 0)
        rows.append((chat, t * rng.choice([1, 1, 4]) if seed % 2 else t, 1000 + i, rng.choice([None, 5, 20, 70, 200])))
    while rows:
        part, rows = rows[:40], rows[40:]
        part += part[:1] * (rng.random() < 0.1)
        rng.shuffle(part)
        frame = pd.DataFrame(part, columns=["chat", "micros", "message_id", "size"]).astype({"size": "float64"})
        frame["packed"] = [f"{c}:{i}" for c, _, i, _ in part]
        (out,) = step((0,), iter([frame]), together)
        got = {(r.packed, bool(r.placed), int(r.first_id), bool(r.reopened)) for r in out.itertuples()}
        want = set()
        for chat, own in frame.groupby("chat"):
            (single,) = step((chat,), iter([own.drop(columns="chat")]), alone.setdefault(chat, Held()))
            want |= {(r.packed, bool(r.placed), int(r.first_id), bool(r.reopened)) for r in single.itertuples()}
            kept.setdefault(chat, set()).update((t, i, None if pd.isna(s) else int(s)) for t, i, s in zip(own.micros, own.message_id, own["size"]))
        assert got == want
        bad |= {int(p.split(":")[0]) for p, _, _, reopened in got if reopened}
        placed.update({int(p.split(":")[1]): (int(p.split(":")[0]), first) for p, here, first, _ in got if here})
    for chat in kept.keys() - bad:
        assert {i: f for i, (c, f) in placed.items() if c == chat} == greedy(kept[chat], 10, 150, 6)


def test_state_keys_do_not_grow_with_chats(spark, tmp_path):
    n = 5 * sessions.STATE_BUCKETS
    rows = spark.range(n).select(F.col("id").alias("message_id"), F.col("id").alias("chat_id"), F.lit("hello").alias("text"), F.lit(0).alias("kind"))
    rows = rows.withColumns({"from_me": F.lit(True), "unsent": F.lit(False), "ts": F.timestamp_seconds(F.lit(1_700_000_000)), "attach_count": F.lit(0)})
    have = set(rows.columns)
    rows.select(*[F.expr(f"CAST({c if c in have else 'NULL'} AS {kind}) AS {c}") for c, kind in (f.split() for f in schemas.MESSAGES.split(", "))]).write.parquet(str(tmp_path / "landed"))
    landed = spark.readStream.schema(schemas.MESSAGES).parquet(str(tmp_path / "landed"))
    placed = sessions.place(landed, schemas.empty(spark, schemas.HANDLES))
    q = placed.writeStream.format("noop").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert max(p["numInputRows"] for p in q.recentProgress) == n
    keys = max(op["numRowsTotal"] for p in q.recentProgress for op in p["stateOperators"])
    assert 0 < keys <= sessions.STATE_BUCKETS


def test_lists_of_tokens_are_never_null(spark):
    """Arrow's writer takes as many steps for a NULL list as there are NULL lists before it in the batch."""
    rows = spark.createDataFrame([("plain words",), (None,), ("",), ("日本 x",), ("é a",), ("。",)], "text string")
    made = rows.select(*splitting.columns(F.col("text"))).collect()
    assert [r["tokens"] for r in made] == [[], [], [], ["日本", "x"], [], []]


def test_index_batch_sees_only_messages_that_change(spark, tmp_path, monkeypatch):
    h = History(spark, str(tmp_path / "h"))
    sync.sync_people(h, raw(spark))
    rows = raw_source.messages(raw(spark)).select(COLUMNS)
    seen, begin = [], stored.begin
    ids = lambda df: {r["message_id"] for r in df.select("message_id").collect()}
    monkeypatch.setattr(stored, "begin", lambda history, before, after: seen.append((ids(before), ids(after))) or begin(history, before, after))
    first, last = {100, 101, 102}, {103, 104}
    for batch in (first, last, {104}):
        part = rows.filter(F.col("message_id").isin(batch))
        sync.apply_messages(h, part.withColumn("text", F.lit("edited")) if batch == {104} else part)
    gone = rows.filter(F.col("message_id").isin({100, 102, 103}))
    sync.apply_messages(h, gone, full=True)
    assert seen == [(set(), first), (set(), last), ({104}, {104}), ({101, 104}, set())]
    left = stored.texts(h).groupBy("message_id").agg(F.sum(F.expr("CAST(here AS INT) - CAST(was AS INT)")).alias("n")).filter("n <> 0")
    assert ids(left) == {100, 102, 103}
    assert len(MESSAGES) > 5

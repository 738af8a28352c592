"""Windows kept open in stream state: in-order messages extend their chat's windows without reading what is stored.

Per chat the state is seven numbers: the last line, since when its session (no silence above the gap) runs, rows, bytes
and first id of the open window, and whether the open session is stale. Every message comes out with the window it
belongs to, found by the same prefix sums and doubled jumps as in batch. Nothing has to be closed by a timer: a window
is stored from its first message on and grows.

Rows that do not come in order (late, edited, repeated, or unsent ones) come out marked, and the stored windows of their
chats are rebuilt from there. If such a row reaches into the open session, that session is stale: its further rows are
rebuilt too, until a silence above the gap starts a session that owes nothing to the past.

Chats are kept in a fixed number of buckets, each one key of the state with a list for each of the numbers, so the calls
of Python do not grow with the chats. There is no watermark, so no late row is dropped. A task holds the rows of one
bucket in one micro-batch, which ``files_per_batch`` bounds. The stream must be the only writer of the history's messages from the start (``start``
refuses others), and reads names once: restart it after names change.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from chatlake import schemas
from chatlake.operators import windows
from chatlake.plans import sync
from chatlake.session import durable
from chatlake.sources.tables import History, bucket

STATE = ", ".join(f"{c} array<long>" for c in "chat last last_id since n used first_id".split()) + ", stale array<boolean>"
PLACED = "packed string, placed boolean, first_id long, reopened boolean"
OWNER = "stream:sessions"
NO_CHAT_KEYS = 64
STATE_BUCKETS = 1024
COLUMNS = [f.split()[0] for f in schemas.MESSAGES.split(", ")]
SHORT = {f"c{i}": c for i, c in enumerate(COLUMNS)}  # names inside packed rows


def _step(gap: int, max_bytes: int, max_messages: int):
    """Rows of a bucket of chats in a micro-batch: each with its window's first id, or marked as reopening its chat.

    All chats are worked out at once. A window that is open on entry is a row before those of its chat, of its bytes
    and standing for its lines; every chat starts a window then, and nothing is done chat by chat.
    """

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(frames), ignore_index=True)
        of = rows["chat"].to_numpy(np.int64) if "chat" in rows else np.full(len(rows), key[0], np.int64)
        order = np.lexsort((rows["message_id"].to_numpy(np.int64), rows["micros"].to_numpy(np.int64), of))
        ts, ids = (rows[c].to_numpy(np.int64)[order] for c in ("micros", "message_id"))
        line = rows["size"].notna().to_numpy()[order]
        sizes = rows["size"].fillna(0).to_numpy(np.int64)[order]
        held = [np.asarray(v, np.int64) for v in (state.get if state.exists else [()] * 8)]
        chats = np.union1d(of, held[0])
        chat = np.searchsorted(chats, of[order])
        known = np.isin(chats, held[0])
        last, last_id, since, n, used, first, stale = (np.zeros(len(chats), np.int64) for _ in range(7))
        for now, before in zip((last, last_id, since, n, used, first, stale), held[1:], strict=True):
            now[np.searchsorted(chats, held[0])] = before
        stale = stale > 0

        reopened = known[chat] & ((ts < last[chat]) | ((ts == last[chat]) & (ids <= last_id[chat])))
        stale[chat[reopened & (ts >= since[chat] - gap)]] = True
        fresh = np.flatnonzero(line & ~reopened)
        head = np.diff(chat[fresh], prepend=-1) > 0
        before = np.where(head, last[chat[fresh]], np.roll(ts[fresh], 1))
        breaks = (ts[fresh] - before > gap) | (head & ~known[chat[fresh]])
        ends = fresh[np.append(head[1:], True)] if len(fresh) else fresh
        last[chat[ends]], last_id[chat[ends]], known[chat[ends]] = ts[ends], ids[ends], True
        by_id = np.lexsort((ids, chat))
        again = (np.diff(chat[by_id]) == 0) & (np.diff(ids[by_id]) == 0)
        twice = np.zeros(len(chats), bool)  # which of two versions counts is decided by the merge
        twice[chat[by_id[1:][again]]] = True
        reopened |= twice[chat]
        stale |= twice
        breaks, fresh = breaks[~twice[chat[fresh]]], fresh[~twice[chat[fresh]]]
        owing = np.zeros(len(chats), bool)
        owing[chat[fresh]] = stale[chat[fresh]]
        n[owing], used[owing] = 0, 0
        stale[chat[fresh[breaks]]] = False
        total = np.cumsum(breaks)
        start = np.searchsorted(chat[fresh], chat[fresh])
        clean = ~owing[chat[fresh]] | (total > total[start] - breaks[start])  # from the chat's first silence on
        reopened[fresh[~clean]] = True
        fresh, breaks = fresh[clean], breaks[clean]

        firsts, placed = np.zeros(len(ts), np.int64), np.zeros(len(ts), bool)
        if len(fresh):
            placed[fresh] = True
            broken = fresh[breaks]
            since[chat[broken]] = ts[broken]  # the last of a chat remains
            at = np.flatnonzero(np.diff(chat[fresh], prepend=-1) > 0)
            at = at[n[chat[fresh[at]]] > 0]
            whose = chat[fresh[at]]
            opened = np.zeros(len(fresh) + len(at), bool)
            opened[at + np.arange(len(at))] = True
            line_of, of_chat = np.insert(ids[fresh], at, first[whose]), np.insert(chat[fresh], at, whose)
            lines_ = np.insert(np.ones(len(fresh), np.int64), at, n[whose])
            row = windows.Run(
                np.insert(sizes[fresh], at, used[whose] - 1), np.insert(breaks, at, True) | (np.diff(of_chat, prepend=-1) > 0),
                max_bytes, max_messages, lines_,
            )
            where = np.flatnonzero(row.starts(0))
            of_window = line_of[np.repeat(where, np.diff(np.append(where, row.n)))]
            firsts[fresh] = of_window[~opened]
            end = np.flatnonzero(np.diff(of_chat, append=-1) != 0)
            final = where[np.searchsorted(where, end, "right") - 1]
            counted = np.concatenate([[0], np.cumsum(lines_)])
            whose = of_chat[end]
            n[whose], used[whose] = counted[end + 1] - counted[final], row.used[end + 1] - row.used[final]
            first[whose] = line_of[final]
        if known.any():
            state.update(tuple(v[known].tolist() for v in (chats, last, last_id, since, n, used, first, stale)))
        out = {"placed": placed, "first_id": firsts, "reopened": reopened}
        for name, values in out.items():
            out[name] = np.empty_like(values)
            out[name][order] = values
        yield pd.DataFrame({"packed": rows["packed"], **out})

    return run


def place(
    messages: DataFrame,
    handles: DataFrame,
    gap_minutes: int = windows.GAP_MINUTES,
    max_bytes: int = windows.MAX_BYTES,
    max_messages: int = windows.MAX_MESSAGES,
) -> DataFrame:
    """A stream of messages with ``placed``, ``first_id`` and ``reopened``. Rows go through as text, so no long becomes a float."""
    lined = windows.with_line(messages, handles)
    whole = F.struct(*[(F.unix_micros("ts") if c == "ts" else F.col(c)).alias(short) for short, c in SHORT.items()])
    no_chat = F.lit(-1) - F.pmod(F.xxhash64("message_id"), F.lit(NO_CHAT_KEYS))  # such rows have no line, so they leave no state
    rows = lined.select(
        F.coalesce("chat_id", no_chat).alias("chat"), "message_id", F.unix_micros("ts").alias("micros"),
        F.octet_length("line").alias("size"), F.to_json(whole).alias("packed"),
    ).withColumn("key", bucket("chat", STATE_BUCKETS))
    out = rows.groupBy("key").applyInPandasWithState(
        _step(gap_minutes * 60_000_000, max_bytes, max_messages), PLACED, STATE, "append", GroupStateTimeout.NoTimeout
    )
    kinds = [f.split()[1] for f in schemas.MESSAGES.split(", ")]
    packed = ", ".join(f"{short} {'long' if kind == 'timestamp' else kind}" for short, kind in zip(SHORT, kinds, strict=True))
    opened = out.select(F.from_json("packed", packed).alias("m"), "placed", "first_id", "reopened")
    opened = opened.select(*[F.col(f"m.{short}").alias(c) for short, c in SHORT.items()], "placed", "first_id", "reopened")
    return opened.withColumn("ts", F.timestamp_micros("ts"))


def extend(history: History, rows: DataFrame, tz: str = "UTC") -> int:
    """Add placed messages to their stored windows, or begin these; lines a window already has are left out."""
    parts = history.parts_of("windows", rows)
    held = durable(history.read_parts("windows", parts))
    lines = windows.with_line(rows, history.read("handles")).filter("line IS NOT NULL").select("chat_id", "ts", "message_id", "line", "first_id")
    ends = held.select("chat_id", "first_id", F.struct(F.col("end_ts").alias("ts"), F.col("last_id").alias("message_id")).alias("_end"))
    new = durable(lines.join(ends, ["chat_id", "first_id"], "left").filter(F.col("_end").isNull() | (F.struct("ts", "message_id") > F.col("_end"))))
    if new.isEmpty():
        return 0
    columns = held.columns
    more = new.filter("_end IS NOT NULL").groupBy("chat_id", "first_id").agg(F.array_sort(F.collect_list(F.struct("ts", "message_id", "line"))).alias("_l"))
    newest = F.element_at("_l", -1)
    grown = held.join(more, ["chat_id", "first_id"], "left").withColumns(
        {
            "text": F.when(F.col("_l").isNull(), F.col("text")).otherwise(F.concat_ws("\n", "text", F.array_join(F.col("_l.line"), "\n"))),
            "end_ts": F.coalesce(newest["ts"], "end_ts"),
            "last_id": F.coalesce(newest["message_id"], "last_id"),
            "n_messages": F.col("n_messages") + F.coalesce(F.size("_l"), F.lit(0)),
        }
    )
    begun = windows.build(new.filter("_end IS NULL").select("chat_id", "ts", "message_id", "line", "first_id"), history.read("chats"), tz)
    both = grown.drop("_l", "text_hash", "window_id").unionByName(begun.drop("text_hash")).withColumn("text_hash", F.xxhash64("text"))
    both = both.withColumn("window_id", windows.window_id(F.col("chat_id"), F.col("start_ts"), F.col("text_hash")))
    history.merge_parts("windows", both.select(columns), parts)
    return new.select("chat_id", "first_id").distinct().count()


def merge_batch(history: History, tz: str = "UTC", gap_minutes: int = windows.GAP_MINUTES):
    """The ``foreachBatch`` function: merge messages, extend windows of chats in order, rebuild the others.

    Chats that an interrupted run left to be rebuilt are rebuilt, so a replayed batch is harmless.
    """

    def run(batch: DataFrame, batch_id: int) -> None:
        rows = durable(batch)
        owed = durable(history.read("dirty").select("chat_id"))
        _, changed, _ = sync.apply_messages(history, rows.select(COLUMNS))  # the merge takes one row per source id
        others = owed.unionByName(rows.filter("reopened AND chat_id IS NOT NULL").select("chat_id")).distinct()
        placed = durable(rows.filter("placed").join(others, "chat_id", "left_anti").drop("placed", "reopened"))
        extended = extend(history, placed, tz)
        left = durable(history.read("dirty").join(placed.select("chat_id"), "chat_id", "left_anti"))
        history.replace("dirty", left)
        rebuilt = sync.rebuild_dirty(history, tz, gap_minutes)
        history.set_state(**{"stream:batch": batch_id, "stream:changed": changed, "stream:windows": extended + rebuilt, "stream:extended": extended})

    return run


def start(
    history: History, landed: str, checkpoint: str, files_per_batch: int = 1000, tz: str = "UTC", gap_minutes: int = windows.GAP_MINUTES
) -> DataStreamWriter:
    """A writer over the landed folder; add a trigger and start it."""
    if history.state(OWNER) is None:
        if not history.read("messages").isEmpty():
            raise ValueError("the history has messages that this stream has not seen; use streaming.feed")
        history.set_state(**{OWNER: checkpoint})
    elif history.state(OWNER) != checkpoint:
        raise ValueError(f"the windows of this history are kept by the stream with checkpoint {history.state(OWNER)}")
    messages = history.spark.readStream.schema(schemas.MESSAGES).option("maxFilesPerTrigger", files_per_batch).parquet(landed)
    placed = place(messages, history.read("handles"), gap_minutes)
    return placed.writeStream.foreachBatch(merge_batch(history, tz, gap_minutes)).option("checkpointLocation", checkpoint)

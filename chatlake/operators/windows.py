"""Conversation windows: spans of consecutive messages of one chat.

A window ends when the chat is silent for longer than the gap, or when the next line would
take it over the byte cap or the message cap. The gap rule is a lag. The caps are worked out for whole
Arrow batches of sorted rows: prefix sums of the line sizes give, by binary search, where the next
window starts if one starts at a row; the rows that are starts are marked by doubling this
successor table. Only the open window (its rows, bytes and first id) goes from batch to batch, so
no session is ever held in memory and no step is taken per message. Chats too large for one task
are cut into slices (see ``plans.ordered``); the open window on entering each slice is worked out
from one small summary row per slice.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chatlake.functions import kinds, times
from chatlake.plans.ordered import Ordered, bounded_broadcast

GAP_MINUTES = 45
MAX_BYTES = 900
MAX_MESSAGES = 16


def _micros(minutes: int) -> Column:
    return F.lit(minutes * 60_000_000)


def _shown() -> Column:
    """Rows that go into windows."""
    plain = (F.col("kind") == kinds.TEXT) & ~F.col("unsent") & F.col("chat_id").isNotNull()
    return plain & (F.col("text").isNotNull() | (F.col("attach_count") > 0))


def with_line(messages: DataFrame, handles: DataFrame) -> DataFrame:
    """Messages with their ``line``, ``who: body`` with the whole body; NULL for rows that go into no window."""
    people = handles.select("handle_id", F.coalesce("name", "address").alias("_who"))
    who = F.when(F.col("from_me"), F.lit("Me")).otherwise(F.coalesce("_who", F.lit("Them")))
    line = F.concat(who, F.lit(": "), F.coalesce("text", F.lit("[attachment]")))
    return messages.join(people, "handle_id", "left").withColumn("line", F.when(_shown(), line)).drop("_who")


def lines(messages: DataFrame, handles: DataFrame) -> DataFrame:
    """Rows that go into windows; a line over the byte cap is a window of its own."""
    return with_line(messages.filter(_shown()), handles).select("chat_id", "ts", "message_id", "line")


def gap_breaks(ordered: Ordered, gap_minutes: int = GAP_MINUTES, partitioned: bool = False) -> DataFrame:
    """1 on each row that starts a gap session: first of its chat, or silent for longer than the gap.

    ``partitioned`` fixes the partitioning by (chat, slice) up front; the window then needs no
    shuffle of its own and its sorted output can be streamed.
    """
    rows = ordered.neighbours(["ts"], prev="_prev", next=None, partitioned=partitioned)
    silence = F.unix_micros("ts") - F.unix_micros("_prev.ts")
    starts = F.col("_prev").isNull() | (silence > _micros(gap_minutes))
    return rows.withColumn("gap_break", starts.cast("int")).drop("_prev")


def gap_sessions(messages: DataFrame, gap_minutes: int = GAP_MINUTES, target_rows: int | None = None) -> DataFrame:
    """Messages with the number of their gap session in the chat."""
    ordered = Ordered(messages, ["chat_id"], ["ts", "message_id"], target_rows)
    rows = gap_breaks(ordered, gap_minutes)
    return ordered.running_sum(rows, "gap_break", "session").drop("_slice", "gap_break")


_SUMMARY = (
    "chat_id long, part int, head array<int>, broken boolean, "
    "exits array<struct<n:int,bytes:int,first_id:long>>, n int, bytes int"
)
_SUMMARY_SCHEMA = pa.schema(
    [
        ("chat_id", pa.int64()), ("part", pa.int32()), ("head", pa.list_(pa.int32())), ("broken", pa.bool_()),
        ("exits", pa.list_(pa.struct([("n", pa.int32()), ("bytes", pa.int32()), ("first_id", pa.int64())]))), ("n", pa.int32()), ("bytes", pa.int32()),
    ]
)
_ENTRY = "chat_id long, _slice int, n_in int, bytes_in int, id_in long"


class Run:
    """Lines of one batch in order, with where a next window starts for every row on which one may start."""

    def __init__(self, sizes: np.ndarray, breaks: np.ndarray, max_bytes: int, max_messages: int, held: np.ndarray | int = 1):
        """``held``: the lines each row stands for; more than one where a row is a window that is already open."""
        n = len(sizes)
        self.n, self.max_bytes, self.max_messages = n, max_bytes, max_messages
        self.used = np.concatenate([[0], np.cumsum(sizes + 1)])  # a line and its end
        self.full = self.used[1:] - 1  # what a window from row 0 would have with this line
        places = np.flatnonzero(breaks)
        after = np.searchsorted(places, np.arange(n), "right")
        self.broken = np.append(places, n)[after]  # the next break after each row
        self.first_break = int(places[0]) if len(places) else n
        over = np.searchsorted(self.full, self.used[:-1] + max_bytes, "right")
        at = np.arange(n)
        step = np.minimum(np.minimum(self.broken, at + 1 + max_messages - held), np.maximum(over, at + 1))
        jump = np.append(np.minimum(step, n), n)
        self.jumps = [jump]
        while (self.jumps[-1][:-1] < n).any():  # the last table leads past the end from everywhere
            self.jumps.append(self.jumps[-1][self.jumps[-1]])

    def opening(self, n: int, used: int) -> int:
        """The first row that starts a window when one of ``n`` rows and ``used`` bytes is open."""
        if n == 0:
            return 0
        over = int(np.searchsorted(self.full, self.max_bytes - used, "right"))
        return min(self.first_break, over, max(self.max_messages - n, 0), self.n)

    def starts(self, first: int) -> np.ndarray:
        """Which rows start a window if ``first`` does, none before it being one."""
        marked = np.zeros(self.n + 1, bool)
        marked[first] = True
        for jump in self.jumps:
            marked[jump[np.flatnonzero(marked)]] = True
        return marked[: self.n]

    def last(self, first: np.ndarray) -> np.ndarray:
        """The last start reached from each of some starts."""
        for jump in reversed(self.jumps):
            onward = jump[first]
            first = np.where(onward < self.n, onward, first)
        return first

    def leaving(self, start: int) -> tuple[int, int]:
        """Rows and bytes of the window open at the end, if it started at a row."""
        return self.n - start, int(self.used[-1] - self.used[start])


def _numbers(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return batch.column(name).to_numpy(zero_copy_only=False).astype(np.int64)


def _changes(chat: np.ndarray, part: np.ndarray, key: tuple | None) -> np.ndarray:
    """Rows that begin another (chat, slice) than the row before."""
    new = np.ones(len(chat), bool)
    new[1:] = (chat[1:] != chat[:-1]) | (part[1:] != part[:-1])
    if key is not None and len(chat):
        new[0] = (int(chat[0]), int(part[0])) != key
    return new


def _fold(max_bytes: int, max_messages: int):
    """Greedy caps over rows sorted by (chat, slice, ts, id): adds the id of each row's window start."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, n, used, first = None, 0, 0, None
        for batch in batches:
            chat, part, ids, sizes, n_in = (_numbers(batch, c) for c in ("chat_id", "_slice", "message_id", "size", "n_in"))
            new = _changes(chat, part, key)
            breaks = (_numbers(batch, "gap_break") > 0) | (new & (n_in == 0))
            # only a slice that an open window reaches into needs its own beginning
            cuts = [0, *[int(k) for k in np.flatnonzero(new & (n_in > 0)) if k], len(ids)]
            firsts = np.empty(len(ids), np.int64)
            for a, z in zip(cuts[:-1], cuts[1:], strict=True):
                if a == z:
                    continue
                if new[a]:
                    row = batch.slice(a, 1)
                    n, used, first = (row.column(c)[0].as_py() for c in ("n_in", "bytes_in", "id_in"))
                lines_ = Run(sizes[a:z], breaks[a:z], max_bytes, max_messages)
                at = lines_.opening(n, used)
                marked = lines_.starts(at)
                where = np.flatnonzero(marked)
                if len(where) == 0 or where[0] > 0:
                    firsts[a : a + at] = first
                firsts[a + at : z] = ids[a:z][np.repeat(where, np.diff(np.append(where, lines_.n)))]
                if len(where):
                    (n, used), first = lines_.leaving(int(where[-1])), int(ids[a + where[-1]])
                else:
                    n, used = n + lines_.n, used + int(lines_.used[-1])
            if len(ids):
                key = (int(chat[-1]), int(part[-1]))
            out = [batch.column(c) for c in ("chat_id", "ts", "message_id", "line")]
            yield pa.RecordBatch.from_arrays([*out, pa.array(firsts)], names=["chat_id", "ts", "message_id", "line", "first_id"])

    return run


def _summarise(max_bytes: int, max_messages: int):
    """What a slice does to the fold: one row per slice, whatever its length.

    ``head`` holds the line sizes up to the first gap (at most ``max_messages`` of them): with
    the state on entry they tell where the first window of the slice starts. ``exits[k]`` is
    the state on leaving when that first start is row k. So a slice is followed by at most
    ``max_messages`` chains.
    """

    def row_of(key, head, broken, chains, n, used):
        exits = [None if c is None else dict(zip(("n", "bytes", "first_id"), c, strict=True)) for c in chains]
        exits += [None] * (max_messages - len(exits))
        return {
            "chat_id": key[0], "part": key[1], "head": head, "broken": broken, "exits": exits, "n": n, "bytes": used,
        }

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, head, broken, chains, n, used = None, [], False, [], 0, 0
        for batch in batches:
            chat, part, ids, sizes, gaps = (_numbers(batch, c) for c in ("chat_id", "_slice", "message_id", "size", "gap_break"))
            new, done = _changes(chat, part, key), []
            cuts = [0, *[int(k) for k in np.flatnonzero(new) if k], len(ids)]
            for a, z in zip(cuts[:-1], cuts[1:], strict=True):
                if a == z:
                    continue
                if new[a]:
                    if key is not None:
                        done.append(row_of(key, head, broken, chains, n, used))
                    key, head, broken, chains, n, used = (int(chat[a]), int(part[a])), [], False, [], 0, 0
                lines_ = Run(sizes[a:z], gaps[a:z] > 0, max_bytes, max_messages)
                if not broken:
                    head += sizes[a : a + min(lines_.first_break, max_messages - len(head))].tolist()
                    broken = lines_.first_break < lines_.n
                moved = []
                for rows, bytes_, first in chains:
                    at = lines_.opening(rows, bytes_)
                    if at == lines_.n:
                        moved.append((rows + lines_.n, bytes_ + int(lines_.used[-1]), first))
                    else:
                        last = int(lines_.last(np.array([at]))[0])
                        moved.append((*lines_.leaving(last), int(ids[a + last])))
                fresh = np.arange(min(max_messages - n, lines_.n)) if n < max_messages else np.empty(0, np.int64)
                for last in lines_.last(fresh).tolist():
                    moved.append((*lines_.leaving(last), int(ids[a + last])))
                chains, n, used = moved, n + lines_.n, used + int(lines_.used[-1])
            if done:
                yield pa.RecordBatch.from_pylist(done, schema=_SUMMARY_SCHEMA)
        if key is not None:
            yield pa.RecordBatch.from_pylist([row_of(key, head, broken, chains, n, used)], schema=_SUMMARY_SCHEMA)

    return run


def _enter(max_bytes: int, max_messages: int):
    """Chain the summaries of one chat's slices, in order, into the state on entry of each slice."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        n, used, first, out = 0, 0, None, []
        for s in pdf.sort_values("part").to_dict("records"):
            out.append((s["chat_id"], s["part"], n, used, first))
            m, b, at = n, used, None
            for k, size in enumerate(s["head"]):
                if m == 0 or m >= max_messages or b + size > max_bytes:
                    at = k
                    break
                m, b = m + 1, b + size + 1
            if at is None and s["broken"]:
                at = len(s["head"])
            if at is None:  # too short to close the open window
                n, used = n + s["n"], used + s["bytes"]
            else:
                state = s["exits"][at]
                n, used, first = state["n"], state["bytes"], state["first_id"]
        frame = pd.DataFrame(out, columns=["chat_id", "_slice", "n_in", "bytes_in", "id_in"])
        return frame.astype({"id_in": "Int64"})

    return run


def assign(
    rows: DataFrame,
    gap_minutes: int = GAP_MINUTES,
    max_bytes: int = MAX_BYTES,
    max_messages: int = MAX_MESSAGES,
    target_rows: int | None = None,
) -> DataFrame:
    """Lines with ``first_id``, the first message of their window, under the gap and both caps."""
    by = ["chat_id", "_slice"]
    order = [*by, "ts", "message_id"]
    ordered = Ordered(rows, ["chat_id"], ["ts", "message_id"], target_rows)
    sized = gap_breaks(ordered, gap_minutes, partitioned=True).withColumn("size", F.octet_length("line"))
    fold = _fold(max_bytes, max_messages)
    schema = "chat_id long, ts timestamp, message_id long, line string, first_id long"
    if not ordered.n_hot:
        ready = sized.withColumns(
            {"n_in": F.lit(0), "bytes_in": F.lit(0), "id_in": F.lit(None).cast("long")}
        ).sortWithinPartitions(*order)
        return ready.mapInArrow(fold, schema)
    hot = sized.filter("_slice >= 0").sortWithinPartitions(*order)
    entry = (
        hot.select(*by, "message_id", "gap_break", "size")
        .mapInArrow(_summarise(max_bytes, max_messages), _SUMMARY)
        .groupBy("chat_id")
        .applyInPandas(_enter(max_bytes, max_messages), _ENTRY)
    )
    ready = sized.join(bounded_broadcast(entry, ordered.n_borders), by, "left").withColumns(
        {"n_in": F.coalesce("n_in", F.lit(0)), "bytes_in": F.coalesce("bytes_in", F.lit(0))}
    )
    return ready.repartition(*by).sortWithinPartitions(*order).mapInArrow(fold, schema)


def build(assigned: DataFrame, chats: DataFrame, tz: str = "UTC") -> DataFrame:
    """One row per window with its span, text and content hash.

    The text is the chat title, the local start date and one line per message. A window has a
    bounded number of messages, so the ordered list of its lines is small by construction.
    """
    ordered_lines = F.array_sort(F.collect_list(F.struct("ts", "message_id", "line")))
    spans = assigned.groupBy("chat_id", "first_id").agg(ordered_lines.alias("_l"))
    first, last = F.get("_l", F.lit(0)), F.element_at("_l", -1)
    titled = spans.join(chats.select("chat_id", "title"), "chat_id", "left")
    header = F.concat(
        F.coalesce("title", F.lit("")), F.lit(" · "), F.date_format(times.local(first["ts"], tz), "yyyy-MM-dd")
    )
    text = F.concat_ws("\n", header, F.array_join(F.col("_l.line"), "\n"))
    return titled.select(
        "chat_id",
        first["ts"].alias("start_ts"),
        last["ts"].alias("end_ts"),
        "first_id",
        last["message_id"].alias("last_id"),
        F.size("_l").cast("long").alias("n_messages"),
        text.alias("text"),
    ).withColumn("text_hash", F.xxhash64("text"))


def message_windows(assigned: DataFrame) -> DataFrame:
    """Window (by its first message) of every line, for joins from messages to windows."""
    return assigned.select("message_id", "chat_id", "first_id")


def dirty_cut(dirty: DataFrame, windows: DataFrame, gap_minutes: int = GAP_MINUTES) -> DataFrame:
    """From when each dirty chat is rebuilt: the earliest start of its windows ending within a gap of the change."""
    near = windows.join(dirty, "chat_id").filter(
        F.unix_micros("end_ts") >= F.unix_micros("from_ts") - _micros(gap_minutes)
    )
    earliest = near.groupBy("chat_id").agg(F.min("start_ts").alias("_start"))
    return dirty.join(earliest, "chat_id", "left").select(
        "chat_id", F.least("from_ts", "_start").alias("cut_ts")
    )


def to_rebuild(lines_: DataFrame, cut: DataFrame) -> DataFrame:
    """Lines at or after the cut of their chat."""
    return lines_.join(cut, "chat_id").filter("ts >= cut_ts").drop("cut_ts")


def diff(old: DataFrame, new: DataFrame, cut: DataFrame, gap_minutes: int = GAP_MINUTES) -> DataFrame:
    """What a rebuild does to the stored windows of the dirty chats: keep, insert or delete.

    A rebuilt window with the same start and text keeps its id (and so its vector). Chats
    without a change, and windows that end before the cut, do not appear.
    """
    affected = old.join(cut, "chat_id").filter(
        F.unix_micros("end_ts") >= F.unix_micros("cut_ts") - _micros(gap_minutes)
    )
    affected = affected.filter("start_ts >= cut_ts").select(
        "chat_id", "start_ts", "text_hash", "window_id", F.col("first_id").alias("_first")
    )
    keys = ["chat_id", "start_ts", "text_hash"]
    action = (
        F.when(F.col("window_id").isNull(), "insert").when(F.col("_new").isNull(), "delete").otherwise("keep")
    )
    fresh = new.withColumn("_new", F.lit(True))
    joined = affected.join(fresh, keys, "full_outer").withColumn("action", action)
    return joined.withColumn("first_id", F.coalesce("first_id", "_first")).drop("_new", "_first")


def window_id(chat_id: Column, start_ts: Column, text_hash: Column) -> Column:
    """Stable id from the content, so a rerun after a lost executor gives the same ids."""
    return F.xxhash64(chat_id, start_ts, text_hash)


def pending(windows: DataFrame, vectors: DataFrame, model_id: str) -> DataFrame:
    """Windows without a vector (or rejection mark) of the current model, newest first."""
    done = vectors.filter(F.col("model_id") == model_id).select("window_id")
    return windows.join(done, "window_id", "left_anti")


def span_members(windows: DataFrame, messages: DataFrame) -> DataFrame:
    """Messages of each window: same chat, (ts, id) inside the span.

    Windows of a chat do not overlap, so the window of a message is the latest one that starts
    at or before it. That is a running maximum over the chat's starts and messages in one order
    rather than a range join that would pair every message with every window of its chat.
    """
    starts = windows.select(
        "chat_id", F.col("start_ts").alias("ts"), F.col("first_id").alias("message_id"), F.lit(0).alias("_side"),
        F.struct("window_id", "end_ts", "last_id").alias("_w"),
    )
    rows = messages.select("chat_id", "ts", "message_id", F.lit(1).alias("_side"), F.lit(None).alias("_w"))
    both = starts.unionByName(rows)
    ordered = Ordered(both, ["chat_id"], ["ts", "message_id", "_side"])
    latest = ordered.last_value("_w", "_latest")
    inside = F.struct("ts", "message_id") <= F.struct(
        F.col("_latest.end_ts").alias("ts"), F.col("_latest.last_id").alias("message_id")
    )
    return latest.filter((F.col("_side") == 1) & F.col("_latest").isNotNull() & inside).select(
        "chat_id", "message_id", F.col("_latest.window_id").alias("window_id")
    )

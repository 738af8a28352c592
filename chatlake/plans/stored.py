"""Search over a stored history: its keyword index is kept up to date by every sync, its windows and vectors are read.

Index batches are folders of plain Parquet, ``index/postings/batch=N`` and ``index/texts/batch=N``. A batch is written
before the messages are, and counts from the moment its number is in the state. A run that dies in between leaves one
batch that does not count; the next run keeps what of it the messages already show and drops the rest.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chatlake.operators import deltas, embed, filters, windows
from chatlake.plans.search import Corpus
from chatlake.session import durable
from chatlake.sources.tables import History

COUNT = "index:batches"


def _read(history: History, name: str, schema: str) -> DataFrame:
    return history.spark.read.schema(schema).parquet(f"{history.path}/index/{name}")


def _write(history: History, name: str, rows: DataFrame, number: int) -> None:
    rows.drop("batch").write.mode("overwrite").parquet(f"{history.path}/index/{name}/batch={number}")


def _batches(history: History) -> int | None:
    value = history.state(COUNT)
    return None if value is None else int(value)


def _counted(history: History, name: str, schema: str) -> DataFrame:
    number = _batches(history) or 0
    if number == 0:
        return history.spark.createDataFrame([], schema)
    return _read(history, name, schema).filter(F.col("batch") <= number)


def postings(history: History) -> DataFrame:
    return _counted(history, "postings", deltas.POSTINGS)


def texts(history: History) -> DataFrame:
    return _counted(history, "texts", deltas.TEXTS)


def settle(history: History) -> None:
    """Before a sync: index a history that has none, or finish what an interrupted run began."""
    messages = history.read("messages")
    number = _batches(history)
    if number is None:
        if messages.isEmpty():
            history.set_state(**{COUNT: 0})
        else:
            commit(history, begin(history, messages.limit(0), messages))
        return
    try:
        rows = _read(history, "texts", deltas.TEXTS).filter(F.col("batch") == number + 1)
        if rows.isEmpty():
            return
    except AnalysisException:  # no batch has ever been written
        return
    kept = durable(deltas.applied(rows, messages))
    if kept.isEmpty():
        return
    theirs = _read(history, "postings", deltas.POSTINGS).filter(F.col("batch") == number + 1)
    theirs = durable(theirs.join(kept.select("message_id"), "message_id", "left_semi").select(theirs.columns))
    _write(history, "postings", theirs, number + 1)
    _write(history, "texts", kept, number + 1)
    commit(history, number + 1)


def begin(history: History, before: DataFrame, after: DataFrame) -> int:
    """Write the index batch of a change of messages; it counts after ``commit``."""
    number = (_batches(history) or 0) + 1
    changed = durable(deltas.changes(before, after))
    _write(history, "postings", deltas.signed_postings(changed, number), number)
    _write(history, "texts", deltas.signed_texts(changed, number), number)
    return number


def commit(history: History, number: int) -> None:
    history.set_state(**{COUNT: number})


def corpus(history: History) -> Corpus:
    """What a search needs, all of it read from the stored tables. Messages of no live window are found by keyword only."""
    messages = filters.with_flags(history.read("messages"), history.read("attachments"))
    live = history.read("windows")
    vectors = history.read("vectors").filter(F.col("status") == embed.DONE)
    return Corpus(
        messages,
        history.read("handles"),
        history.read("chats"),
        history.read("members"),
        deltas.index(postings(history), texts(history)),
        vectors.join(live.select("window_id"), "window_id", "left_semi"),
        windows.span_members(live, messages),
    )

"""Continuous ingest: landed files of canonical messages merged micro-batch by micro-batch.

There is no watermark on purpose: a row may arrive any time late and is merged where it
belongs; the chats it touches are rebuilt from its time on. The checkpoint plus the no-op
detection of the merge make a replayed batch harmless.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import DataStreamWriter

from chatlake import schemas
from chatlake.plans import sync
from chatlake.sources.tables import History


def once_each(batch: DataFrame) -> DataFrame:
    """Identical rows of overlapping reads inside a batch count once."""
    return batch.dropDuplicates(["source_id", "text", "chat_id", "edited", "unsent", "attach_count"])


def merge_batch(history: History, tz: str = "UTC"):
    """The ``foreachBatch`` function: merge, rebuild dirty chats, record progress."""

    def run(batch: DataFrame, batch_id: int) -> None:
        _, changed, _ = sync.apply_messages(history, once_each(batch))
        written = sync.rebuild_dirty(history, tz)
        history.set_state(**{"stream:batch": batch_id, "stream:changed": changed, "stream:windows": written})

    return run


def start(history: History, landed: str, checkpoint: str, files_per_batch: int = 1000, tz: str = "UTC") -> DataStreamWriter:
    """A writer over the landed folder; add a trigger and start it."""
    rows = (
        history.spark.readStream.schema(schemas.MESSAGES)
        .option("maxFilesPerTrigger", files_per_batch)
        .parquet(landed)
    )
    return rows.writeStream.foreachBatch(merge_batch(history, tz)).option("checkpointLocation", checkpoint)


def progress(history: History) -> DataFrame:
    """Windows that are done of all windows: a count over tables, so it never goes back within a model."""
    from chatlake.operators import embed

    return embed.coverage(history.read("windows"), history.read("vectors"), embed.BagOfWords.model_id)

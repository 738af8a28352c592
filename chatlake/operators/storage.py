"""Attachment storage reports."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chatlake.operators.insights import first_members

TOP_CHATS = 20
TOP_CHAT_PEOPLE = 4

# Size choices in decimal bytes.
SIZE_BANDS = {"1 MB": 1_000_000, "10 MB": 10_000_000, "50 MB": 50_000_000, "100 MB": 100_000_000}


@dataclass(frozen=True)
class AttachmentFilter:
    kind: int | None = None
    min_bytes: int | None = None
    chat_id: int | None = None
    sort: str = "size"  # or "date"
    limit: int = 50
    offset: int = 0


def by_kind(attachments: DataFrame) -> DataFrame:
    """Count and bytes per kind, biggest first."""
    return (
        attachments.groupBy("kind")
        .agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes"))
        .orderBy(F.desc("bytes"))
    )


def totals(attachments: DataFrame) -> DataFrame:
    return attachments.agg(
        F.count(F.lit(1)).alias("total_count"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("total_bytes")
    )


def per_message(attachments: DataFrame) -> DataFrame:
    """Attachment bytes summed per message before any join, so that the join moves one row per message."""
    return attachments.groupBy("message_id").agg(F.count(F.lit(1)).alias("n"), F.sum("bytes").alias("bytes"))


def by_chat(attachments: DataFrame, messages: DataFrame, chats: DataFrame, k: int = TOP_CHATS) -> DataFrame:
    """Chats holding the most attachment bytes; titles are joined after the cut."""
    owner = messages.filter(F.col("chat_id").isNotNull()).select("message_id", "chat_id")
    top = (
        per_message(attachments)
        .join(owner, "message_id")
        .groupBy("chat_id")
        .agg(F.sum("n").alias("n"), F.sum("bytes").alias("bytes"))
        .orderBy(F.desc("bytes"), "chat_id")
        .limit(k)
    )
    return top.join(chats.select("chat_id", "title"), "chat_id", "left").select(
        "chat_id", F.coalesce("title", F.lit("")).alias("title"), "n", "bytes"
    )


def with_people(top: DataFrame, members: DataFrame, handles: DataFrame, shown: int = TOP_CHAT_PEOPLE) -> DataFrame:
    """Add the labels of the first few people of each chat; only members of the chats at hand are read on."""
    inside = members.join(top.select("chat_id"), "chat_id", "left_semi")
    label = F.struct("place", F.coalesce("name", "address").alias("who"))
    people = first_members(inside, handles, shown).groupBy("chat_id").agg(F.array_sort(F.collect_list(label)).alias("_p"))
    return top.join(people, "chat_id", "left").select(top["*"], F.coalesce(F.col("_p.who"), F.array().cast("array<string>")).alias("people"))


def present_bytes(attachments: DataFrame, manifest: DataFrame) -> DataFrame:
    """Bytes whose file is listed in the manifest (a table with one ``path`` per present file)."""
    known = attachments.filter(F.col("path").isNotNull())
    return known.join(manifest.select("path"), "path", "left_semi").agg(
        F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes_on_disk")
    )


def _selected(attachments: DataFrame, messages: DataFrame, f: AttachmentFilter) -> DataFrame:
    if f.kind is not None:
        attachments = attachments.filter(F.col("kind") == f.kind)
    if f.min_bytes is not None:
        attachments = attachments.filter(F.col("bytes") >= f.min_bytes)
    if f.chat_id is not None:
        messages = messages.filter(F.col("chat_id") == f.chat_id)
    return attachments.join(messages.select("message_id", "chat_id", "handle_id", "from_me", "ts"), "message_id")


def listing(attachments: DataFrame, messages: DataFrame, f: AttachmentFilter) -> DataFrame:
    """One page of the matching attachments (top-k, no full sort)."""
    order = [F.desc("bytes"), F.desc("ts")] if f.sort == "size" else [F.desc("ts")]
    page = _selected(attachments, messages, f).orderBy(*order, F.desc("attachment_id"))
    return page.offset(max(f.offset, 0)).limit(max(f.limit, 1))


def listing_totals(attachments: DataFrame, messages: DataFrame, f: AttachmentFilter) -> DataFrame:
    """Count and bytes over everything the filter keeps, not just the page."""
    return totals(_selected(attachments, messages, f))


def enrich(
    page: DataFrame, chats: DataFrame, handles: DataFrame, removed: DataFrame, manifest: DataFrame
) -> DataFrame:
    """Title, sender (NULL when mine) and the on-disk / in-trash flags of listed rows."""
    present = manifest.select("path").distinct().withColumn("_present", F.lit(True))
    trashed = removed.join(manifest.withColumnRenamed("path", "new_path"), "new_path", "left_semi")
    trashed = trashed.select("attachment_id").distinct().withColumn("_trashed", F.lit(True))
    people = handles.select("handle_id", F.coalesce("name", "address").alias("_sender"))
    return (
        page.join(chats.select("chat_id", "title"), "chat_id", "left")
        .join(people, "handle_id", "left")
        .join(present, "path", "left")
        .join(trashed, "attachment_id", "left")
        .withColumn("title", F.coalesce("title", F.lit("")))
        .withColumn("sender", F.when(~F.col("from_me"), F.col("_sender")))
        .withColumn("on_disk", F.coalesce("_present", F.lit(False)))
        .withColumn("in_trash", F.coalesce("_trashed", F.lit(False)))
        .drop("_sender", "_present", "_trashed")
    )


def cleanup_plan(
    requested: DataFrame, attachments: DataFrame, removed: DataFrame, manifest: DataFrame
) -> DataFrame:
    """For each requested id: can it be moved, how many bytes, and why not otherwise."""
    known = attachments.select("attachment_id", "path", "bytes").withColumn("_known", F.lit(True))
    gone = removed.select("attachment_id").distinct().withColumn("_gone", F.lit(True))
    present = manifest.select("path").distinct().withColumn("_present", F.lit(True))
    reason = (
        F.when(F.col("_known").isNull(), "unknown id")
        .when(F.col("_gone").isNotNull(), "already removed")
        .when(F.col("_present").isNull(), "not present")
    )
    return (
        requested.select("attachment_id")
        .distinct()
        .join(known, "attachment_id", "left")
        .join(gone, "attachment_id", "left")
        .join(present, "path", "left")
        .select(
            "attachment_id",
            reason.alias("reason"),
            F.when(reason.isNull(), F.col("bytes")).otherwise(F.lit(0)).alias("bytes"),
        )
    )


def cleanup_outcome(plan: DataFrame) -> DataFrame:
    """Moved count, bytes and failures per reason in one row per outcome."""
    return plan.groupBy(F.coalesce("reason", F.lit("moved")).alias("outcome")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("bytes").alias("bytes")
    )


def size_bands(attachments: DataFrame) -> DataFrame:
    """Attachments at or over each size choice, in one pass."""
    bands = F.array(
        F.struct(F.lit("any").alias("band"), F.lit(0).cast("long").alias("floor")),
        *[
            F.struct(F.lit(name).alias("band"), F.lit(floor).cast("long").alias("floor"))
            for name, floor in SIZE_BANDS.items()
        ],
    )
    fits = F.filter(bands, lambda b: F.col("bytes") >= b["floor"])
    return (
        attachments.select("bytes", F.explode(fits).alias("b"))
        .groupBy("b.band")
        .agg(F.count(F.lit(1)).alias("n"), F.sum("bytes").alias("bytes"))
    )


def kind_shares(attachments: DataFrame) -> DataFrame:
    """Share of all bytes per kind that has any."""
    kinds = by_kind(attachments).filter("bytes > 0")
    total = F.greatest(F.sum("bytes").over(Window.partitionBy()), F.lit(1))  # five rows at most
    return kinds.select("kind", "bytes", (F.col("bytes") / total).alias("share"))


def look_up(ids: DataFrame, attachments: DataFrame) -> DataFrame:
    """Path, name and kind of each wanted attachment."""
    return ids.select("attachment_id").join(
        attachments.select("attachment_id", "path", "filename", "kind"), "attachment_id"
    )

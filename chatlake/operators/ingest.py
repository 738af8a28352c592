"""Incremental merge of source rows into the canonical tables: joins and aggregates, no row loops."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chatlake.functions import address, text

REPLACED = ["text", "chat_id", "kind", "edited", "unsent", "has_link", "attach_count"]
COMPARED = ["text", "chat_id", "edited", "unsent", "attach_count"]
BEGINNING = "1900-01-01 00:00:00"


# ------------------------------------------------------------------- people
def contact_names(contacts: DataFrame) -> DataFrame:
    """First contact per key; its name is the full name, else the nickname, else the organisation.

    ``contacts`` has ``address`` and ``position`` (its place in the address book) next to the
    name columns that exist.
    """
    columns = [c for c in ("full_name", "nickname", "organisation") if c in contacts.columns]
    name = F.coalesce(*[F.when(F.trim(c) != "", F.trim(c)) for c in columns])
    place = F.col("position") if "position" in contacts.columns else F.col("address")
    keyed = contacts.select(address.contact_key(F.col("address")).alias("contact_key"), name.alias("contact_name"), place.alias("_at"))
    return (
        keyed.filter("contact_key IS NOT NULL AND contact_name IS NOT NULL")
        .groupBy("contact_key")
        .agg(F.min_by("contact_name", "_at").alias("contact_name"))
    )


def resolve_contacts(handles: DataFrame, contacts: DataFrame) -> DataFrame:
    """Handles with the name of their contact; an unmatched handle keeps the name it has."""
    keyed = handles.withColumn("contact_key", address.contact_key(F.col("address")))
    joined = keyed.join(contact_names(contacts), "contact_key", "left")
    return joined.withColumn("name", F.coalesce("contact_name", "name")).drop("contact_name")


def upsert_handles(current: DataFrame, batch: DataFrame) -> DataFrame:
    """The new address wins; a known name is kept when the batch has none."""
    fresh = batch.select(
        "handle_id", F.col("address").alias("_address"), F.col("name").alias("_name"), F.lit(True).alias("_new")
    ).dropDuplicates(["handle_id"])
    merged = current.select("handle_id", "address", "name").join(fresh, "handle_id", "full_outer")
    where = F.when(F.col("_new"), F.col("_address")).otherwise(F.col("address"))
    return merged.select(
        "handle_id",
        where.alias("address"),
        F.coalesce("_name", "name").alias("name"),
        address.phone_digits(where).alias("digits"),
        address.contact_key(where).alias("contact_key"),
    )


def renamed_chats(before: DataFrame, after: DataFrame, members: DataFrame) -> DataFrame:
    """Chats whose people changed name: their titles and all their windows are out of date."""
    old = before.select("handle_id", F.col("name").alias("_old"))
    changed = after.join(old, "handle_id", "left").filter(~F.col("name").eqNullSafe(F.col("_old")))
    chats = members.join(changed.select("handle_id"), "handle_id", "left_semi").select("chat_id").distinct()
    return chats.withColumn("from_ts", F.lit(BEGINNING).cast("timestamp"))


# --------------------------------------------------------------------- chats
def upsert_chats(current: DataFrame, batch: DataFrame) -> DataFrame:
    """Attributes of the batch win; a blank group name becomes NULL."""
    cleaned = batch.withColumn("display_name", F.when(F.trim("display_name") != "", F.col("display_name")))
    kept = current.join(cleaned.select("chat_id"), "chat_id", "left_anti")
    return kept.unionByName(cleaned.select(current.columns))


def upsert_members(current: DataFrame, batch_chats: DataFrame, batch_members: DataFrame) -> DataFrame:
    """Membership of the chats in the batch is replaced as a whole."""
    kept = current.join(batch_chats.select("chat_id"), "chat_id", "left_anti")
    return kept.unionByName(batch_members.select("chat_id", "handle_id").distinct())


# ------------------------------------------------------------------ messages
def latest_per_source(batch: DataFrame, order: list[str] | None = None) -> DataFrame:
    """One row per source id (map-side combine; overlapping re-reads collapse here)."""
    by = F.struct(*(order or ["edited", "unsent", "ts"]))
    row = F.struct(*batch.columns)
    return batch.groupBy("source_id").agg(F.max_by(row, by).alias("r")).select("r.*")


def merge_messages(current: DataFrame, batch: DataFrame, order: list[str] | None = None) -> DataFrame:
    """Current rows and batch in one table with ``change`` in (insert, update, same, kept).

    Only a different text, chat, edit or unsend mark or attachment count is an update; an
    update keeps id, guid, sender, direction and time. ``touched_ts`` is the batch row's time.
    """
    trimmed = text.clean(F.col("text"))
    fresh = latest_per_source(batch, order).withColumns({"text": trimmed, "has_link": text.has_link(trimmed)})
    columns = [c for c in current.columns if c != "source_id"]
    left = current.select("source_id", *[F.col(c).alias(f"_{c}") for c in columns], F.lit(True).alias("_held"))
    right = fresh.select("source_id", *columns, F.lit(True).alias("_read"))
    both = left.join(right, "source_id", "full_outer")
    differs = F.lit(False)
    for c in COMPARED:
        differs = differs | ~F.col(c).eqNullSafe(F.col(f"_{c}"))
    change = (
        F.when(F.col("_held").isNull(), "insert")
        .when(F.col("_read").isNull(), "kept")
        .when(differs, "update")
        .otherwise("same")
    )
    both = both.withColumn("change", change)

    def pick(c: str) -> Column:
        if c in REPLACED:
            use_new = F.col("change").isin("insert", "update")
        else:
            use_new = F.col("change") == "insert"
        return F.when(use_new, F.col(c)).otherwise(F.col(f"_{c}")).alias(c)

    return both.select("source_id", *[pick(c) for c in columns], "change", F.col("ts").alias("touched_ts"))


def changed(merged: DataFrame) -> DataFrame:
    return merged.filter(F.col("change").isin("insert", "update"))


def touched_chats(merged: DataFrame) -> DataFrame:
    """Earliest changed time per chat."""
    return (
        changed(merged).filter("chat_id IS NOT NULL").groupBy("chat_id").agg(F.min("touched_ts").alias("from_ts"))
    )


def replace_attachments(current: DataFrame, batch: DataFrame, merged: DataFrame) -> DataFrame:
    """Attachments of changed messages are replaced; all others stay."""
    ids = changed(merged).select("message_id")
    kept = current.join(ids, "message_id", "left_anti")
    return kept.unionByName(batch.join(ids, "message_id", "left_semi").select(current.columns))


def merge_dirty(*lists: DataFrame) -> DataFrame:
    """Pending rebuilds with the earliest time per chat."""
    rows = lists[0].select("chat_id", "from_ts")
    for more in lists[1:]:
        rows = rows.unionByName(more.select("chat_id", "from_ts"))
    return rows.groupBy("chat_id").agg(F.min("from_ts").alias("from_ts"))


def deleted(current: DataFrame, seen: DataFrame) -> DataFrame:
    """Indexed messages that a full read of the source no longer has."""
    return current.join(seen.select("source_id"), "source_id", "left_anti")


def deleted_touched(gone: DataFrame) -> DataFrame:
    return gone.filter("chat_id IS NOT NULL").groupBy("chat_id").agg(F.min("ts").alias("from_ts"))


def read_bound(messages: DataFrame, last_ts: Column, last_source_id: Column) -> DataFrame:
    """From when to re-read: the newest time seen, or older when a late row has an older time.

    NULL bounds are ignored; both NULL means a full read.
    """
    late = messages.agg(F.min(F.when(F.col("source_id") > last_source_id, F.col("ts"))).alias("late"))
    return late.select(F.least(last_ts, F.coalesce(F.col("late"), last_ts)).alias("since"))


def next_cursor(messages: DataFrame, previous: Column, now: Column) -> DataFrame:
    """New cursor: the newest time, but never past now + 1 day; and the largest source id."""
    limit = now + F.expr("INTERVAL 1 DAY")
    return messages.agg(
        F.least(F.greatest(F.max("ts"), previous), limit).alias("last_ts"), F.max("source_id").alias("last_source_id")
    )


def corpus_stats(
    messages: DataFrame, attachments: DataFrame, windows: DataFrame | None = None, vectors: DataFrame | None = None
) -> DataFrame:
    """Long table (metric, value): one small aggregate per table, times as unix milliseconds."""
    m = messages.groupBy("chat_id").agg(
        F.count(F.lit(1)).alias("n"), F.min("ts").alias("oldest"), F.max("ts").alias("newest")
    )
    m = m.agg(
        F.sum("n").alias("messages"),
        F.count("chat_id").alias("chats"),
        F.unix_millis(F.min("oldest")).alias("oldest"),
        F.unix_millis(F.max("newest")).alias("newest"),
    )

    def long(df: DataFrame) -> DataFrame:
        pairs = [F.struct(F.lit(c).alias("metric"), F.col(c).cast("long").alias("value")) for c in df.columns]
        return df.select(F.inline(F.array(*pairs)))

    out = long(m).unionByName(long(attachments.agg(F.count(F.lit(1)).alias("attachments"))))
    if windows is not None:
        marked = windows.join(vectors.select("window_id", F.lit(1).alias("_done")).dropDuplicates(["window_id"]), "window_id", "left")
        out = out.unionByName(
            long(marked.agg(F.count(F.lit(1)).alias("windows"), F.count("_done").alias("embedded_windows")))
        )
    return out

"""Full and incremental sync of a history with its source, and the rebuild of what changed."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chatlake.operators import chats, embed, ingest, reactions, windows
from chatlake.plans import stored
from chatlake.session import durable
from chatlake.sources import raw as raw_source
from chatlake.sources.tables import History


@dataclass(frozen=True)
class Report:
    read: int
    changed: int
    touched_chats: int
    deleted: int
    windows_written: int


def _instant(micros: int | str) -> Column:
    return F.timestamp_micros(F.lit(int(micros)))


def sync_people(history: History, raw: raw_source.Raw, contacts: DataFrame | None = None) -> DataFrame:
    """Merge handles, chats and members; returns the chats whose people changed name."""
    before = history.read("handles")
    merged = ingest.upsert_handles(before, raw_source.handles(raw))
    if contacts is not None:
        merged = ingest.resolve_contacts(merged, contacts)
    merged = durable(merged)
    held = history.read("chats").select("chat_id", "identifier", "display_name", "service")
    batch = raw_source.chats(raw)
    all_chats = ingest.upsert_chats(held, batch)
    all_members = durable(ingest.upsert_members(history.read("members"), batch, raw_source.members(raw)))
    renamed = durable(ingest.renamed_chats(before, merged, all_members))
    titled = durable(chats.titles(all_chats, all_members, merged))
    history.replace("handles", merged)
    history.replace("members", all_members)
    history.replace("chats", titled)
    return renamed


def apply_messages(
    history: History,
    batch: DataFrame,
    attachments: DataFrame | None = None,
    reaction_log: DataFrame | None = None,
    full: bool = False,
) -> tuple[DataFrame, int, int]:
    """Merge a batch; returns touched chats, changed rows and deleted rows.

    Incremental batches read and rewrite only the partitions they fall into. The list of chats
    to rebuild is stored before anything else is, so that an interrupted run is made good later;
    the keyword index gets its batch before the messages are written (see ``plans.stored``).
    """
    stored.settle(history)
    batch = durable(batch)
    parts = [] if full else history.parts_of("messages", batch)
    current = history.read("messages") if full else history.read_parts("messages", parts)
    merged = durable(ingest.merge_messages(current, batch))
    touched = ingest.touched_chats(merged)
    n_deleted = 0
    rows = merged
    if full:
        gone = durable(ingest.deleted(merged, batch))
        n_deleted = gone.count()
        touched = ingest.merge_dirty(touched, ingest.deleted_touched(gone))
        rows = merged.join(gone.select("source_id"), "source_id", "left_anti")
    touched = durable(touched)
    by_change = {r["change"]: r["count"] for r in merged.groupBy("change").count().collect()}
    n_changed = by_change.get("insert", 0) + by_change.get("update", 0)
    if not touched.isEmpty():
        history.replace("dirty", ingest.merge_dirty(history.read("dirty"), touched))
    if n_changed or n_deleted:
        before = current.limit(0)  # the index takes texts back only of messages that change or go
        if n_deleted or by_change.get("update"):
            going = merged.filter("change = 'update'").select("message_id")
            going = going.unionByName(gone.select("message_id")) if full else going
            before = current.join(going, "message_id", "left_semi")
        index_batch = stored.begin(history, before, ingest.changed(rows))
        if full:
            history.replace("messages", rows)
        else:
            history.merge_parts("messages", rows, parts)
        stored.commit(history, index_batch)
    if attachments is not None and (n_changed or n_deleted):
        fresh = durable(attachments.join(ingest.changed(merged).select("message_id"), "message_id", "left_semi"))
        if full:
            held = history.read("attachments").join(rows.select("message_id"), "message_id", "left_semi")
            history.replace("attachments", durable(ingest.replace_attachments(held, fresh, merged)))
        else:
            parts = history.parts_of("attachments", ingest.changed(merged).select("message_id"))
            held = history.read_parts("attachments", parts)
            history.merge_parts("attachments", ingest.replace_attachments(held, fresh, merged), parts)
    if reaction_log is not None and not reaction_log.isEmpty():
        log = durable(reaction_log)
        parts = history.parts_of("reactions", log)
        history.merge_parts("reactions", reactions.merge(history.read_parts("reactions", parts), log), parts)
    return touched, n_changed, n_deleted


def rebuild_dirty(history: History, tz: str = "UTC", gap_minutes: int = windows.GAP_MINUTES) -> int:
    """Rebuild the windows of all dirty chats from their cut on; returns windows written."""
    dirty = durable(history.read("dirty"))
    if dirty.isEmpty():
        return 0
    parts = history.parts_of("windows", dirty)
    held = durable(history.read_parts("windows", parts))
    cut = durable(windows.dirty_cut(dirty, held, gap_minutes))
    earliest = cut.agg(F.unix_micros(F.min("cut_ts")).alias("t")).first()["t"]
    recent = history.read("messages").filter(F.col("ts") >= _instant(earliest))
    theirs = recent.join(cut.select("chat_id"), "chat_id", "left_semi")
    rows = windows.to_rebuild(windows.lines(theirs, history.read("handles")), cut)
    built = windows.build(windows.assign(rows, gap_minutes), history.read("chats"), tz)
    built = durable(
        built.withColumn("window_id", windows.window_id(F.col("chat_id"), F.col("start_ts"), F.col("text_hash")))
    )
    kept = held.join(cut, "chat_id", "left").filter("cut_ts IS NULL OR start_ts < cut_ts").drop("cut_ts")
    history.merge_parts("windows", kept.unionByName(built.select(kept.columns)), parts)
    history.replace("dirty", dirty.limit(0))
    return built.count()


def embed_windows(history: History, model=None) -> None:
    """Append vectors of the windows that have none of the current model."""
    history.append("vectors", embed.embed_pending(history.read("windows"), history.read("vectors"), model))


def sync(
    history: History,
    raw: raw_source.Raw,
    full: bool = False,
    contacts: DataFrame | None = None,
    tz: str = "UTC",
    now: Column | None = None,
) -> Report:
    """One sync run: people, messages, deletions (full only), windows, cursor."""
    renamed = sync_people(history, raw, contacts)
    if not renamed.isEmpty():
        history.replace("dirty", ingest.merge_dirty(history.read("dirty"), renamed))
    last_ts, last_id = history.state("last_ts"), history.state("last_source_id")
    bound = None
    if not full and last_ts is not None:
        since = ingest.read_bound(raw_source.times_of(raw), _instant(last_ts), F.lit(int(last_id)))
        bound = _instant(since.select(F.unix_micros("since").alias("t")).first()["t"])
    batch = durable(raw_source.messages(raw, bound))
    touched, changed, deleted = apply_messages(
        history, batch, raw_source.attachments(raw), raw_source.reactions(raw, bound), full
    )
    written = rebuild_dirty(history, tz)
    seen = ingest.next_cursor(raw_source.times_of(raw), _instant(last_ts or 0), F.now() if now is None else now)
    cursor = seen.select(F.unix_micros("last_ts").alias("t"), "last_source_id").first()
    history.set_state(last_ts=cursor["t"], last_source_id=cursor["last_source_id"])
    return Report(batch.count(), changed, touched.count(), deleted, written)


def apply_contacts_file(history: History, path: str, tz: str = "UTC") -> int:
    """Names from a contacts file; the chats they rename are rebuilt. Returns how many chats."""
    before = durable(history.read("handles"))
    merged = durable(ingest.resolve_contacts(before, raw_source.contacts(history.spark, path)))
    members = history.read("members")
    renamed = durable(ingest.renamed_chats(before, merged, members))
    held = durable(history.read("chats"))
    titled = chats.titles(held.select("chat_id", "identifier", "display_name", "service"), members, merged)
    history.replace("handles", merged)
    history.replace("chats", titled)
    history.replace("dirty", ingest.merge_dirty(history.read("dirty"), renamed))
    rebuild_dirty(history, tz)
    return renamed.count()



"""Conversation views: chat lists, context, pages, transcripts, links, galleries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chatlake.functions import kinds, text
from chatlake.plans.ordered import Ordered, top_per_group

SEPARATOR_MINUTES = 60
RUN_MINUTES = 15


def chat_list(chats: DataFrame, messages: DataFrame, limit: int = 50, offset: int = 0) -> DataFrame:
    """Non-empty chats, newest first, with the text of their newest text message. One aggregate, then top-k."""
    newest = F.max_by(
        F.when(F.col("kind") == kinds.TEXT, F.col("text")),
        F.when(F.col("kind") == kinds.TEXT, F.struct("ts", "message_id")),
    )
    stats = messages.filter("chat_id IS NOT NULL").groupBy("chat_id").agg(
        F.max("ts").alias("last_ts"), F.count(F.lit(1)).alias("message_count"), newest.alias("last_text")
    )
    page = stats.orderBy(F.desc("last_ts"), "chat_id").offset(offset).limit(limit)
    return page.join(chats.select("chat_id", "title", "is_group"), "chat_id")


def with_participants(page: DataFrame, members: DataFrame, handles: DataFrame) -> DataFrame:
    """Nested people of the chats of one page (a page is short, so the small side is broadcast)."""
    theirs = members.join(F.broadcast(page.select("chat_id")), "chat_id", "left_semi")
    people = theirs.join(handles, "handle_id").groupBy("chat_id").agg(
        F.sort_array(
            F.collect_list(
                F.struct(
                    F.col("name").isNull().alias("nameless"), F.col("name"), F.col("address"), F.col("handle_id")
                )
            )
        ).alias("participants")
    )
    return page.join(people, "chat_id", "left")


def context(
    anchors: DataFrame, messages: DataFrame, before: int, after: int, target_rows: int | None = None
) -> DataFrame:
    """For every anchor the ``before`` and ``after`` messages around it in its chat.

    Messages are numbered once per chat; neighbours are then an equality join on
    (chat, number), a key that no two messages share.
    """
    place = anchors.select(F.col("message_id").alias("anchor_id")).distinct()
    at = place.join(messages, place.anchor_id == messages.message_id).select("anchor_id", "chat_id")
    relevant = messages.join(at.select("chat_id").distinct(), "chat_id", "left_semi")
    numbered = Ordered(relevant, ["chat_id"], ["ts", "message_id"], target_rows).row_number().drop("_slice")
    centre = place.join(
        numbered.select(F.col("message_id").alias("anchor_id"), "chat_id", F.col("rn").alias("_rn")), "anchor_id"
    )
    wanted = centre.select(
        "anchor_id", "chat_id", "_rn", F.explode(F.sequence(F.col("_rn") - before, F.col("_rn") + after)).alias("rn")
    )
    return wanted.join(numbered, ["chat_id", "rn"]).withColumn("offset", F.col("rn") - F.col("_rn")).drop("rn", "_rn")


def keyset_page(
    cursors: DataFrame, messages: DataFrame, limit: int, target_rows: int | None = None
) -> DataFrame:
    """For every cursor (cursor_id, chat_id, ts, message_id, newer) the next ``limit`` messages strictly past it.

    Cursors are sorted in between the messages and counted along; the count turns each cursor
    into a range of row numbers, again an equality join.
    """
    relevant = messages.join(cursors.select("chat_id").distinct(), "chat_id", "left_semi")
    side = F.when(F.col("newer"), 1).otherwise(-1)
    marks = cursors.select("chat_id", "ts", "message_id", side.alias("_side"), "cursor_id", F.lit(0).alias("_one"))
    rows = relevant.select(
        "chat_id", "ts", "message_id", F.lit(0).alias("_side"), F.lit(None).cast("long").alias("cursor_id"),
        F.lit(1).alias("_one"),
    )
    ordered = Ordered(rows.unionByName(marks), ["chat_id"], ["ts", "message_id", "_side", "cursor_id"], target_rows)
    counted = ordered.running_sum(ordered.df, "_one", "rn")
    numbered = counted.filter("_one = 1").select("chat_id", "rn", "message_id", "ts")
    edge = F.col("rn")
    span = F.when(F.col("_side") > 0, F.sequence(edge + 1, edge + limit)).otherwise(
        F.sequence(edge - limit + 1, edge)
    )
    wanted = counted.filter("_one = 0").select("cursor_id", "chat_id", F.explode(span).alias("rn"))
    return wanted.join(numbered, ["chat_id", "rn"])


def latest(messages: DataFrame, limit: int) -> DataFrame:
    """The newest ``limit`` messages of every chat."""
    return top_per_group(messages, ["chat_id"], [F.desc("ts"), F.desc("message_id")], limit, "place")


def message_views(page: DataFrame, attachments: DataFrame, reactions: DataFrame, handles: DataFrame) -> DataFrame:
    """Messages of a page with sender, attachments (by id) and reactions (by time) nested."""
    wanted = page.select("message_id", "guid")
    files = (
        attachments.join(wanted, "message_id", "left_semi")
        .groupBy("message_id")
        .agg(F.sort_array(F.collect_list(F.struct("attachment_id", "filename", "bytes", "kind"))).alias("attachments"))
    )
    names = handles.select("handle_id", F.coalesce("name", "address").alias("_who"))
    received = F.when(~F.col("from_me"), F.col("_who"))
    marks = (
        reactions.join(wanted, reactions.target_guid == wanted.guid, "left_semi")
        .join(names, "handle_id", "left")
        .groupBy(F.col("target_guid").alias("guid"))
        .agg(
            F.sort_array(
                F.collect_list(F.struct("ts", "reaction_id", "emoji", "from_me", received.alias("sender"), "part"))
            ).alias("reactions")
        )
    )
    return (
        page.join(names, "handle_id", "left")
        .withColumn("sender", received)
        .drop("_who")
        .join(files, "message_id", "left")
        .join(marks, "guid", "left")
        .withColumns(
            {"attachments": F.coalesce("attachments", F.array()), "reactions": F.coalesce("reactions", F.array())}
        )
    )


def message_items(attachments: DataFrame, reactions: DataFrame, messages: DataFrame, target_rows: int | None = None) -> DataFrame:
    """Attachments and reactions of all messages as rows with their place: the flat form of the nested view.

    For whole tables, where one message may own any number of items.
    """
    files = attachments.select(
        "message_id", F.lit("attachment").alias("item"), F.lit(0).cast("long").alias("_at"),
        F.col("attachment_id").cast("string").alias("_key"), F.col("filename").alias("label"),
    )
    marks = reactions.join(messages.select("message_id", F.col("guid").alias("target_guid")), "target_guid").select(
        "message_id", F.lit("reaction").alias("item"), F.unix_micros("ts").alias("_at"),
        F.col("reaction_id").cast("string").alias("_key"), F.col("emoji").alias("label"),
    )
    ordered = Ordered(files.unionByName(marks), ["message_id", "item"], ["_at", "_key"], target_rows)
    return ordered.row_number(name="place").select("message_id", "item", "place", "label")


def transcript_runs(messages: DataFrame, groups: DataFrame | None = None, target_rows: int | None = None) -> DataFrame:
    """Layout facts of each message: time separator, run with the neighbours, name and tail."""
    ordered = Ordered(messages, ["chat_id"], ["ts", "message_id"], target_rows)
    rows = ordered.neighbours(["ts", "from_me", "handle_id", "kind", "unsent"])

    def minutes(a, b):
        return (F.unix_micros(b) - F.unix_micros(a)) / 60_000_000

    def bubble(prefix=""):
        return (F.col(f"{prefix}kind") != kinds.SYSTEM) & ~F.col(f"{prefix}unsent")

    def same_sender(other):
        return (
            bubble() & bubble(f"{other}.") & (F.col("from_me") == F.col(f"{other}.from_me"))
            & F.col("handle_id").eqNullSafe(F.col(f"{other}.handle_id"))
        )

    show_time = F.col("prev").isNull() | (minutes("prev.ts", "ts") > SEPARATOR_MINUTES)
    with_prev = F.coalesce(~show_time & same_sender("prev") & (minutes("prev.ts", "ts") < RUN_MINUTES), F.lit(False))
    with_next = F.coalesce(same_sender("next") & (minutes("ts", "next.ts") < RUN_MINUTES), F.lit(False))
    if groups is None:
        in_group = F.lit(True)
    else:
        rows = rows.join(groups.select("chat_id", "is_group"), "chat_id", "left")
        in_group = F.coalesce("is_group", F.lit(False))
    received = in_group & ~F.col("from_me") & bubble()
    return rows.select(
        "chat_id",
        "message_id",
        show_time.alias("show_time"),
        with_prev.alias("with_previous"),
        (received & ~with_prev).alias("show_name"),
        (~with_next).alias("tail"),
    )


def replies(messages: DataFrame) -> DataFrame:
    """Replied-to message of every reply; ``resolved`` is false when it is absent."""
    target = messages.select(F.col("guid").alias("reply_to"), F.col("message_id").alias("target_id"), F.col("text").alias("target_text"))
    return (
        messages.filter("reply_to IS NOT NULL")
        .select("message_id", "reply_to")
        .join(target, "reply_to", "left")
        .withColumn("resolved", F.col("target_id").isNotNull())
    )


def links(rows: DataFrame, key: str, body: str) -> DataFrame:
    """Every link span of a text column with its target, host and path."""
    spans = rows.select(key, F.posexplode(text.link_spans(F.col(body))).alias("place", "span"))
    href = text.link_href(F.col("span"))
    return spans.select(
        key, F.col("place").cast("long").alias("place"), "span", text.link_host(href).alias("host"), text.link_path(href).alias("rest")
    )


def link_only(body):
    return F.coalesce(body.rlike(text.LINK_ONLY), F.lit(False))


def gallery(attachments: DataFrame, messages: DataFrame) -> DataFrame:
    """Images, videos and stickers with their chat and time, for ordering inside a chat."""
    shown = attachments.filter(F.col("kind").isin(kinds.IMAGE, kinds.VIDEO, kinds.STICKER))
    return shown.join(messages.select("message_id", "chat_id", "ts"), "message_id").select(
        "chat_id", "ts", "message_id", "attachment_id", "kind", "filename"
    )

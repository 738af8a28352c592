"""Raw source tables to canonical rows: one pass of native expressions per table."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chatlake import schemas
from chatlake.functions import address, kinds, text, times

# Codes and identifiers of the source.
URL_PREVIEW = "com.apple.messages.URLBalloonProvider"
PLAIN_TYPES = (0, 2, 3)
SHARED_ACTIVITY_ITEM = 6


@dataclass(frozen=True)
class Raw:
    """The seven source tables."""

    handle: DataFrame
    chat: DataFrame
    chat_handle_join: DataFrame
    message: DataFrame
    chat_message_join: DataFrame
    attachment: DataFrame
    message_attachment_join: DataFrame


def read(spark: SparkSession, path: str, fmt: str = "parquet") -> Raw:
    """Landed tables in any file format Spark reads, one folder each, with fixed schemas."""
    return Raw(**{n: spark.read.schema(s).format(fmt).load(f"{path}/{n}") for n, s in schemas.RAW.items()})


def read_jdbc(spark: SparkSession, url: str, **options: str) -> Raw:
    """The same tables over JDBC; give partitionColumn and bounds in ``options`` for parallel reads."""
    reader = spark.read.format("jdbc").option("url", url).options(**options)
    return Raw(**{name: reader.option("dbtable", name).load() for name in schemas.RAW})


def split_valid(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows that can be decoded, and a quarantine with the reason. Casts are tried, never fatal."""
    checked = rows.withColumns(
        {
            "rowid": F.col("rowid").try_cast("long"),
            "date": F.col("date").try_cast("long"),
            "_reason": F.when(F.col("rowid").try_cast("long").isNull(), "no id")
            .when(F.col("guid").isNull(), "no guid")
            .when(F.col("date").try_cast("long").isNull(), "bad date"),
        }
    )
    good = checked.filter("_reason IS NULL").drop("_reason")
    return good, checked.filter("_reason IS NOT NULL").withColumnRenamed("_reason", "reason")


def handles(raw: Raw) -> DataFrame:
    h = raw.handle
    return h.select(
        h.rowid.alias("handle_id"),
        h.id.alias("address"),
        F.lit(None).cast("string").alias("name"),
        address.phone_digits(h.id).alias("digits"),
        address.contact_key(h.id).alias("contact_key"),
    )


def chats(raw: Raw) -> DataFrame:
    """Chats with a blank group name as NULL; membership stays a relation of its own."""
    c = raw.chat
    return c.select(
        c.rowid.alias("chat_id"),
        c.chat_identifier.alias("identifier"),
        F.when(F.trim(c.display_name) != "", c.display_name).alias("display_name"),
        c.service_name.alias("service"),
    )


def members(raw: Raw) -> DataFrame:
    return raw.chat_handle_join.select("chat_id", "handle_id").distinct()


def _is_reaction(kind: Column) -> Column:
    return kind.between(2000, 2999) | kind.between(3000, 3999) | (kind == 1000)


def since(rows: DataFrame, bound: Column | None) -> DataFrame:
    """Rows on or after ``bound`` less one day of slack for time zones, as a plain range on ``date``."""
    if bound is None:
        return rows
    start = F.date_sub(F.to_date(bound), 1).cast("timestamp")
    return rows.filter(F.col("date") >= (F.unix_micros(start) - times.SOURCE_EPOCH_MICROS) * 1000)


def times_of(raw: Raw) -> DataFrame:
    """Source id and time of every row: the two columns that cursors need."""
    return raw.message.select(F.col("rowid").alias("source_id"), times.from_source_nanos("date").alias("ts"))


def messages(raw: Raw, bound: Column | None = None) -> DataFrame:
    """Canonical messages: classified, cleaned, inside a chat, without reactions.

    Attachment counts come from one aggregate of the link table.
    """
    good, _ = split_valid(since(raw.message, bound))
    code = F.coalesce("associated_message_type", F.lit(0))
    app = (
        ~code.isin(*PLAIN_TYPES)
        | (F.col("balloon_bundle_id").isNotNull() & (F.col("balloon_bundle_id") != URL_PREVIEW))
        | (F.col("item_type") == SHARED_ACTIVITY_ITEM)
    )
    announcement = F.col("group_title").isNotNull() | (
        (F.coalesce("item_type", F.lit(0)) != 0) & (F.col("item_type") != SHARED_ACTIVITY_ITEM)
    )
    unsent = F.coalesce("date_retracted", F.lit(0)) > 0
    body = F.when(announcement, F.col("group_title")).when(~unsent, text.clean(F.col("text")))
    rows = good.filter(~_is_reaction(code)).select(
        F.col("rowid").alias("message_id"),
        F.col("rowid").alias("source_id"),
        "guid",
        F.nullif("handle_id", F.lit(0)).alias("handle_id"),
        (F.coalesce("is_from_me", F.lit(0)) == 1).alias("from_me"),
        times.from_source_nanos("date").alias("ts"),
        body.alias("text"),
        F.when(announcement, kinds.SYSTEM).when(app, kinds.APP).otherwise(kinds.TEXT).alias("kind"),
        "service",
        F.col("thread_originator_guid").alias("reply_to"),
        (F.coalesce("date_edited", F.lit(0)) > 0).alias("edited"),
        unsent.alias("unsent"),
        text.has_link(body).alias("has_link"),
    )
    chat = raw.chat_message_join.groupBy("message_id").agg(F.min("chat_id").alias("chat_id"))
    counts = attachments(raw).groupBy("message_id").agg(F.count(F.lit(1)).alias("attach_count"))
    placed = rows.join(chat, "message_id").join(counts, "message_id", "left")
    return placed.withColumn("attach_count", F.coalesce("attach_count", F.lit(0))).select(
        *[f.split()[0] for f in schemas.MESSAGES.split(", ")]
    )


def reactions(raw: Raw, bound: Column | None = None) -> DataFrame:
    """Reactions and removals; sticker reactions and custom ones without an emoji are dropped."""
    good, _ = split_valid(since(raw.message, bound))
    rows = good.filter(_is_reaction(F.col("associated_message_type")))
    code = F.col("associated_message_type")
    removed = code >= 3000
    base = F.when(removed, code - kinds.REMOVAL_OFFSET).otherwise(code)
    known = F.create_map(*[F.lit(x) for pair in kinds.REACTIONS.items() for x in pair])
    emoji = F.when(base == kinds.CUSTOM_REACTION, F.col("associated_message_emoji")).otherwise(F.try_element_at(known, base))
    target = F.regexp_extract("associated_message_guid", r"^(?:p:(\d+)/|bp:)?(.+)$", 2)
    part = F.regexp_extract("associated_message_guid", r"^p:(\d+)/", 1)
    return rows.select(
        F.col("rowid").alias("reaction_id"),
        F.nullif(target, F.lit("")).alias("target_guid"),
        F.when(part != "", part.cast("long")).otherwise(F.lit(0).cast("long")).alias("part"),
        F.nullif("handle_id", F.lit(0)).alias("handle_id"),
        (F.coalesce("is_from_me", F.lit(0)) == 1).alias("from_me"),
        emoji.alias("emoji"),
        removed.alias("removed"),
        times.from_source_nanos("date").alias("ts"),
    ).filter("target_guid IS NOT NULL AND emoji IS NOT NULL")


def attachments(raw: Raw) -> DataFrame:
    """Files of messages without the hidden ones; the name is the transfer name, else the path's."""
    a = raw.attachment.filter(F.coalesce("hide_attachment", F.lit(0)) == 0)
    name = F.coalesce("transfer_name", F.substring_index("filename", "/", -1))
    return a.join(raw.message_attachment_join, a.rowid == F.col("attachment_id")).select(
        "attachment_id",
        "message_id",
        name.alias("filename"),
        F.col("mime_type").alias("mime"),
        F.col("filename").alias("path"),
        F.coalesce("total_bytes", F.lit(0)).alias("bytes"),
        kinds.attachment_kind(F.col("mime_type"), name, F.col("is_sticker") == 1).cast("int").alias("kind"),
    )


def contacts(spark: SparkSession, path: str) -> DataFrame:
    """A JSON file with a ``contacts`` object of address -> name, as contact rows."""
    rows = spark.read.schema("contacts map<string,string>").option("multiLine", True).json(path)
    return rows.select(F.explode("contacts").alias("address", "full_name"))

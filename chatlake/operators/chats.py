"""Chats: group rule, titles, membership, statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chatlake.operators.insights import first_members

TITLE_PEOPLE = 3


def member_counts(members: DataFrame) -> DataFrame:
    return members.groupBy("chat_id").agg(F.count_distinct("handle_id").alias("n_people"))


def is_group(identifier: Column, n_people: Column) -> Column:
    return (F.coalesce(n_people, F.lit(0)) > 1) | identifier.startswith("chat")


def _title_part(who: Column, n_people: Column) -> Column:
    """First word of a name in a group; addresses stay whole."""
    shorten = (n_people > 1) & ~who.contains("@") & ~who.startswith("+")
    return F.when(shorten, F.regexp_extract(F.trim(who), r"^\S+", 0)).otherwise(who)


def titles(chats: DataFrame, members: DataFrame, handles: DataFrame) -> DataFrame:
    """Chats with ``title`` and ``is_group``.

    The title is the group name, else up to three people and how many more, else the
    identifier. Only three rows per chat are ever listed, however large the group.
    """
    known = members.join(handles.select("handle_id"), "handle_id", "left_semi")
    counts = known.groupBy("chat_id").agg(F.count(F.lit(1)).alias("_n"))
    shown = first_members(members, handles, TITLE_PEOPLE).join(counts, "chat_id")
    names = shown.groupBy("chat_id").agg(
        F.first("_n").alias("_n"),
        F.sort_array(
            F.collect_list(F.struct("place", _title_part(F.coalesce("name", "address"), F.col("_n")).alias("part")))
        ).alias("_parts"),
    )
    joined = F.array_join(F.col("_parts.part"), ", ")
    more = F.concat(joined, F.lit(" +"), (F.col("_n") - TITLE_PEOPLE).cast("string"))
    named = F.nullif(F.trim("display_name"), F.lit("")).isNotNull()
    title = (
        F.when(named, F.col("display_name"))
        .when(F.col("_n").isNull(), F.col("identifier"))
        .when(F.col("_n") > TITLE_PEOPLE, more)
        .otherwise(joined)
    )
    return chats.join(names, "chat_id", "left").select(
        *chats.columns, title.alias("title"), is_group(F.col("identifier"), F.col("_n")).alias("is_group")
    )


def statistics(messages: DataFrame) -> DataFrame:
    """Last time and message count per chat over all kinds."""
    return messages.filter(F.col("chat_id").isNotNull()).groupBy("chat_id").agg(
        F.max("ts").alias("last_ts"), F.count(F.lit(1)).alias("message_count")
    )


def subtitles(chats: DataFrame, members: DataFrame, handles: DataFrame) -> DataFrame:
    """Line under the title: member names of a group, the address of a named person otherwise.

    Meant for a page of chats, since a group's line names all its members.
    """
    from chatlake.functions.text import short_name

    people = members.join(chats.select("chat_id"), "chat_id", "left_semi").join(handles, "handle_id")
    listed = people.groupBy("chat_id").agg(
        F.sort_array(
            F.collect_list(
                F.struct(
                    F.col("name").isNull().alias("nameless"),
                    F.coalesce("name", F.lit("")).alias("name"),
                    F.col("address"),
                )
            )
        ).alias("_p")
    )
    who = F.transform("_p", lambda p: F.when(p["nameless"], p["address"]).otherwise(short_name(p["name"])))
    n = F.size("_p")
    group = F.when(n <= 1, F.array_join(who, "")).otherwise(
        F.concat(F.array_join(F.slice(who, F.lit(1), n - 1), ", "), F.lit(" & "), F.element_at(who, -1))
    )
    first = F.get("_p", F.lit(0))
    single = F.when(~first["nameless"], first["address"]).otherwise(F.lit(""))
    return chats.join(listed, "chat_id", "left").select(
        "chat_id", F.when(F.col("is_group"), F.coalesce(group, F.lit(""))).otherwise(F.coalesce(single, F.lit(""))).alias("subtitle")
    )

"""Activity statistics.

Everything derives from one pre-aggregate per (chat, local day, hour): it is the only
shuffle over messages, with map-side combine, and a hot chat is spread over its days.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chatlake.functions import kinds, times
from chatlake.plans.ordered import top_per_group

TOP_PEOPLE = 20
TOP_GROUPS = 10
GROUP_PEOPLE = 4
WEEKS_SHOWN = 52


def in_scope(messages: DataFrame, year: int | None, tz: str) -> DataFrame:
    """Rows of one local calendar year as a plain range on ``ts`` (prunes partitions), or all rows."""
    if year is None:
        return messages
    start, end = (times.midnight(F.make_date(F.lit(y), F.lit(1), F.lit(1)), tz) for y in (year, year + 1))
    return messages.filter((F.col("ts") >= start) & (F.col("ts") < end))


def activity(messages: DataFrame, year: int | None = None, tz: str = "UTC") -> DataFrame:
    """Message counts per (chat, local day, hour) over text rows, with first and last time."""
    rows = in_scope(messages.filter(F.col("kind") == kinds.TEXT), year, tz)
    when = times.local(F.col("ts"), tz)
    return rows.groupBy("chat_id", F.to_date(when).alias("day"), F.hour(when).alias("hour")).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if("from_me").alias("sent"),
        F.min("ts").alias("first_ts"),
        F.max("ts").alias("last_ts"),
    )


def years(messages: DataFrame, tz: str = "UTC") -> DataFrame:
    """Every year from the first to the last text message, gaps included."""
    bounds = messages.filter(F.col("kind") == kinds.TEXT).agg(F.min("ts").alias("a"), F.max("ts").alias("b"))
    span = F.sequence(F.year(times.local(F.col("a"), tz)), F.year(times.local(F.col("b"), tz)))
    return bounds.filter("a IS NOT NULL").select(F.explode(span).alias("year")).select(F.col("year").cast("long"))


def days(act: DataFrame) -> DataFrame:
    return act.groupBy("day").agg(F.sum("n").alias("n"))


def _dense(counts: DataFrame, key: str, size: int) -> DataFrame:
    spark = counts.sparkSession
    slots = spark.range(size).select(F.col("id").alias(key))
    return slots.join(F.broadcast(counts), key, "left").select(key, F.coalesce("n", F.lit(0)).alias("n"))


def hours(act: DataFrame) -> DataFrame:
    """24 rows, empty hours included."""
    counts = act.groupBy(F.col("hour").cast("long").alias("hour")).agg(F.sum("n").alias("n"))
    return _dense(counts, "hour", 24)


def weekdays(act: DataFrame) -> DataFrame:
    """7 rows, Sunday = 0."""
    weekday = (F.dayofweek("day") - 1).cast("long").alias("weekday")
    return _dense(act.groupBy(weekday).agg(F.sum("n").alias("n")), "weekday", 7)


def per_chat(act: DataFrame) -> DataFrame:
    return act.filter("chat_id IS NOT NULL").groupBy("chat_id").agg(
        F.sum("sent").alias("sent"),
        (F.sum("n") - F.sum("sent")).alias("received"),
        F.sum("n").alias("total"),
    )


def totals(act: DataFrame) -> DataFrame:
    """One row; the distinct count runs over the already small per-chat rows."""
    chats = act.groupBy("chat_id").agg(
        F.sum("n").alias("n"),
        F.sum("sent").alias("sent"),
        F.min("first_ts").alias("first_ts"),
        F.max("last_ts").alias("last_ts"),
    )
    return chats.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("total"),
        F.coalesce(F.sum("sent"), F.lit(0)).alias("sent"),
        (F.coalesce(F.sum("n"), F.lit(0)) - F.coalesce(F.sum("sent"), F.lit(0))).alias("received"),
        F.count("chat_id").alias("chats"),
        F.min("first_ts").alias("first_ts"),
        F.max("last_ts").alias("last_ts"),
    )


def runs(day_counts: DataFrame) -> DataFrame:
    """Runs of consecutive days (gaps and islands) over one row per day: small by nature."""
    numbered = day_counts.select(
        "day", F.date_sub("day", F.row_number().over(Window.orderBy("day"))).alias("island")
    )
    return numbered.groupBy("island").agg(F.count(F.lit(1)).alias("length"), F.max("day").alias("last_day"))


def streaks(day_counts: DataFrame, today: Column) -> DataFrame:
    """Longest run, and the run that ends today or yesterday (else 0)."""
    current = F.when(
        F.max("last_day").isin(today) | (F.max("last_day") == F.date_sub(today, 1)),
        F.max_by("length", "last_day"),
    ).otherwise(F.lit(0))
    return runs(day_counts).agg(
        F.coalesce(F.max("length"), F.lit(0)).alias("longest"), F.coalesce(current, F.lit(0)).alias("current")
    )


def busiest_day(day_counts: DataFrame) -> DataFrame:
    """Day with the most messages, the earliest on ties."""
    key = F.struct(F.col("n"), -F.unix_date("day"))
    return day_counts.agg(F.max_by("day", key).alias("day"), F.max("n").alias("n"))


def _people(members: DataFrame, handles: DataFrame) -> DataFrame:
    return members.join(handles.select("handle_id", "address", "name"), "handle_id")


def _person_order() -> list[Column]:
    """Named people first, then by name and address."""
    return [F.col("name").isNull(), F.col("name"), F.col("address")]


def first_members(members: DataFrame, handles: DataFrame, k: int) -> DataFrame:
    """The first ``k`` people of each chat: k rows per chat and task before the shuffle."""
    return top_per_group(_people(members, handles), ["chat_id"], [*_person_order(), F.col("handle_id")], k, "place")


def top_people(
    chat_totals: DataFrame, chats: DataFrame, members: DataFrame, handles: DataFrame, k: int = TOP_PEOPLE
) -> DataFrame:
    """People by messages in 1:1 chats; all chats of one named person are merged."""
    single = chat_totals.join(chats.filter("NOT is_group").select("chat_id"), "chat_id")
    partner = _people(members, handles).groupBy("chat_id").agg(
        F.min_by(F.struct("name", "address"), F.struct(*_person_order())).alias("p")
    )
    nameless = F.when(F.col("p.name").isNull(), F.col("chat_id"))
    return (
        single.join(partner, "chat_id")
        .groupBy(F.col("p.name").alias("name"), nameless.alias("nameless"))
        .agg(
            F.max_by("chat_id", F.struct("total", -F.col("chat_id"))).alias("chat_id"),
            F.sum("sent").alias("sent"),
            F.sum("received").alias("received"),
            F.sum("total").alias("total"),
        )
        .orderBy(F.desc("total"), "chat_id")
        .limit(k)
        .drop("nameless")
    )


def top_groups(
    chat_totals: DataFrame, chats: DataFrame, members: DataFrame, handles: DataFrame, k: int = TOP_GROUPS
) -> DataFrame:
    """Group chats by messages, each with its first people. People are looked up for the k chats only."""
    top = (
        chat_totals.join(chats.filter("is_group").select("chat_id", "title"), "chat_id")
        .orderBy(F.desc("total"), "chat_id")
        .limit(k)
    )
    theirs = members.join(F.broadcast(top.select("chat_id")), "chat_id", "left_semi")
    named = first_members(theirs, handles, GROUP_PEOPLE).groupBy("chat_id").agg(
        F.sort_array(F.collect_list(F.struct("place", F.coalesce("name", "address").alias("who")))).alias("_p")
    )
    return top.join(named, "chat_id", "left").select(
        "chat_id", "title", "total", F.array_join(F.col("_p.who"), ", ").alias("people")
    )


def attachment_totals(messages: DataFrame, attachments: DataFrame, year: int | None = None, tz: str = "UTC") -> DataFrame:
    """Attachments in range, whatever the kind of their message."""
    rows = in_scope(messages, year, tz).select("message_id")
    return attachments.join(rows, "message_id", "left_semi").agg(
        F.count(F.lit(1)).alias("attachments"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes")
    )


def heat_levels(day_counts: DataFrame) -> DataFrame:
    """Level 0-4 of each day from the quartiles of the non-zero days."""
    by_count = Window.orderBy("n", "day")
    ranked = day_counts.filter("n > 0").select(
        "*",
        (F.row_number().over(by_count) - 1).alias("_i"),
        F.count(F.lit(1)).over(Window.partitionBy()).alias("_size"),
    )

    def cut(p: float) -> Column:
        at = F.least(F.col("_size") - 1, F.floor(F.lit(p) * F.col("_size")))
        return F.max(F.when(F.col("_i") == at, F.col("n"))).over(Window.partitionBy())

    level = F.when(F.col("n") <= cut(0.25), 1).when(F.col("n") <= cut(0.5), 2).when(F.col("n") <= cut(0.75), 3)
    return ranked.select("day", "n", level.otherwise(4).cast("long").alias("level"))


def calendar_grid(day_counts: DataFrame, year: int | None = None) -> DataFrame:
    """Cells of the year, or of the 53 weeks up to the last day, with week and weekday; empty days are 0."""
    last = day_counts.agg(F.max("day").alias("last"))
    if year is not None:
        start, end = (F.make_date(F.lit(year), F.lit(m), F.lit(d)) for m, d in ((1, 1), (12, 31)))
        bounds = last.select(start.alias("start"), end.alias("end"))
    else:
        back = F.lit(7 * WEEKS_SHOWN) + F.dayofweek("last") - 1
        bounds = last.select(F.date_sub("last", back.cast("int")).alias("start"), F.col("last").alias("end"))
    first = F.date_sub("start", F.dayofweek("start") - 1)
    until = F.date_add("end", 7 - F.dayofweek("end"))
    cells = bounds.filter("start IS NOT NULL").select(
        "start", "end", first.alias("first"), F.explode(F.sequence(first, until)).alias("day")
    )
    return cells.join(heat_levels(day_counts), "day", "left").select(
        "day",
        F.floor(F.datediff("day", "first") / 7).cast("long").alias("week"),
        (F.dayofweek("day") - 1).cast("long").alias("weekday"),
        F.coalesce("n", F.lit(0)).alias("n"),
        F.coalesce("level", F.lit(0).cast("long")).alias("level"),
        (~F.col("day").between(F.col("start"), F.col("end"))).alias("outside"),
    )


def insights(
    messages: DataFrame,
    attachments: DataFrame,
    chats: DataFrame,
    members: DataFrame,
    handles: DataFrame,
    today: Column,
    year: int | None = None,
    tz: str = "UTC",
) -> dict[str, DataFrame]:
    """Every metric by name, over one shared activity table."""
    act = activity(messages, year, tz)
    day_counts = days(act)
    chat_totals = per_chat(act)
    return {
        "years": years(messages, tz),
        "days": day_counts,
        "hours": hours(act),
        "weekdays": weekdays(act),
        "totals": totals(act),
        "per_chat": chat_totals,
        "streaks": streaks(day_counts, today),
        "busiest_day": busiest_day(day_counts),
        "top_people": top_people(chat_totals, chats, members, handles),
        "top_groups": top_groups(chat_totals, chats, members, handles),
        "attachments": attachment_totals(messages, attachments, year, tz),
        "calendar": calendar_grid(day_counts, year),
    }

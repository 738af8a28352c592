"""Structured search filters: resolve people and chats, then keep candidate messages."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chatlake.functions import address, kinds
from chatlake.plans.ordered import top_per_group
from chatlake.session import durable, spread

MIN_DIGITS = 4
LONGEST = 32
"""Letters of a needle that are looked up; the rest of longer ones is tested."""
FEW_NEEDLES = 50_000
"""Needles that are broadcast."""
HAS_KINDS = {"photo": kinds.IMAGE, "video": kinds.VIDEO, "audio": kinds.AUDIO, "file": kinds.FILE}


def _pieces(value: Column, size: Column) -> Column:
    spots = F.when(F.length(value) >= size, F.sequence(F.lit(1), F.length(value) - size + 1)).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(F.transform(spots, lambda i: F.substring(value, i, size)))


def contains_join(needles: DataFrame, rows: DataFrame, few: int = FEW_NEEDLES) -> DataFrame:
    """Triples (space, value, key), repeats included, where a ``field`` of ``rows`` contains a ``needle`` of the same space.

    A needle is one of the field's pieces of its own length, so the two meet by equality and no pair is tested. Fields are
    cut only into pieces of lengths that needles of the space have. Lengths with few needles, ``few`` together, are looked
    up where the pieces are made; only pieces of the other lengths are shuffled, as short rows. Of needles longer than
    LONGEST letters the beginning is looked up, and the whole is then tested.
    """
    beginning = F.substring("needle", 1, LONGEST)
    asked = durable(needles.filter("needle <> ''").select("space", "value", "needle", beginning.alias("piece"), F.least(F.length("needle"), F.lit(LONGEST)).alias("size")))
    sizes = asked.groupBy("space", "size").agg(F.count(F.lit(1)).alias("n")).orderBy("n", "space", "size").collect()  # LONGEST a space
    total, inside, shuffled = 0, [], []
    for r in sizes:
        total += r["n"]
        (inside if total <= few else shuffled).append((r["space"], r["size"]))
    fields = rows.filter("field IS NOT NULL").select("space", "key", "field")

    def meet(chosen: list[tuple[str, int]], here: bool) -> DataFrame:
        wanted = F.array(*[F.struct(F.lit(space).alias("space"), F.lit(size).alias("size")) for space, size in chosen])
        own = F.filter(wanted, lambda c: c["space"] == F.col("space"))
        cut = F.flatten(F.transform(own, lambda c: F.transform(_pieces(F.col("field"), c["size"]), lambda p: F.struct(c["size"].alias("size"), p.alias("piece")))))
        # only needles of LONGEST letters may go on in the field, so shorter pieces leave it behind
        rest = F.when(F.col("_c.size") == LONGEST, F.col("field")).alias("field")
        pieces = fields.select("space", "key", "field", F.explode(cut).alias("_c")).select("space", "key", F.col("_c.size").alias("size"), F.col("_c.piece").alias("piece"), rest)
        kinds_of = F.struct("space", "size").isin(*[F.struct(F.lit(space).alias("space"), F.lit(size).alias("size")) for space, size in chosen])
        side = asked.filter(kinds_of)
        # cut fields are much larger than the plan supposes: they are never the side to broadcast
        met = pieces.join(F.broadcast(side) if here else side.hint("merge"), ["space", "size", "piece"])
        return met.filter(F.col("field").isNull() | F.col("field").contains(F.col("needle"))).select("space", "value", "key")

    found = [meet(chosen, here) for chosen, here in ((inside, True), (shuffled, False)) if chosen]
    if not found:
        return fields.join(asked.limit(0), "space").select("space", "value", "key")
    return reduce(DataFrame.unionByName, found)


def _needles(values: DataFrame) -> DataFrame:
    """Each value with what is looked for: itself in texts, its digits (four or more) in digit forms."""
    needle = F.lower(F.trim("value"))
    digits = address.digits_of(needle)
    looked = F.array(
        F.struct(F.lit("person").alias("space"), needle.alias("needle")),
        F.struct(F.lit("chat").alias("space"), needle.alias("needle")),
        F.struct(F.lit("digits").alias("space"), F.when(F.length(digits) >= MIN_DIGITS, digits).alias("needle")),
    )
    return values.distinct().select("value", F.inline(looked)).filter("needle IS NOT NULL")


def match_names(values: DataFrame, handles: DataFrame, chats: DataFrame | None = None) -> DataFrame:
    """(space, value, key): people by name, address or digits, and chats by title or group name, in one look-up."""
    fields = F.array(
        F.struct(F.lit("person").alias("space"), F.lower("name").alias("field")),
        F.struct(F.lit("person").alias("space"), F.lower("address").alias("field")),
        F.struct(F.lit("digits").alias("space"), F.col("digits").alias("field")),
    )
    rows = spread(handles).select(F.col("handle_id").alias("key"), F.inline(fields))
    if chats is not None:
        titles = F.array(
            F.struct(F.lit("chat").alias("space"), F.lower("title").alias("field")),
            F.struct(F.lit("chat").alias("space"), F.lower("display_name").alias("field")),
        )
        rows = rows.unionByName(spread(chats).select(F.col("chat_id").alias("key"), F.inline(titles)))
    found = contains_join(_needles(values), rows)
    kind = F.when(F.col("space") == "chat", "chat").otherwise("person")
    return found.select(kind.alias("space"), "value", "key").distinct()


def people_of(names: DataFrame) -> DataFrame:
    return names.filter("space = 'person'").select("value", F.col("key").alias("handle_id"))


def chats_of(names: DataFrame, members: DataFrame) -> DataFrame:
    """Chats by their own name, or with a matched person among their members."""
    titled = names.filter("space = 'chat'").select("value", F.col("key").alias("chat_id"))
    # people found are more than the plan supposes, and many values may find the same
    by_people = people_of(names).hint("merge").join(members, "handle_id").select("value", "chat_id")
    return titled.unionByName(by_people).distinct()


def match_people(values: DataFrame, handles: DataFrame) -> DataFrame:
    """(value, handle_id): name or address contains the value, or its digits are in the digit form."""
    return people_of(match_names(values, handles))


def match_chats(values: DataFrame, handles: DataFrame, chats: DataFrame, members: DataFrame) -> DataFrame:
    """(value, chat_id): title or group name contains the value, or a matched person is a member."""
    return chats_of(durable(match_names(values, handles, chats)), members)


@dataclass(frozen=True)
class Resolved:
    """Filters of a query table with people and chats looked up."""

    people: DataFrame  # (query_id, handle_id)
    chats: DataFrame  # (query_id, chat_id)
    flags: DataFrame  # one row per query that can have results


def resolve(parsed: DataFrame, handles: DataFrame, chats: DataFrame, members: DataFrame) -> Resolved:
    """Several people widen, several chats narrow; a value that matches nothing empties the query.

    The look-ups are small next to the messages and read by every list of a search, so they are
    written once.
    """
    spark = parsed.sparkSession
    me = F.lower(F.trim("value")) == "me"
    wanted = parsed.select(
        "query_id", F.inline(F.concat(
            F.transform("from_vals", lambda x: F.struct(F.lit("person").alias("space"), x.alias("value"))),
            F.transform("chat_vals", lambda x: F.struct(F.lit("chat").alias("space"), x.alias("value"))),
        ))
    ).filter((F.col("space") == "chat") | ~me).distinct()
    if wanted.isEmpty():
        return Resolved(
            spark.createDataFrame([], "query_id long, handle_id long"),
            spark.createDataFrame([], "query_id long, chat_id long"),
            _flags(parsed),
        )
    names = durable(match_names(wanted.select("value"), handles, chats))
    keys = people_of(names).select(F.lit("person").alias("space"), "value", F.col("handle_id").alias("key")).unionByName(
        chats_of(names, members).select(F.lit("chat").alias("space"), "value", F.col("chat_id").alias("key"))
    )
    found = durable(wanted.join(keys, ["space", "value"]))
    people = found.filter("space = 'person'").select("query_id", F.col("key").alias("handle_id")).distinct()
    n_values = wanted.filter("space = 'chat'").groupBy("query_id").agg(F.count(F.lit(1)).alias("_wanted"))
    shared = found.filter("space = 'chat'").groupBy("query_id", "key").agg(F.count(F.lit(1)).alias("_n"))
    kept_chats = shared.join(n_values, "query_id").filter("_n = _wanted").select("query_id", F.col("key").alias("chat_id"))
    unmatched = wanted.join(found, ["query_id", "space", "value"], "left_anti").select("query_id")
    no_chat = n_values.join(kept_chats, "query_id", "left_anti").select("query_id")
    hopeless = unmatched.unionByName(no_chat)
    return Resolved(people, durable(kept_chats), durable(_flags(parsed.join(hopeless, "query_id", "left_anti"))))


def _flags(parsed: DataFrame) -> DataFrame:
    return parsed.select(
        "query_id",
        (F.size("from_vals") > 0).alias("has_from"),
        F.exists("from_vals", lambda v: F.lower(F.trim(v)) == "me").alias("from_me_too"),
        (F.size("chat_vals") > 0).alias("has_chat"),
        "has",
        "after_ts",
        "before_ts",
    )


def attachment_flags(attachments: DataFrame) -> DataFrame:
    """Kinds present per message as a bit mask: one combinable aggregate."""
    return attachments.groupBy("message_id").agg(
        F.bit_or(F.expr("shiftleft(1, cast(kind as int))")).alias("kind_mask")
    )


def with_flags(messages: DataFrame, attachments: DataFrame) -> DataFrame:
    """Messages with the kinds of their attachments, for ``has:`` filters."""
    joined = messages.join(attachment_flags(attachments), "message_id", "left")
    return joined.withColumn("kind_mask", F.coalesce("kind_mask", F.lit(0)))


def _has_condition() -> Column:
    ok = ~F.array_contains("has", "link") | F.col("has_link")
    ok = ok & (~F.array_contains("has", "attachment") | (F.col("kind_mask") > 0))
    for word, kind in HAS_KINDS.items():
        ok = ok & (~F.array_contains("has", word) | (F.col("kind_mask").bitwiseAND(1 << kind) > 0))
    return ok


def _in_dates() -> Column:
    after = F.col("after_ts").isNull() | (F.col("ts") >= F.col("after_ts"))
    return after & (F.col("before_ts").isNull() | (F.col("ts") < F.col("before_ts")))


def keep(candidates: DataFrame, resolved: Resolved) -> DataFrame:
    """Candidates (query_id, message_id and message columns) that pass every filter of their query."""
    rows = candidates.join(resolved.flags, "query_id")
    rows = rows.filter(_in_dates() & _has_condition())
    rows = rows.join(
        resolved.people.withColumn("_person", F.lit(True)), ["query_id", "handle_id"], "left"
    ).join(resolved.chats.withColumn("_chat", F.lit(True)), ["query_id", "chat_id"], "left")
    sender = (F.col("from_me_too") & F.col("from_me")) | (F.col("_person").isNotNull() & ~F.col("from_me"))
    rows = rows.filter((~F.col("has_from") | sender) & (~F.col("has_chat") | F.col("_chat").isNotNull()))
    return rows.select(*candidates.columns)


def matching(asked: DataFrame, resolved: Resolved, messages: DataFrame) -> DataFrame:
    """(query_id, message columns) of all text messages that pass the filters of the queries ``asked(query_id)``.

    Chats, people and own messages are found by equality joins. Queries for kinds only meet the few different
    combinations of flags that messages have, and messages are found by their combination.
    """
    rows = messages.filter((F.col("kind") == kinds.TEXT) & ~F.col("unsent"))
    columns = ["query_id", *rows.columns]
    flags = resolved.flags.join(asked.select("query_id"), "query_id", "left_semi")
    by_chat = flags.filter("has_chat").select("query_id").join(resolved.chats, "query_id").join(rows, "chat_id")
    by_person = flags.filter("has_from AND NOT has_chat").select("query_id").join(resolved.people, "query_id").join(rows, "handle_id")
    own = flags.filter("from_me_too AND NOT has_chat").select("query_id", F.lit(True).alias("from_me")).join(rows, "from_me")
    combination = ["has_link", "kind_mask"]
    kinds_only = flags.filter("NOT has_chat AND NOT has_from").select("query_id", "has")
    found = [by_chat, by_person, own]
    if "kind_mask" in rows.columns:
        held = rows.select(*combination).distinct()  # two flags and a mask of five bits
        wanted = kinds_only.join(F.broadcast(held), _has_condition()).select("query_id", *combination)
        found.append(wanted.join(rows, combination))
    all_ = found[0].select(*columns)
    for more in found[1:]:
        all_ = all_.unionByName(more.select(*columns))
    return keep(all_, resolved).dropDuplicates(["query_id", "message_id"])


def _newest(rows: DataFrame, limit: int) -> DataFrame:
    return top_per_group(rows, ["query_id"], [F.desc("ts"), F.desc("message_id")], max(limit, 1))


def filter_only(parsed: DataFrame, resolved: Resolved, messages: DataFrame, limit: int) -> DataFrame:
    """Newest matching text messages of queries that have filters but no text.

    Queries with a chat or a person start from those rows by an equality join. The others have
    only dates, ``from:me`` and ``has:``; for them a calendar of how many messages each day
    holds per combination of those flags (small, whatever the history) tells which days hold
    the newest ``limit`` matches, and only those days are read.
    """
    from chatlake.operators.querytable import has_filters, has_text

    asked = parsed.filter(~has_text() & has_filters()).select("query_id").join(resolved.flags, "query_id")
    rows = messages.filter(F.col("kind") == kinds.TEXT)
    columns = ["query_id", *rows.columns]

    chat_queries = asked.filter("has_chat").select("query_id").join(resolved.chats, "query_id")
    by_chat = chat_queries.join(rows, "chat_id").select(*columns)
    person_queries = asked.filter("NOT has_chat AND NOT from_me_too AND has_from").select("query_id")
    by_person = person_queries.join(resolved.people, "query_id").join(rows, "handle_id").select(*columns)
    direct = _newest(keep(by_chat.unionByName(by_person), resolved), limit)

    open_queries = asked.filter("NOT has_chat AND (from_me_too OR NOT has_from)")
    flagged = rows.withColumn("day", F.to_date("ts"))
    cell = ["day", "from_me", "has_link", "kind_mask"]
    calendar = flagged.groupBy(*cell).agg(F.count(F.lit(1)).alias("n"))
    span = calendar.agg(F.min("day").alias("lo"), F.max("day").alias("hi"))
    first = F.greatest(F.to_date("after_ts"), span.select("lo").scalar())
    last = F.least(F.to_date("before_ts"), span.select("hi").scalar())
    dated = open_queries.withColumns({"_from": first, "_to": last}).filter("_from <= _to")
    days = dated.select("*", F.explode(F.sequence("_from", "_to")).alias("day"))
    # Messages of ``from:`` people come on top of one's own, so only a sure lower bound is counted:
    # whole days inside the date bounds, own messages where a sender is asked for.
    start, end = F.col("day").cast("timestamp"), F.date_add("day", 1).cast("timestamp")
    whole = (F.coalesce("after_ts", start) <= start) & (F.coalesce("before_ts", end) >= end)
    sure = whole & _has_condition() & (~F.col("has_from") | F.col("from_me"))
    per_day = days.join(calendar, "day").groupBy("query_id", "day").agg(
        F.sum(F.when(sure, F.col("n")).otherwise(0)).alias("_n")
    )
    newer = Window.partitionBy("query_id").orderBy(F.desc("day")).rowsBetween(Window.unboundedPreceding, -1)
    needed = per_day.withColumn("_newer", F.coalesce(F.sum("_n").over(newer), F.lit(0))).filter(F.col("_newer") < limit)
    by_day = needed.select("query_id", "day").join(flagged, "day").select(*columns)
    return direct.unionByName(_newest(keep(by_day, resolved), limit))

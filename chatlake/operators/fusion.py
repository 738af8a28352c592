"""Fusion of ranked lists, hits with their snippet, grouping by conversation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chatlake.operators.insights import first_members
from chatlake.plans.ordered import top_per_group

RRF_K = 60.0
HIT_PEOPLE = 4
SNIPPET_CHARS = 180
SNIPPET_LEAD = 40
PREVIEW = 3
MARK_ON, MARK_OFF = "\u0002", "\u0003"


def depth(limit: int, open_lists: int = 1) -> int:
    """How far down lists have to be read for the best ``limit`` when the ranks of all entries of the other, wholly read
    lists are known: the threshold of the unread rest.

    An entry that is further down in ``open_lists`` lists, and in no other, has less than ``open_lists / (RRF_K + depth + 1)``;
    the best ``limit`` of one list all have at least ``1 / (RRF_K + limit)``. All-words and any-word lists share no message,
    so for them one list counts.
    """
    return max(limit, open_lists * (int(RRF_K) + limit) - int(RRF_K) - 1)


def fuse(lists: dict[str, DataFrame], limit: int) -> DataFrame:
    """Reciprocal rank fusion of lists named ``strict``, ``relaxed`` and ``meaning``.

    Exact if the lists hold their first ``depth(limit)`` entries and all entries of the meaning list, with ranks in the whole
    lists. Adds the origin of each match. Ties go to the larger (newer) id.
    """
    named = [
        df.select("query_id", "message_id", "rank", F.lit(name == "meaning").alias("_m")) for name, df in lists.items()
    ]
    rows = reduce(DataFrame.unionByName, named)
    fused = rows.groupBy("query_id", "message_id").agg(
        F.round(F.sum(1.0 / (RRF_K + F.col("rank"))), 12).alias("score"),
        F.bool_or("_m").alias("meaning"),
        F.bool_or(~F.col("_m")).alias("keyword"),
    )
    origin = F.when(F.col("keyword") & F.col("meaning"), "both").when(F.col("meaning"), "meaning").otherwise("keyword")
    top = top_per_group(fused, ["query_id"], [F.desc("score"), F.desc("message_id")], max(limit, 1))
    return top.select("query_id", "message_id", "rank", "score", origin.alias("matched_by"))


def _pattern() -> Column:
    longest_first = F.array_sort(
        F.filter("marks", lambda w: w != ""), lambda a, b: F.length(b) - F.length(a)
    )
    return F.when(
        F.size("marks") > 0, F.concat(F.lit(r"(?iu)(?<![\p{L}\p{N}])("), F.array_join(longest_first, "|"), F.lit(")"))
    )


def add_snippets(hits: DataFrame, max_chars: int = SNIPPET_CHARS) -> DataFrame:
    """Add ``snippet`` to rows with ``text``, ``attach_count`` and ``marks``.

    Up to ``max_chars`` characters from about forty before the first marked word, cut at a word
    start, with ellipses, marked words wrapped. Runs on final hits only.
    """
    shown = F.coalesce("text", F.when(F.col("attach_count") > 0, F.lit("Attachment")).otherwise(F.lit("")))
    rows = hits.withColumns({"_t": shown, "_p": F.coalesce(_pattern(), F.lit("(?!)()"))})
    lead = F.call_function("regexp_extract", F.col("_t"), F.concat(F.lit("(?s)^(.*?)"), F.col("_p")), F.lit(1))
    rows = rows.withColumn("_first", F.length(lead)).withColumn("_n", F.length("_t"))
    at_least = F.greatest(F.col("_first") - SNIPPET_LEAD, F.lit(0))
    rows = rows.withColumn("_s", F.when(F.col("_n") <= max_chars, 0).otherwise(at_least))
    between = F.substring("_t", F.col("_s") + 1, F.col("_first") - F.col("_s"))
    skip = F.length(F.regexp_extract(between, r"(?sU)^(\S*\s)", 1))
    before = F.substring("_t", F.col("_s"), F.lit(1))
    start = (
        F.when(F.col("_s") == 0, 0)
        .when(before.rlike(r"(?U)\s"), F.col("_s"))
        .when(skip == 0, F.col("_first"))
        .otherwise(F.col("_s") + skip)
    )
    rows = rows.withColumn("_start", start)
    rest = F.substring("_t", F.col("_start") + 1, F.col("_n"))
    marked = F.regexp_replace(rest, F.col("_p"), F.lit(f"{MARK_ON}$1{MARK_OFF}"))
    rows = rows.withColumn("_m", marked)
    window = F.regexp_extract("_m", f"(?s)^(?:[{MARK_ON}{MARK_OFF}]*[^{MARK_ON}{MARK_OFF}]){{0,{max_chars}}}", 0)
    rows = rows.withColumn("_w", window)
    open_mark = F.regexp_count("_w", F.lit(MARK_ON)) > F.regexp_count("_w", F.lit(MARK_OFF))
    snippet = F.concat(
        F.when(F.col("_start") > 0, "…").otherwise(""),
        F.col("_w"),
        F.when(open_mark, MARK_OFF).otherwise(""),
        F.when(F.col("_n") > F.col("_start") + max_chars, "…").otherwise(""),
    )
    return rows.withColumn("snippet", snippet).drop("_t", "_p", "_first", "_n", "_s", "_start", "_m", "_w")


def enrich(
    ranked: DataFrame,
    messages: DataFrame,
    chats: DataFrame,
    handles: DataFrame,
    members: DataFrame,
    highlights: DataFrame,
) -> DataFrame:
    """Full hits of ranked (query_id, message_id) rows; only these rows meet the wide tables."""
    wanted = ranked.select("message_id").distinct()
    rows = messages.join(wanted, "message_id", "left_semi").select(
        "message_id", "chat_id", "handle_id", "from_me", "ts", "text", "attach_count"
    )
    people = handles.select("handle_id", F.coalesce("name", "address").alias("_who"))
    shown = first_members(
        members.join(rows.select("chat_id").distinct(), "chat_id", "left_semi"), handles, HIT_PEOPLE
    )
    nested = shown.groupBy("chat_id").agg(
        F.sort_array(F.collect_list(F.struct("place", "handle_id", "address", "name"))).alias("people")
    )
    full = (
        ranked.join(rows, "message_id")
        .join(chats.select("chat_id", "title", "is_group"), "chat_id", "left")
        .join(people, "handle_id", "left")
        .join(nested, "chat_id", "left")
        .join(highlights, "query_id", "left")
    )
    return add_snippets(full).select(
        "query_id",
        "rank",
        "message_id",
        "chat_id",
        F.coalesce("title", F.lit("")).alias("chat_title"),
        F.coalesce("is_group", F.lit(False)).alias("is_group"),
        "from_me",
        F.when(~F.col("from_me"), F.col("_who")).alias("sender"),
        "ts",
        "snippet",
        "matched_by",
        F.col("attach_count").alias("attachment_count"),
        "score",
        "people",
    )


def group_hits(hits: DataFrame, preview: int = PREVIEW) -> DataFrame:
    """Hits by conversation in best-hit order, with the newest time and the first hits of each.

    A query has at most the search limit of hits, so its groups are small lists.
    """
    key = F.coalesce(F.concat(F.lit("c"), F.col("chat_id").cast("string")), F.concat(F.lit("m"), F.col("message_id").cast("string")))
    ids = F.sort_array(F.collect_list(F.struct("rank", "message_id")))
    return (
        hits.groupBy("query_id", key.alias("group_key"))
        .agg(
            F.min("rank").alias("best_rank"),
            F.max("ts").alias("latest_ts"),
            F.count(F.lit(1)).alias("n_hits"),
            F.slice(ids, 1, preview).alias("_p"),
        )
        .select("query_id", "group_key", "best_rank", "latest_ts", "n_hits", F.col("_p.message_id").alias("preview"))
    )


def result_counts(hits: DataFrame) -> DataFrame:
    """Conversations, messages and messages found by meaning alone, per query."""
    key = F.coalesce(F.concat(F.lit("c"), F.col("chat_id").cast("string")), F.concat(F.lit("m"), F.col("message_id").cast("string")))
    return hits.groupBy("query_id").agg(
        F.count_distinct(key).alias("conversations"),
        F.count(F.lit(1)).alias("messages"),
        F.count_if(F.col("matched_by") == "meaning").alias("by_meaning"),
    )

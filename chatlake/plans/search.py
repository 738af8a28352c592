"""Hybrid search of a query table: keyword lists and near windows, fused, filtered, enriched."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chatlake.functions import vectors as vector_functions
from chatlake.operators import embed, filters, fusion, keyword, nearest, querytable, scan, windows
from chatlake.session import durable, spread


@dataclass(frozen=True)
class Corpus:
    """The canonical tables of one history and its indexes."""

    messages: DataFrame  # with kind_mask (filters.with_flags)
    handles: DataFrame
    chats: DataFrame  # with title, is_group, display_name
    members: DataFrame
    index: keyword.Index | None  # None: no stored index, searches read the texts
    vectors: DataFrame | None = None  # window_id, start_ts, v, q
    message_windows: DataFrame | None = None  # window_id, message_id


def with_windows(corpus: Corpus, **caps) -> Corpus:
    """The corpus with windows of all its messages embedded by the native model."""
    assigned = durable(windows.assign(windows.lines(corpus.messages, corpus.handles), **caps))
    built = windows.build(assigned, corpus.chats).withColumn("window_id", F.col("first_id"))
    embedded = embed.bag_of_words(spread(built.select("window_id", "chat_id", "start_ts", "text")), "text")
    vectors = embedded.drop("text").withColumn("q", vector_functions.to_int8(F.col("v")))
    placed = windows.message_windows(assigned).withColumn("window_id", F.col("first_id"))
    return replace(corpus, vectors=durable(vectors), message_windows=placed)


@dataclass(frozen=True)
class Lists:
    """The ranked lists of a query table (strict, relaxed, meaning) and what they were made from."""

    lists: dict[str, DataFrame]
    parsed: DataFrame
    resolved: filters.Resolved


@dataclass(frozen=True)
class Results:
    ranked: DataFrame  # query_id, message_id, rank, score, matched_by
    semantic: bool
    parsed: DataFrame


def near_windows(parsed: DataFrame, corpus: Corpus, resolved: filters.Resolved, model, column: str, limit: int) -> DataFrame:
    """The nearest windows of every query that can have results; only vectors of the model, of windows that still have
    messages, take part."""
    asked = embed.embed_queries(parsed, model).join(resolved.flags.select("query_id"), "query_id", "left_semi")
    if column == "q":
        asked = asked.withColumn("q", vector_functions.to_int8(F.col("v")))
    vectors = corpus.vectors
    if "model_id" in vectors.columns:
        vectors = vectors.filter(F.col("model_id") == model.model_id)
    vectors = vectors.join(corpus.message_windows.select("window_id").distinct(), "window_id", "left_semi")
    bounds = nearest.search_bounds(parsed, max(nearest.NEIGHBOURS, limit))
    narrow = durable(parsed.filter(nearest.narrowed()).select("query_id"))
    near = durable(nearest.knn(asked.join(narrow, "query_id", "left_anti"), vectors, bounds, column=column))
    if not narrow.isEmpty():
        passing = filters.matching(narrow, resolved, corpus.messages).select("query_id", "message_id")
        allowed = passing.join(corpus.message_windows.select("window_id", "message_id"), "message_id").select("query_id", "window_id").distinct()
        among = nearest.knn_among(asked.join(narrow, "query_id", "left_semi"), vectors, allowed, bounds, column)
        near = near.unionByName(durable(among))
    return durable(nearest.cut(near, model.max_distance))


def ranked_lists(
    queries: DataFrame,
    corpus: Corpus,
    tz: str = "UTC",
    model=None,
    keyword_only: bool = False,
    column: str = "q",
    limit: int = 50,
    relax_below: int = keyword.RELAX_BELOW,
) -> Lists:
    """All ranked lists, as far as the best ``limit`` need them. ``column`` picks int8 (``q``) or full (``v``) vectors for
    the meaning list; ``relax_below`` is the number of all-words matches below which any-word matches are added.

    The messages of near windows are looked up in the keyword lists, so their ranks there are known however far
    down they are; of the rest of those lists the best ``limit`` suffice.
    """
    parsed = durable(querytable.parse(queries, tz))
    resolved = filters.resolve(parsed, corpus.handles, corpus.chats, corpus.members)
    semantic = corpus.vectors is not None and not keyword_only
    looked_up = None
    if semantic:
        near = near_windows(parsed, corpus, resolved, model or embed.BagOfWords(), column, limit)
        windows_of = corpus.message_windows.select("window_id", "message_id")
        looked_up = durable(near.join(windows_of, "window_id").select("query_id", "message_id").distinct())
    if corpus.index is None:
        found = scan.keyword_search(parsed, corpus.messages, resolved, fusion.depth(limit), relax_below, looked_up)
    else:
        found = keyword.keyword_search(parsed, corpus.index, corpus.messages, resolved, fusion.depth(limit), relax_below, looked_up)
    lists = {"strict": found.strict, "relaxed": found.relaxed}
    if not semantic:
        return Lists(lists, parsed, resolved)
    counts = found.strict.groupBy("query_id").agg(F.count(F.lit(1)).alias("_n"))  # where there is a second list, the first is whole
    after = found.relaxed.join(counts, "query_id", "left").select(
        "query_id", "message_id", (F.col("rank") + F.coalesce("_n", F.lit(0))).alias("rank")
    )
    ranks = found.strict.select("query_id", "message_id", "rank").unionByName(after)
    lists["meaning"] = nearest.anchors(near, corpus.message_windows, corpus.messages, parsed, resolved, ranks)
    return Lists(lists, parsed, resolved)


def rank(queries: DataFrame, corpus: Corpus, limit: int = 50, **options) -> Results:
    """Ranked messages of every query. Without vectors the result is keyword-only."""
    made = ranked_lists(queries, corpus, limit=limit, **options)
    fused = fusion.fuse(made.lists, limit)
    silent = made.parsed.filter(~querytable.has_text() & querytable.has_filters())
    if not silent.isEmpty():
        listed = filters.filter_only(made.parsed, made.resolved, corpus.messages, limit).select(
            "query_id", "message_id", "rank", F.lit(0.0).alias("score"), F.lit("filter").alias("matched_by")
        )
        fused = fused.unionByName(listed)
    return Results(fused, "meaning" in made.lists, made.parsed)


def search(queries: DataFrame, corpus: Corpus, limit: int = 50, **options) -> DataFrame:
    """Hits of every query: ranked rows with chat, sender, people and snippet."""
    results = rank(queries, corpus, limit, **options)
    marks = querytable.highlight_words(results.parsed)
    return fusion.enrich(results.ranked, corpus.messages, corpus.chats, corpus.handles, corpus.members, marks)

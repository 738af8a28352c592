"""Keyword search over a term index kept as ordinary tables.

``postings`` has one row per (term, message) with the term's count, its positions and the
message's length, all worked out inside the message's row. A search never pairs queries with
messages: distinct search terms are expanded against the vocabulary, joined to the postings
by term, and shared by all queries that use them. Hot terms are split by AQE's skew join.

The best of each query are found by score bounds. Messages lie in blocks of ``BLOCK_IDS`` ids; of every search term and
block the largest weight is known, so a query's score in a block is bounded by their weighted sum, times the recency of
the block's newest message. The most promising blocks are scored first; blocks whose bound is below the worst score
that still counts are left before their occurrences are joined. Nothing is lost: where fewer than the asked number
match, every block is scored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chatlake.functions import kinds, splitting, text
from chatlake.operators import filters, querytable
from chatlake.plans.ordered import Ordered, top_per_group
from chatlake.session import durable, spread

K1, B = 1.2, 0.75
MIN_IDF = 1e-6
RELAX_BELOW = 20
RECENCY_FLOOR = 0.75
RECENCY_DAYS = 730.0
DAY_MICROS = 86_400_000_000
BLOCK_IDS = 128
FIRST_BLOCKS = 16
ROUNDING = 1e-8
FEW_PLACES = 200_000
ROWS_AT_ONCE = 256
"""Messages whose tokens a task groups at once."""


@dataclass(frozen=True)
class Index:
    postings: DataFrame  # term, message_id, tf, length, positions
    vocabulary: DataFrame  # term, df, stem (its first two letters)
    stats: DataFrame  # one row: n, avg_length


def build_postings(messages: DataFrame) -> DataFrame:
    """One row per term and message, without a shuffle: Arrow tasks split texts and group the tokens of each row."""
    rows = messages.select(F.col("message_id").cast("long").alias("message_id"), *splitting.columns(F.col("text")))
    return rows.mapInArrow(_grouped_tokens, _POSTINGS)


_POSTINGS = "term string, message_id long, tf int, length int, positions array<int>"


def _grouped_tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS_AT_ONCE):
            part, tokens, lengths = splitting.words(batch.slice(at, ROWS_AT_ONCE))
            if not len(tokens):
                continue
            words = tokens.cast(pa.string()).dictionary_encode()
            row = np.repeat(np.arange(len(lengths)), lengths)
            place = np.arange(len(row)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
            key = row * len(words.dictionary) + words.indices.to_numpy().astype(np.int64)
            order = np.argsort(key, kind="stable")  # places of a term stay in order
            key = key[order]
            first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
            ends = np.r_[first, len(key)].astype(np.int32)
            whose, word = np.divmod(key[first], len(words.dictionary))
            yield pa.RecordBatch.from_arrays(
                [
                    words.dictionary.take(pa.array(word)), part.column(0).take(pa.array(whose)), pa.array(np.diff(ends)),
                    pa.array(lengths[whose].astype(np.int32)), pa.ListArray.from_arrays(pa.array(ends), pa.array(place[order].astype(np.int32))),
                ],
                names=["term", "message_id", "tf", "length", "positions"],
            )


def build_vocabulary(postings: DataFrame) -> DataFrame:
    """Distinct terms, with the stem that turns prefix matching into an equality join."""
    terms = postings.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    return terms.withColumn("stem", F.substring("term", 1, 2))


def build_stats(messages: DataFrame) -> DataFrame:
    """Rows of any kind, with or without text, and their mean number of tokens."""
    length = F.coalesce(F.size(text.tokens(F.col("text"))), F.lit(0))
    return messages.agg(F.count(F.lit(1)).alias("n"), (F.sum(length) / F.nullif(F.count(F.lit(1)), F.lit(0))).alias("avg_length"))


def build_index(messages: DataFrame) -> Index:
    """Terms of all rows, whatever their kind, since corpus statistics count them all.

    The tables are written once to the checkpoint folder; a search reads them several times.
    """
    postings = durable(build_postings(spread(messages.select("message_id", "text"))))
    lengths = postings.groupBy("message_id").agg(F.first("length").alias("length")).agg(F.sum("length")).scalar()
    n = messages.agg(F.count(F.lit(1)).alias("n"))
    stats = n.select("n", (F.coalesce(lengths, F.lit(0)) / F.nullif(F.col("n"), F.lit(0))).alias("avg_length"))
    return Index(postings, durable(build_vocabulary(postings)), durable(stats))


def _expand(atoms: DataFrame, index: Index) -> DataFrame:
    """Index terms of every one-token atom: itself, or all words it begins."""
    single = atoms.filter("mode <> 'phrase'").select("atom", "mode", F.get("tokens", F.lit(0)).alias("token"))
    prefixes = single.filter("mode = 'prefix'").withColumn("stem", F.substring("token", 1, 2))
    words = prefixes.join(index.vocabulary, "stem").filter(F.col("term").startswith(F.col("token")))
    exact = single.filter("mode = 'exact'").select("atom", F.col("token").alias("term"))
    return words.select("atom", "term").unionByName(exact)


def phrase_hits(atoms: DataFrame, index: Index, few: int = FEW_PLACES) -> DataFrame:
    """Messages holding a phrase's tokens next to each other and in order, and how often.

    Only messages that hold the phrase's two rarest tokens at the right distance meet its other tokens, so frequent
    words of long phrases are not paired with all their messages. Up to ``few`` of these are broadcast to the postings.
    """
    parts = atoms.filter("mode = 'phrase'").select("atom", F.size("tokens").alias("parts"), F.posexplode("tokens").alias("i", "term"))
    rarest = Window.partitionBy("atom").orderBy("df", "i")  # one short list per phrase
    known = parts.join(index.vocabulary.select("term", "df"), "term").withColumns(
        {"_o": F.row_number().over(rarest), "_known": F.count(F.lit(1)).over(Window.partitionBy("atom"))}
    )
    known = durable(known.filter("_known = parts").drop("_known", "df"))
    starts = F.transform("positions", lambda p: p - F.col("i"))

    def holding(place: int) -> DataFrame:
        return known.filter(F.col("_o") == place).join(index.postings, "term").select("atom", "parts", "message_id", "length", starts.alias("starts"))

    second = holding(2).select("atom", "message_id", F.col("starts").alias("_second"))
    longer = holding(1).filter("parts > 1").join(second, ["atom", "message_id"])
    longer = longer.withColumn("starts", F.array_intersect("starts", "_second")).drop("_second").filter(F.size("starts") > 0)
    candidates = durable(longer.unionByName(holding(1).filter("parts = 1")))
    asked = candidates.filter("parts > 2").select("atom", "message_id").join(known.filter("_o > 2").select("atom", "i", "term"), "atom")
    asked = durable(asked)
    placed = (F.broadcast(asked) if asked.count() <= few else asked.hint("merge")).join(
        index.postings.select("term", "message_id", "positions"), ["term", "message_id"]
    )
    # One short list per (phrase, message): as long as the phrase.
    others = placed.groupBy("atom", "message_id").agg(F.collect_list(starts).alias("_s"))
    together = candidates.join(others, ["atom", "message_id"], "left").withColumn("_s", F.coalesce("_s", F.array().cast("array<array<int>>")))
    every = F.aggregate("_s", F.col("starts"), lambda acc, s: F.array_intersect(acc, s))
    complete = together.filter(F.size("_s") == F.greatest(F.col("parts") - 2, F.lit(0))).withColumn("tf", F.size(every))
    return complete.filter("tf > 0").select("atom", "message_id", "tf", "length")


def atom_hits(atoms: DataFrame, index: Index) -> DataFrame:
    """(atom, message_id, weight): where each distinct search atom occurs, with its length-normalised count."""
    words = (
        _expand(atoms, index)
        .join(index.postings.select("term", "message_id", "tf", "length"), "term")
        .groupBy("atom", "message_id")
        .agg(F.sum("tf").alias("tf"), F.first("length").alias("length"))
    )
    hits = words.unionByName(phrase_hits(atoms, index).withColumn("tf", F.col("tf").cast("long")))
    average = index.stats.first()["avg_length"] or 1.0  # one row
    norm = F.lit(1 - B) + F.lit(B) * F.col("length") / F.lit(average)
    return hits.select("atom", "message_id", (F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * norm)).alias("weight"))


def block_of(message_id: Column) -> Column:
    return F.floor(message_id / BLOCK_IDS).cast("long")


@dataclass(frozen=True)
class Matches:
    """Everything the ranked lists need, computed once per distinct atom."""

    groups: DataFrame  # query_id, plan, group_no, atom, df, idf
    hits: DataFrame  # atom, block, message_id, weight
    excluded: DataFrame  # query_id, message_id is decided by term
    index: Index
    maxima: DataFrame  # atom, block, most: the largest weight


def match(parsed: DataFrame, index: Index) -> Matches:
    """Occurrences of all atoms of a query table.

    They are read several times below, so they are written once to the checkpoint folder.
    """
    terms = durable(querytable.strict_terms(parsed).unionByName(querytable.relaxed_terms(parsed)))
    atoms = terms.select("atom", "mode", "tokens").dropDuplicates(["atom"])
    hits = durable(atom_hits(atoms, index).withColumn("block", block_of(F.col("message_id"))))
    frequency = hits.groupBy("atom").agg(F.count(F.lit(1)).alias("df"))
    total = F.lit(index.stats.first()["n"])
    df = F.coalesce("df", F.lit(0))
    idf = F.log((total - df + 0.5) / (df + 0.5))
    groups = terms.join(frequency, "atom", "left").select(
        "query_id", "plan", "group_no", "atom", df.alias("df"), F.when(idf > 0, idf).otherwise(F.lit(MIN_IDF)).alias("idf")
    )
    maxima = hits.groupBy("atom", "block").agg(F.max("weight").alias("most"))
    return Matches(durable(groups), hits, querytable.excluded_terms(parsed), index, maxima)


def _without_excluded(rows: DataFrame, m: Matches) -> DataFrame:
    """Drop candidates that hold an excluded term exactly."""
    banned = m.excluded.join(m.index.postings.select("term", "message_id"), "term").select("query_id", "message_id")
    return rows.join(banned, ["query_id", "message_id"], "left_anti")


def strict_scores(m: Matches) -> DataFrame:
    """(query_id, message_id, score) of messages holding every group of their query.

    Candidates come from the rarest group only; each is then checked against the others by an
    equality join on (atom, message), a key without duplicates.
    """
    groups = m.groups.filter("plan = 'strict'")
    plan = groups.groupBy("query_id").agg(
        F.count(F.lit(1)).alias("n_groups"), F.min("df").alias("least"), F.min_by("atom", F.struct("df", "group_no")).alias("atom")
    )
    candidates = plan.filter("least > 0").join(m.hits.select("atom", "message_id"), "atom")
    candidates = candidates.select("query_id", "n_groups", "message_id")
    # Occurrences are many and compress well: never broadcast them for their small files.
    checked = candidates.join(groups.select("query_id", "atom", "idf"), "query_id").join(
        m.hits.hint("merge"), ["atom", "message_id"]
    )
    scored = checked.groupBy("query_id", "message_id", "n_groups").agg(
        F.count(F.lit(1)).alias("_n"), F.sum(F.col("idf") * F.col("weight")).alias("score")
    )
    full = scored.filter("_n = n_groups").select("query_id", "message_id", "score")
    return _without_excluded(full, m)


def relaxed_scores(m: Matches, queries: DataFrame) -> DataFrame:
    """The same for messages holding any group of the any-word plan of ``queries``."""
    groups = m.groups.filter("plan = 'relaxed'").join(queries.select("query_id"), "query_id", "left_semi")
    scored = groups.join(m.hits, "atom").groupBy("query_id", "message_id").agg(
        F.sum(F.col("idf") * F.col("weight")).alias("score")
    )
    return _without_excluded(scored, m)


def blend_recency(score: Column, ts: Column, newest: Column) -> Column:
    """Mild preference for recent messages; age counts from the newest message and is never negative."""
    age = F.greatest(F.unix_micros(newest) - F.unix_micros(ts), F.lit(0)) / F.lit(float(DAY_MICROS))
    return score * (RECENCY_FLOOR + (1 - RECENCY_FLOOR) * F.exp(-age / RECENCY_DAYS))


def _blended(scores: DataFrame, messages: DataFrame, resolved: filters.Resolved) -> DataFrame:
    """(query_id, message_id, score) of the text messages that pass their query's filters, with recency.

    Scores are rounded to 9 digits so that rank ties do not depend on the order of additions.
    """
    rows = scores.join(messages.filter(F.col("kind") == kinds.TEXT), "message_id")
    kept = filters.keep(rows, resolved).select("query_id", "message_id", "ts", "score")
    newest = messages.agg(F.max("ts").alias("t")).scalar()
    return kept.select("query_id", "message_id", F.round(blend_recency(F.col("score"), F.col("ts"), newest), 9).alias("score"))


def _all_ranked(rows: DataFrame) -> DataFrame:
    """(query_id, message_id, score, rank) of scored rows of any number: a query may have a large share of them."""
    keyed = durable(rows.select("query_id", "message_id", "score", (-F.col("score")).alias("_s"), (-F.col("message_id")).alias("_m")))
    return Ordered(keyed, ["query_id"], ["_s", "_m"]).row_number(name="rank").select("query_id", "message_id", "score", "rank")


def ranked_matches(scores: DataFrame, messages: DataFrame, resolved: filters.Resolved) -> DataFrame:
    """All scored matches with their rank."""
    return _all_ranked(_blended(scores, messages, resolved))


def _groups(m: Matches, plan: str, queries: DataFrame | None) -> DataFrame:
    groups = m.groups.filter(F.col("plan") == plan)
    return groups if queries is None else groups.join(queries.select("query_id"), "query_id", "left_semi")


def block_bounds(m: Matches, plan: str, messages: DataFrame, queries: DataFrame | None = None) -> DataFrame:
    """(query_id, block, bound): what no message of the block can exceed; of the strict plan, blocks that hold every group."""
    groups = _groups(m, plan, queries)
    rows = groups.join(m.maxima, "atom").groupBy("query_id", "block").agg(
        F.count(F.lit(1)).alias("_n"), F.sum(F.col("idf") * F.col("most")).alias("bound")
    )
    if plan == "strict":
        rows = rows.join(groups.groupBy("query_id").agg(F.count(F.lit(1)).alias("_groups")), "query_id").filter("_n = _groups")
    newest = messages.filter(F.col("kind") == kinds.TEXT).groupBy(block_of(F.col("message_id")).alias("block")).agg(F.max("ts").alias("_ts"))
    last = messages.agg(F.max("ts").alias("t")).scalar()
    return rows.join(newest, "block").select("query_id", "block", blend_recency(F.col("bound"), F.col("_ts"), last).alias("bound"))


def scores_in(m: Matches, plan: str, blocks: DataFrame) -> DataFrame:
    """(query_id, message_id, score) of the matches in some blocks(query_id, block); other occurrences are not joined."""
    groups = m.groups.filter(F.col("plan") == plan)
    wanted = groups.join(blocks.select("query_id", "block"), "query_id").select("query_id", "atom", "idf", "block")
    return _matched(wanted.join(m.hits.hint("merge"), ["atom", "block"]), groups, m, plan)


def scores_of(m: Matches, plan: str, pairs: DataFrame) -> DataFrame:
    """The same for given (query_id, message_id), looked up by equality."""
    groups = m.groups.filter(F.col("plan") == plan)
    wanted = groups.join(pairs.select("query_id", "message_id"), "query_id").select("query_id", "atom", "idf", "message_id")
    return _matched(wanted.join(m.hits.hint("merge"), ["atom", "message_id"]), groups, m, plan)


def _matched(rows: DataFrame, groups: DataFrame, m: Matches, plan: str) -> DataFrame:
    scored = rows.groupBy("query_id", "message_id").agg(
        F.count(F.lit(1)).alias("_n"), F.sum(F.col("idf") * F.col("weight")).alias("score")
    )
    if plan == "strict":
        scored = scored.join(groups.groupBy("query_id").agg(F.count(F.lit(1)).alias("_groups")), "query_id").filter("_n = _groups")
    return _without_excluded(scored.select("query_id", "message_id", "score"), m)


def open_blocks(bounds: DataFrame, first: DataFrame, floors: DataFrame) -> DataFrame:
    """Blocks not in ``first`` that may hold a score of at least their query's floor; all where it has none."""
    rest = bounds.join(first.select("query_id", "block"), ["query_id", "block"], "left_anti")
    return rest.join(floors, "query_id", "left").filter(F.col("floor").isNull() | (F.col("bound") + ROUNDING >= F.col("floor")))


def best_matches(
    m: Matches,
    plan: str,
    messages: DataFrame,
    resolved: filters.Resolved,
    depth: int,
    queries: DataFrame | None = None,
    looked_up: DataFrame | None = None,
) -> DataFrame:
    """(query_id, message_id, score, rank): at least the best ``depth`` of each query, and every match among ``looked_up``
    (query_id, message_id), however far down. All ranks are those of the whole list.

    A rank is the number of better matches, so what has to be scored is everything down to the floor: the worst of the
    best ``depth`` or of the looked-up matches.
    """
    bounds = durable(block_bounds(m, plan, messages, queries))
    first = top_per_group(bounds, ["query_id"], [F.desc("bound"), F.col("block")], FIRST_BLOCKS).select("query_id", "block")
    one = durable(_blended(scores_in(m, plan, first), messages, resolved))
    best = top_per_group(one, ["query_id"], [F.desc("score"), F.desc("message_id")], depth)
    floors = best.groupBy("query_id").agg(F.count(F.lit(1)).alias("_n"), F.min("score").alias("floor")).filter(F.col("_n") >= depth)
    floors = floors.select("query_id", "floor")
    if looked_up is not None:
        if queries is not None:
            looked_up = looked_up.join(queries.select("query_id"), "query_id", "left_semi")
        least = _blended(scores_of(m, plan, looked_up), messages, resolved).groupBy("query_id").agg(F.min("score").alias("_least"))
        floors = floors.join(least, "query_id", "left").select("query_id", F.least("floor", "_least").alias("floor"))
    floors = durable(floors)
    two = _blended(scores_in(m, plan, open_blocks(bounds, first, floors)), messages, resolved)
    rows = one.unionByName(two).join(floors, "query_id", "left").filter(F.col("floor").isNull() | (F.col("score") >= F.col("floor")))
    if looked_up is None:
        top = top_per_group(rows, ["query_id"], [F.desc("score"), F.desc("message_id")], depth)
        return durable(top.select("query_id", "message_id", "score", "rank"))
    return durable(_all_ranked(rows))


@dataclass(frozen=True)
class KeywordLists:
    strict: DataFrame
    relaxed: DataFrame


def few_matches(m: Matches, strict: DataFrame, relax_below: int) -> DataFrame:
    """Queries with fewer than ``relax_below`` all-words matches."""
    found = strict.groupBy("query_id").agg(F.count(F.lit(1)).alias("_n"))
    asked = m.groups.filter("plan = 'strict'").select("query_id").distinct().join(found, "query_id", "left")
    return asked.filter(F.coalesce("_n", F.lit(0)) < relax_below).select("query_id")


def keyword_search(
    parsed: DataFrame,
    index: Index,
    messages: DataFrame,
    resolved: filters.Resolved,
    depth: int | None,
    relax_below: int = RELAX_BELOW,
    looked_up: DataFrame | None = None,
) -> KeywordLists:
    """All-words list of every query, and an any-word list for those with fewer than ``relax_below`` matches.

    The best ``depth`` of each list (None: whole lists), and what of ``looked_up`` is in it, with ranks in the whole list.
    """
    m = match(parsed, index)
    if depth is None:
        strict = durable(ranked_matches(strict_scores(m), messages, resolved))
        few = durable(few_matches(m, strict, relax_below))
        any_word = ranked_matches(relaxed_scores(m, few), messages, resolved)
    else:
        strict = best_matches(m, "strict", messages, resolved, max(depth, relax_below, 1), None, looked_up)
        few = durable(few_matches(m, strict, relax_below))
        # the list proper is without the all-words matches, of which there are fewer than ``relax_below``
        any_word = best_matches(m, "relaxed", messages, resolved, max(depth, 1) + relax_below, few, looked_up)
    fresh = any_word.join(strict.select("query_id", "message_id", F.col("rank").alias("_strict")), ["query_id", "message_id"], "left")
    taken = fresh.filter("_strict IS NOT NULL").groupBy("query_id").agg(F.sort_array(F.collect_list("rank")).alias("_taken"))
    rest = fresh.filter("_strict IS NULL").join(taken, "query_id", "left")  # lists of fewer than ``relax_below`` ranks
    before = F.size(F.filter(F.coalesce("_taken", F.array().cast("array<bigint>")), lambda r: r < F.col("rank")))
    relaxed = rest.select("query_id", "message_id", "score", (F.col("rank") - before).cast("long").alias("rank"))
    return KeywordLists(strict, durable(relaxed))

"""A table of search strings to structured searches. Every step stays inside the row."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chatlake.functions import text, times

# Operators and their spellings.
CHAT_KEYS = ["in", "with", "to"]
RANGE_KEYS = ["during", "on", "in_year"]
HAS_WORDS = {
    "link": ["link", "links", "url"],
    "photo": ["photo", "photos", "image", "images", "pic", "picture"],
    "video": ["video", "videos"],
    "audio": ["audio", "voice", "voicememo"],
    "file": ["file", "files", "doc", "pdf"],
    "attachment": ["attachment", "attachments"],
}

# A quoted phrase, key:"value", key:value, or a word; an unclosed quote runs to the end.
PIECE = r'(?U)"[^"]*(?:"|$)|[A-Za-z_]+:"[^"]*(?:"|$)|\S+'
KEYED = r'(?s)^([A-Za-z_]+):(.*)$'


def _unquote(value: Column) -> Column:
    return F.when(value.startswith('"'), F.regexp_replace(value, '^"|"$', "")).otherwise(value)


def _has_word(value: Column) -> Column:
    lookup = F.create_map(*[F.lit(x) for kind, words in HAS_WORDS.items() for w in words for x in (w, kind)])
    return F.try_element_at(lookup, F.lower(value))


def _strip(value: Column) -> Column:
    return F.regexp_replace(value, r"(?U)^\s+|\s+$", "")


def _with(*names: str, **more: Callable[[Column], Column]) -> Callable[[Column], Column]:
    """Lambda that keeps the named fields of a struct and adds ``more``, each a function of the struct."""
    return lambda x: F.struct(*[x[n].alias(n) for n in names], *[f(x).alias(n) for n, f in more.items()])


DATE_KEYS = ["before", "after", *RANGE_KEYS]


def _special(piece: Column) -> Column:
    """May a piece be more than a plain word."""
    return piece.startswith('"') | piece.startswith("-") | piece.contains(":")


def _numbered(pieces: Column, kept: Callable[[Column], Column]) -> Column:
    """(at, piece) of some pieces."""
    marked = F.transform(pieces, lambda p, i: F.when(kept(p), F.struct(i.alias("at"), p.alias("piece"))))
    return F.filter(marked, lambda x: x.isNotNull())


def _classify(pieces: Column, tz: str) -> Column:
    """Numbered pieces as structs: place, role, what is said, and the instants of a date operand.

    In steps, so that each part of a piece is worked out once; dates only where a date key asks for one.
    """
    steps = F.transform(
        pieces,
        _with(
            "at",
            "piece",
            head=lambda x: F.regexp_extract(x["piece"], KEYED, 1),
            raw=lambda x: _unquote(F.regexp_extract(x["piece"], KEYED, 2)),
        ),
    )
    steps = F.transform(
        steps,
        _with("at", "piece", "head", "raw", key=lambda x: F.lower(x["head"]), value=lambda x: F.when(x["head"] != "", _strip(x["raw"]))),
    )

    def date(x: Column, side: int) -> Column:
        return F.when(x["key"].isin(DATE_KEYS), times.date_operand(x["value"], tz)[side])

    steps = F.transform(
        steps, _with("at", "piece", "head", "raw", "key", "value", start=lambda x: date(x, 0), end=lambda x: date(x, 1))
    )

    def role(x: Column) -> Column:
        filled = x["value"] != ""
        dated = x["start"].isNotNull() & x["end"].isNotNull()
        return (
            F.when(x["piece"].startswith('"'), "phrase")
            .when(x["piece"].startswith("-"), "excluded")
            .when(filled & (x["key"] == "from"), "from")
            .when(filled & x["key"].isin(CHAT_KEYS), "chat")
            .when((x["key"] == "has") & _has_word(x["value"]).isNotNull(), "has")
            .when(dated & x["key"].isin(RANGE_KEYS), "during")
            .when(dated, x["key"])
            .otherwise("word")
        )

    steps = F.transform(steps, _with("at", "piece", "head", "raw", "value", "start", "end", role=role))

    def said(x: Column) -> Column:
        return (
            F.when(x["role"] == "phrase", _unquote(x["piece"]))
            .when(x["role"] == "excluded", F.substring(x["piece"], F.lit(2), F.length(x["piece"])))
            .when(x["role"] == "has", _has_word(x["value"]))
            .when(x["role"].isin("from", "chat"), x["value"])
            .when(x["head"] != "", F.concat(x["head"], F.lit(":"), x["raw"]))
            .otherwise(x["piece"])
        )

    return F.transform(
        steps,
        _with(
            "at",
            "role",
            said=said,
            after_ts=lambda x: F.when(x["role"] == "after", x["end"]).when(x["role"] == "during", x["start"]),
            before_ts=lambda x: F.when(x["role"] == "before", x["start"]).when(x["role"] == "during", x["end"]),
        ),
    )


def parse(queries: DataFrame, tz: str = "UTC") -> DataFrame:
    """``queries(query_id, text)`` with words, phrases, exclusions, filters and date bounds."""
    rows = queries.withColumn("_pieces", F.regexp_extract_all("text", F.lit(PIECE), F.lit(0)))
    rows = rows.withColumn("_p", _classify(_numbered(F.col("_pieces"), _special), tz))  # few of a long text's pieces

    def having(role: str) -> Column:
        return F.filter("_p", lambda p: (p["role"] == role) & p["said"].rlike(r"(?U)\S"))

    def said(role: str) -> Column:
        return F.transform(having(role), lambda p: p["said"])

    def words() -> Column:
        """Plain pieces, and special ones that turned out to be words, in their order."""
        others = F.transform(having("word"), lambda p: F.struct(p["at"].alias("at"), p["said"].alias("piece")))
        both = F.array_sort(F.concat(_numbered(F.col("_pieces"), lambda p: ~_special(p)), others))
        plain = F.filter("_pieces", lambda p: ~_special(p))
        return F.when(F.exists("_p", lambda p: p["role"] == "word"), F.transform(both, lambda x: x["piece"])).otherwise(plain)

    def last(bound: str) -> Column:
        return F.try_element_at(F.filter("_p", lambda p: p[bound].isNotNull()), F.lit(-1))[bound]

    return rows.select(
        *queries.columns,
        words().alias("words"),
        said("phrase").alias("phrases"),
        said("excluded").alias("excluded"),
        said("from").alias("from_vals"),
        said("chat").alias("chat_vals"),
        F.array_distinct(said("has")).alias("has"),
        last("after_ts").alias("after_ts"),
        last("before_ts").alias("before_ts"),
    )


def free_text(parsed: DataFrame) -> Column:
    """Words, then phrases, as given to the embedder."""
    return F.concat_ws(" ", F.concat("words", "phrases"))


def has_text() -> Column:
    return (F.size("words") > 0) | (F.size("phrases") > 0)


def has_filters() -> Column:
    return (
        (F.size("from_vals") > 0)
        | (F.size("chat_vals") > 0)
        | (F.size("has") > 0)
        | F.col("after_ts").isNotNull()
        | F.col("before_ts").isNotNull()
    )


def _tokens_of(column: str) -> Column:
    return F.flatten(F.transform(column, lambda w: text.tokens(w)))


def _atom(mode: Column, tokens: Column) -> Column:
    return F.struct(mode.alias("mode"), tokens.alias("tokens"))


def strict_terms(parsed: DataFrame) -> DataFrame:
    """All-words plan, one row per group: every word token as a prefix (one letter: exact), every phrase in order."""
    words = F.transform(
        _tokens_of("words"),
        lambda t: _atom(F.when(F.length(t) == 1, F.lit("exact")).otherwise(F.lit("prefix")), F.array(t)),
    )
    phrases = F.transform(
        F.filter(F.transform("phrases", lambda p: text.tokens(p)), lambda ts: F.size(ts) > 0),
        lambda ts: _atom(F.when(F.size(ts) == 1, F.lit("exact")).otherwise(F.lit("phrase")), ts),
    )
    return _exploded(parsed, F.concat(words, phrases), "strict")


def relaxed_terms(parsed: DataFrame) -> DataFrame:
    """Any-word plan: distinct meaningful tokens as prefixes; none when it would equal a one-word search."""
    all_tokens = F.concat(_tokens_of("words"), _tokens_of("phrases"))
    useful = F.array_distinct(F.filter(all_tokens, lambda t: ~text.is_stopword(t) & (F.length(t) >= 2)))
    same = (F.size(useful) == 1) & (F.size(all_tokens) == 1)
    groups = F.transform(useful, lambda t: _atom(F.lit("prefix"), F.array(t)))
    return _exploded(parsed, F.when(~same, groups), "relaxed")


def _exploded(parsed: DataFrame, groups: Column, plan: str) -> DataFrame:
    rows = parsed.select("query_id", F.posexplode(groups).alias("group_no", "g"))
    atom = F.concat_ws(" ", F.concat(F.col("g.mode"), F.lit(":")), F.array_join("g.tokens", " "))
    return rows.select(
        "query_id", F.lit(plan).alias("plan"), "group_no", F.col("g.mode").alias("mode"), F.col("g.tokens").alias("tokens"),
        atom.alias("atom"),
    )


def excluded_terms(parsed: DataFrame) -> DataFrame:
    return parsed.select("query_id", F.explode(_tokens_of("excluded")).alias("term")).distinct()


def highlight_words(parsed: DataFrame) -> DataFrame:
    """Tokens to mark in snippets: of words (filler dropped when any content word exists) and of phrases."""

    def plain(column: str) -> Column:
        return F.flatten(
            F.transform(column, lambda w: F.regexp_extract_all(F.lower(w), F.lit(text.TOKEN), F.lit(0)))
        )

    words = plain("words")
    content = F.filter(words, lambda t: ~text.is_stopword(t))
    kept = F.when(F.size(content) > 0, content).otherwise(words)
    return parsed.select("query_id", F.array_distinct(F.concat(kept, plain("phrases"))).alias("marks"))


def transcript_pattern(parsed: DataFrame) -> DataFrame:
    """Pattern that marks a search's terms in a transcript: phrases, then useful words at word starts."""
    phrases = F.transform(
        "phrases", lambda p: F.regexp_replace(text.regex_quote(_strip(p)), r"\s+", r"\\s+")
    )
    tokens = F.flatten(
        F.transform("words", lambda w: F.regexp_extract_all(w, F.lit(text.TOKEN), F.lit(0)))
    )
    useful = F.filter(tokens, lambda t: (F.length(t) > 1) & ~F.lower(t).isin(text.TRANSCRIPT_STOPWORDS))
    shown = F.when(F.size(useful) > 0, useful).otherwise(tokens)
    parts = F.concat(phrases, F.transform(shown, lambda t: F.concat(F.lit(r"(?<![\p{L}\p{N}])"), t)))
    longest_first = F.array_sort(parts, lambda a, b: F.length(b) - F.length(a))
    return parsed.select(
        "query_id",
        F.when(F.size(parts) > 0, F.concat(F.lit("(?iu)("), F.array_join(longest_first, "|"), F.lit(")"))).alias("pattern"),
    )


def people_facets(members: DataFrame, handles: DataFrame) -> DataFrame:
    """Distinct people to filter by (name, else address), named people before bare numbers and addresses."""
    label = F.coalesce("name", "address")
    people = (
        members.select("handle_id").distinct().join(handles, "handle_id").groupBy(label.alias("label"))
        .agg(F.min(F.when(F.col("name").isNotNull(), F.col("address"))).alias("detail"))
    )
    bare = F.col("label").rlike(r"^[+\d]") | F.col("label").contains("@")
    return people.withColumn("bare", bare).orderBy("bare", "label")


def date_presets(messages: DataFrame, today: Column) -> DataFrame:
    """Date choices: the past week, month and year, then every year back to the oldest message."""
    oldest = messages.agg(F.min("ts").alias("oldest"), F.first(today).alias("today"))
    recent = [
        F.struct(F.lit(label).alias("label"), F.concat(F.lit("after:"), F.date_format(F.date_sub("today", days), "yyyy-MM-dd")).alias("op"))
        for label, days in (("Past week", 8), ("Past month", 31), ("Past year", 366))
    ]
    newest = F.year("today")
    span = F.sequence(newest, F.least(newest, F.coalesce(F.year("oldest"), newest - 3)), F.lit(-1))
    years = F.transform(span, lambda y: F.struct(y.cast("string").alias("label"), F.concat(F.lit("during:"), y.cast("string")).alias("op")))
    return oldest.select(F.inline(F.concat(F.array(*recent), years)))

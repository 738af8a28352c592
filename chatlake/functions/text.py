"""Text expressions: clean-up, folding, tokens, links. All native, no Python at run time."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F


def _latin_folding() -> tuple[str, str]:
    """Lower-case Latin letters with marks, and their base letters, by Unicode decomposition."""
    marked, plain = [], []
    for code in [*range(0x00C0, 0x0250), *range(0x1E00, 0x1F00)]:
        ch = chr(code)
        parts = unicodedata.normalize("NFD", ch)
        if ch == ch.lower() and len(parts) > 1 and parts[0].isascii():
            marked.append(ch)
            plain.append(parts[0])
    return "".join(marked), "".join(plain)


MARKED, PLAIN = _latin_folding()
TOKEN = r"[\p{L}\p{N}]+"

# Filler words of natural-language questions, left out of any-word matching.
STOPWORDS = [
    "a", "am", "an", "and", "are", "as", "at", "be", "can", "could", "did", "do", "does", "for",
    "from", "get", "had", "has", "have", "how", "i", "if", "in", "is", "it", "its", "me", "my",
    "of", "on", "or", "s", "should", "so", "that", "the", "their", "there", "they", "this", "to",
    "was", "we", "were", "what", "whats", "when", "where", "which", "who", "why", "will", "with",
    "would", "you", "your",
]

# Words too common to mark in a transcript.
TRANSCRIPT_STOPWORDS = (
    "a an and are at be but by do for from i if in is it me my of on or so that the this to was we "
    "were what when where who why will with you your"
).split()

# Fixed patterns: link spans, and texts that are one link.
LINK_SPAN = r"(?i)((?:https?://|www\.)[^\s<]+[^\s<.,:;\"')\]!?])"
LINK_ONLY = r"(?i)^(?:https?://|www\.)\S+$"


def clean(text: Column) -> Column:
    """Drop object-replacement marks, trim; blank becomes NULL."""
    bare = F.regexp_replace(F.translate(text, "￼", ""), r"^\s+|\s+$", "")
    return F.nullif(bare, F.lit(""))


def fold(text: Column) -> Column:
    """Lower case without diacritics, precomposed or combining. Plain ASCII texts skip the letter map."""
    lower = F.lower(text)
    plain = F.octet_length(text) == F.length(text)
    return F.when(plain, lower).otherwise(F.regexp_replace(F.translate(lower, MARKED, PLAIN), r"\p{Mn}+", ""))


def tokens(text: Column) -> Column:
    """Runs of letters and digits, folded, in order: the terms of the keyword index."""
    return F.regexp_extract_all(fold(text), F.lit(TOKEN), F.lit(0))


def is_stopword(token: Column) -> Column:
    return token.isin(STOPWORDS)


def has_link(text: Column) -> Column:
    return F.coalesce(
        text.contains("http://") | text.contains("https://") | text.contains("www."), F.lit(False)
    )


def link_spans(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(LINK_SPAN), F.lit(1))


def link_href(span: Column) -> Column:
    return F.when(span.rlike(r"(?i)^https?://"), span).otherwise(F.concat(F.lit("https://"), span))


def link_host(href: Column) -> Column:
    """Host without ``www.``, as typed when the link can't be parsed."""
    return F.regexp_replace(F.lower(F.regexp_extract(href, r"(?i)^https?://(?:[^/?#@]*@)?([^/?#:]+)", 1)), r"^www\.", "")


def link_path(href: Column) -> Column:
    """Path and query; empty for the bare root."""
    rest = F.regexp_extract(href, r"(?i)^https?://[^/?#]*([^#]*)", 1)
    return F.when(rest == "/", F.lit("")).otherwise(rest)


def regex_quote(text: Column) -> Column:
    return F.regexp_replace(text, r"([.*+?^${}()|\[\]\\])", r"\\$1")


def short_name(name: Column) -> Column:
    """First word of a name; addresses and numbers stay whole."""
    return F.when(name.rlike(r"^[@+\d]") | name.contains("@"), name).otherwise(F.regexp_extract(name, r"^\S*", 0))

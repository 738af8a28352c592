"""Tokens of many texts at once inside Arrow tasks: equal to ``text.tokens``, without a regular expression per text."""

from __future__ import annotations

import unicodedata

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from chatlake.functions import text

SAFE = "[^\\x00-\\u024F\\u2000-\\u206F]"
"""Other characters than those that tasks fold and split themselves; texts with any are split natively."""


def _letters() -> tuple[np.ndarray, np.ndarray]:
    ascii_words = np.zeros(256, bool)
    ascii_words[[ord(c) for c in "0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"]] = True
    folded = np.zeros(0x250, np.uint8)  # 0: no letter or digit, 1: stays as it is, else the letter without its mark
    for code in range(0x80, 0x250):
        folded[code] = unicodedata.category(chr(code))[0] in "LN"
    for marked, plain in zip(text.MARKED, text.PLAIN):
        if ord(marked) < 0x250:
            folded[ord(marked)] = ord(plain)
    return ascii_words, folded


ASCII_WORDS, FOLDED = _letters()


def split_words(lowered: pa.Array, folded: bool = True) -> tuple[pa.Array, np.ndarray]:
    """``text.tokens`` of lower-case texts without characters of ``SAFE``: all tokens, and their number in each text.

    Without ``folded``, letters keep their marks.
    """
    texts = pc.fill_null(lowered, "").cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    if not len(texts) or offsets[0] == offsets[-1]:
        return pa.array([], pa.large_string()), np.zeros(len(texts), np.int64)
    data = np.frombuffer(texts.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    offsets = offsets - offsets[0]
    word = ASCII_WORDS[data]
    lead = np.flatnonzero((data >= 0xC2) & (data <= 0xC9))  # two bytes: up to U+024F
    if len(lead):
        to = FOLDED[(data[lead].astype(np.int64) & 0x1F) << 6 | data[lead + 1] & 0x3F]
        to = to if folded else np.minimum(to, 1)
        stays, changes = lead[to == 1], lead[to > 1]
        word[stays] = word[stays + 1] = word[changes] = True
        data = data.copy()
        data[changes] = to[to > 1]
        left = np.ones(len(data), bool)
        left[changes + 1] = False
        offsets = offsets - np.searchsorted(changes + 1, offsets)
        data, word = data[left], word[left]
    opens = word.copy()
    opens[1:] &= ~word[:-1]
    firsts = offsets[:-1][np.diff(offsets) > 0]
    opens[firsts] = word[firsts]  # a token ends with its text
    starts = np.flatnonzero(opens)
    sizes = np.add.reduceat(word, starts, dtype=np.int64) if len(starts) else np.zeros(0, np.int64)
    ends = np.concatenate([[0], np.cumsum(sizes)])
    words = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(ends), pa.py_buffer(data[word].tobytes()))
    return words, np.diff(np.searchsorted(starts, offsets))


def columns(source: Column, folded: bool = True, prefix: str = "") -> list[Column]:
    """``lowered`` for texts that tasks split, else NULL; ``tokens`` of the others, else empty.

    It is not NULL, because a NULL list takes Arrow's writer as many steps as there are NULL lists before it in the batch.
    """
    lowered = F.lower(source)
    safe = (F.octet_length(source) == F.length(source)) | ~lowered.rlike(SAFE)
    tokens = text.tokens(source) if folded else F.regexp_extract_all(lowered, F.lit(text.TOKEN), F.lit(0))
    return [F.when(safe, lowered).alias(f"{prefix}lowered"), F.when(~safe, tokens).otherwise(F.array().cast("array<string>")).alias(f"{prefix}tokens")]


def words(part: pa.RecordBatch, folded: bool = True) -> tuple[pa.RecordBatch, pa.Array, np.ndarray]:
    """The rows, those split natively last, with all their tokens and the number of each."""
    native = pc.greater(pc.fill_null(pc.list_value_length(part.column("tokens")), 0), 0).to_numpy(zero_copy_only=False)
    part = part.take(pa.array(np.argsort(native, kind="stable")))
    here, there = part.slice(0, int((~native).sum())), part.slice(int((~native).sum()))
    tokens, n = split_words(here.column("lowered"), folded)
    if there.num_rows:
        more = there.column("tokens")
        tokens = pa.concat_arrays([tokens, more.flatten().cast(pa.large_string())])
        n = np.concatenate([n, pc.list_value_length(more).to_numpy(zero_copy_only=False).astype(np.int64)])
    return part, tokens, n


def lengths(lowered: pa.Array, tokens: pa.Array) -> np.ndarray:
    """Number of tokens of each text, in order."""
    more = pc.fill_null(pc.list_value_length(tokens), 0).to_numpy(zero_copy_only=False)
    return split_words(lowered)[1] + more.astype(np.int64)

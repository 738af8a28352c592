"""Document fingerprints of Lempel-Ziv phrases.

A text is read as a row of units: words, lower-cased, long ones in parts of ``UNIT`` bytes. It is parsed as in
Lempel-Ziv 78: from where the last phrase ended, the longest phrase that is known already is taken, one more unit makes a
new phrase, and that is put in the dictionary. Texts that compress well together have many phrases in common, so the
likeness of texts is that of their dictionaries. A dictionary is kept as a minimum-hash signature: the hashes of
phrases are dealt to ``BINS`` bins by their upper bits, the least of each bin stays, and an empty bin borrows from the next one.
The share of equal bins estimates the share of common phrases.

``with_neighbours`` also fingerprints each text with its second half replaced by the beginning of the next text. Documents are
range-partitioned and sorted by descending id, so the next document is at hand; only at the border of two
partitions it is not, and these pairs, one per partition, are completed afterwards.

Cases: a text without words has an empty dictionary; two such are alike (1), one such and another are not (0); null text
is empty; null ids come last; rows with equal ids follow each other by text; a single document is its own next one. An
empty table gives an empty result. Only id and text are read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chatlake.llm.common import documents, pair, query, small, spark_schema
from chatlake.llm.words import WORD_BYTE, _series
from chatlake.session import durable

BINS = 64
UNIT = 16
PARTITION_BYTES = 32 << 20
_BASE = 0x100000001B3
_ODD, _MASK = 0x9E3779B97F4A7C15, (1 << 61) - 1


def units(text: str) -> list[int]:
    """A hash of each unit."""
    raw = np.frombuffer(text.lower().encode(), np.uint8)
    n = len(raw)
    if not n:
        return []
    inside = WORD_BYTE[raw]
    edge = np.flatnonzero(np.diff(np.concatenate([[False], inside, [False]]).astype(np.int8)))
    first, stop = edge[::2], edge[1::2]
    parts = -(-(stop - first) // UNIT)
    if (parts > 1).any():
        step = (np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)) * UNIT
        first, stop = np.repeat(first, parts) + step, np.repeat(stop, parts)
        stop = np.minimum(first + UNIT, stop)
    sums = np.concatenate([[np.uint64(0)], np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * _series(_BASE, n))])
    code = (sums[stop] - sums[first]) * _series(pow(_BASE, -1, 1 << 64), n)[first]
    code ^= code >> np.uint64(32)
    code *= np.uint64(_ODD)
    return (code >> np.uint64(3)).tolist()


def phrases(row: list[int]) -> set[int]:
    """Hashes of the phrases that the parse puts into the dictionary."""
    known: set[int] = set()
    add = known.add
    phrase = 0
    for unit in row:
        phrase = (phrase * 0x2545F491 + unit + 1) & _MASK
        if phrase not in known:
            add(phrase)
            phrase = 0
    return known


def signature(text: str) -> np.ndarray | None:
    """BINS numbers of 16 bits, None of an empty dictionary."""
    known = phrases(units(text))
    if not known:
        return None
    codes = np.fromiter(known, np.uint64, len(known)) * np.uint64(_ODD)
    codes ^= codes >> np.uint64(29)
    codes = np.sort(codes * np.uint64(0xBF58476D1CE4E5B9))
    least = np.searchsorted(codes, np.arange(BINS, dtype=np.uint64) << np.uint64(58))
    value = codes[np.minimum(least, len(codes) - 1)]
    filled = np.flatnonzero((least < len(codes)) & (value >> np.uint64(58) == np.arange(BINS, dtype=np.uint64)))
    source = filled[np.searchsorted(filled, np.arange(BINS)) % len(filled)]  # an empty bin takes the next filled one
    away = ((source - np.arange(BINS)) % BINS).astype(np.uint64)
    # the least hash of many has zeros in front, so its bits are mixed again before they are cut
    return (((value[source] ^ (value[source] >> np.uint64(31))) * np.uint64(_ODD) >> np.uint64(48)) + away * np.uint64(0x9E35)).astype(np.uint16)


def likeness(a: np.ndarray | None, b: np.ndarray | None) -> float:
    if a is None or b is None:
        return float(a is b)
    return float((a == b).mean())


def fingerprint(s: np.ndarray | None) -> bytes:
    return b"" if s is None else s.astype(">u2").tobytes()


def edited(text: str, following: str) -> str:
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


_FIELDS = "doc_id long, n_chars long, edited_sha256 string, fingerprint binary, edited_fingerprint binary, near_edited double, near_next double"
_BORDER = "part int, first_text string, last_id long, last_text string"


def _compare(doc_id: int | None, text: str, own: np.ndarray | None, following: str, its: np.ndarray | None) -> dict:
    changed = edited(text, following)
    other = own if changed == text else signature(changed)
    return {
        "doc_id": doc_id,
        "n_chars": len(text),
        "edited_sha256": hashlib.sha256(changed.encode()).hexdigest(),
        "fingerprint": fingerprint(own),
        "edited_fingerprint": fingerprint(other),
        "near_edited": likeness(own, other),
        "near_next": likeness(own, its),
    }


def with_neighbours(docs: DataFrame) -> DataFrame:
    """_FIELDS of (doc_id, text), fingerprints in hex: fingerprints, and likeness to the edited text and to the next document."""
    spark = docs.sparkSession
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(spark.sparkContext.defaultParallelism, -(-size // PARTITION_BYTES))
    ordered = docs.repartitionByRange(int(parts), F.col("doc_id").desc_nulls_last()).sortWithinPartitions(F.col("doc_id").desc_nulls_last(), "text")
    schema = spark_schema(spark, f"{_FIELDS}, {_BORDER}")
    final = spark_schema(spark, _FIELDS)

    def walk(batches):
        held, first = None, None
        for batch in small(batches):
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own = held[2] if held and held[1] == text else signature(text)
                if held:
                    rows.append(_compare(*held, text, own))
                else:
                    first = text
                held = (doc_id, text, own)
            yield pa.RecordBatch.from_pylist(rows, schema=schema)
        if held:
            yield pa.RecordBatch.from_pylist([{"part": TaskContext.get().partitionId(), "first_text": first, "last_id": held[0], "last_text": held[1]}], schema=schema)

    walked = durable(ordered.mapInArrow(walk, f"{_FIELDS}, {_BORDER}"))
    names = [f.name for f in final]
    border = walked.where("part is not null").select("part", "first_text", "last_id", "last_text")
    # one small row per partition; the last one is followed by the first
    order = Window.orderBy("part")
    after = border.select("part", F.coalesce(F.lead("part").over(order), F.min("part").over(order)).alias("next_part"))
    heads = border.select(F.col("part").alias("next_part"), F.col("first_text").alias("following"))
    open_ = border.join(after, "part").join(heads, "next_part").select("last_id", "last_text", "following")

    def close(batches):
        for batch in small(batches, 16):
            rows = [_compare(d, t, signature(t), f, signature(f)) for d, t, f in zip(*(c.to_pylist() for c in batch.columns), strict=True)]
            yield pa.RecordBatch.from_pylist(rows, schema=final)

    whole = walked.where("part is null").select(*names).union(open_.mapInArrow(close, _FIELDS))
    return whole.withColumns({name: F.lower(F.hex(name)) for name in ("fingerprint", "edited_fingerprint")})


@query("op6_phrase_fingerprint")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_neighbours(pair(documents(spark, sf_dir)))

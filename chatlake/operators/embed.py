"""Embedding jobs: a pluggable model over pending windows, and a built-in bag-of-words model."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from typing import Protocol

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from chatlake.functions import splitting, vectors
from chatlake.operators import windows

BATCH = 64
TOKEN_BUDGET = 8192
OVERLAP = 32
WORD = r"\s*\S+"
DONE, REJECTED = "embedded", "rejected"

# The model's own buckets for words that mean the same.
SYNONYMS = [
    ["photo", "picture", "image"],
    ["trip", "travel", "journey"],
    ["locker", "cabinet", "cupboard"],
]
DIMS = 64
MIN_WORD_BYTES = 3


class Embedder(Protocol):
    """What a model must offer; loaded once per task by ``load``."""

    model_id: str
    dims: int
    max_distance: float
    query_prefix: str
    passage_prefix: str

    def load(self) -> None: ...

    def embed(self, texts: list[str]) -> list[list[float]]: ...


@dataclass(frozen=True)
class BagOfWords:
    """Facts of the native model below."""

    model_id: str = "bag-of-words-64"
    dims: int = DIMS
    max_distance: float = 0.9


def _bucket(word: bytes) -> int:
    for i, group in enumerate(SYNONYMS):
        if word.decode() in group:
            return i
    return int(hashlib.md5(word).hexdigest()[:8], 16) % (DIMS - len(SYNONYMS)) + len(SYNONYMS)


@F.arrow_udf(ArrayType(DoubleType()))
def _unit_counts(lowered: pa.Array, tokens: pa.Array) -> pa.Array:
    """Hashed counts of the words of each text at length one; each different word of a batch is hashed once."""
    rows = pa.RecordBatch.from_arrays([lowered, tokens, pa.array(np.arange(len(lowered)))], names=["lowered", "tokens", "row"])
    rows, words, n = splitting.words(rows, folded=False)
    coded = words.dictionary_encode()
    names = coded.dictionary.cast(pa.large_binary()).to_pylist()
    bucket = np.array([_bucket(w) if len(w) >= MIN_WORD_BYTES else -1 for w in names], np.int64)[coded.indices.to_numpy()]
    row = np.repeat(rows.column("row").to_numpy(), n)
    counts = np.bincount(row[bucket >= 0] * DIMS + bucket[bucket >= 0], minlength=len(lowered) * DIMS).astype(np.float64)
    counts = counts.reshape(len(lowered), DIMS)
    unit = counts / np.maximum(np.sqrt(np.square(counts).sum(axis=1, keepdims=True)), 1e-6)
    return pa.ListArray.from_arrays(pa.array(np.arange(len(lowered) + 1, dtype=np.int32) * DIMS), pa.array(unit.reshape(-1)))


def bag_of_words(rows: DataFrame, source: str, target: str = "v") -> DataFrame:
    """Add unit vectors of hashed word counts; synonyms share a bucket. Words are split and counted on Arrow batches."""
    return rows.withColumn(target, _unit_counts(*splitting.columns(F.col(source), folded=False)))


def token_parts(rows: DataFrame, key: str, source: str, most: int | None, overlap: int = OVERLAP) -> DataFrame:
    """(id, part, parts, tokens, text): texts of more than ``most`` words in overlapping parts, others whole as they are.

    A NULL text is an empty one. The parts of a text follow each other in its partition; without the overlaps they give
    all of its words.
    """
    body = F.coalesce(F.col(source), F.lit(""))
    words = rows.select(F.col(key).alias("id"), body.alias("text"), F.regexp_extract_all(body, F.lit(WORD), F.lit(0)).alias("_w"))
    n = F.size("_w")
    if most is None:
        return words.select("id", F.lit(0).alias("part"), F.lit(1).alias("parts"), n.alias("tokens"), "text")
    step = most - overlap
    if step < 1:
        raise ValueError("parts must be longer than their overlap")
    starts = F.sequence(F.lit(0), F.greatest(n - overlap - 1, F.lit(0)), F.lit(step))
    cut = words.withColumn("parts", F.size(starts)).select("*", F.posexplode(starts).alias("part", "_at"))
    text_ = F.when(n <= most, F.col("text")).otherwise(F.array_join(F.slice("_w", F.col("_at") + 1, F.lit(most)), ""))
    return cut.select("id", "part", "parts", F.least(n - F.col("_at"), F.lit(most)).alias("tokens"), text_.alias("text"))


def pack(tokens: np.ndarray, budget: int, most: int) -> Iterator[np.ndarray]:
    """Row numbers of batches, shortest texts first: at most ``most`` texts, and at most ``budget`` tokens when all are
    padded to the longest. A text over the budget is a batch of its own."""
    order = np.argsort(tokens, kind="stable")
    at = 0
    while at < len(order):
        ends = np.arange(1, min(most, len(order) - at) + 1)
        n = max(int((ends * tokens[order[at : at + len(ends)]] <= budget).sum()), 1)  # padded sizes never fall
        yield order[at : at + n]
        at += n


def _mean(parts: list, weights: list) -> list[float] | None:
    """Mean by tokens, as long as the parts are on average; none where a part has none."""
    if any(v is None for v in parts):
        return None
    if len(parts) == 1:
        return parts[0]
    vectors_, share = np.asarray(parts, dtype=np.float64), np.maximum(np.asarray(weights, dtype=np.float64), 1.0)
    mean = share @ vectors_ / share.sum()
    length = np.linalg.norm(mean)
    return (mean * (share @ np.linalg.norm(vectors_, axis=1) / share.sum() / length)).tolist() if length > 0 else mean.tolist()


def _embed_batches(model: Embedder, prefix: str, batch: int, budget: int):
    def attempt(texts: list[str]) -> list | None:
        try:
            out = model.embed(texts)
        except Exception:  # a model may reject any text in its own way
            return None
        return out if len(out) == len(texts) else None

    def vectors_of(texts: list[str], tokens: np.ndarray) -> list:
        done: list = [None] * len(texts)
        for chosen in pack(tokens, budget, batch):
            got = attempt([texts[k] for k in chosen])
            if got is None:  # one bad text must not cost the others
                singles = [attempt([texts[k]]) for k in chosen]
                got = [s[0] if s else None for s in singles]
            for k, v in zip(chosen, got, strict=True):
                done[k] = v
        return done

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model.load()
        parts, weights = [], []  # of the text that goes on in the next frame
        for pdf in frames:
            ids, out = [], []
            done = vectors_of([prefix + t for t in pdf["text"]], pdf["tokens"].to_numpy(np.int64))
            for key, part, of, n, v in zip(pdf["id"], pdf["part"], pdf["parts"], pdf["tokens"], done, strict=True):
                parts.append(v)
                weights.append(n)
                if part == of - 1:
                    ids.append(key)
                    out.append(_mean(parts, weights))
                    parts, weights = [], []
            yield pd.DataFrame({"id": pd.Series(ids, dtype="int64"), "v": pd.Series(out, dtype=object), "status": pd.Series([REJECTED if v is None else DONE for v in out], dtype=object)})

    return run


def embed_with(
    rows: DataFrame, key: str, source: str, model: Embedder, prefix: str | None = None, batch: int = BATCH, budget: int = TOKEN_BUDGET
) -> DataFrame:
    """Vectors of ``source`` by a plug-in model, in batches of texts of like length within a token budget.

    Texts over the model's ``max_tokens`` (if it has that member) go in overlapping parts, and their vectors are averaged, so
    all of every text is embedded. Rows a model rejects, wholly or a part of them, come back with status ``rejected`` and no
    vector. Tokens are words here; a model with shorter tokens states fewer.
    """
    most = getattr(model, "max_tokens", None)
    out = token_parts(rows, key, source, most, getattr(model, "overlap", OVERLAP)).mapInPandas(
        _embed_batches(model, model.passage_prefix if prefix is None else prefix, batch, budget),
        "id long, v array<double>, status string",
    )
    return out.withColumnRenamed("id", key)


def finish(windows_: DataFrame, embedded: DataFrame, model_id: str) -> DataFrame:
    """Vector rows of windows that still exist, one per window, with their int8 form."""
    current = windows_.select("window_id", "chat_id", "start_ts")
    one = embedded.dropDuplicates(["window_id"])
    return current.join(one, "window_id").select(
        "window_id",
        "chat_id",
        "start_ts",
        F.lit(model_id).alias("model_id"),
        "status",
        "v",
        F.when(F.col("v").isNotNull(), vectors.to_int8(F.col("v"))).alias("q"),
    )


def embed_pending(windows_: DataFrame, stored: DataFrame, model: Embedder | BagOfWords | None = None) -> DataFrame:
    """Vectors to append: all windows without one of the current model. Run again, it resumes by itself."""
    model = model or BagOfWords()
    waiting = windows.pending(windows_, stored, model.model_id)
    if isinstance(model, BagOfWords):
        embedded = bag_of_words(waiting.select("window_id", "text"), "text").withColumn("status", F.lit(DONE))
        return finish(waiting, embedded.drop("text"), model.model_id)
    return finish(waiting, embed_with(waiting, "window_id", "text", model), model.model_id)


def embed_queries(parsed: DataFrame, model: Embedder | BagOfWords | None = None) -> DataFrame:
    """Vectors of the free text of queries that have any."""
    from chatlake.operators import querytable

    model = model or BagOfWords()
    asked = parsed.filter(querytable.has_text()).select("query_id", querytable.free_text(parsed).alias("text"))
    if isinstance(model, BagOfWords):
        return bag_of_words(asked, "text").drop("text")
    return embed_with(asked, "query_id", "text", model, model.query_prefix).filter(F.col("status") == DONE).drop("status")


def coverage(windows_: DataFrame, stored: DataFrame, model_id: str) -> DataFrame:
    """Windows that are done (rejected ones count) of all windows."""
    done = stored.filter(F.col("model_id") == model_id).select("window_id", F.lit(1).alias("_done"))
    return windows_.join(done.dropDuplicates(["window_id"]), "window_id", "left").agg(
        F.count("_done").alias("done"), F.count(F.lit(1)).alias("windows")
    )

"""Quality classifier: supervised subword embeddings.

Every word and every character 3- to 5-gram of it (bytes, with the blanks around the word as its ends) is
hashed into a table of learned vectors. A document is the average of its vectors; a softmax layer turns the
average into class probabilities. Both are trained by plain stochastic gradient descent in numpy.

The average is linear, so for scoring the softmax layer is folded into the table: one number per bucket, half a
megabyte whatever the data, sent with the task. Scoring is a map over whole texts without a shuffle.

Cases: null and empty texts have no word and get the score of the learned bias; repeated rows get equal scores;
a table without labels, or with labels of one class only, gives a model that knows the class share only (0.5
without labels); null ids are scored, never learned from. Only ``doc_id`` and ``text`` are read.
"""

from __future__ import annotations

import sys
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chatlake.llm.common import documents, held_out, pair, query, small, table

BUCKETS = 1 << 17
GRAMS = (3, 4, 5)
BLOCK = 1 << 18
#: Labelled rows that the model is fitted on at most; which ones is decided by a hash of their id.
TRAIN_ROWS = 2000

_SPACE = np.zeros(256, np.int32)
_SPACE[[9, 10, 11, 12, 13, 32]] = 1
_MIX = np.uint64(0x9E3779B97F4A7C15)
_WORD = np.uint64(0xD6E8FEB86659FD93)
_SHIFT = np.uint64(64 - BUCKETS.bit_length() + 1)


def hashed(texts: list[bytes]):
    """Yield (bucket, place) arrays of all words and character n-grams of the joined texts, then the texts' starts.

    ``place`` is the byte where the piece starts, so that the owner of a piece follows from the starts.
    """
    joined = b" " + b"  ".join(texts) + b" " + bytes(8)
    starts = np.cumsum([0] + [len(t) + 2 for t in texts])[:-1]
    raw = np.frombuffer(joined, np.uint8)
    n = len(raw) - 8
    eight = np.ndarray((n,), "<u8", joined, strides=(1,))
    blank = np.concatenate([[0], np.cumsum(_SPACE[raw[:n]], dtype=np.int32)])
    pieces = []
    for size in GRAMS:
        at = np.flatnonzero(blank[size - 1 : n] == blank[1 : n - size + 2])
        at = at[at + size <= n]
        code = (eight[at] & np.uint64((1 << 8 * size) - 1)) * _MIX + np.uint64(size << 40)
        code ^= code >> np.uint64(29)
        pieces.append(((code * _MIX >> _SHIFT).astype(np.int64), at))
    inside = _SPACE[raw[:n]] == 0
    first = np.flatnonzero(inside[1:] & ~inside[:-1]) + 1
    if len(first):
        last = np.flatnonzero(inside[:-1] & ~inside[1:]) + 1
        # a word's hash: the sum of its bytes, each weighed by a power of its place in the word
        sums = np.concatenate([[np.uint64(0)], np.cumsum(np.where(inside, (raw[:n].astype(np.uint64) + np.uint64(1)) * _powers(n), np.uint64(0)))])
        code = (sums[last] - sums[first]) * _inverses(n)[first]
        code ^= code >> np.uint64(32)
        pieces.append(((code * _WORD >> _SHIFT).astype(np.int64), first))
    return pieces, starts


_CACHE: dict[str, np.ndarray] = {}


def _grown(name: str, factor: int, n: int) -> np.ndarray:
    have = _CACHE.get(name)
    if have is None or len(have) < n:
        steps = np.full(max(n, BLOCK), factor, np.uint64)
        steps[0] = 1
        have = _CACHE[name] = np.cumprod(steps, dtype=np.uint64)
    return have[:n]


def _powers(n: int) -> np.ndarray:
    return _grown("up", 0x100000001B3, n)


def _inverses(n: int) -> np.ndarray:
    return _grown("down", pow(0x100000001B3, -1, 1 << 64), n)


def blocks(texts: list[str | None]):
    """Lists of texts of about BLOCK bytes together; a longer text stands alone."""
    held, size, at = [], 0, 0
    for k, text in enumerate(texts):
        raw = (text or "").encode()
        if held and size + len(raw) > BLOCK:
            yield at, held
            held, size, at = [], 0, k
        held.append(raw)
        size += len(raw) + 2
    if held:
        yield at, held


@dataclass
class SubwordModel:
    """``folded``: what a bucket adds to the logit of class 1, ``bias``: the logit of a text without words."""

    folded: np.ndarray
    bias: float

    def score(self, texts: list[str | None]) -> np.ndarray:
        out = np.empty(len(texts))
        for at, held in blocks(texts):
            pieces, starts = hashed(held)
            total, count = np.zeros(len(held)), np.zeros(len(held))
            for bucket, place in pieces:
                cut = np.searchsorted(place, np.append(starts, np.iinfo(np.int64).max))
                run = np.concatenate([[0.0], np.cumsum(self.folded[bucket], dtype=np.float64)])
                total += run[cut[1:]] - run[cut[:-1]]
                count += cut[1:] - cut[:-1]
            out[at : at + len(held)] = total / np.maximum(count, 1) + self.bias
        # a fixed number of digits: the same text scores the same in any batch
        return np.round(1 / (1 + np.exp(-np.clip(out, -30, 30))), 6)


def fit(rows: list[tuple[int, np.ndarray, np.ndarray]], dims: int = 16, epochs: int = 6, rate: float = 0.5, seed: int = 7) -> SubwordModel:
    """Stochastic gradient descent over (label, buckets, counts) of each document."""
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1 / dims, 1 / dims, (BUCKETS, dims)).astype(np.float32)
    layer = np.zeros((2, dims), np.float32)
    ones = sum(r[0] for r in rows)
    bias = np.log(np.array([len(rows) - ones + 1, ones + 1], np.float32))
    if 0 < ones < len(rows):
        steps, done = epochs * len(rows), 0
        for _ in range(epochs):
            for k in rng.permutation(len(rows)):
                label, bucket, count = rows[k]
                step = rate * (1 - done / steps)
                done += 1
                if not len(bucket):
                    continue
                share = (count / count.sum()).astype(np.float32)
                hidden = share @ vectors[bucket]
                logit = layer @ hidden + bias
                p = np.exp(logit - logit.max())
                p /= p.sum()
                p[label] -= 1
                back = p @ layer
                layer -= step * np.outer(p, hidden)
                bias -= 0.1 * step * p
                # the average hands each vector its share only; the usual scale-up keeps the steps of use
                vectors[bucket] -= (step * 20 * share)[:, None] * back
    return SubwordModel((vectors @ (layer[1] - layer[0])).astype(np.float32), float(bias[1] - bias[0]))


def train(docs: DataFrame, labels: DataFrame, target: str = "quality", rows: int = TRAIN_ROWS) -> SubwordModel:
    """Learn from at most ``rows`` labelled documents outside the held-out third.

    The documents are turned into bucket counts on the executors; the driver gets at most ``rows`` vectors of at
    most BUCKETS entries each.
    """
    known = labels.select(labels["doc_id"].cast("long").alias("doc_id"), labels[target].cast("int").alias("label"))
    known = known.where(F.col("label").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    chosen = known.groupBy("doc_id").agg(F.min("label").alias("label")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    texts = pair(docs).join(F.broadcast(chosen), "doc_id").select("doc_id", "label", "text")

    def count(batches):
        for batch in small(batches):
            ids, label = batch.column(0), batch.column(1)
            buckets, counts = [], []
            for text in batch.column(2).to_pylist():
                pieces, _ = hashed([text.encode()])
                bucket, n = np.unique(np.concatenate([p[0] for p in pieces]), return_counts=True)
                buckets.append(bucket.astype("<i4").tobytes())
                counts.append(n.astype("<i4").tobytes())
            yield pa.RecordBatch.from_arrays([ids, label, pa.array(buckets, pa.binary()), pa.array(counts, pa.binary())], names=["doc_id", "label", "bucket", "n"])

    got = texts.mapInArrow(count, "doc_id long, label int, bucket binary, n binary").dropDuplicates(["doc_id"]).collect()
    got.sort(key=lambda r: r["doc_id"])
    return fit([(r["label"], np.frombuffer(r["bucket"], "<i4"), np.frombuffer(r["n"], "<i4")) for r in got])


def score(docs: DataFrame, model: SubwordModel) -> DataFrame:
    """docs + (score double, predicted int) by the whole text of each row."""
    fields = [f for f in docs.schema if f.name not in ("score", "predicted")]
    kept = docs.select(*[f.name for f in fields])

    def run(batches):
        for batch in small(batches, 512):
            at = batch.schema.names.index("text")
            s = model.score(batch.column(at).to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(s), pa.array((s >= 0.5).astype(np.int32))], names=[*batch.schema.names, "score", "predicted"])

    from pyspark.sql.types import DoubleType, IntegerType, StructType

    schema = StructType(fields).add("score", DoubleType()).add("predicted", IntegerType())
    return kept.mapInArrow(run, schema)


@query("op8_quality_classifier")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = train(docs, table(spark, sf_dir, "labels"))
    scored = score(pair(docs), model)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject."""
    model = train(docs, table(spark, sf_dir, "labels"))
    return score(docs, model).where("predicted = 1").select(*docs.columns)

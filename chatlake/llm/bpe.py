"""Byte-level BPE: overlapping chunk encoding and decoding.

A long text is cut into chunks that overlap. Each chunk is split into pre-tokens on its own, in parallel, as if a text
started there. Where a chunk and the one before it have a boundary of pre-tokens at the same place in their
overlap, the two splits have resynchronised: from there on both read the same text in the same state. The text is cut at
these places, and the pieces are encoded in parallel; the ids of a text are those of its pieces in order. Decoding
concatenates the raw bytes of the ids.

Boundaries close to the end of a chunk depend on what follows and do not count, nor do boundaries after white space, where the
pattern looks ahead. Should a chunk not resynchronise (a run longer than the overlap), the rest of that text is one piece.

Texts up to one chunk long are one piece and never leave their task; only chunks of longer texts are shuffled.
In a worker every different blank-separated piece of text is encoded once.

Cases: null text is empty and has no ids; repeated rows are encoded each; null ids stay. Other columns are not read.
"""

from __future__ import annotations

import base64
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chatlake.llm.common import documents, pair, query, small
from chatlake.llm.pieces import PieceMemo, packed
from chatlake.session import durable

RANKS = "byte_bpe_multi_50k.tiktoken"
CHUNK = 32_768
OVERLAP = 1_024
#: Characters before the end of a chunk where a boundary may still depend on what follows.
MARGIN = 4


@lru_cache(maxsize=4)
def ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


@lru_cache(maxsize=4)
def memo(path: str, pattern: str) -> PieceMemo:
    coder = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks(path), special_tokens={})
    return PieceMemo(lambda texts: [packed(coder.encode_ordinary(t)) for t in texts], limit=200_000)


@lru_cache(maxsize=4)
def tokens(path: str) -> list[bytes]:
    known = ranks(path)
    out = [b""] * (max(known.values()) + 1)
    for token, rank in known.items():
        out[rank] = token
    return out


def boundaries(chunk: str, last: bool, pattern: str = public_tokenizers.PATTERN) -> list[int]:
    """Ends of the pre-tokens of a chunk that do not depend on what follows it."""
    stop = len(chunk) if last else len(chunk) - MARGIN
    ends = [m.end() for m in regex.compile(pattern).finditer(chunk)]
    return [e for e in ends if e <= stop and not chunk[e - 1].isspace()]


def decode(ids: bytes, path: str) -> bytes:
    """The raw bytes of the ids one after the other."""
    return b"".join(map(tokens(path).__getitem__, np.frombuffer(ids, "<u4").tolist()))


def _ids(df: DataFrame, path: str, pattern: str) -> DataFrame:
    """df with ids binary in place of text, and decoded binary, which is made from the ids alone."""
    rest = [f for f in df.schema if f.name != "text"]

    def run(batches):
        coder = memo(path, pattern)
        for batch in small(batches):
            at = batch.schema.names.index("text")
            ids = coder.encode(batch.column(at).to_pylist())
            texts = [decode(x, path) for x in ids]
            keep = [k for k in range(batch.num_columns) if k != at]
            columns = [*[batch.column(k) for k in keep], pa.array(ids, pa.binary()), pa.array(texts, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=[*[batch.schema.names[k] for k in keep], "ids", "decoded"])

    from pyspark.sql.types import BinaryType, StructType

    return df.mapInArrow(run, StructType(list(rest)).add("ids", BinaryType()).add("decoded", BinaryType()))


def encode(docs: DataFrame, path: str, pattern: str = public_tokenizers.PATTERN, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """(doc_id, ids binary, decoded binary) of (doc_id, text): ids are little-endian unsigned 32-bit integers, and what they
    decode to comes with them, since a second pass of Python over all ids would only cost memory."""
    short = _ids(docs.where(F.char_length("text") <= chunk + overlap), path, pattern)
    long = docs.where(F.char_length("text") > chunk + overlap).withColumn("row", F.monotonically_increasing_id())
    starts = F.sequence(F.lit(0), F.char_length("text") - 1, F.lit(chunk))
    cut = long.select(
        "doc_id", "row", F.char_length("text").alias("n"), "text", F.explode(starts).alias("start")
    ).select("doc_id", "row", "n", "start", F.substring("text", F.col("start") + 1, F.lit(chunk + overlap)).alias("text"))
    cut = durable(cut)  # fixes the row numbers

    def split(batches):
        for batch in small(batches, 16):
            n, start, text = (batch.column(k).to_pylist() for k in (1, 2, 3))
            left, right = [], []
            for size, s, t in zip(n, start, text, strict=True):
                ends = boundaries(t, s + len(t) >= size, pattern)
                left.append([s + e for e in ends if e < overlap])
                right.append([s + e for e in ends if e >= chunk])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(left, pa.list_(pa.int64())), pa.array(right, pa.list_(pa.int64()))], names=["row", "start", "left", "right"])

    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # chunks of one text are dealt over all tasks
    zones = cut.repartition(tasks, "row", "start").select("row", "n", "start", "text").mapInArrow(split, "row long, start int, left array<long>, right array<long>")
    zones = durable(zones)
    before = zones.select("row", (F.col("start") + chunk).alias("start"), F.col("right").alias("theirs"))
    met = F.array_min(F.array_intersect("left", "theirs"))
    joined = zones.join(before, ["row", "start"], "left").select("row", "start", F.when(F.col("start") == 0, 0).otherwise(met).alias("at"))
    # after a chunk that does not resynchronise nothing is known, so the piece before it goes on to the end
    lost = joined.groupBy("row").agg(F.min(F.when(F.col("at").isNull(), F.col("start"))).alias("lost"))
    known = joined.join(lost, "row").select("row", "start", "at", "lost")
    after = known.select("row", (F.col("start") - chunk).alias("start"), F.col("at").alias("until"))
    known = known.join(after, ["row", "start"], "left")
    parts = cut.join(known, ["row", "start"])
    fine = parts.where("lost is null or start + %d < lost" % chunk).select(
        "doc_id", "row", F.col("start").alias("part"), F.substring("text", F.col("at") - F.col("start") + 1, F.coalesce("until", "n") - F.col("at")).alias("text")
    )
    rest = (
        parts.where("start + %d >= lost" % chunk)
        .groupBy("row", "doc_id", "lost")
        .agg(F.sort_array(F.collect_list(F.struct("start", "at", F.substring("text", 1, chunk).alias("text")))).alias("c"))  # of one text
        .select("doc_id", "row", (F.col("lost") - chunk).alias("part"), F.expr("substring(array_join(c.text, ''), c[0].at - c[0].start + 1)").alias("text"))
    )
    pieces = _ids(fine.union(rest).repartition(tasks, "row", "part"), path, pattern)
    whole = pieces.groupBy("row", "doc_id").agg(F.sort_array(F.collect_list(F.struct("part", "ids", "decoded"))).alias("p"))  # of one text
    ids = F.aggregate("p", F.lit(b""), lambda a, x: F.concat(a, x["ids"]))
    return short.union(whole.select("doc_id", ids, F.aggregate("p", F.lit(b""), lambda a, x: F.concat(a, x["decoded"]))))


@query("op1_byte_bpe")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path(RANKS)
    coded = encode(pair(documents(spark, sf_dir)), path)
    return coded.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids binary, text): the ids of each text and the text decoded from them."""
    path = public_tokenizers.path(RANKS)
    coded = encode(pair(docs), path)
    return coded.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), "ids", F.decode("decoded", "UTF-8").alias("text"))

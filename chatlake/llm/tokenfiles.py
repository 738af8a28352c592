"""Token ids in Arrow stream files of equal-length sequences.

A file is one Arrow IPC stream. Each row is a sequence: ``ids``, a fixed-size list of ``length`` token ids, and ``mask``,
a fixed-size list of booleans that says which of them are tokens and which fill up the end of the file. The ids of the
documents follow each other, each document closed by the end id, and run on over the edges of sequences. ``doc_ids`` and
``doc_starts`` name the documents that begin in a sequence and where. All batches but the last have ``ROWS`` rows, so the
k-th sequence is row k % ROWS of batch k // ROWS, and reading it copies nothing: it is a view of the file's bytes.
Ids take two bytes if the vocabulary allows it, else four.

The documents are range-partitioned by id into files of about ``FILE_BYTES`` of text, sorted, encoded and written in the same
task by Spark's text writer, whose commit makes lost tasks harmless. The writer ends a row with a separator;
a zero byte is used, which stands behind the end mark of the stream. A task holds one file.

Cases: null text is empty, such a document is its end id alone; repeated ids stand next to each other, ordered by text;
rows with null id come first; an empty table gives an empty folder. A text longer than a file makes a file longer, up to
the 2 GB of a row. Only id and text columns are read.
"""

from __future__ import annotations

import os
import uuid
import zlib
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chatlake.llm.common import documents, pair, query, small_transfers
from chatlake.llm.pieces import PieceMemo, regular
from chatlake.session import durable, ensure_checkpoint_dir

TOKENIZER = "byte_bpe_50k.json"
LENGTH = 2048
ROWS = 512
FILE_BYTES = 16 << 20
END = 2
#: Words that the library encodes in one call.
WORDS = 10_000


@lru_cache(maxsize=2)
def coder(path: str) -> tuple[PieceMemo, np.dtype]:
    """Encoder of whole texts and the type of its ids."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark has all cores busy
    from tokenizers import Tokenizer

    known = Tokenizer.from_file(path)
    kind = np.dtype("<u2" if known.get_vocab_size() <= 1 << 16 else "<u4")

    blank = np.zeros(known.get_vocab_size(), bool)
    blank[[i for token, i in known.get_vocab().items() if token.startswith("\u0120")]] = True  # the sign for a blank

    def encode(texts: list[str]) -> list[np.ndarray]:
        return [np.array(x.ids, kind) for x in known.encode_batch_fast(texts, add_special_tokens=False)]

    def many(texts: list[str]) -> list[bytes]:
        return [ids.tobytes() for ids in encode(texts)]

    def words(texts: list[str]) -> list[bytes]:
        """One call for all words: in their join each starts where a token starts with a blank. Those that hold white space go one by one."""
        if len(texts) > WORDS:  # the library holds about a hundred bytes a token until it is done
            return [ids for at in range(0, len(texts), WORDS) for ids in words(texts[at : at + WORDS])]
        if not texts:
            return []
        joined = " ".join(texts)
        if joined.count(" ") != len(texts) - 1 or "" in texts or not regular(joined):
            plain = [k for k, t in enumerate(texts) if t and t.split() == [t]]
            out = dict(zip(plain, words([texts[k] for k in plain]), strict=True)) if len(plain) < len(texts) else {}
            other = [k for k in range(len(texts)) if k not in out]
            out.update(zip(other, many([" " + texts[k] for k in other]), strict=True))
            return [out[k] for k in range(len(texts))]
        ids = encode([" " + joined])[0]
        raw, edges = ids.tobytes(), np.append(np.flatnonzero(blank[ids]), len(ids)) * kind.itemsize
        if len(edges) != len(texts) + 1:
            raise ValueError("tokens do not follow the words")
        return [raw[a:z] for a, z in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)]

    return PieceMemo(many, limit=600_000, width=kind.itemsize, encode_words=words), kind


# ---------------------------------------------------------------- the format
def write_stream(doc_ids: list[int | None], lengths: list[int], ids: np.ndarray, length: int = LENGTH) -> bytes:
    """The bytes of a file with the ids of documents, ``lengths`` of each."""
    n = -(-len(ids) // length)
    padded = np.zeros(n * length, ids.dtype)
    padded[: len(ids)] = ids
    mask = np.zeros(n * length, bool)
    mask[: len(ids)] = True
    starts = np.cumsum(lengths) - lengths
    edges = np.searchsorted(starts, np.arange(n + 1) * length).astype(np.int32)
    columns = [
        pa.FixedSizeListArray.from_arrays(pa.array(padded), length),
        pa.FixedSizeListArray.from_arrays(pa.array(mask), length),
        pa.ListArray.from_arrays(edges, pa.array(doc_ids, pa.int64())),
        pa.ListArray.from_arrays(edges, pa.array((starts % length).astype(np.int32))),
    ]
    whole = pa.RecordBatch.from_arrays(columns, names=["ids", "mask", "doc_ids", "doc_starts"])
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, whole.schema) as out:
        for at in range(0, n, ROWS):
            out.write_batch(whole.slice(at, ROWS))
    return sink.getvalue().to_pybytes()


class TokenFile:
    """A file read from a buffer; nothing is copied until asked for."""

    def __init__(self, buffer):
        self.batches = list(pa.ipc.open_stream(pa.py_buffer(buffer)))

    def __len__(self) -> int:
        return sum(b.num_rows for b in self.batches)

    def sequence(self, k: int) -> np.ndarray:
        """The ids of the k-th sequence, a view of the file's bytes."""
        return self.batches[k // ROWS].column(0)[k % ROWS].values.to_numpy(zero_copy_only=True)

    def mask(self, k: int) -> np.ndarray:
        return self.batches[k // ROWS].column(1)[k % ROWS].values.to_numpy(zero_copy_only=False)

    def documents(self):
        """Yield (doc_id, place of its first id in the file, its ids with the end id)."""
        if not self.batches:
            return
        length = self.batches[0].column(0).type.list_size
        ids = np.concatenate([b.column(0).flatten().to_numpy(zero_copy_only=True) for b in self.batches])
        used = sum(b.column(1).flatten().true_count for b in self.batches)
        doc_ids, starts, row = [], [], 0
        for b in self.batches:
            for names, places in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                doc_ids += names
                starts += [row * length + p for p in places]
                row += 1
        for doc_id, a, z in zip(doc_ids, starts, [*starts[1:], used], strict=True):
            yield doc_id, a, ids[a:z]


# ---------------------------------------------------------------- the jobs
def write(docs: DataFrame, folder: str, tokenizer: str, end: int = END, length: int = LENGTH, file_bytes: int = FILE_BYTES) -> None:
    """Write (doc_id, text) as token files in ascending order of ids."""
    small_transfers(docs.sparkSession)
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    files = max(docs.sparkSession.sparkContext.defaultParallelism, -(-size // file_bytes))
    ordered = docs.repartitionByRange(int(files), "doc_id").sortWithinPartitions("doc_id", "text")

    def run(batches):
        memo, kind = coder(tokenizer)
        closing = np.array([end], kind).tobytes()
        doc_ids, parts = [], []
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                doc_ids += part.column(0).to_pylist()
                parts += [x + closing for x in memo.encode(part.column(1).to_pylist())]
        if parts:
            lengths = [len(x) // kind.itemsize for x in parts]
            ids = np.frombuffer(b"".join(parts), kind)
            del parts
            yield pa.RecordBatch.from_arrays([pa.array([write_stream(doc_ids, lengths, ids, length)], pa.binary())], names=["file"])

    streams = ordered.mapInArrow(run, "file binary")
    streams.select(F.col("file").cast("string")).write.option("lineSep", "\0").text(folder)


def read(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of each document in the token files of a folder."""
    files = spark.read.format("binaryFile").load(folder).where("length > 1").select("path", "content")

    def run(batches):
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                rows = [(d, a, len(x), zlib.crc32(x.astype("<u4").tobytes())) for d, a, x in TokenFile(content.as_buffer()).documents()]
                columns = [[r[k] for r in rows] for k in range(4)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([path] * len(rows), pa.string()), *[pa.array(c, pa.int64()) for c in columns]], names=["path", "doc_id", "place", "n_tokens", "ids_crc32"]
                )

    found = durable(files.mapInArrow(run, "path string, doc_id long, place long, n_tokens long, ids_crc32 long"))
    # one row per file: what stands before it in all files
    each = found.groupBy("path").agg(F.sum("n_tokens").alias("n"), F.min("doc_id").alias("first"))
    before = Window.orderBy(F.col("first").asc_nulls_first(), "path").rowsBetween(Window.unboundedPreceding, -1)
    base = each.select("path", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    return found.join(base, "path").select("doc_id", (F.col("base") + F.col("place")).alias("start"), "n_tokens", "ids_crc32")


@query("op10_token_files")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    ensure_checkpoint_dir(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/tokens-{uuid.uuid4().hex}"
    write(pair(documents(spark, sf_dir)), folder, public_tokenizers.path(TOKENIZER))
    return read(spark, folder)

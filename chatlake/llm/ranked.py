"""Ranked lexical search of a table of items against all documents, by groups of equal presence masks.

Weights. A term's weight is floor(1000 * ln((2 * N + 2) / (2 * df + 1))), a document's m is 50 + (50 * n * N) div L, and
its score for an item is the sum of weight * ((1000000000 * tf) div (1000 * tf + 20 * m)) over the item's terms. N counts
documents with a term, L all terms, n those of one document, df documents that hold a term, tf its places in one.

Masks. Of a block of documents every term has the list of those that hold it. For an item these lists are or-ed
into one bitmap per document, a bit for each of the item's terms; documents with equal bitmaps are one group. No document
of a group can score more than the sum of weight times the block's largest tf part over the mask's terms. Groups are
taken by falling bound and their documents scored in full, until the bound is below the score of the item's worst
kept document: what is left cannot get in (at an equal bound a smaller id might, so equal ones are taken).

Scale. Items go in blocks of at most ``BLOCK_ITEMS`` rows or ``BLOCK_CHARS`` characters; of a block only is anything in the driver,
the terms, their counts and the items. Each block reads the documents once: whole texts are cut into words by numpy,
a document's known terms are written as small integers, and counting and ranking read this table. A task keeps at most
``k`` documents per item, over all its documents, so the shuffle carries at most k rows per item and task, whatever
words an item has. Words are found by a 64-bit hash and verified byte by byte.

Cases. Null texts have no terms. Items are the distinct rows of (id, text); those without terms, and documents without a
term of the item, give no rows. Every row of documents counts, also repeated ones and those without id, which come last among
equal scores. Items of any number of terms work (masks of more than 63 bits are several words). Columns other than
those named do not matter.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from string import ascii_lowercase, ascii_uppercase

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chatlake.llm.common import documents, drop_written, query, small, spark_schema, table
from chatlake.llm.words import WORD_BYTE, word_hashes
from chatlake.session import durable

K = 50
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
BLOCK_ITEMS = 500
BLOCK_CHARS = 1 << 20
#: Bytes of text and documents handled at once in a task.
CHUNK = 1 << 20
DOCS = 4096

_LOWER = str.maketrans(ascii_uppercase, ascii_lowercase)
_LOWER_BYTES = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)
_MASK_BITS = 63
_NO_ID = np.iinfo(np.int64).max


def terms_of(text: str | None) -> list[str]:
    """The distinct terms of a text, in order."""
    return list(dict.fromkeys(re.findall(TERM, (text or "").translate(_LOWER))))


class Vocabulary:
    """Terms by number, found in many texts at once."""

    def __init__(self, terms: list[str]):
        raw = [t.encode() for t in terms]
        self.size = len(raw)
        self.length = np.array([len(t) for t in raw], np.int64)
        self.start = np.concatenate([[0], np.cumsum(self.length)[:-1]]).astype(np.int64)
        self.bytes = np.frombuffer(b"".join(raw), np.uint8)
        joined = np.frombuffer(b" ".join(raw), np.uint8)
        code = word_hashes(joined)[0]
        self.order = np.argsort(code)
        self.code = code[self.order]
        if (self.code[1:] == self.code[:-1]).any():
            raise ValueError("two terms with one hash")

    def find(self, raw: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts of all words in lower-cased bytes that end in a blank; places (of these) and numbers of those known."""
        code, first = word_hashes(raw)
        if not len(code) or not self.size:
            return first, np.empty(0, np.int64), np.empty(0, np.int64)
        at = np.minimum(np.searchsorted(self.code, code), self.size - 1)
        place = np.flatnonzero(self.code[at] == code)
        number = self.order[at[place]]
        length, start = self.length[number], first[place]
        right = ~WORD_BYTE[raw[np.minimum(start + length, len(raw) - 1)]]
        offset = np.arange(int(length.sum())) - np.repeat(np.cumsum(length) - length, length)
        inside = np.minimum(np.repeat(start, length) + offset, len(raw) - 1)
        differs = raw[inside] != self.bytes[np.repeat(self.start[number], length) + offset]
        right[np.repeat(np.arange(len(length)), length)[differs]] = False
        return first, place[right], number[right]


def _parts(raw: np.ndarray) -> Iterator[np.ndarray]:
    """The bytes in parts of about CHUNK, cut where no word is."""
    at = 0
    while len(raw) - at > CHUNK:
        stop = at + CHUNK
        free = np.flatnonzero(~WORD_BYTE[raw[at:stop]])
        if len(free):
            stop = at + int(free[-1]) + 1
        else:
            later = np.flatnonzero(~WORD_BYTE[raw[stop:]])
            stop = stop + int(later[0]) + 1 if len(later) else len(raw)
        yield raw[at:stop]
        at = stop
    yield raw[at:]


def counts(texts: list[str | None], vocabulary: Vocabulary) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """n of every text, and (text, term, tf) of the known terms, ordered by text."""
    n = np.zeros(len(texts), np.int64)
    found: list[np.ndarray] = []
    held: list[tuple[int, np.ndarray]] = []
    size = 0
    blank = np.array([32], np.uint8)

    def flush():
        raw = _LOWER_BYTES[np.concatenate([x for _, part in held for x in (part, blank)])]
        edges = np.cumsum([len(part) + 1 for _, part in held])
        owner = np.array([k for k, _ in held], np.int64)
        first, place, number = vocabulary.find(raw)
        whose = owner[np.searchsorted(edges, first, "right")]
        np.add.at(n, whose, 1)
        found.append(whose[place] * max(vocabulary.size, 1) + number)

    for k, text in enumerate(texts):
        for part in _parts(np.frombuffer((text or "").encode(), np.uint8)):
            held.append((k, part))
            size += len(part)
            if size > CHUNK:
                flush()
                held, size = [], 0
    if held:
        flush()
    pair, tf = np.unique(np.concatenate(found), return_counts=True) if found else (np.empty(0, np.int64), np.empty(0, np.int64))
    text, term = np.divmod(pair, max(vocabulary.size, 1))
    return n, text, term, tf


ENCODED = "doc_id long, n long, terms array<int>, tfs array<int>"


def encoded(docs: DataFrame, terms: list[str]) -> DataFrame:
    """Documents with at least one term: their number of terms, the known ones as numbers, with counts."""
    schema = spark_schema(docs.sparkSession, ENCODED)

    def run(batches):
        vocabulary = Vocabulary(terms)
        for batch in small(batches, 512):
            n, text, term, tf = counts(batch.column(1).to_pylist(), vocabulary)
            edges = np.searchsorted(text, np.arange(len(n) + 1)).astype(np.int32)
            lists = [pa.ListArray.from_arrays(pa.array(edges), pa.array(x.astype(np.int32))) for x in (term, tf)]
            whole = pa.RecordBatch.from_arrays([batch.column(0), pa.array(n), *lists], names=schema.names)
            yield whole.filter(pa.array(n > 0)).cast(schema)

    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"))
    return rows.mapInArrow(run, ENCODED)


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def lengths(n: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """m of documents with ``n`` terms."""
    if int(n.max(initial=0)) * 50 * n_docs < 1 << 63:
        return 50 + (50 * n * n_docs) // n_terms
    return np.array([50 + (50 * int(x) * n_docs) // n_terms for x in n], np.int64)


class Block:
    """A block of documents: its postings by document and by term, with the part of the score that tf and m decide."""

    def __init__(self, doc_id: np.ndarray, edges: np.ndarray, term: np.ndarray, tf: np.ndarray, m: np.ndarray, size: int):
        self.doc_id, self.edges, self.term = doc_id, edges, term
        doc = np.repeat(np.arange(len(doc_id)), np.diff(edges))
        tf = tf.astype(np.int64)
        self.part = (1_000_000_000 * tf) // (1000 * tf + 20 * m[doc])
        order = np.argsort(term, kind="stable")
        self.docs = doc[order]
        self.bounds = np.searchsorted(term[order], np.arange(size + 1))
        self.most = np.zeros(size, np.int64)
        np.maximum.at(self.most, term, self.part)

    def masks(self, terms: np.ndarray) -> np.ndarray:
        """One bitmap per document, of as many words as the terms need."""
        words = np.zeros((-(-len(terms) // _MASK_BITS), len(self.doc_id)), np.int64)
        for bit, t in enumerate(terms.tolist()):
            held = self.docs[self.bounds[t] : self.bounds[t + 1]]
            if len(held):
                words[bit // _MASK_BITS][held] |= np.int64(1 << (bit % _MASK_BITS))
        return words

    def scores(self, docs: np.ndarray, worth: np.ndarray) -> np.ndarray:
        """Full scores of some documents; ``worth`` has the item's weights by term, zero for others."""
        size = self.edges[docs + 1] - self.edges[docs]
        ends = np.cumsum(size)
        at = np.repeat(self.edges[docs] - (ends - size), size) + np.arange(int(size.sum()))
        sums = np.concatenate([[0], np.cumsum(worth[self.term[at]] * self.part[at])])
        return sums[ends] - sums[ends - size]


class Best:
    """The ``k`` best documents of one item, of all blocks so far. Counts the documents it scored."""

    def __init__(self, terms: np.ndarray, weights: np.ndarray, k: int):
        self.terms, self.weights, self.k = terms, weights, k
        self.score, self.doc = np.empty(0, np.int64), np.empty(0, np.int64)
        self.scored = 0

    def _floor(self) -> int:
        return int(self.score[-1]) if len(self.score) == self.k else 1

    def add(self, block: Block, worth: np.ndarray) -> None:
        words = block.masks(self.terms)
        some = np.flatnonzero(words.any(axis=0))
        if not len(some):
            return
        if len(words) == 1:
            mask, group = np.unique(words[0][some], return_inverse=True)
            mask = mask[None]
        else:
            mask, group = np.unique(words[:, some], axis=1, return_inverse=True)
        bound = np.zeros(mask.shape[1], np.int64)
        for bit, t in enumerate(self.terms.tolist()):
            bound += ((mask[bit // _MASK_BITS] >> (bit % _MASK_BITS)) & 1) * (self.weights[bit] * block.most[t])
        order = np.argsort(-bound, kind="stable")
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        by_group = some[np.argsort(rank[group.ravel()], kind="stable")]
        ends = np.cumsum(np.bincount(rank[group.ravel()], minlength=len(order)))
        bound = bound[order]
        worth[self.terms] = self.weights
        done, step = 0, self.k
        while done < len(order):
            reach = int(np.searchsorted(-bound, -self._floor(), "right"))  # masks whose bound is at least the floor
            if reach <= done:
                break
            before = int(ends[done - 1]) if done else 0
            until = min(reach, int(np.searchsorted(ends, before + step)) + 1)
            docs = by_group[before : ends[until - 1]]
            self._keep(block.scores(docs, worth), block.doc_id[docs])
            done, step = until, step * 2
        worth[self.terms] = 0

    def _keep(self, score: np.ndarray, doc: np.ndarray) -> None:
        self.scored += len(score)
        good = score >= self._floor()
        score, doc = np.concatenate([self.score, score[good]]), np.concatenate([self.doc, doc[good]])
        order = np.lexsort((doc, -score))[: self.k]
        self.score, self.doc = score[order], doc[order]


FOUND = "item int, doc_id long, score long"


def _ranked(table_: DataFrame, items: list[list[int]], df: list[int], n_docs: int, n_terms: int, k: int) -> DataFrame:
    """The best documents of every item of each task."""
    size = len(df)
    schema = spark_schema(table_.sparkSession, FOUND)

    def run(batches):
        weights = np.array([weight(n_docs, x) for x in df], np.int64)
        best = [Best(np.array(t, np.int64), weights[t], k) for t in items]
        worth = np.zeros(size, np.int64)
        for batch in small(batches, DOCS):
            ids, n, terms, tfs = batch.columns
            edges = terms.offsets.to_numpy().astype(np.int64)
            flat = [x.flatten().to_numpy(zero_copy_only=False) for x in (terms, tfs)]
            m = lengths(n.to_numpy(zero_copy_only=False), n_docs, n_terms)
            doc_id = ids.fill_null(_NO_ID).to_numpy(zero_copy_only=False)
            block = Block(doc_id, edges - edges[0], *flat, m, size)
            for one in best:
                one.add(block, worth)
        for number, one in enumerate(best):
            doc = pa.array(one.doc, mask=one.doc == _NO_ID)
            yield pa.RecordBatch.from_arrays([pa.array([number] * len(one.doc), pa.int32()), doc, pa.array(one.score)], schema=schema)

    return table_.mapInArrow(run, FOUND)


def item_blocks(items: DataFrame, item_id: str, rows: int, chars: int) -> Iterator[list[tuple]]:
    """(id, terms) of the distinct items, in blocks; one block at a time is in the driver."""
    held, size = [], 0
    for row in items.select(items[item_id].cast("long"), items["text"].cast("string")).distinct().toLocalIterator():
        terms = terms_of(row[1])
        if not terms:
            continue
        held.append((row[0], terms))
        size += len(row[1])
        if len(held) >= rows or size >= chars:
            yield held
            held, size = [], 0
    if held:
        yield held


def search(docs: DataFrame, items: DataFrame, item_id: str = "item_id", k: int = K, rows: int = BLOCK_ITEMS, chars: int = BLOCK_CHARS) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``k`` best documents of every item, those with scores above zero."""
    spark = docs.sparkSession
    out = None
    for block in item_blocks(items, item_id, rows, chars):
        terms = list(dict.fromkeys(t for _, found in block for t in found))
        number = {t: i for i, t in enumerate(terms)}
        table_ = durable(encoded(docs, terms))
        n_docs, n_terms = table_.agg(F.count(F.lit(1)), F.sum("n")).first()
        if not n_docs:
            break
        df = [0] * len(terms)
        for term, count in table_.select(F.explode("terms").alias("t")).groupBy("t").count().collect():  # one row per term of the block
            df[term] = count
        found = _ranked(table_, [[number[t] for t in x] for _, x in block], df, n_docs, n_terms, k)
        by_rank = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
        top = found.withColumn("rank", F.row_number().over(by_rank)).where(F.col("rank") <= k)
        names = spark.createDataFrame([(i, x[0]) for i, x in enumerate(block)], "item int, item_id long")
        best = durable(top.join(F.broadcast(names), "item").select(F.col("item_id").alias(item_id), "rank", "doc_id", "score"))
        drop_written(table_)
        out = best if out is None else out.unionByName(best)
    return out if out is not None else spark.createDataFrame([], f"{item_id} long, rank int, doc_id long, score long")


SQL = rf"""
WITH words AS (
  SELECT row_no, doc_id, unnest(regexp_extract_all(translate(text, '{ascii_uppercase}', '{ascii_lowercase}'), '{TERM}')) AS term
  FROM (SELECT row_number() OVER () AS row_no, doc_id, text FROM documents)
), docs AS (
  SELECT row_no, any_value(doc_id) AS doc_id, count(*) AS n FROM words GROUP BY row_no
), corpus AS (
  SELECT count(*) AS n_docs, sum(n)::BIGINT AS n_terms FROM docs
), places AS (
  SELECT row_no, term, count(*) AS tf FROM words GROUP BY row_no, term
), items AS (
  SELECT row_number() OVER () AS item, item_id, text FROM (SELECT DISTINCT item_id, text FROM benchmark)
), wanted AS (
  SELECT DISTINCT item, item_id, unnest(regexp_extract_all(translate(text, '{ascii_uppercase}', '{ascii_lowercase}'), '{TERM}')) AS term
  FROM items
), weights AS (
  SELECT term, floor(1000 * ln((2 * n_docs + 2) / (2 * count(*) + 1)))::BIGINT AS w FROM places, corpus GROUP BY term, n_docs
), scores AS (
  SELECT item, item_id, row_no, doc_id,
         sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + (50 * n * n_docs) // n_terms))))::BIGINT AS score
  FROM wanted JOIN weights USING (term) JOIN places USING (term) JOIN docs USING (row_no), corpus
  GROUP BY item, item_id, row_no, doc_id
), best AS (
  SELECT *, row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id NULLS LAST)::INT AS rank FROM scores WHERE score > 0
)
SELECT item_id, rank, doc_id, score FROM best WHERE rank <= {K}
"""


@query("op13_ranked_search", SQL)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(documents(spark, sf_dir), table(spark, sf_dir, "benchmark"))

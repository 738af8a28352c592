"""Benchmark decontamination by random-walk embedding of edit distance.

A document holds an item if some stretch of its words can be made into the item's words by at most
``(1 - similarity) * n`` insertions, deletions and replacements of words, n being the item's number of words.

Candidates. A random walk reads a window of words as long as the item: at each of 3n steps it writes the word it
stands on, and a random bit, the same for the same step and word, says whether it goes on. Walks over texts that
differ by few edits fall into step again, so edit distance becomes Hamming distance of what is written. Each of a
number of repetitions has its own bits and compares some sampled steps; a window and an item that agree on all of
them are a candidate. The number of repetitions follows from the wished recall: items are edited at random as far
as the threshold allows, and the agreement of their walks is measured.

Windows are read where an item can start: if there are at most k edits, one of k + 1 pieces of the item is left
whole, so a window starts where such a piece stands in the text, less the place of the piece in the item. This
loses no match. Candidates are verified by the exact edit distance of the item to any stretch there.

Scale. Documents are read once, by a map without a shuffle. The items go to every task in blocks of at most
``BLOCK_ITEMS`` items and ``BLOCK_WORDS`` words, checked; a larger benchmark takes one pass over the documents per block.

Cases: words are runs of letters and digits, lower-cased; null texts have no words; items under ``MIN_WORDS`` words are
no evidence and match nothing; equal items are all reported; rows with null doc_id are searched like others; rows with null item_id are
no items; repeated documents are each reported. Empty tables give empty results. Only id and text columns are read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chatlake.llm.common import documents, pair, query, small, table
from chatlake.llm.words import words_of

SIMILARITY = 0.8
MIN_WORDS = 5
RECALL = 0.99
SAMPLED = 2
MAX_REPEATS = 64
BLOCK_ITEMS = 20_000
BLOCK_WORDS = 1_000_000
_ODD, _STEP = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)
_END = np.uint64(0x2545F4914F6CDD1D)


def walks(words: np.ndarray, start: np.ndarray, n: np.ndarray, seeds: np.ndarray, spots: np.ndarray) -> np.ndarray:
    """(repetitions x windows): the sampled words of the walk over each window, hashed together.

    Places outside the array of words read as an end mark. ``spots`` are the sampled steps as shares of the walk.
    """
    repeats, m = len(seeds), len(start)
    key = np.tile(n.astype(np.uint64) * _ODD, (repeats, 1))
    at = np.zeros((repeats, m), np.int64)
    chosen = (spots[:, :, None] * (3 * n)).astype(np.int64)  # repetitions x samples x windows
    open_ = (start >= 0) & (start + n <= len(words))
    safe = np.where(open_, start, 0)
    step_seeds = np.arange(1, 3 * int(n.max(initial=0)) + 1, dtype=np.uint64) * _STEP
    for step in range(int(3 * n.max()) if m else 0):
        reads = (at < n) & open_
        word = np.where(reads, words[np.minimum(safe + at, len(words) - 1)], _END)
        for k in range(chosen.shape[1]):
            hit = chosen[:, k] == step
            if hit.any():
                fresh = (key ^ word) * _STEP
                key = np.where(hit, fresh ^ (fresh >> np.uint64(30)), key)
        mixed = (word ^ (seeds[:, None] + step_seeds[step])) * _ODD
        mixed ^= mixed >> np.uint64(32)
        at += (mixed * _STEP >> np.uint64(63)).astype(np.int64)
    return key


def stretch_distance(item: np.ndarray, text: np.ndarray) -> tuple[int, int]:
    """(least edits that make some stretch of the text the item, the stretch's end)."""
    steps = np.arange(len(text) + 1)
    row = np.zeros(len(text) + 1, np.int64)
    for k, word in enumerate(item):
        fresh = np.empty_like(row)
        fresh[0] = k + 1
        fresh[1:] = np.minimum(row[:-1] + (text != word), row[1:] + 1)
        row = np.minimum.accumulate(fresh - steps) + steps
    end = int(row.argmin())
    return int(row[end]), end


@dataclass
class Benchmark:
    """A block of items, ready to be looked for."""

    ids: list[int]
    words: list[np.ndarray]
    similarity: float = SIMILARITY
    recall: float = RECALL

    def __post_init__(self):
        self.n = np.array([len(w) for w in self.words], np.int64)
        self.edits = np.floor((1 - self.similarity) * self.n + 1e-9).astype(np.int64)
        self._pieces()
        self._sample()

    def _pieces(self) -> None:
        found: dict[int, list[tuple[int, int, int]]] = {}
        for item, (words, edits) in enumerate(zip(self.words, self.edits.tolist(), strict=True)):
            cut = np.linspace(0, len(words), edits + 2).astype(int)
            for a, z in zip(cut[:-1], cut[1:], strict=True):
                found.setdefault(int(z - a), []).append((int(chain(words[a:z], int(z - a))[0]), item, int(a)))
        self.pieces = {}
        for size, rows in found.items():
            rows.sort()
            code, item, place = np.array([r[0] for r in rows], np.uint64), np.array([r[1] for r in rows]), np.array([r[2] for r in rows])
            seen = np.zeros(1 << 16, bool)
            seen[(code >> np.uint64(48)).astype(np.int64)] = True
            self.pieces[size] = (seen, code, item, place)

    def _sample(self) -> None:
        rng = np.random.default_rng(11)
        self.seeds = rng.integers(1, 1 << 63, MAX_REPEATS).astype(np.uint64)
        self.spots = rng.random((MAX_REPEATS, SAMPLED)) * 0.999
        if not self.words:
            return
        # how often a window and the item it comes from agree, with as many edits as are allowed
        pick = rng.permutation(len(self.words))[:200]
        edited = []
        for k in pick:
            w = self.words[k].copy()
            for _ in range(int(self.edits[k])):
                at, kind = rng.integers(len(w)), rng.integers(3)
                other = rng.integers(1, 1 << 63, 1).astype(np.uint64)
                w = np.delete(w, at) if kind == 0 and len(w) > 1 else np.insert(w, at, other) if kind == 1 else np.concatenate([w[:at], other, w[at + 1 :]])
            edited.append(np.resize(w, self.n[k]) if len(w) >= self.n[k] else np.concatenate([w, np.zeros(self.n[k] - len(w), np.uint64)]))
        start, n = np.cumsum(self.n[pick]) - self.n[pick], self.n[pick]
        same = walks(np.concatenate([self.words[k] for k in pick]), start, n, self.seeds, self.spots)
        agree = (same == walks(np.concatenate(edited), start, n, self.seeds, self.spots)).mean()
        repeats = int(np.ceil(np.log(1 - self.recall) / np.log(1 - min(max(agree, 1e-3), 0.999))))
        self.seeds, self.spots = self.seeds[: min(repeats, MAX_REPEATS)], self.spots[: min(repeats, MAX_REPEATS)]
        own = walks(np.concatenate(self.words), np.cumsum(self.n) - self.n, self.n, self.seeds, self.spots)
        self.order = np.argsort(own, axis=1)
        self.keys = np.take_along_axis(own, self.order, axis=1)

    def windows(self, words: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(start, length in words) of the distinct windows where an item can stand."""
        starts, sizes = [], []
        for size, (seen, code, item, place) in self.pieces.items():
            if len(words) < size:
                continue
            here = chain(words, size)
            maybe = np.flatnonzero(seen[(here >> np.uint64(48)).astype(np.int64)])
            maybe = maybe[doc[maybe] == doc[maybe + size - 1]]
            low, high = np.searchsorted(code, here[maybe], "left"), np.searchsorted(code, here[maybe], "right")
            width = high - low
            which = np.repeat(low, width) + np.arange(width.sum()) - np.repeat(np.cumsum(width) - width, width)
            starts.append(np.repeat(maybe, width) - place[which])
            sizes.append(self.n[item[which]])
        if not starts:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        both = np.unique(np.stack([np.concatenate(starts), np.concatenate(sizes)]), axis=1)
        return both[0], both[1]

    def search(self, texts: list[str | None]) -> list[tuple[int, int, int, int]]:
        """(row of the text, row of the item, edits, first word) of each item that a text holds, its best place."""
        words, cut = words_of(texts)
        if not len(words) or not self.words:
            return []
        doc = np.repeat(np.arange(len(texts)), np.diff(cut))
        start, n = self.windows(words, doc)
        best: dict[tuple[int, int], tuple[int, int]] = {}
        tried: set[tuple[int, int]] = set()
        for at in range(0, len(start), 4096):
            s, size = start[at : at + 4096], n[at : at + 4096]
            middle = doc[np.clip(s + size // 2, 0, len(words) - 1)]
            # a window that reaches over the text's end reads the end mark there
            inner = np.clip(s, cut[middle], np.maximum(cut[middle + 1] - size, cut[middle]))
            keys = walks(words, inner, size, self.seeds, self.spots)
            for r in range(len(self.seeds)):
                low, high = np.searchsorted(self.keys[r], keys[r], "left"), np.searchsorted(self.keys[r], keys[r], "right")
                for k in np.flatnonzero(high > low):
                    for item in self.order[r, low[k] : high[k]]:
                        tried.add((int(inner[k]), int(item)))
        for place, item in sorted(tried):
            d, edits, size = int(doc[place]), int(self.edits[item]), int(self.n[item])
            a, z = max(int(cut[d]), place - edits), min(int(cut[d + 1]), place + size + edits)
            distance, end = stretch_distance(self.words[item], words[a:z])
            if distance <= edits:
                found = (distance, max(0, a - int(cut[d]) + end - size))
                best[d, item] = min(best.get((d, item), found), found)
        return [(d, item, *found) for (d, item), found in best.items()]


def chain(words: np.ndarray, size: int) -> np.ndarray:
    """A hash of each ``size`` words in a row."""
    n = len(words) - size + 1
    out = words[:n].copy()
    for k in range(1, size):
        out = out * _STEP + words[k : k + n]
    out ^= out >> np.uint64(31)
    return out * _ODD


def load(items: DataFrame, id_col: str = "item_id", similarity: float = SIMILARITY, recall: float = RECALL) -> list[Benchmark]:
    """Blocks of items, each small enough to go with a task whatever the size of the benchmark."""
    known = pair(items, id_col).where("doc_id is not null")
    n, size = known.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    count = max(1, -(-n // BLOCK_ITEMS), -(-size // (4 * BLOCK_WORDS)))
    found = []
    for block in range(count):
        rows = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(count)) == block).collect()  # bounded by the block
        words, cut = words_of([r["text"] for r in rows])
        lists = [words[a:z] for a, z in zip(cut[:-1], cut[1:], strict=True)]
        use = [k for k, w in enumerate(lists) if len(w) >= MIN_WORDS]
        found.append(Benchmark([rows[k]["doc_id"] for k in use], [lists[k] for k in use], similarity, recall))
    return found


def matches(docs: DataFrame, block: Benchmark) -> DataFrame:
    """(doc_id, item_id, edits, similarity, first_word) of (doc_id, text) and a block of items."""

    def run(batches):
        for batch in small(batches, 2048):
            ids = batch.column(0)
            rows = block.search(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays(
                [
                    ids.take(pa.array([r[0] for r in rows], pa.int64())),
                    pa.array([block.ids[r[1]] for r in rows], pa.int64()),
                    pa.array([r[2] for r in rows], pa.int32()),
                    pa.array([1 - r[2] / len(block.words[r[1]]) for r in rows], pa.float64()),
                    pa.array([r[3] for r in rows], pa.int64()),
                ],
                names=["doc_id", "item_id", "edits", "similarity", "first_word"],
            )

    return docs.mapInArrow(run, "doc_id long, item_id long, edits int, similarity double, first_word long")


@query("op7_benchmark_decontamination")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = pair(documents(spark, sf_dir))
    found = None
    for block in load(table(spark, sf_dir, "benchmark")):
        one = matches(docs, block)
        found = one if found is None else found.union(one)
    return found


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    for block in load(table(spark, sf_dir, "benchmark")):

        def clean(batches, block=block):
            for batch in small(batches, 2048):
                texts = batch.column(batch.schema.names.index("text")).to_pylist()
                keep = np.ones(len(texts), bool)
                keep[[r[0] for r in block.search(texts)]] = False
                yield batch.filter(pa.array(keep))

        docs = docs.mapInArrow(clean, docs.schema)
    return docs

"""SimHash near-duplicates by a Gray-order hierarchical index.

Fingerprints. A bit is set if it is set in more than half of the 64-bit hashes of the text's word shingles.

Links. Fingerprints that differ in at most ``limit`` bits agree whole on at least one of ``limit + 1`` parts of the
64 bits, so these parts are the top nodes of the index: a masked bit pattern (part, value), shared by all
fingerprints below it. Each top node is a cell; a shuffle brings the distinct fingerprints of a cell together. In a
cell they are sorted by Gray rank, which puts fingerprints that share bits next to each other, and every ``FAN``
neighbours get a parent that holds the bits they all share. A search goes down from the top with the differences
counted so far; each node adds only the bits that its parent does not have, and a node with too many differences is
left with all that is below it. All searches of a task go down together, a level at a time.

Scale. Equal fingerprints are one row before any comparing. A cell with over ``cell_rows`` fingerprints is dealt to
salts, and each pair of salts is a cell of its own; the table of such cells has at most 5 * 2**13 rows, whatever the
data, and is broadcast. A task passes on one row per fingerprint and cell, its link to the smallest fingerprint it
hangs together with there, never the pairs. Components of these links are found by star contraction.

Cases: null text is empty; texts without words have fingerprint zero and are linked like others; a text with fewer
words than a shingle is one shingle; equal texts and repeated rows share a component; rows with null id have a
fingerprint and belong to the component, which is named by the smallest id that is not null (null if there is
none). An empty table gives an empty result. Columns other than id and text do not matter.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chatlake.llm.common import documents, map_rows, pair, query
from chatlake.llm.components import components
from chatlake.session import durable

WORDS = 4
LIMIT = 4
SEED = 42
FAN = 8
CELL_ROWS = 200_000
TASK_ROWS = 500_000
#: Pairs of a code and a node that a task holds at once.
PAIRS = 500_000


def fingerprint(text: str, words: int = WORDS) -> int:
    """The unsigned 64-bit fingerprint of one text."""
    found = text.encode().lower().split()  # bytes: only A-Z change, only ASCII blanks part words
    if not found:
        return 0
    joined = b" ".join(found)
    if len(found) <= words:
        hashes = [xxhash.xxh64_intdigest(joined, SEED)]
    else:
        ends = np.cumsum([len(w) + 1 for w in found]) - 1
        starts = [0, *(ends[: -words] + 1).tolist()]
        digest = xxhash.xxh64_intdigest
        hashes = [digest(joined[a:z], SEED) for a, z in zip(starts, ends[words - 1 :].tolist(), strict=True)]
    count = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 65536):
        part = np.array(hashes[at : at + 65536], "<u8")
        count += np.unpackbits(part.view(np.uint8), bitorder="little").reshape(-1, 64).sum(axis=0, dtype=np.int64)
    return int(np.packbits(count * 2 > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """(doc_id, fp long) of (doc_id, text); a column ``key`` is passed on."""
    key = "key" in docs.columns

    def run(got: dict) -> dict:
        fp = np.array([fingerprint(t, words) for t in got["text"]], np.uint64).astype(np.int64)
        return {"doc_id": got["doc_id"], "fp": fp} | ({"key": got["key"]} if key else {})

    return map_rows(docs, run, "doc_id long, fp long" + ", key long" * key)


def hexadecimal(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


# ---------------------------------------------------------------- the index
def gray_rank(codes: np.ndarray) -> np.ndarray:
    """Place of each code in Gray order."""
    rank = codes.copy()
    for step in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(step)
    return rank


class GrayIndex:
    """Trees over the codes of many cells; ``cells`` gives the cell of each code."""

    def __init__(self, cells: np.ndarray, codes: np.ndarray):
        order = np.lexsort((gray_rank(codes), cells))
        self.cells, self.codes = cells[order], codes[order]
        n = len(order)
        #: Per level from the codes up: shared bits, their values, first node of the level below, last node + 1.
        self.levels = [(np.full(n, np.uint64(2**64 - 1)), self.codes, None, np.arange(1, n + 1))]
        cell, low, high = self.cells, self.codes, self.codes
        end = np.arange(1, n + 1)  # last code below each node + 1
        while True:
            first = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]]))
            length = np.diff(np.append(first, len(cell)))
            if self.levels[1:] and length.max() == 1:
                break
            place = np.arange(len(cell)) - np.repeat(first, length)
            heads = np.flatnonzero(place % FAN == 0)
            low, high = np.bitwise_and.reduceat(low, heads), np.bitwise_or.reduceat(high, heads)
            end = end[np.append(heads[1:], len(cell)) - 1]
            shared = ~(low ^ high)
            # what a child has beyond its parent: only these bits are still to be compared below
            owner = np.repeat(np.arange(len(heads)), np.diff(np.append(heads, len(cell))))
            mask, value, child, stop = self.levels[-1]
            self.levels[-1] = (mask & ~shared[owner], value, child, stop)
            self.levels.append((shared, low, np.append(heads, len(cell)), end))
            cell = cell[heads]
        self.roots = cell

    def pairs(self, limit: int):
        """Yield (i, j) arrays, i < j: places of codes of one cell that differ in ``limit`` bits or fewer."""
        first = np.flatnonzero(np.concatenate([[True], self.cells[1:] != self.cells[:-1]]))
        size = np.diff(np.append(first, len(self.cells)))
        most = np.cumsum(np.repeat(size, size))  # a search meets its own cell's codes at most
        start = 0
        while start < len(self.codes):
            stop = max(start + 1, int(np.searchsorted(most, (most[start - 1] if start else 0) + PAIRS, side="right")))
            who = np.arange(start, stop)
            start = stop
            node = np.searchsorted(self.roots, self.cells[who])
            seen = np.zeros(len(who), np.int64)
            for mask, value, child, end in reversed(self.levels):
                seen = seen + np.bitwise_count((self.codes[who] ^ value[node]) & mask[node])
                keep = np.flatnonzero((seen <= limit) & (end[node] > who + 1))
                who, node, seen = who[keep], node[keep], seen[keep]
                if child is None or not len(who):
                    break
                width = child[node + 1] - child[node]
                inner = np.arange(width.sum()) - np.repeat(np.cumsum(width) - width, width)
                node = np.repeat(child[node], width) + inner
                who, seen = np.repeat(who, width), np.repeat(seen, width)
            if len(who):
                yield who, node


def roots(n: int, pairs) -> np.ndarray:
    """The smallest place that each of n places hangs together with."""
    root = np.arange(n)
    for a, b in pairs:
        while True:
            ra, rb = root[a], root[b]
            apart = np.flatnonzero(ra != rb)
            if not len(apart):
                break
            a, b, ra, rb = a[apart], b[apart], ra[apart], rb[apart]
            np.minimum.at(root, np.maximum(ra, rb), np.minimum(ra, rb))
            while not np.array_equal(up := root[root], root):
                root = up
    return root


def links(codes: DataFrame, limit: int = LIMIT, cell_rows: int = CELL_ROWS) -> DataFrame:
    """(fp, root): links that join distinct fingerprints of a written table ``codes(fp)`` into components."""
    parts = limit + 1
    width = [64 // parts + (k < 64 % parts) for k in range(parts)]
    at = [sum(width[:k]) for k in range(parts)]
    value = [F.shiftrightunsigned("fp", at[k]).bitwiseAND((1 << width[k]) - 1) for k in range(parts)]
    top = codes.select("fp", F.explode(F.array(*[F.lit(k << 13) + value[k] for k in range(parts)])).alias("cell"))
    # at most parts * 2**13 rows
    hot = top.groupBy("cell").count().where(F.col("count") > cell_rows).select("cell", F.least(F.ceil(F.col("count") / cell_rows), F.lit(1024)).cast("long").alias("salts"))
    own = F.pmod(F.xxhash64("fp"), F.col("salts"))
    # a code is in the cells of its salt with every other salt
    pairs = F.expr("transform(sequence(0L, salts - 1), s -> least(s, own) * 1024 + greatest(s, own))")
    dealt = (
        top.join(F.broadcast(hot), "cell", "left")
        .withColumn("salts", F.coalesce("salts", F.lit(1).cast("long")))
        .withColumn("own", own)
        .withColumn("pair", F.explode(F.when(F.col("salts") == 1, F.array(F.lit(0).cast("long"))).otherwise(F.array_except(pairs, F.array(F.col("own") * 1025)))))
        .select((F.col("cell") * (1 << 20) + F.col("pair")).alias("cell"), "fp")
    )

    def search(batches):
        got = [(b.column(0).to_numpy(zero_copy_only=False), b.column(1).to_numpy(zero_copy_only=False)) for b in batches]
        if not got:
            return
        index = GrayIndex(np.concatenate([g[0] for g in got]), np.concatenate([g[1] for g in got]).astype(np.uint64))
        root = roots(len(index.codes), index.pairs(limit))
        child = np.flatnonzero(root != np.arange(len(root)))
        fp, to = index.codes[child].astype(np.int64), index.codes[root[child]].astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(fp), pa.array(to)], names=["fp", "root"])

    n = codes.count() * parts
    tasks = max(int(codes.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-n // TASK_ROWS))
    return dealt.repartition(tasks, "cell").mapInArrow(search, "fp long, root long")


def near_duplicates(docs: DataFrame, words: int = WORDS, limit: int = LIMIT) -> DataFrame:
    """(doc_id, fp, component_id, root) of every row of (doc_id, text), and its ``key``; components can share an id, not the root."""
    fps = durable(fingerprints(docs, words))
    codes = durable(fps.groupBy("fp").agg(F.min("doc_id").alias("least")))
    joined = components(links(codes.select("fp"), limit), "fp", "root")
    # only fingerprints that have a link are in `joined`; the others are components of their own
    named = codes.join(joined.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    ids = named.groupBy("root").agg(F.min("least").alias("component_id"))
    return fps.join(named.select("fp", "root").join(ids, "root").select("fp", "component_id", "root"), "fp").select(*fps.columns, "component_id", "root")


@query("op3_simhash_near_dedup")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(pair(documents(spark, sf_dir)))
    return found.select("doc_id", hexadecimal(F.col("fp")).alias("fingerprint"), "component_id")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each component of near-duplicates stays, of those with the smallest id; rows without id stay.

    Near-duplicates are those of op3's contract; README has the share of copies found by similarity.
    """
    whole = F.xxhash64(F.coalesce(docs["text"].cast("string"), F.lit("")))
    found = near_duplicates(pair(docs).withColumn("key", F.xxhash64("text")))
    kept = found.where("doc_id = component_id").groupBy("doc_id", "root").agg(F.min("key").alias("_key")).select(F.col("doc_id").alias("_id"), "_key")
    rows = docs.join(kept, (docs["doc_id"].cast("long") == kept["_id"]) & (whole == kept["_key"]), "left_semi")
    # one of the rows that share id and text
    rest = F.xxhash64(F.lit(0), *[docs[c] for c in docs.columns if c not in ("doc_id", "text")])
    place = max(docs.columns, key=len) + "_"  # no other column's name
    rows = rows.withColumn(place, F.row_number().over(Window.partitionBy(docs["doc_id"].cast("long"), whole).orderBy(rest))).where(F.col(place) == 1)
    return rows.select(*docs.columns).union(docs.where("doc_id is null"))

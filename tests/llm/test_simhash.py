import re

import numpy as np
import xxhash
from pyspark.sql import functions as F

from chatlake.llm import simhash
from chatlake.llm.common import pair
from chatlake.llm.components import components


def slow(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    rows = [" ".join(words[k : k + 4]) for k in range(len(words) - 3)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(x.encode(), 42) for x in rows]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def closure(codes, limit=4):
    root = list(range(len(codes)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(codes)):
        for j in range(i):
            if bin(codes[i] ^ codes[j]).count("1") <= limit:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(k) for k in range(len(codes))]


def test_fingerprints(texts):
    for _, t in texts:
        assert simhash.fingerprint(t or "") == slow(t)


def test_index_finds_every_pair():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 1 << 63, 40).astype(np.uint64)
    codes = np.concatenate([base, *[base ^ (np.uint64(1) << rng.integers(0, 64, 40).astype(np.uint64)) for _ in range(6)]])
    cells = rng.integers(0, 3, len(codes))
    index = simhash.GrayIndex(cells, codes)
    got = {(int(i), int(j)) for a, b in index.pairs(4) for i, j in zip(a, b)}
    want = {
        (i, j)
        for i in range(len(codes))
        for j in range(i + 1, len(codes))
        if index.cells[i] == index.cells[j] and bin(int(index.codes[i]) ^ int(index.codes[j])).count("1") <= 4
    }
    assert got == want


def test_salted_cells_keep_all_links(spark):
    rng = np.random.default_rng(2)
    base = int(rng.integers(0, 1 << 62))
    codes = sorted({base ^ (1 << int(a)) ^ (1 << int(b)) for a, b in rng.integers(0, 62, (150, 2))} | {int(x) for x in rng.integers(0, 1 << 62, 50)})
    from chatlake.session import durable

    table = durable(spark.createDataFrame([(c,) for c in codes], "fp long"))
    joined = components(simhash.links(table, cell_rows=20), "fp", "root")
    got = {r.node: r.root for r in joined.collect()}
    root = closure(codes)
    for k, c in enumerate(codes):
        assert got.get(c, c) == codes[root[k]]


def test_components_of_paths_and_hubs(spark):
    path = [(k, k + 1) for k in range(40)]
    hub = [(100, k) for k in range(101, 160)] + [(5000, 159), (5000, 6000)]
    got = {r.node: r.root for r in components(spark.createDataFrame(path + hub + [(7, 7)], "u long, v long"), "u", "v").collect()}
    assert all(got[k] == 0 for k in range(41)) and all(got[k] == 100 for k in [*range(100, 160), 5000, 6000])
    assert components(spark.createDataFrame([], "u long, v long"), "u", "v").count() == 0


def test_edge_rows(docs, nothing, texts):
    rows = simhash.near_duplicates(pair(docs)).collect()
    assert len(rows) == len(texts)
    by = {r.doc_id: r for r in rows}
    assert by[4].component_id == by[5].component_id == 4
    assert by[2].component_id == by[3].component_id == by[6].component_id == 2 and by[2].fp == 0
    codes = [slow(t) for _, t in texts]
    root = closure(codes)
    for (i, _), k in zip(texts, range(len(texts))):
        mates = [texts[m][0] for m in range(len(texts)) if root[m] == root[k] and texts[m][0] is not None]
        assert by[i].component_id == min(mates, default=None)
    assert simhash.near_duplicates(pair(nothing)).count() == 0


def test_stage_keeps_one_of_each(spark, docs):
    kept = simhash.stage(spark, docs, "")
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.where(F.col("doc_id").isNotNull()).collect()).count(4) == 1
    assert kept.where("doc_id in (3, 5, 6)").count() == 0 and kept.where("doc_id is null").count() == 1

import random

import numpy as np

from chatlake.llm import decontaminate as dec
from chatlake.llm.common import pair
from chatlake.llm.words import words_of

VOCABULARY = [f"w{k}" for k in range(400)]


def slow(items, texts):
    """All (text, item) with an edit distance of the item to a stretch of the text within the limit."""
    out = set()
    for t, text in enumerate(texts):
        for i, item in enumerate(items):
            row = [0] * (len(text) + 1)
            for k, w in enumerate(item):
                fresh = [k + 1]
                for j, x in enumerate(text):
                    fresh.append(min(row[j] + (x != w), row[j + 1] + 1, fresh[j] + 1))
                row = fresh
            if min(row) <= int((1 - dec.SIMILARITY) * len(item) + 1e-9):
                out.add((t, i))
    return out


def planted(rng, items, count):
    texts = []
    for _ in range(count):
        body = [rng.choice(VOCABULARY) for _ in range(rng.randrange(5, 80))]
        item = list(rng.choice(items))
        for _ in range(rng.randrange(0, len(item) // 4 + 2)):
            at = rng.randrange(len(item))
            kind = rng.randrange(3)
            item[at : at + 1] = [] if kind == 0 else [rng.choice(VOCABULARY)] if kind == 1 else [item[at], rng.choice(VOCABULARY)]
            item = item or ["w0"]
        at = rng.randrange(len(body))
        texts.append(body[:at] + item + body[at:])
    return texts


def block(items):
    words, cut = words_of([" ".join(i) for i in items])
    return dec.Benchmark(list(range(len(items))), [words[a:z] for a, z in zip(cut[:-1], cut[1:])])


def test_recall_and_precision_against_brute_force():
    rng = random.Random(4)
    items = [[rng.choice(VOCABULARY) for _ in range(rng.randrange(5, 60))] for _ in range(25)]
    texts = planted(rng, items, 150)
    got = {(r[0], r[1]) for r in block(items).search([" ".join(t) for t in texts])}
    want = slow(items, texts)
    assert got <= want
    assert len(got) >= 0.97 * len(want) and len(want) > 90


def test_distance():
    words, cut = words_of(["a b c d e", "x x a b q c d y y", "a b c d e"])
    a, b, c = (words[s:z] for s, z in zip(cut[:-1], cut[1:]))
    assert dec.stretch_distance(a, b)[0] == 2 and dec.stretch_distance(a, c) == (0, 5) and dec.stretch_distance(a, b[:0])[0] == 5


def test_edge_rows(spark, folder, docs, nothing):
    rows = dec.op7(spark, folder).collect()
    assert [(r.doc_id, r.item_id, r.edits, r.similarity, r.first_word) for r in rows] == [(10, 1, 0, 1.0, 1)]
    blocks = dec.load(spark.read.parquet(f"{folder}/benchmark.parquet"))
    assert dec.matches(pair(nothing), blocks[0]).count() == 0
    none = dec.load(spark.createDataFrame([], "item_id long, text string"))
    assert dec.matches(pair(docs), none[0]).count() == 0
    kept = dec.stage(spark, docs, folder)
    assert kept.columns == docs.columns and kept.count() == docs.count() - 1 and kept.where("doc_id = 10").count() == 0


def test_blocks_of_items(spark, monkeypatch):
    monkeypatch.setattr(dec, "BLOCK_ITEMS", 3)
    items = spark.createDataFrame([(k, " ".join(f"i{k}x{j}" for j in range(8))) for k in range(10)], "item_id long, text string")
    blocks = dec.load(items)
    assert len(blocks) == 4 and sorted(i for b in blocks for i in b.ids) == list(range(10))


def test_windows_do_not_cross_texts():
    items = [[f"w{k}" for k in range(10)]]
    assert block(items).search(["w0 w1 w2 w3 w4", "w5 w6 w7 w8 w9"]) == []
    assert np.array_equal(block(items).search(["", None, "w0 w1 w2 w3 w4 w5 w6 w7 w8 w9"]), [(2, 0, 0, 0)])

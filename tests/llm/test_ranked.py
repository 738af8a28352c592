import math
import random
import re
from collections import Counter

import numpy as np
import oracle
import pytest

from chatlake.llm import ranked

DOCS = "doc_id long, text string, n long, terms string, item int"
ITEMS = "item_id long, text string, rank int"


def words(text):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", lower)


def expected(docs, items, k=50):
    """Every document scored for every item."""
    bags = [(d, Counter(words(t))) for d, t in docs if words(t)]
    n_docs, n_terms = len(bags), sum(sum(b.values()) for _, b in bags)
    df = Counter(t for _, b in bags for t in b)
    out = []
    for item, text in sorted(set(items), key=str):
        found = []
        for doc, bag in bags:
            m = 100 - 50 + (50 * sum(bag.values()) * n_docs) // n_terms
            score = 0
            for t in set(words(text)) & bag.keys():
                w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                score += w * ((1000000000 * bag[t]) // (1000 * bag[t] + 20 * m))
            if score > 0:
                found.append((-score, doc is None, doc or 0))
        out += [(item, r, None if none else doc, -s) for r, (s, none, doc) in enumerate(sorted(found)[:k], 1)]
    return sorted(out, key=str)


def corpus(seed, n=400):
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(60)] + ["Straße", "ÄB", "日本", "x9", "THE", "the", "naïve"]
    line = lambda most: " ".join(rng.choice(vocabulary[: rng.choice([5, 20, 67])]) for _ in range(rng.randint(0, most)))
    docs = [(k, line(40)) for k in range(n)] + [(None, line(9)), (None, line(9)), (3, line(9)), (-5, None), (7, ""), (8, "...!")]
    docs += docs[10:40]
    items = [(k, line(20)) for k in range(30)] + [(1, "THE-end. the"), (None, "w1 w2"), (None, None), (5, ""), (6, "unheard of"), (2, "w1"), (2, "w1")]
    return docs, items


def run(spark, docs, items, **options):
    d = spark.createDataFrame([(*r, 1, "x", 2) for r in docs], DOCS).repartition(5)
    i = spark.createDataFrame([(*r, 1) for r in items], ITEMS)
    return sorted((tuple(r) for r in ranked.search(d, i, **options).collect()), key=str)


@pytest.mark.parametrize("k,rows", [(50, 500), (3, 7)])
def test_against_scoring_everything(spark, k, rows):
    docs, items = corpus(k)
    assert run(spark, docs, items, k=k, rows=rows) == expected(docs, items, k)


def test_items_of_more_terms_than_a_word_has_bits(spark):
    rng = random.Random(4)
    names = [f"t{k}" for k in range(200)]
    docs = [(k, " ".join(rng.choices(names, k=30))) for k in range(300)]
    items = [(1, " ".join(names)), (2, " ".join(names[:64])), (3, " ".join(names[:63]))]
    assert run(spark, docs, items, k=5) == expected(docs, items, 5)


def test_most_documents_are_never_scored():
    rng = np.random.default_rng(0)
    n, size = 4000, 12
    held = rng.random((n, size)) < np.linspace(0.9, 0.02, size)
    edges = np.concatenate([[0], np.cumsum(held.sum(axis=1))])
    term = np.nonzero(held)[1]
    block = ranked.Block(np.arange(n), edges, term, np.ones(len(term), np.int64), np.full(n, 100), size)
    weights = np.array([ranked.weight(n, int(x)) for x in held.sum(axis=0)])
    best = ranked.Best(np.arange(size), weights, 10)
    best.add(block, np.zeros(size, np.int64))
    every = block.scores(np.arange(n), weights)
    order = np.lexsort((np.arange(n), -every))[:10]
    assert best.doc.tolist() == order.tolist() and best.score.tolist() == every[order].tolist()
    assert best.scored < 200


def test_long_texts_and_words(monkeypatch):
    monkeypatch.setattr(ranked, "CHUNK", 50)
    texts = ["alpha " * 100 + "b" * 300 + ", Alpha", None, "b" * 300, "", "!" * 200, "alphabet alpha5 alpha"]
    vocabulary = ranked.Vocabulary(["alpha", "b" * 300])
    n, text, term, tf = ranked.counts(texts, vocabulary)
    assert n.tolist() == [len(words(t)) for t in texts]
    assert list(zip(text.tolist(), term.tolist(), tf.tolist())) == [(0, 0, 101), (0, 1, 1), (2, 1, 1), (5, 0, 1)]


def test_numbers_beyond_64_bits():
    n = np.array([1, 10**9])
    assert ranked.lengths(n, 10**12, 10**13).tolist() == [50 + 5, 50 + 5 * 10**9]


def test_empty_tables(spark):
    docs, items = corpus(1, 5)
    d, i = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert ranked.search(d.where("1=0"), i).columns == ["item_id", "rank", "doc_id", "score"]
    assert ranked.search(d.where("1=0"), i).count() == 0 and ranked.search(d, i.where("1=0")).count() == 0


def test_query_against_sql(spark):
    at = "/root/testdata/sf0.001"
    assert oracle.compare(ranked.op13(spark, at), oracle.connect(at), ranked.SQL) is None

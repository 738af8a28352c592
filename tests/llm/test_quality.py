import random
import zlib

import numpy as np

from chatlake.llm import quality
from chatlake.llm.common import pair


def corpus(n=400):
    rng = random.Random(2)
    good = ["the river ran", "people walked home", "music was heard", "we read a letter"]
    bad = ["BUY NOW!!!", "$$$ %%% ***", "click | here |", "WIN!! BIG!!"]
    return [(k, " ".join(rng.choice(bad if k % 4 == 0 else good) for _ in range(rng.randrange(3, 40))), int(k % 4 != 0)) for k in range(n)]


def test_held_out_accuracy(spark):
    rows = corpus()
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, q) for i, _, q in rows] + [(1, None), (None, 1)], "doc_id long, quality int")
    model = quality.train(docs, labels)
    got = {r.doc_id: r for r in quality.score(pair(docs), model).collect()}
    held = [(i, q) for i, _, q in rows if zlib.crc32(str(i).encode()) % 3 == 1]
    assert np.mean([got[i].predicted == q for i, q in held]) > 0.97
    assert all((got[i].score >= 0.5) == (got[i].predicted == 1) and 0 <= got[i].score <= 1 for i, _ in held)


def test_held_out_rows_teach_nothing(spark):
    rows = corpus(60)
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, q) for i, _, q in rows], "doc_id long, quality int")
    lies = spark.createDataFrame([(i, 1 - q if zlib.crc32(str(i).encode()) % 3 == 1 else q) for i, _, q in rows], "doc_id long, quality int")
    a, b = quality.train(docs, labels), quality.train(docs, lies)
    assert np.array_equal(a.folded, b.folded) and a.bias == b.bias


def test_pieces_of_a_word():
    pieces, starts = quality.hashed([b"ab cde", b"", b"ab"])
    assert [len(p[0]) for p in pieces] == [2 + 3 + 2, 1 + 2 + 1, 0 + 1 + 0, 3]
    assert starts.tolist() == [0, 8, 10]
    alone, _ = quality.hashed([b"ab"])
    for (b, at), (x, _) in zip(pieces, alone):
        assert b[at >= 10].tolist() == x.tolist()


def test_scores_do_not_depend_on_the_batch():
    model = quality.SubwordModel(np.random.default_rng(1).normal(size=quality.BUCKETS).astype(np.float32), 0.1)
    texts = ["one two", None, "", "three " * 500, "ünï"]
    assert model.score(texts * 3).tolist() == [model.score([t])[0] for t in texts] * 3


def test_edge_rows(spark, docs, nothing, folder, texts):
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    for some in (labels, labels.where("quality = 1"), labels.where("1 = 0")):
        model = quality.train(docs, some)
        assert quality.score(docs, model).count() == len(texts)
    assert quality.score(nothing, quality.train(nothing, labels)).count() == 0
    rows = quality.op8(spark, folder).collect()
    assert len(rows) == len(texts)
    assert {r.doc_id: r.held_out for r in rows} == {i: i is not None and zlib.crc32(str(i).encode()) % 3 == 1 for i, _ in texts}
    assert quality.stage(spark, docs, folder).columns == docs.columns

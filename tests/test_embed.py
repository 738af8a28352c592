"""Token budget and parts of long texts in embedding jobs."""

import numpy as np
import pytest

from chatlake.operators import embed


def directions():
    class Directions:
        """Unit vectors by the first word; refuses over-long texts and over-full batches."""

        model_id, dims, max_distance, query_prefix, passage_prefix = "directions", 2, 0.5, "", ""
        max_tokens, overlap = 10, 3

        def load(self):
            pass

        def embed(self, texts):
            sizes = [len(t.split()) for t in texts]
            if max(sizes) > 10 or len(texts) * max(sizes) > 40 or any("bad" in t for t in texts):
                raise ValueError
            return [[1.0, 0.0] if t.split()[:1] == ["a"] else [0.0, 1.0] for t in texts]

    return Directions()


@pytest.mark.parametrize("seed", range(20))
def test_batches_keep_to_the_budget_and_hold_every_text_once(seed):
    rng = np.random.default_rng(seed)
    tokens = rng.integers(0, 30, rng.integers(0, 200))
    batches = list(embed.pack(tokens, 60, 8))
    assert sorted(np.concatenate([*batches, np.array([], int)])) == list(range(len(tokens)))
    for b in batches:
        assert len(b) <= 8 and (len(b) == 1 or len(b) * tokens[b].max() <= 60)
    longest = [tokens[b].max() for b in batches]
    assert longest == sorted(longest)


def test_long_texts_are_embedded_whole(spark):
    long = " ".join(["a"] * 10 + ["b"] * 7)  # parts of 10 and 10 words, 3 of them shared
    texts = {1: "a b", 2: long, 3: "", 4: None, 5: "b bad " + "b " * 30, 6: "  b\n\tb ", 7: "a " * 10, 8: "b " * 400}
    rows = spark.createDataFrame(list(texts.items()), "id long, text string").repartition(2)
    parts = embed.token_parts(rows, "id", "text", 10, 3).collect()
    for i, text in texts.items():
        mine = sorted((r for r in parts if r.id == i), key=lambda r: r.part)
        assert [r.part for r in mine] == list(range(mine[0].parts)) and all(r.tokens == len(r.text.split()) <= 10 for r in mine)
        again = mine[0].text.split() + [w for r in mine[1:] for w in r.text.split()[3:]]
        assert again == (text or "").split() and (mine[0].parts > 1 or mine[0].text == (text or ""))
    with spark_batches(spark, 3):
        got = {r.id: (r.status, r.v) for r in embed.embed_with(rows, "id", "text", directions(), budget=40).collect()}
    assert got.pop(5) == ("rejected", None)
    assert all(status == "embedded" for status, _ in got.values())
    assert got[1][1] == got[7][1] == [1.0, 0.0] and got[8][1] == pytest.approx([0.0, 1.0])
    both = np.asarray(got[2][1])  # the second part begins with a shared "a"
    assert np.linalg.norm(both) == pytest.approx(1.0) and both == pytest.approx([1.0, 0.0])
    with pytest.raises(ValueError):
        embed.token_parts(rows, "id", "text", 3, 3)


def test_mean_weighs_by_tokens_and_keeps_the_length():
    v = embed._mean([[1.0, 0.0], [0.0, 1.0]], [3, 1])
    assert np.linalg.norm(v) == pytest.approx(1.0) and v[0] / v[1] == pytest.approx(3.0)
    assert embed._mean([[1.0], None], [3, 1]) is None and embed._mean([[2.0], [-2.0]], [1, 1]) == [0.0]


class spark_batches:
    """Arrow batches of a few rows, so that parts of a text fall into several."""

    def __init__(self, spark, n):
        self.spark, self.n, self.key = spark, n, "spark.sql.execution.arrow.maxRecordsPerBatch"

    def __enter__(self):
        self.before = self.spark.conf.get(self.key)
        self.spark.conf.set(self.key, str(self.n))

    def __exit__(self, *_):
        self.spark.conf.set(self.key, self.before)

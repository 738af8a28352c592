"""Phrases against reading every text, and how many places are looked up for them."""

import random

import pytest

from chatlake.operators import keyword

PHRASES = ["common often rare plain", "often often", "plain", "common common often", "never common", "word plain often common rare word", "rare rare"]


@pytest.fixture(scope="module")
def texts(spark):
    rng = random.Random(5)
    rows = []
    for k in range(400):
        words = rng.choices(["common", "often", "plain", "word"], k=rng.randint(0, 30))
        if k % 40 == 0:
            at = rng.randint(0, len(words))
            words[at:at] = rng.choice(PHRASES).replace("never", "rare").split() + ["rare"]
        rows.append((k, " ".join(words)))
    messages = spark.createDataFrame(rows, "message_id long, text string")
    atoms = spark.createDataFrame([(p, "phrase", p.split()) for p in PHRASES], "atom string, mode string, tokens array<string>")
    return dict(rows), keyword.build_index(messages), atoms


def places(words, phrase):
    return sum(words[i : i + len(phrase)] == phrase for i in range(len(words)))


@pytest.mark.parametrize("few", [0, 200_000])
def test_phrases_against_every_text(texts, monkeypatch, few):
    rows, index, atoms = texts
    monkeypatch.setattr(keyword.phrase_hits, "__defaults__", (few,))
    got = {(r["atom"], r["message_id"]): (r["tf"], r["length"]) for r in keyword.phrase_hits(atoms, index).collect()}
    want = {(p, k): (places(t.split(), p.split()), len(t.split())) for p in PHRASES for k, t in rows.items() if places(t.split(), p.split())}
    assert got == want and {p for p, _ in want} >= {"plain", "often often", "common common often"}


def test_frequent_words_meet_only_messages_with_the_rare_ones(texts, monkeypatch):
    """A long phrase with one rare word was paired with all messages of its frequent words."""
    _, index, atoms = texts
    written = []
    keep = keyword.durable
    monkeypatch.setattr(keyword, "durable", lambda df: written.append(keep(df)) or written[-1])
    keyword.phrase_hits(atoms.filter("atom = 'word plain often common rare word'"), index).collect()
    rare = index.postings.filter("term = 'rare'").count()
    assert written and sum(w.count() for w in written if "message_id" in w.columns) <= 6 * rare

import re

from chatlake.llm import licences
from chatlake.llm.common import pair

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def slow(text):
    words = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    at, labels = [], set()
    for label, phrase in licences.BASE.items():
        p = phrase.split()
        hits = [k for k in range(len(words)) if words[k : k + len(p)] == p]
        at += hits
        labels |= {label} if hits else set()
    return len(words), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(labels))


def rows(table):
    return {r.doc_id: r for r in licences.scan(table).collect()}


def test_base_phrases_are_exact(spark, docs, texts):
    more = [
        (50, "cc by cc-by CC\x00BY ccby cc, by; " * 30),
        (51, "All rights\nreserved all rights all rights reserved the general public license general public licenses"),
        (52, "cc bÿ é general public license"),
        (53, "!!! ... "),
        (54, "cc"),
    ]
    got = rows(pair(docs).union(spark.createDataFrame(more, "doc_id long, text string")))
    for i, t in [*texts, *more]:
        r = got[i]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == slow(t), i
        assert 0 <= r.score <= 1 and set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(","))


def test_templates(spark):
    texts = [
        (1, "Released under the MIT License."),
        (2, "Permission is hereby granted, free of charge, to any person obtaining a copy of this software"),
        (3, "permission is granted free of charge hereby"),
        (4, "the mit license of apache"),
        (5, "Licensed under the Apache License, Version 2.0"),
        (6, "apache license version"),
        (7, "der mit license"),
    ]
    got = rows(spark.createDataFrame(texts, "doc_id long, text string"))
    assert {i: got[i].labels for i, _ in texts} == {1: "mit", 2: "mit-text", 3: "", 4: "", 5: "apache", 6: "apache", 7: ""}
    assert got[5].score == 1.0 and 0 < got[6].score < 1 and got[3].score == 0


def test_plan_is_native(spark, docs):
    plan = licences.scan(pair(docs))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_empty_table(nothing):
    assert licences.scan(pair(nothing)).count() == 0

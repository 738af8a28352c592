"""Licence scan by a positional rare-token index, in DataFrame functions only.

Texts are split into words, and places of licence words are kept with a few words around them; common words are no
licence words. Counted over all texts, these places give the inverse document frequency of each licence word. A
template is a stretch of words of a licence; its postings say at which place of which template a licence word stands.
Each file looks up the words it has, the place of the word less its place in the template is where the template
would begin, and words that agree on template and beginning belong together. Such a match stands if the template's
mandatory key phrase is there word for word around its rarest word, the key phrase's licence word with the
highest inverse document frequency. It scores by the share of the template's frequency weights that are in place.

The base phrases are templates that consist of their key phrase, so their matches are all places of the phrase.

Scale. One pass over the texts without a shuffle; what is written of a text is its number of words and the places of licence
words, hardly ever more than a line. The templates are constants and the weights at most one row per licence word, so
both go to every task. Groups are of one text, so no licence line is a hot key.

Cases: null text has no words; texts without licence words have no labels and score 0; repeated rows and null ids give a
row each; an empty table gives an empty result. Only id and text are read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chatlake.llm.common import documents, pair, query
from chatlake.session import durable

# Phrases and labels of the contract, and wording of public licences with a phrase that must be there.
BASE = {"cc-by": "cc by", "gpl": "general public license", "reserved": "all rights reserved"}
TEMPLATES = {
    "agpl": ("the gnu affero general public license as published by the free software foundation", "gnu affero general public license"),
    "apache": ("licensed under the apache license version 2 0", "apache license version"),
    "bsd": ("redistribution and use in source and binary forms with or without modification are permitted", "redistribution and use in source"),
    "cc-by-nc": ("licensed under cc by nc", "cc by nc"),
    "cc-by-nd": ("licensed under cc by nd", "cc by nd"),
    "cc-by-sa": ("licensed under cc by sa", "cc by sa"),
    "gnu-gpl": ("this work is licensed under the gnu general public license version", "gnu general public license"),
    "isc": ("permission to use copy modify and or distribute this software for any purpose", "permission to use copy modify"),
    "lgpl": ("the gnu lesser general public license as published by the free software foundation", "gnu lesser general public license"),
    "mit": ("released under the mit license", "under the mit license"),
    "mit-text": ("permission is hereby granted free of charge to any person obtaining a copy of this software", "permission is hereby granted free of charge"),
    "mpl": ("subject to the terms of the mozilla public license", "mozilla public license"),
    "unlicense": ("this is free and unencumbered software released into the public domain", "free and unencumbered software"),
}
COMMON = set("a all and any any as by copy for free in into is it mit of or person person source terms that the this to under use version with work 0 2".split())
DELIMITERS = "".join(map(chr, [*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]))
AROUND = 8
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def templates() -> list[tuple[str, bool, list[str], int, int]]:
    """(label, base, words, first word of the key phrase, its length)."""
    out = [(label, True, phrase.split(), 0, len(phrase.split())) for label, phrase in BASE.items()]
    for label, (text, key) in TEMPLATES.items():
        words, part = text.split(), key.split()
        first = next(k for k in range(len(words)) if words[k : k + len(part)] == part)
        out.append((label, False, words, first, len(part)))
    return out


def licence_words() -> list[str]:
    return sorted({w for _, _, words, _, _ in templates() for w in words} - COMMON)


def words_of(text: Column) -> Column:
    """Words in order: digits, a-z after lower-casing A-Z, and everything beyond ASCII."""
    bare = F.btrim(F.translate(text, UPPER, LOWER), F.lit(DELIMITERS))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"))


def places(docs: DataFrame) -> DataFrame:
    """(row, doc_id, n_words, found) of (doc_id, text); found has (pos, word, before, after) of each licence word."""
    known = licence_words()
    words = F.col("words")
    around = F.filter(
        F.transform(words, lambda w, i: F.struct(i.alias("pos"), w.alias("word"))), lambda x: x["word"].isin(known)
    )
    start = lambda x: F.greatest(x["pos"] - AROUND, F.lit(0))
    found = F.transform(
        around,
        lambda x: F.struct(
            x["pos"].alias("pos"),
            x["word"].alias("word"),
            F.slice(words, start(x) + 1, x["pos"] - start(x)).alias("before"),
            F.slice(words, x["pos"] + 2, F.lit(AROUND)).alias("after"),
        ),
    )
    has = F.arrays_overlap(words, F.array(*map(F.lit, known)))
    split = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", words_of(F.col("text")).alias("words"))
    return split.select("row", "doc_id", F.size("words").cast("long").alias("n_words"), F.when(has, found).alias("found"))


def weights(found: DataFrame) -> dict[str, float]:
    """Inverse document frequency of each licence word over all texts."""
    n = found.count()
    each = found.select("row", F.explode(F.array_distinct(F.transform("found", lambda x: x["word"]))).alias("word"))
    counts = {r["word"]: r["count"] for r in each.groupBy("word").count().collect()}  # at most one row per licence word
    return {w: math.log((n + 1) / (counts.get(w, 0) + 1)) + 1e-9 for w in licence_words()}


def postings(spark: SparkSession, weight: dict[str, float]) -> DataFrame:
    """One row for each licence word of each template: where it stands, and for the rarest word of the key phrase the
    words before and after it there."""
    rows = []
    for label, base, words, first, length in templates():
        rare = [k for k, w in enumerate(words) if w in weight]
        anchor = max((k for k in rare if first <= k < first + length), key=lambda k: (weight[words[k]], -k))
        total = sum(weight[words[k]] for k in rare)
        for k in rare:
            lead = words[first:k] if k == anchor else []
            trail = words[k + 1 : first + length] if k == anchor else []
            texts = lambda ws: F.array(*map(F.lit, ws)).cast("array<string>")
            rows.append(
                F.struct(
                    F.lit(words[k]).alias("word"), F.lit(label).alias("label"), F.lit(base).alias("base"), F.lit(k).alias("place"),
                    F.lit(weight[words[k]] / total).alias("share"), F.lit(k == anchor).alias("anchor"), texts(lead).alias("lead"), texts(trail).alias("trail"),
                )
            )
    return spark.range(1).select(F.inline(F.array(*rows)))


def matches(found: DataFrame, weight: dict[str, float]) -> DataFrame:
    """(row, label, base, start, score) of each template that stands in a text, its key phrase verified."""
    spark = found.sparkSession
    hits = found.select("row", F.inline("found")).join(F.broadcast(postings(spark, weight)), "word")
    n = F.size("lead")
    near = F.when(F.size("before") >= n, F.slice("before", F.size("before") - n + 1, n) == F.col("lead")) & (F.slice("after", F.lit(1), F.size("trail")) == F.col("trail"))
    return (
        hits.groupBy("row", "label", "base", (F.col("pos") - F.col("place")).alias("start"))
        .agg(F.sum("share").alias("score"), F.max(F.col("anchor") & F.coalesce(near, F.lit(False))).alias("verified"))
        .where("verified")
        .drop("verified")
    )


def scan(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score) of (doc_id, text)."""
    found = durable(places(docs))
    hit = matches(found.where("found is not null"), weights(found))
    base = F.col("base")
    per_text = hit.groupBy("row").agg(
        F.count_if(base).alias("n_base"),
        F.min(F.when(base, F.col("start"))).cast("long").alias("first_word"),
        F.max(F.when(base, F.col("start"))).cast("long").alias("last_word"),
        F.array_join(F.array_sort(F.collect_set(F.when(base, F.col("label")))), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.collect_set("label")), ",").alias("labels"),
        F.least(F.round(F.max("score"), 6), F.lit(1.0)).alias("score"),
    )
    return found.select("row", "doc_id", "n_words").join(per_text, "row", "left").select(
        "doc_id",
        "n_words",
        F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"),
        "first_word",
        "last_word",
        F.coalesce("base_labels", F.lit("")).alias("base_labels"),
        F.coalesce("labels", F.lit("")).alias("labels"),
        F.coalesce("score", F.lit(0.0)).alias("score"),
    )


@query("op5_licence_scan")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(pair(documents(spark, sf_dir)))

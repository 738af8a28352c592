"""The best matches by score bounds against scoring everything, and exact fusion."""

import random

import pytest
from pyspark.sql import functions as F

from chatlake.operators import filters, fusion, keyword, querytable
from chatlake.session import durable


@pytest.fixture(scope="module")
def corpus(spark):
    """3,000 messages over four years; some words are everywhere, some in a few stretches of time only."""
    rng = random.Random(11)
    rows = []
    for k in range(3000):
        words = rng.choices(["common", "often", "plain", "word"], k=rng.randint(1, 12))
        if k // 100 % 10 == 3:
            words += rng.choices(["harbour", "harbours", "lantern"], k=rng.randint(0, 3))
        if k % 997 == 0:
            words += ["lantern"] * 6
        rng.shuffle(words)
        rows.append((k, k % 7, k % 5, k % 3 == 0, 0 if k % 50 else 1, " ".join(words), k * 40_000))
    schema = "message_id long, chat_id long, handle_id long, from_me boolean, kind int, text string, s long"
    messages = durable(
        spark.createDataFrame(rows, schema)
        .withColumn("ts", F.timestamp_seconds(F.lit(1_600_000_000) + F.col("s")))
        .withColumns({"unsent": F.lit(False), "has_link": F.lit(False), "kind_mask": F.lit(0), "attach_count": F.lit(0)})
        .drop("s")
    )
    said = ["lantern", "harb lantern", "common often", "lantern -word", "harbour plain zzz", '"common often"', "after:2021 lantern common", "nothing-at-all"]
    parsed = durable(querytable.parse(spark.createDataFrame(list(enumerate(said)), "query_id long, text string")))
    people = spark.createDataFrame([(1, "Ann", "+15550001", "15550001")], "handle_id long, name string, address string, digits string")
    chats = spark.createDataFrame([(1, "A", "A", False)], "chat_id long, title string, display_name string, is_group boolean")
    members = spark.createDataFrame([(1, 1)], "chat_id long, handle_id long")
    return messages, parsed, filters.resolve(parsed, people, chats, members), keyword.build_index(messages)


def by_query(df):
    out = {}
    for r in df.collect():
        out.setdefault(r["query_id"], []).append((r["rank"], r["message_id"], r["score"]))
    return {q: sorted(rows) for q, rows in out.items()}


@pytest.mark.parametrize("plan,blocks,k", [("strict", (16, 2), 7), ("relaxed", (128, 16), 50)])
def test_best_matches_are_those_of_the_whole_list(corpus, monkeypatch, plan, blocks, k):
    messages, parsed, resolved, index = corpus
    monkeypatch.setattr(keyword, "BLOCK_IDS", blocks[0])
    monkeypatch.setattr(keyword, "FIRST_BLOCKS", blocks[1])
    m = keyword.match(parsed, index)
    every = keyword.strict_scores(m) if plan == "strict" else keyword.relaxed_scores(m, parsed)
    want = by_query(keyword.ranked_matches(every, messages, resolved))
    got = by_query(keyword.best_matches(m, plan, messages, resolved, k))
    assert got == {q: rows[:k] for q, rows in want.items()}
    assert len(want) >= 5


def test_blocks_that_cannot_win_are_not_joined(corpus, monkeypatch):
    messages, parsed, resolved, index = corpus
    monkeypatch.setattr(keyword, "BLOCK_IDS", 16)
    monkeypatch.setattr(keyword, "FIRST_BLOCKS", 2)
    m = keyword.match(parsed, index)
    bounds = durable(keyword.block_bounds(m, "relaxed", messages))
    first = keyword.top_per_group(bounds, ["query_id"], [F.desc("bound"), F.col("block")], 2).select("query_id", "block")
    best = keyword.best_matches(m, "relaxed", messages, resolved, 7)
    floors = best.groupBy("query_id").agg(F.count("*").alias("n"), F.min("score").alias("floor")).filter("n = 7")
    left = keyword.open_blocks(bounds, first, floors.select("query_id", "floor"))
    joined = lambda blocks: m.groups.filter("plan = 'relaxed'").join(blocks, "query_id").join(m.hits, ["atom", "block"]).count()
    assert joined(left.select("query_id", "block").union(first)) < 0.4 * joined(bounds.select("query_id", "block"))


def test_looked_up_matches_have_their_rank_in_the_whole_list(spark, corpus):
    messages, parsed, resolved, index = corpus
    whole = keyword.keyword_search(parsed, index, messages, resolved, None)
    want = {(r["query_id"], r["message_id"]): r["rank"] for r in whole.strict.collect()}
    deep = [key for key, rank in want.items() if rank in (301, 777)] + [(0, 1), (2, 50)]
    asked = spark.createDataFrame(deep, "query_id long, message_id long")
    found = keyword.keyword_search(parsed, index, messages, resolved, fusion.depth(50), looked_up=asked)
    got = {(r["query_id"], r["message_id"]): r["rank"] for r in found.strict.collect()}
    assert all(want[key] == rank for key, rank in got.items())
    assert {key for key in deep if key in want} <= got.keys()
    assert {key for key, rank in want.items() if rank <= 50} <= got.keys()
    relaxed = {(r["query_id"], r["message_id"]): r["rank"] for r in whole.relaxed.collect()}
    for r in found.relaxed.collect():
        assert relaxed[r["query_id"], r["message_id"]] == r["rank"]
    assert {key for key, rank in relaxed.items() if rank <= 50} <= {(r["query_id"], r["message_id"]) for r in found.relaxed.collect()}


def test_switch_to_any_word_matches_is_an_option(corpus):
    messages, parsed, resolved, index = corpus
    count = lambda n: keyword.keyword_search(parsed, index, messages, resolved, 10, relax_below=n).relaxed.select("query_id").distinct().count()
    assert count(0) == 0 and count(100_000) > count(20)


def test_a_message_far_down_one_list_counts_in_both(spark):
    rows = lambda ranks: spark.createDataFrame([(1, m, r) for m, r in ranks], "query_id long, message_id long, rank long")
    strict = rows([(1000 + r, r) for r in range(1, 51)] + [(7, 301)])
    meaning = rows([(2000 + r, r) for r in range(1, 60)] + [(7, 60)])
    top = {r["message_id"]: r for r in fusion.fuse({"strict": strict, "relaxed": strict.limit(0), "meaning": meaning}, 150).collect()}
    assert top[7]["score"] == pytest.approx(1 / 120 + 1 / 361) and top[7]["matched_by"] == "both"
    assert top[7]["rank"] < top[1050]["rank"]  # before rank 50 of one list


def test_depth_is_the_threshold():
    for limit in (1, 20, 50, 500):
        assert fusion.depth(limit) == limit
        deep = fusion.depth(limit, 2)
        assert 2 / (60 + deep + 1) <= 1 / (60 + limit)

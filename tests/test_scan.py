"""Search without an index against the same search over postings."""

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from chatlake.functions import splitting, text
from chatlake.operators import deltas, filters, fusion, keyword, querytable, scan
from chatlake.session import durable

SAID = [
    "zwei", "ha", "éa the", '"de la" le', "the -la", '"la la"', "in:room the", 'from:"ann" from:me the', "has:link de", "from:nobody the",
    "the the le", "in:room in:attic le", "has:photo the", "after:2020-09-14 la", "unknown words only", "de -zwei", "İs σ", "12 x", "has:link", "le",
]
TEXTS = [
    "Zwei Häuser, the LA la la", "de la Le éa ÉA", None, "", "İs the ΣΑΣ 12 x² de—la", "the the the le zwei", "la la la 日本 the", "é́ combined à the x",
    "http://a.b de la harbour", "a b c the_le", "straße ﬀ ǅ the", "Le LE le",
]


@pytest.fixture(scope="module")
def history(spark):
    rows = [
        (k, k % 4, k % 3, None if k % 11 == 5 else k % 3 == 0, 1 if k % 13 == 7 else 0, TEXTS[k * 7 % 12], k % 5 == 0, k % 8, k * 9000 if k % 17 else None)
        for k in range(400)
    ]
    schema = "message_id long, chat_id long, handle_id long, from_me boolean, kind int, text string, has_link boolean, kind_mask int, s long"
    messages = spark.createDataFrame(rows, schema).withColumn("ts", F.timestamp_seconds(F.lit(1_600_000_000) + F.col("s"))).drop("s")
    messages = durable(messages.withColumns({"unsent": F.lit(False), "attach_count": F.lit(0)}))
    parsed = durable(querytable.parse(spark.createDataFrame(list(enumerate(SAID)), "query_id long, text string")))
    people = spark.createDataFrame([(1, "Ann", "+15550001", "15550001")], "handle_id long, name string, address string, digits string")
    chats = spark.createDataFrame([(1, "Room", "Room", True), (2, "attic room", "", True)], "chat_id long, title string, display_name string, is_group boolean")
    members = spark.createDataFrame([(1, 1)], "chat_id long, handle_id long")
    return messages, parsed, filters.resolve(parsed, people, chats, members), keyword.build_index(messages)


def ranks(df):
    return {(r["query_id"], r["message_id"]): (r["rank"], round(r["score"], 8)) for r in df.collect()}


def test_words_are_those_of_the_index(spark):
    texts = [*TEXTS, "Ĳ ŉ ª²³ µ Ÿ ɏ", "x" * 300 + "é" * 5, "é", "a é", "ø-Ł đ", "‘quoted’… word"]
    rows = spark.createDataFrame([(t,) for t in texts], "text string")
    rows = rows.select(F.lower("text").alias("low"), F.lower("text").rlike(splitting.SAFE).alias("other"), text.tokens(F.col("text")).alias("t")).collect()
    rows = [r for r in rows if not r["other"]]
    assert len(rows) >= 12
    words, n = splitting.split_words(pa.array(["skipped", *[r["low"] for r in rows]]).slice(1))
    assert n.tolist() == [len(r["t"] or []) for r in rows]
    assert words.to_pylist() == [w for r in rows for w in r["t"] or []]
    assert splitting.split_words(pa.array([None, ""], pa.string()))[1].tolist() == [0, 0]


@pytest.mark.parametrize("at_once", [512, 7])
def test_whole_lists_equal_those_of_the_postings(history, monkeypatch, at_once):
    messages, parsed, resolved, index = history
    monkeypatch.setattr(scan, "QUERIES_AT_ONCE", at_once)
    want = keyword.keyword_search(parsed, index, messages, resolved, None)
    got = scan.keyword_search(parsed, messages, resolved, None)
    assert ranks(got.strict) == ranks(want.strict) and ranks(got.relaxed) == ranks(want.relaxed)
    assert len(want.strict.select("query_id").distinct().collect()) >= 12 and not want.relaxed.isEmpty()


def test_best_and_looked_up_have_ranks_of_the_whole_list(spark, history, monkeypatch):
    messages, parsed, resolved, index = history
    monkeypatch.setattr(scan, "MOST_ROWS", 16)
    whole = keyword.keyword_search(parsed, index, messages, resolved, None, 100)
    strict, relaxed = ranks(whole.strict), ranks(whole.relaxed)
    asked = [key for lists in (strict, relaxed) for key, (rank, _) in lists.items() if rank % 9 == 4] + [(0, 2), (3, 399)]
    asked = spark.createDataFrame(asked, "query_id long, message_id long")
    found = scan.keyword_search(parsed, messages, resolved, 5, 100, asked)
    for got, want in ((ranks(found.strict), strict), (ranks(found.relaxed), relaxed)):
        assert all(want[key] == value for key, value in got.items())
        assert {key for key, (rank, _) in want.items() if rank <= 100 or rank % 9 == 4} <= got.keys()
        assert max(rank for rank, _ in got.values()) > 120


def test_texts_do_not_leave_their_task(spark, history):
    messages, parsed, resolved, _ = history
    plan = scan._rows(messages, resolved, spark.createDataFrame([(0, 0)], "query_id long, q int"), None)._jdf.queryExecution().toString()
    assert "SortMergeJoin" not in plan


def test_depth_of_fusion_is_enough(history):
    messages, parsed, resolved, index = history
    lists = [f(parsed, *a, messages, resolved, fusion.depth(10)) for f, a in ((scan.keyword_search, ()), (keyword.keyword_search, (index,)))]
    a, b = ([tuple(r) for r in fusion.fuse({"strict": x.strict, "relaxed": x.relaxed}, 10).orderBy("query_id", "rank").collect()] for x in lists)
    assert a == b


def test_lengths_of_changes_are_counted_in_tasks(spark):
    rows = spark.createDataFrame([(1, True, True, "a É b", "日本 x"), (2, False, True, None, None), (3, True, False, "gone", None)], "message_id long, was boolean, here boolean, old string, new string")
    made = deltas.signed_texts(rows, 1)
    assert "MapInArrow" in made._jdf.queryExecution().toString()
    assert [(r["message_id"], r["old_length"], r["new_length"], r["new_hash"] is None) for r in made.orderBy("message_id").collect()] == [
        (1, 3, 2, False), (2, 0, 0, False), (3, 1, 0, True),
    ]


@pytest.mark.parametrize("below", [20, 0])
def test_any_word_lists_alone_are_made_from_the_terms_of_their_queries(history, monkeypatch, below):
    messages, parsed, resolved, index = history
    best, seen = scan._best, []
    monkeypatch.setattr(scan, "_best", lambda make, k: seen.append(make().b) or best(make, k))
    want = ranks(keyword.keyword_search(parsed, index, messages, resolved, None, below).relaxed)
    got = scan.keyword_search(parsed, messages, resolved, None, below, all_words=False)
    assert ranks(got.relaxed) == want and got.strict.isEmpty()
    assert bool(want) == bool(below) == bool(seen)
    assert all(b.n < len(SAID) for b in seen)

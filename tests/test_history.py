"""Sync, windows, search and streaming over the generated history; expected results are worked out from its rows."""

import json
import re

import pytest
from history import CHATS, CONTACTS, DAY, IDS, LAST_ID, MESSAGES, MINUTE, PEOPLE, START, address, contacts, message, raw, window_starts
from pyspark.sql import functions as F

from chatlake import schemas
from chatlake.operators import embed, fusion, keyword, querytable, views, windows
from chatlake.plans import search, stored, sync
from chatlake.session import durable
from chatlake.sources import raw as raw_source
from chatlake.sources.tables import History
from chatlake.streaming import feed


def saying(*words, where=lambda row, chat: True):
    """Ids of messages in which every word begins one of the message's words."""
    tokens = lambda row: re.findall(r"[^\W_]+", row["text"].lower())
    return {row["rowid"] for row, chat in MESSAGES if where(row, chat) and all(any(t.startswith(w) for t in tokens(row)) for w in words)}


def at(rowid):
    return next(row for row, _ in MESSAGES if row["rowid"] == rowid)


@pytest.fixture(scope="module")
def history(spark, tmp_path_factory):
    h = History(spark, str(tmp_path_factory.mktemp("history")))
    report = sync.sync(h, raw(spark), full=True, contacts=contacts(spark))
    assert (report.read, report.changed, report.deleted, report.touched_chats) == (len(MESSAGES), len(MESSAGES), 0, 5)
    assert {r.first_id for r in h.read("windows").select("first_id").collect()} == window_starts(MESSAGES)
    sync.embed_windows(h)
    return h


@pytest.fixture(scope="module")
def corpus(history):
    return stored.corpus(history)


own = lambda row, chat: row["is_from_me"] == 1
sender = lambda h: lambda row, chat: not row["is_from_me"] and row["handle_id"] == h
#: search text: the messages that match
KEYWORDS = {
    "pump valve": saying("pump", "valve"),
    "compo": {IDS["compost"]},
    "spad needs": saying("spad", "needs"),
    "pump -reading": saying("pump") - {IDS["reading"]},
    "from:mira valve": saying("valve", where=sender(1)),
    "from:me bucket": saying("bucket", where=own),
    "from:me from:priya rake": saying("rake", where=own) | saying("rake", where=sender(4)),
    'in:"seed swap" pump': {IDS["ordered"], IDS["reading"]},
    "from:55550104 tomatoes": {IDS["tomatoes"]},
    "has:link": {IDS["seeds"]},
    "has:photo": {IDS["tomatoes"]},
    "with:lev supper": {IDS["supper"]},
    "from:nobody-here spade": set(),
    "in:mira in:lev hose": saying("hose", where=lambda row, chat: chat == 53),
    '"is ordered"': {IDS["ordered"]},
    "during:2023-08": {row["rowid"] for row, _ in MESSAGES if row["date"] >= at(IDS["supper"])["date"]},
}
MEANING = ["image", "picture has:link"]


@pytest.fixture(scope="module")
def hits(spark, corpus):
    asked = spark.createDataFrame(list(enumerate([*KEYWORDS, *MEANING])), "query_id long, text string")
    names, out = [*KEYWORDS, *MEANING], {}
    for mode, only in (("keyword", True), ("hybrid", False)):
        for r in search.search(asked, corpus, 60, keyword_only=only, relax_below=0).orderBy("query_id", "rank").collect():
            out.setdefault((mode, names[r.query_id]), []).append(r)
    return out


def test_keyword_search_and_filters(hits):
    assert {k: {r.message_id for r in hits.get(("keyword", k), [])} for k in KEYWORDS} == KEYWORDS
    assert all(KEYWORDS[k] for k in KEYWORDS if "nobody" not in k)


def test_hits_carry_chat_sender_people_and_snippet(hits):
    one = hits["keyword", "from:mira valve"][0]
    assert (one.chat_title, one.sender, one.is_group) == (PEOPLE[1][1], PEOPLE[1][1], False) and [p.handle_id for p in one.people] == [1]
    assert one.snippet == "the pump needs a \x02valve\x03, model KX-40"
    group = hits["keyword", 'in:"seed swap" pump'][0]
    assert (group.chat_title, group.is_group) == ("Seed Swap", True) and {p.handle_id for p in group.people} == {1, 2, 3, 4}
    assert hits["keyword", "has:photo"][0].attachment_count == 1


def test_meaning(hits):
    found = hits["hybrid", "image"]
    assert (found[0].message_id, found[0].matched_by) == (IDS["greenhouse"], "meaning")
    assert {r.message_id for r in hits.get(("hybrid", "picture has:link"), [])} <= {IDS["seeds"]}  # filters before the nearest windows
    for text, ids in KEYWORDS.items():
        if "has:" not in text and "during:" not in text:
            assert ids <= {r.message_id for r in hits.get(("hybrid", text), [])}
    assert any(r.matched_by == "both" for r in hits["hybrid", "pump valve"])


def test_vectors_and_coverage(history):
    n = len(window_starts(MESSAGES))
    assert history.read("vectors").filter("status = 'embedded' AND size(q) = 64").count() == n
    count = lambda model: tuple(embed.coverage(history.read("windows"), history.read("vectors"), model).select("done", "windows").first())
    assert count(embed.BagOfWords.model_id) == (n, n) and count("some-other-model") == (0, n)


def test_chat_list_and_context(history):
    m, c = history.read("messages"), history.read("chats")
    page = [r.chat_id for r in views.chat_list(c, m, 3).orderBy(F.desc("last_ts")).collect()]
    newest = {}
    for row, chat in MESSAGES:
        newest[chat] = row["date"]
    assert page == sorted(newest, key=newest.get, reverse=True)[:3]
    inside = [row["rowid"] for row, chat in MESSAGES if chat == 53]
    k = len(inside) // 2
    around = views.context(m.filter(F.col("message_id") == inside[k]), m, 2, 3).orderBy("ts").collect()
    assert [r.message_id for r in around] == inside[k - 2 : k + 4]


def test_incremental_then_full(spark, tmp_path):
    h = History(spark, str(tmp_path / "h"))
    sync.sync(h, raw(spark), full=True, contacts=contacts(spark))
    sync.embed_windows(h)
    seeds = at(IDS["seeds"])
    more = MESSAGES + [
        message(LAST_ID + 1, 52, None, START + 26 * DAY + 372 * 2 * MINUTE, "thanks, I will look"),  # minutes after the link
        message(LAST_ID + 2, 52, None, START + 45 * DAY, "is the barn free?"),  # back-dated, on its own
    ]
    assert 0 < more[-2][0]["date"] - seeds["date"] < 45 * 60e9
    report = sync.sync(h, raw(spark, more), contacts=contacts(spark), now=F.lit("2023-09-20").cast("timestamp"))
    assert (report.changed, report.touched_chats) == (2, 1)
    starts = lambda: {r.first_id for r in h.read("windows").select("first_id").collect()}
    assert starts() == window_starts(more)
    waiting = windows.pending(h.read("windows"), h.read("vectors"), embed.BagOfWords.model_id)
    assert {r.first_id for r in waiting.collect()} == {seeds["rowid"], LAST_ID + 2}
    # a full sync: an edit changes the text, a chat that is gone leaves with its windows
    kept = [(row | {"text": "model KX-41", "date_edited": 1}, chat) if row["rowid"] == IDS["valve"] else (row, chat) for row, chat in more if chat != 54]
    report = sync.sync(h, raw(spark, kept), full=True, contacts=contacts(spark))
    assert (report.deleted, report.changed) == (len(more) - len(kept), 1)
    row = h.read("messages").filter(F.col("message_id") == IDS["valve"]).first()
    assert (row.text, row.edited) == ("model KX-41", True) and starts() == window_starts(kept)
    assert same_index(h) and h.state(stored.COUNT) == "3"
    asked = spark.createDataFrame([(1, "kx"), (2, "valve kx"), (3, "barn free")], "query_id long, text string")
    found = search.search(asked, stored.corpus(h), keyword_only=True, relax_below=0).collect()
    assert {(r.query_id, r.message_id) for r in found} == {(1, IDS["valve"]), (3, LAST_ID + 2)}


def same_index(h):
    """The stored index is what one build over the messages gives."""
    rows = lambda index: (
        sorted((r.term, r.message_id, r.tf, r.length, tuple(r.positions)) for r in index.postings.collect()),
        sorted((r.term, r.df, r.stem) for r in index.vocabulary.collect()),
        [(r.n, round(r.avg_length or 0, 9)) for r in index.stats.collect()],
    )
    return rows(stored.corpus(h).index) == rows(keyword.build_index(h.read("messages")))


def test_interrupted_index_batches(spark, tmp_path):
    h = History(spark, str(tmp_path / "h"))
    sync.sync_people(h, raw(spark))
    assert same_index(h)  # empty
    third = len(MESSAGES) // 3
    sync.apply_messages(h, raw_source.messages(raw(spark, MESSAGES[:third])))
    assert same_index(h) and h.state(stored.COUNT) == "1"
    # a batch is written, its messages are not: it does not count, and is dropped by the next run
    held = h.read("messages")
    stored.begin(h, held, held.withColumn("text", F.concat("text", F.lit(" lost"))))
    assert same_index(h)
    stored.settle(h)
    assert same_index(h) and h.state(stored.COUNT) == "1"
    # only some messages of a batch were written: those stay in it
    even = F.col("message_id") % 2 == 0
    wanted = held.filter("message_id % 3 <> 0").withColumn("text", F.concat("text", F.lit(" new")))
    written = wanted.filter(even).unionByName(held.filter(~even))
    stored.begin(h, held, wanted)
    h.replace("messages", durable(written))
    stored.settle(h)
    assert same_index(h) and h.state(stored.COUNT) == "2"
    sync.apply_messages(h, raw_source.messages(raw(spark)))
    assert same_index(h) and h.state(stored.COUNT) == "3"
    h.set_state(**{stored.COUNT: None})  # a history from before there was an index
    assert h.state(stored.COUNT) is None
    stored.settle(h)
    assert same_index(h)


def test_interrupted_rebuild_is_resumed(spark, tmp_path):
    h = History(spark, str(tmp_path / "h"))
    sync.sync_people(h, raw(spark))
    sync.apply_messages(h, raw_source.messages(raw(spark)), raw_source.attachments(raw(spark)))
    _, changed, _ = sync.apply_messages(h, raw_source.messages(raw(spark)))
    assert changed == 0 and {r.chat_id for r in h.read("dirty").collect()} == {51, 52, 53, 54, 55}
    assert sync.rebuild_dirty(h) > 0 and h.read("dirty").isEmpty()


def test_contacts_file(spark, tmp_path):
    h = History(spark, str(tmp_path / "h"))
    sync.sync_people(h, raw(spark))
    sync.apply_messages(h, raw_source.messages(raw(spark)))
    title = lambda: h.read("chats").filter("chat_id = 51").first().title
    assert title() == address(1)
    path = tmp_path / "names.json"
    path.write_text(json.dumps({"contacts": CONTACTS}))
    named = [chat for chat, (_, members) in CHATS.items() if any(PEOPLE[h_][1] for h_ in members)]
    assert sync.apply_contacts_file(h, str(path)) == len(named)
    assert title() == PEOPLE[1][1]
    assert all(r.text.startswith(PEOPLE[1][1] + " · 2023-06-") for r in h.read("windows").filter("chat_id = 51").collect())


def test_classification(spark):
    target = f"row-{IDS['valve']}"
    extra = [
        message(940, 53, 1, START, None, item_type=2, group_title="Plots"),
        message(941, 53, 1, START, None, balloon_bundle_id="org.example.poll"),
        message(942, 53, 1, START, "https://x.example", balloon_bundle_id=raw_source.URL_PREVIEW),
        message(943, 53, 1, START, "taken back", date_retracted=1),
        message(944, 53, 1, START, "￼ \n"),
        message(945, None, 1, START, "outside any chat"),
        message(946, 51, 1, START, None, associated_message_type=2000, associated_message_guid=f"p:1/{target}"),
        message(947, 51, 1, START + MINUTE, None, associated_message_type=3000, associated_message_guid=f"p:1/{target}"),
        message(948, 51, None, START, None, associated_message_type=2006, associated_message_guid=f"bp:{target}", associated_message_emoji="🎉"),
        message(949, 51, None, START, None, associated_message_type=2007, associated_message_guid=target),
    ]
    tables = raw(spark, MESSAGES + extra)
    rows = {r.message_id: r for r in raw_source.messages(tables).collect()}
    assert (rows[940].kind, rows[940].text) == (1, "Plots")
    assert (rows[941].kind, rows[942].kind, rows[942].has_link) == (2, 0, True)
    assert rows[943].unsent and rows[943].text is None and rows[944].text is None
    assert 945 not in rows and 946 not in rows and rows[IDS["tomatoes"]].attach_count == 1 and rows[IDS["ordered"]].handle_id is None
    log = {r.reaction_id: r for r in raw_source.reactions(tables).collect()}
    assert set(log) == {946, 947, 948}
    assert (log[946].target_guid, log[946].part, log[946].removed, log[947].removed, log[948].emoji) == (target, 1, False, True, "🎉")
    from chatlake.operators import reactions

    assert [r.emoji for r in reactions.live(raw_source.reactions(tables)).collect()] == ["🎉"]


def test_reactions_do_not_depend_on_how_the_log_is_cut(spark):
    from chatlake.operators import reactions

    rows = [("g", 0, False, 1, "👍", START, 1, False), ("g", 0, False, 1, "👍", START + 2 * MINUTE, 3, True), ("g", 0, False, 1, "🎉", START + MINUTE, 2, False)]
    log = spark.createDataFrame(rows, "target_guid string, part int, from_me boolean, handle_id long, emoji string, ts timestamp, reaction_id long, removed boolean")
    first, late = log.filter("reaction_id <> 2"), log.filter("reaction_id = 2")
    assert reactions.live(log).count() == 0
    assert reactions.live(reactions.merge(reactions.latest(first), late)).count() == 0


def test_quarantine(spark):
    rows = spark.createDataFrame([("1", "G", "5"), ("x", "G", "5"), ("2", None, "5"), ("3", "G", "soon")], "rowid string, guid string, date string")
    good, bad = raw_source.split_valid(rows)
    assert good.count() == 1 and {r.reason for r in bad.collect()} == {"no id", "no guid", "bad date"}


def test_stream(spark, tmp_path):
    h = History(spark, str(tmp_path / "h"))
    sync.sync_people(h, raw(spark), contacts(spark))
    rows = raw_source.messages(raw(spark))
    landed = str(tmp_path / "landed")
    cols = [f.split()[0] for f in schemas.MESSAGES.split(", ")]

    def land(part):
        part.select(cols).coalesce(1).write.mode("append").parquet(landed)
        q = feed.start(h, landed, str(tmp_path / "ck"), files_per_batch=1).trigger(availableNow=True).start()
        q.awaitTermination()

    third = MESSAGES[len(MESSAGES) // 3][0]["rowid"]
    land(rows.filter(F.col("message_id") > third))
    land(rows.filter(F.col("message_id") > third + 20))  # an overlapping re-read
    assert h.state("stream:changed") == "0"
    land(rows.filter(F.col("message_id") <= third))  # late, from before everything else
    assert h.read("messages").count() == len(MESSAGES)
    whole = {r.text for r in windows.build(windows.assign(windows.lines(h.read("messages"), h.read("handles"))), h.read("chats")).collect()}
    assert {r.text for r in h.read("windows").collect()} == whole
    assert feed.progress(h).first().windows == len(whole)


def test_group_hits(spark):
    rows = [(1, 1, 5, 10, START), (1, 2, 6, 11, START), (1, 3, 7, 10, START + DAY), (1, 4, 8, None, START)]
    hits = spark.createDataFrame(rows, "query_id long, rank long, message_id long, chat_id long, ts timestamp")
    got = {r.group_key: (r.best_rank, r.n_hits, r.preview) for r in fusion.group_hits(hits).collect()}
    assert got == {"c10": (1, 2, [5, 7]), "c11": (2, 1, [6]), "m8": (4, 1, [8])}


def test_rejected_texts_are_isolated(spark):
    class Picky:
        model_id, dims, max_distance, query_prefix, passage_prefix = "picky", 1, 0.5, "query: ", "passage: "

        def load(self):
            pass

        def embed(self, texts):
            if any("bad" in t for t in texts):
                raise ValueError
            return [[float(len(t))] for t in texts]

    rows = spark.createDataFrame([(i, "bad" if i == 3 else "fine") for i in range(10)], "id long, text string")
    got = {r.id: (r.status, r.v) for r in embed.embed_with(rows, "id", "text", Picky(), batch=4).collect()}
    assert got.pop(3) == ("rejected", None)
    assert len(got) == 9 and all(v == ("embedded", [13.0]) for v in got.values())


def test_parse(spark):
    cases = {
        'kettle number from:"ada brook" in:family has:photo -old': {"prefix: kettle", "prefix: number"},
        '"see you" it\'s (fine) AND': {"prefix: it", "exact: s", "prefix: fine", "prefix: and", "phrase: see you"},
    }
    frame = spark.createDataFrame(list(enumerate(cases)), "query_id long, text string")
    parsed = querytable.parse(frame)
    terms = querytable.strict_terms(parsed).groupBy("query_id").agg(F.collect_set("atom").alias("a")).collect()
    assert {r.query_id: set(r.a) for r in terms} == dict(enumerate(cases.values()))
    first = parsed.filter("query_id = 0").first()
    assert (first.words, first.from_vals, first.chat_vals, first.has, first.excluded) == (["kettle", "number"], ["ada brook"], ["family"], ["photo"], ["old"])
    frame = spark.createDataFrame(
        [(1, "what's the number to get in the kettle -old"), (2, "AB 77"), (3, "kettle"), (4, "what is the")], "query_id long, text string"
    )
    relaxed = querytable.relaxed_terms(querytable.parse(frame)).groupBy("query_id").agg(F.collect_list("atom").alias("a")).collect()
    assert {r.query_id: sorted(r.a) for r in relaxed} == {1: ["prefix: kettle", "prefix: number"], 2: ["prefix: 77", "prefix: ab"]}
    west = querytable.parse(spark.createDataFrame([(1, "after:2023-12-31 before:2024")], "query_id long, text string"), "-05:00")
    row = west.select(F.unix_millis("after_ts").alias("a"), F.unix_millis("before_ts").alias("b")).first()
    assert (row.a, row.b) == ((1704067200 + 5 * 3600) * 1000,) * 2


def test_snippets(spark):
    long = "blah " * 60 + "the kettle number is 52! " + "more " * 60
    rows = spark.createDataFrame(
        [(1, long, 0, ["kettle", "number"]), (2, "renumbered number", 0, ["number"]), (3, None, 1, ["x"]), (4, "plain", 0, [])],
        "id int, text string, attach_count long, marks array<string>",
    )
    got = {r.id: r.snippet for r in fusion.add_snippets(rows, 80).collect()}
    assert got[1].startswith("…") and got[1].endswith("…") and "\x02kettle\x03 \x02number\x03" in got[1]
    assert (got[2], got[3], got[4]) == ("renumbered \x02number\x03", "Attachment", "plain")


def test_transcript_pattern(spark):
    rows = [(1, 'where is the "tool  shed" kettle c++'), (2, "is it"), (3, "has:link")]
    parsed = querytable.parse(spark.createDataFrame(rows, "query_id long, text string"))
    got = {r.query_id: r.pattern for r in querytable.transcript_pattern(parsed).collect()}
    assert got[1] == r"(?iu)((?<![\p{L}\p{N}])kettle|tool\s+shed)" and got[3] is None
    assert r"(?<![\p{L}\p{N}])is" in got[2]
    marked = parsed.sparkSession.range(1).select(F.regexp_replace(F.lit("the Kettle of the Tool Shed"), got[1], "<$1>").alias("m"))
    assert marked.first().m == "the <Kettle> of the <Tool Shed>"

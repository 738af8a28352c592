"""Embedding, nearest windows, hybrid search and its evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from chatlake.catalog import search as s
from chatlake.catalog import views as v
from chatlake.catalog.conversations import window_ctes
from chatlake.catalog.registry import query
from chatlake.functions import text, vectors
from chatlake.operators import embed, evaluate, fusion, ingest, keyword, nearest, windows
from chatlake.plans import search as plan
from chatlake.session import durable

LINES = "lines AS (SELECT chat_id, ts, message_id, who || ': ' || text AS line, title FROM messages WHERE text IS NOT NULL)"
STEP = "(CAST(2 AS DOUBLE) / 255)"


def bow_sql(name: str, source: str, key: str, column: str) -> str:
    """Bag-of-words vectors of ``source`` in SQL."""
    cases = " ".join(f"WHEN w IN ({s.quoted(g)}) THEN {i}" for i, g in enumerate(embed.SYNONYMS))
    return f"""{name}_words AS (SELECT {key}, unnest(regexp_extract_all(lower({column}), '[\\p{{L}}\\p{{N}}]+')) AS w FROM {source}),
{name}_counts AS (SELECT {key}, CASE {cases} ELSE 3 + CAST('0x' || substring(md5(w), 1, 8) AS BIGINT) % 61 END AS b, count(*) AS n
  FROM {name}_words WHERE strlen(w) >= 3 GROUP BY ALL),
{name}_norms AS (SELECT {key}, greatest(sqrt(CAST(sum(n * n) AS DOUBLE)), 1e-6) AS norm FROM {name}_counts GROUP BY 1),
{name} AS (SELECT k.{key}, list(coalesce(c.n, 0) / coalesce(m.norm, 1) ORDER BY k.b) AS v
  FROM (SELECT {key}, unnest(range(64)) AS b FROM {source}) k LEFT JOIN {name}_counts c ON c.{key} = k.{key} AND c.b = k.b
  LEFT JOIN {name}_norms m ON m.{key} = k.{key} GROUP BY k.{key}),
{name}_q AS (SELECT {key}, list_transform(v, lambda x: CAST(trunc((x + 1) / {STEP} - 128) AS DOUBLE)) AS q FROM {name})"""


def distance_sql(a: str, b: str) -> str:
    return (
        f"round(1 - list_dot_product({a}, {b}) / (sqrt(list_dot_product({a}, {a})) * sqrt(list_dot_product({b}, {b}))), 9)"
    )


# ---------------------------------------------------------------- embeddings
@query(
    "bow_vectors",
    v.with_(v.DOCUMENT_MESSAGES, bow_sql("vec", "messages", "message_id", "text"))
    + "SELECT c.message_id, c.b AS dim, round(c.n / m.norm, 9) AS value FROM vec_counts c JOIN vec_norms m ON m.message_id = c.message_id",
)
def bow_vectors(d):
    rows = embed.bag_of_words(s.documents(d).select("message_id", "text"), "text")
    parts = rows.select("message_id", F.posexplode_outer("v").alias("dim", "value")).filter("value > 0")
    return parts.select("message_id", F.col("dim").cast("long").alias("dim"), F.round("value", 9).alias("value"))


@query(
    "vector_norms",
    """SELECT vec_id, round(sqrt(list_sum(list_transform(e, lambda x: x * x))), 9) AS length,
      round(list_sum(list_transform(e, lambda x: x / sqrt(list_sum(list_transform(e, lambda y: y * y))))), 9) AS unit_sum
    FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings)""",
)
def vector_norms(d):
    e = d.table("embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    total = F.aggregate(vectors.unit(F.col("v")), F.lit(0.0), lambda a, x: a + x)
    return e.select(
        "vec_id", F.round(vectors.norm(F.col("v")), 9).alias("length"), F.round(total, 9).alias("unit_sum")
    )


@query(
    "vector_int8",
    f"""SELECT vec_id, CAST(list_sum(list_transform(CAST(embedding AS DOUBLE[]), lambda x: CAST(trunc((x + 1) / {STEP} - 128) AS BIGINT))) AS BIGINT) AS total,
      array_to_string(list_transform(CAST(embedding AS DOUBLE[]), lambda x: CAST(trunc((x + 1) / {STEP} - 128) AS BIGINT)), ' ') AS q FROM embeddings""",
)
def vector_int8(d):
    q = vectors.to_int8(F.col("embedding").cast("array<double>"))
    return d.table("embeddings").select(
        "vec_id",
        F.aggregate(q, F.lit(0).cast("long"), lambda a, x: a + x).alias("total"),
        F.array_join(F.transform(q, lambda x: x.cast("string")), " ").alias("q"),
    )


KNN = """e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
near AS (SELECT a.vec_id AS query_id, b.vec_id AS window_id, a.label AS a_label, b.label AS b_label, """ + distance_sql("a.v", "b.v") + """ AS distance
  FROM e a JOIN e b ON a.vec_id <> b.vec_id),
knn AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, window_id) AS rank FROM near QUALIFY rank <= 60)
"""


def _embeddings(d):
    e = d.table("embeddings")
    return e.select(F.col("vec_id").alias("window_id"), F.col("embedding").cast("array<double>").alias("v"))


def _all_neighbours(d):
    rows = _embeddings(d)
    return nearest.knn(rows.withColumnRenamed("window_id", "query_id"), rows, skip_self=True)


@query("knn_exact", "WITH " + KNN + "SELECT query_id, window_id, round(distance, 6) AS distance, rank FROM knn")
def knn_exact(d):
    """The 60 nearest other vectors of every vector."""
    return _all_neighbours(d).withColumn("distance", F.round("distance", 6))


@query(
    "semantic_cut",
    "WITH " + KNN + "SELECT query_id, window_id, rank FROM knn k WHERE distance <= least(0.9, (SELECT min(distance) FROM knn b WHERE b.query_id = k.query_id) + 0.06)",
)
def semantic_cut(d):
    return nearest.cut(_all_neighbours(d), 0.9).select("query_id", "window_id", "rank")


@query(
    "nn_label_accuracy",
    "WITH " + KNN + "SELECT count(*) AS queries, count(*) FILTER (WHERE a_label = b_label) AS correct FROM knn WHERE rank = 1",
)
def nn_label_accuracy(d):
    labels = d.table("embeddings").select(F.col("vec_id").alias("id"), "label")
    return evaluate.nearest_label_accuracy(_all_neighbours(d), labels)


@query(
    "embed_coverage",
    v.with_(v.TURN_MESSAGES, "lines AS (SELECT chat_id, ts, message_id, who || ': ' || text AS line, title FROM messages WHERE text IS NOT NULL)",
            window_ctes(45), recursive=True)
    + "SELECT 1 AS step, count(*) FILTER (WHERE chat_id % 2 = 0) AS done, count(*) AS windows FROM windows UNION ALL SELECT 2, count(*), count(*) FROM windows",
)
def embed_coverage(d):
    """Conversations with an even number are embedded first, then, by what is still pending, the others."""
    from chatlake.catalog.conversations import turn_lines

    built = windows.build(windows.assign(turn_lines(d)), d.turn_chats()).withColumn("window_id", F.col("first_id"))
    nothing = built.limit(0).select("window_id", F.lit("").alias("model_id"))
    first = durable(embed.embed_pending(built.filter("chat_id % 2 = 0"), nothing))
    both = first.unionByName(embed.embed_pending(built, first))
    steps = [embed.coverage(built, stored, embed.BagOfWords.model_id).withColumn("step", F.lit(k)) for k, stored in ((1, first), (2, both))]
    return steps[0].unionByName(steps[1])


@query(
    "corpus_window_stats",
    v.with_(v.TURN_MESSAGES, LINES, window_ctes(45), recursive=True)
    + """SELECT 'messages' AS metric, count(*) AS value FROM messages UNION ALL SELECT 'chats', count(DISTINCT chat_id) FROM messages
    UNION ALL SELECT 'oldest', epoch_ms(min(ts)) FROM messages UNION ALL SELECT 'newest', epoch_ms(max(ts)) FROM messages
    UNION ALL SELECT 'attachments', count(*) FROM lineitem UNION ALL SELECT 'windows', count(*) FROM windows
    UNION ALL SELECT 'embedded_windows', count(*) FROM windows WHERE chat_id % 2 = 0""",
)
def corpus_window_stats(d):
    """Totals of a history with windows, of which those of conversations with an even number have vectors."""
    from chatlake.catalog.conversations import turn_lines

    built = durable(windows.build(windows.assign(turn_lines(d)), d.turn_chats()).withColumn("window_id", F.col("first_id")))
    nothing = built.limit(0).select("window_id", F.lit("").alias("model_id"))
    stored = embed.embed_pending(built.filter("chat_id % 2 = 0"), nothing)
    return ingest.corpus_stats(d.turn_messages(), d.attachments(), built, stored)


# -------------------------------------------------------------------- hybrid
def passages(d):
    """Every benchmark passage, whole, as a search for the documents that hold it."""
    return d.table("benchmark").select(F.col("item_id").alias("query_id"), "text")


ASKED = "asked AS (SELECT item_id AS query_id, text FROM benchmark)"
EVERYTHING = "eligible AS (SELECT a.query_id, m.message_id, m.ts FROM asked a, messages m)"
# Every fourth passage asks for a source, an author, links, or a time.
SOME = """eligible AS (SELECT a.query_id, m.message_id, m.ts FROM asked a, messages m WHERE CASE a.query_id % 4
  WHEN 0 THEN contains(m.title, 'src3') WHEN 1 THEN NOT m.from_me AND contains('author ' || m.lang, 'author fr')
  WHEN 2 THEN m.has_link ELSE m.ts >= TIMESTAMP '2024-01-02' END)"""
SOME_WINDOWS = """WHERE CASE a.query_id % 4 WHEN 3 THEN (SELECT start_ts FROM windows x WHERE x.first_id = w.first_id) >= TIMESTAMP '2024-01-01 21:00:00'
  ELSE (a.query_id, w.first_id) IN (SELECT (e.query_id, f.first_id) FROM eligible e JOIN fold f ON f.message_id = e.message_id) END"""
PASSAGES = f"""qtok AS (SELECT query_id, unnest(t) AS tok, unnest(range(len(t))) AS i, len(t) AS n FROM (SELECT query_id, {s.sql_tokens('text')} AS t FROM asked)),
useful AS (SELECT query_id, tok, min(i) AS i, max(n) AS n FROM qtok WHERE length(tok) > 1 AND tok NOT IN ({s.quoted(text.STOPWORDS)}) GROUP BY 1, 2),
groups AS (
  SELECT query_id, 'strict' AS plan, i AS grp, CASE WHEN length(tok) = 1 THEN 'exact' ELSE 'prefix' END AS mode, tok AS txt FROM qtok
  UNION ALL SELECT query_id, 'relaxed', i, 'prefix', tok FROM useful),
excl AS (SELECT query_id, '' AS term FROM asked WHERE FALSE)"""


def semantic_sql(some_windows: str = "") -> str:
    return (
        bow_sql("wvec", "windows", "first_id", "text")
        + ",\n"
        + bow_sql("qvec", "asked", "query_id", "text")
        + f""",
pairs AS (SELECT a.query_id, w.first_id, {distance_sql('a.q', 'w.q')} AS distance FROM qvec_q a, wvec_q w {some_windows}),
near AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, first_id) AS window_rank FROM pairs QUALIFY window_rank <= 60),
kept AS (SELECT * FROM near n WHERE distance <= least(0.9, (SELECT min(distance) FROM near b WHERE b.query_id = n.query_id) + 0.06)),
kranks AS (SELECT query_id, message_id, rank FROM strict UNION ALL
  SELECT r.query_id, r.message_id, r.rank + (SELECT count(*) FROM strict x WHERE x.query_id = r.query_id) FROM relaxed r),
said AS (SELECT query_id, list_filter(regexp_extract_all(lower(text), '\\S+'), lambda w: length(w) >= 3) AS said FROM asked),
inside AS (SELECT k.query_id, k.first_id, k.window_rank, m.message_id, m.ts, lower(m.text) AS body, r.rank AS krank,
    (SELECT count(*) FROM (SELECT unnest(q.said) AS w) WHERE contains(lower(m.text), w)) AS overlap
  FROM kept k JOIN fold f ON f.first_id = k.first_id JOIN messages m ON m.message_id = f.message_id
  JOIN eligible e ON e.query_id = k.query_id AND e.message_id = m.message_id JOIN said q ON q.query_id = k.query_id
  LEFT JOIN kranks r ON r.query_id = k.query_id AND r.message_id = m.message_id),
standing AS (SELECT * FROM inside QUALIFY row_number() OVER (PARTITION BY query_id, first_id
  ORDER BY krank NULLS LAST, overlap DESC, least(strlen(body), 280) DESC, ts DESC, message_id DESC) = 1),
meaning AS (SELECT query_id, message_id, row_number() OVER (PARTITION BY query_id ORDER BY min(window_rank)) AS rank
  FROM standing GROUP BY query_id, message_id),
fused AS (SELECT query_id, message_id, round(sum(1.0 / (60.0 + rank)), 12) AS score, bool_or(m) AS meaning, bool_or(NOT m) AS keyword FROM (
    SELECT query_id, message_id, rank, FALSE AS m FROM strict UNION ALL SELECT query_id, message_id, rank, FALSE FROM relaxed
    UNION ALL SELECT query_id, message_id, rank, TRUE FROM meaning) GROUP BY 1, 2),
ranked AS (SELECT query_id, message_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, message_id DESC) AS rank, score,
    CASE WHEN keyword AND meaning THEN 'both' WHEN meaning THEN 'meaning' ELSE 'keyword' END AS matched_by
  FROM fused QUALIFY rank <= 50)"""
    )


HYBRID = v.with_(v.DOCUMENT_MESSAGES, s.INDEX, ASKED, PASSAGES, EVERYTHING, s.MATCH, LINES, window_ctes(45), semantic_sql(), recursive=True)
FILTERED = v.with_(v.DOCUMENT_MESSAGES, s.INDEX, ASKED, PASSAGES, SOME, s.MATCH, LINES, window_ctes(45), semantic_sql(SOME_WINDOWS), recursive=True)


def hybrid_corpus(d) -> plan.Corpus:
    return plan.with_windows(s.corpus(d))


def ranked_passages(d):
    return plan.rank(passages(d), hybrid_corpus(d), 50).ranked


@query("semantic_anchors", HYBRID + "SELECT query_id, message_id, rank FROM meaning")
def semantic_anchors(d):
    return plan.ranked_lists(passages(d), hybrid_corpus(d)).lists["meaning"]


@query("hybrid_search", HYBRID + "SELECT query_id, message_id, rank, round(score, 9) AS score, matched_by FROM ranked")
def hybrid_search(d):
    return ranked_passages(d).withColumn("score", F.round("score", 9))


@query("hybrid_filtered", FILTERED + "SELECT query_id, message_id, rank, round(score, 9) AS score, matched_by FROM ranked")
def hybrid_filtered(d):
    """The same under filters by chat, person, kind and date, which come before the nearest windows are chosen."""
    asked = d.table("benchmark")
    prefixes = F.array(*map(F.lit, ("in:src3 ", 'from:"author fr" ', "has:link ", "after:2024-01-01 ")))
    text_ = F.concat(F.get(prefixes, (asked.item_id % 4).cast("int")), "text")
    ranked = plan.rank(asked.select(asked.item_id.alias("query_id"), text_.alias("text")), hybrid_corpus(d), 50).ranked
    return ranked.withColumn("score", F.round("score", 9))


@query(
    "hybrid_hits",
    HYBRID + """SELECT r.query_id, r.rank, r.message_id, m.chat_id, m.title AS chat_title,
      CASE WHEN NOT m.from_me THEN 'Author ' || m.lang END AS sender, epoch_ms(m.ts) AS ts_ms, r.matched_by FROM ranked r JOIN messages m ON m.message_id = r.message_id""",
)
def hybrid_hits(d):
    hits = plan.search(passages(d), hybrid_corpus(d), 50)
    return hits.select(
        "query_id", "rank", "message_id", "chat_id", "chat_title", "sender", F.unix_millis("ts").alias("ts_ms"), "matched_by"
    )


@query(
    "grouped_hits",
    HYBRID + """SELECT query_id, 'c' || CAST(chat_id AS VARCHAR) AS group_key, min(rank) AS best_rank, epoch_ms(max(ts)) AS latest_ms, count(*) AS n_hits,
      array_to_string(list_slice(list(r.message_id ORDER BY rank), 1, 3), ' ') AS preview
    FROM ranked r JOIN messages m ON m.message_id = r.message_id GROUP BY query_id, chat_id""",
)
def grouped_hits(d):
    ranked = ranked_passages(d).join(s.documents(d).select("message_id", "chat_id", "ts"), "message_id")
    grouped = fusion.group_hits(ranked)
    return grouped.select(
        "query_id", "group_key", "best_rank", F.unix_millis("latest_ts").alias("latest_ms"), "n_hits",
        F.array_join("preview", " ").alias("preview"),
    )


@query(
    "result_counts",
    HYBRID + """SELECT query_id, count(DISTINCT chat_id) AS conversations, count(*) AS messages, count(*) FILTER (WHERE matched_by = 'meaning') AS by_meaning
    FROM ranked r JOIN messages m ON m.message_id = r.message_id GROUP BY query_id""",
)
def result_counts(d):
    ranked = ranked_passages(d).join(s.documents(d).select("message_id", "chat_id"), "message_id")
    return fusion.result_counts(ranked)


@query(
    "eval_topk",
    HYBRID.rstrip() + """,
    relevance AS (SELECT item_id AS query_id, doc_id AS message_id FROM benchmark JOIN documents ON contains(documents.text, benchmark.text)),
    kw AS (SELECT query_id, message_id, row_number() OVER (PARTITION BY query_id ORDER BY 1.0 / (60.0 + rank) DESC, message_id DESC) AS rank FROM (
      SELECT query_id, message_id, rank FROM strict UNION ALL SELECT query_id, message_id, rank FROM relaxed)),
    firsts AS (
      SELECT 'hybrid' AS mode, q.query_id, (SELECT min(rank) FROM ranked r JOIN relevance x ON x.query_id = r.query_id AND x.message_id = r.message_id
        WHERE r.query_id = q.query_id AND r.rank <= 20) AS r FROM (SELECT DISTINCT query_id FROM relevance) q
      UNION ALL SELECT 'keyword', q.query_id, (SELECT min(rank) FROM kw r JOIN relevance x ON x.query_id = r.query_id AND x.message_id = r.message_id
        WHERE r.query_id = q.query_id AND r.rank <= 20) FROM (SELECT DISTINCT query_id FROM relevance) q)
    SELECT mode, count(*) AS queries, count(*) FILTER (WHERE r <= 1) AS top_1, count(*) FILTER (WHERE r <= 5) AS top_5 FROM firsts GROUP BY mode""",
)
def eval_topk(d):
    """A document is relevant to a passage it holds word for word; found with and without meaning."""
    c = hybrid_corpus(d)
    asked = passages(d).select(F.col("query_id").cast("string").alias("atom"), F.lit("phrase").alias("mode"), text.tokens(F.col("text")).alias("tokens"))
    held = keyword.phrase_hits(asked, keyword.build_index(c.messages)).select(F.col("atom").cast("long").alias("query_id"), "message_id")
    bodies = c.messages.select("message_id", F.col("text").alias("_body"))
    relevance = durable(
        held.join(passages(d), "query_id").join(bodies, "message_id").filter(F.col("_body").contains(F.col("text")))
        .select("query_id", "message_id")
    )
    both = [
        plan.rank(passages(d), c, 50, keyword_only=only).ranked.withColumn("mode", F.lit(mode))
        for mode, only in (("keyword", True), ("hybrid", False))
    ]
    return evaluate.topk_totals(evaluate.first_relevant_rank(both[0].unionByName(both[1]), relevance))


@query(
    "latency_percentiles",
    """WITH t AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value, event_id) AS rn, count(*) OVER (PARTITION BY event_type) AS n FROM events)
    SELECT event_type, max(CASE WHEN rn = floor((n - 1) * 0.5) + 1 THEN value END) AS p50, max(CASE WHEN rn = floor((n - 1) * 0.95) + 1 THEN value END) AS p95,
      max(value) AS max FROM t GROUP BY event_type""",
)
def latency_percentiles(d):
    """Event values read as timings, per event type."""
    return evaluate.latency_percentiles(d.table("events"), "event_type", "value", "event_id")

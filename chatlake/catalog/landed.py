"""Raw source rows made of the events, read by the source functions; file flags; a plug-in model."""

from __future__ import annotations

from pyspark.sql import functions as F

from chatlake import schemas
from chatlake.catalog import views as v
from chatlake.catalog.registry import query
from chatlake.functions import text
from chatlake.operators import chats, embed, querytable, storage
from chatlake.sources import raw as raw_source

EPOCH = 978_307_200_000_000

# Each column of the raw message table as SQL that Spark and DuckDB both take.
MESSAGE = {
    "rowid": "event_id",
    "guid": "concat('G', event_id)",
    "text": "CASE WHEN event_id % 7 = 0 THEN concat('see https://e.example/', event_type) ELSE event_type END",
    "handle_id": "user_id % 50",
    "service": "'s'",
    "is_from_me": "CASE WHEN user_id % 3 = 0 THEN 1 ELSE 0 END",
    "item_type": "CASE WHEN event_id % 19 = 0 THEN 2 ELSE 0 END",
    "group_title": "CASE WHEN event_id % 19 = 0 THEN 'New title' END",
    "associated_message_type": "CASE WHEN event_type = 'error' THEN 2000 + event_id % 8 + 1000 * (user_id % 2) ELSE 0 END",
    "associated_message_guid": "CASE WHEN event_type = 'error' THEN concat('p:', event_id % 3, '/G', CAST(floor(event_id / 10) AS BIGINT)) END",
    "associated_message_emoji": "CASE WHEN event_type = 'error' AND event_id % 8 = 6 THEN '🎉' END",
    "date_edited": "CASE WHEN event_id % 23 = 0 THEN 1 ELSE 0 END",
    "date_retracted": "CASE WHEN event_id % 29 = 0 THEN 1 ELSE 0 END",
    "balloon_bundle_id": "CASE WHEN event_id % 31 = 0 THEN 'com.example.game' END",
}
IN_CHAT = "event_id % 37 <> 0"
ATTACHED = "event_id % 4 = 0"
FILE = {
    "rowid": "event_id",
    "filename": "concat('/files/', event_id, '.jpg')",
    "transfer_name": "CASE WHEN event_id % 8 = 0 THEN concat(event_type, '.mov') END",
    "total_bytes": "event_id * 3",
    "is_sticker": "CASE WHEN event_id % 16 = 0 THEN 1 ELSE 0 END",
    "hide_attachment": "CASE WHEN event_id % 20 = 0 THEN 1 ELSE 0 END",
}

R = f"""r AS (SELECT {', '.join(f'{e} AS {c}' for c, e in MESSAGE.items())}, user_id, ts FROM events),
files AS (SELECT {', '.join(f'{e} AS {c}' for c, e in FILE.items())} FROM events WHERE {ATTACHED} AND event_id % 20 <> 0)"""


def raw(d) -> raw_source.Raw:
    e = d.table("events")

    def frame(name: str, rows, known: dict[str, str]):
        fields = [f.split(" ") for f in schemas.RAW[name].split(", ")]
        return rows.select(*[F.expr(f"CAST({known.get(c, 'NULL')} AS {kind})").alias(c) for c, kind in fields])

    nanos = {"date": f"(unix_micros(CAST(ts AS TIMESTAMP)) - {EPOCH}) * 1000"}
    joined = {"chat_id": "user_id", "message_id": "event_id"}
    linked = {"message_id": "event_id", "attachment_id": "event_id"}
    empty = e.limit(0)
    return raw_source.Raw(
        handle=frame("handle", empty, {}),
        chat=frame("chat", empty, {}),
        chat_handle_join=frame("chat_handle_join", empty, {}),
        message=frame("message", e, MESSAGE | nanos),
        chat_message_join=frame("chat_message_join", e.where(IN_CHAT), joined),
        attachment=frame("attachment", e.where(ATTACHED), FILE),
        message_attachment_join=frame("message_attachment_join", e.where(ATTACHED), linked),
    )


@query(
    "raw_messages",
    f"""WITH {R} SELECT rowid AS message_id, guid, user_id AS chat_id, nullif(handle_id, 0) AS handle_id, is_from_me = 1 AS from_me, epoch_us(ts) // 1000 AS ts_ms,
      CASE WHEN group_title IS NOT NULL THEN group_title WHEN date_retracted = 0 THEN text END AS text,
      CASE WHEN group_title IS NOT NULL THEN 1 WHEN balloon_bundle_id IS NOT NULL THEN 2 ELSE 0 END AS kind, date_edited > 0 AS edited, date_retracted > 0 AS unsent,
      coalesce(group_title IS NULL AND date_retracted = 0 AND contains(text, 'https://'), FALSE) AS has_link, (SELECT count(*) FROM files f WHERE f.rowid = r.rowid) AS attach_count
    FROM r WHERE rowid % 37 <> 0 AND associated_message_type = 0""",
)
def raw_messages(d):
    """Events as raw message rows, through the source scan: times, senders, kinds, clean text, attachment counts."""
    m = raw_source.messages(raw(d))
    return m.select(
        "message_id", "guid", "chat_id", "handle_id", "from_me", F.unix_millis("ts").alias("ts_ms"), "text", "kind", "edited", "unsent",
        F.coalesce("has_link", F.lit(False)).alias("has_link"), "attach_count",
    )


@query(
    "raw_messages_since",
    f"WITH {R} SELECT rowid AS message_id, user_id AS chat_id FROM r WHERE rowid % 37 <> 0 AND associated_message_type = 0 AND ts >= TIMESTAMP '2024-01-14'",
)
def raw_messages_since(d):
    """The same from a bound on, less one day of slack."""
    bound = F.lit("2024-01-15 13:00:00").cast("timestamp")
    return raw_source.messages(raw(d), bound).select("message_id", "chat_id")


@query(
    "raw_reactions",
    f"""WITH {R}, coded AS (SELECT *, associated_message_type % 1000 AS code FROM r WHERE associated_message_type > 0)
    SELECT rowid AS reaction_id, substr(associated_message_guid, 5) AS target_guid, CAST(substr(associated_message_guid, 3, 1) AS BIGINT) AS part,
      nullif(handle_id, 0) AS handle_id, is_from_me = 1 AS from_me, CASE code WHEN 0 THEN '❤️' WHEN 1 THEN '👍' WHEN 2 THEN '👎' WHEN 3 THEN '😂' WHEN 4 THEN '‼️'
        WHEN 5 THEN '❓' ELSE associated_message_emoji END AS emoji, associated_message_type >= 3000 AS removed, epoch_us(ts) // 1000 AS ts_ms
    FROM coded WHERE code < 7""",
)
def raw_reactions(d):
    """Errors as reactions and removals."""
    r = raw_source.reactions(raw(d))
    return r.select("reaction_id", "target_guid", "part", "handle_id", "from_me", "emoji", "removed", F.unix_millis("ts").alias("ts_ms"))


@query(
    "raw_attachments",
    f"""WITH {R} SELECT rowid AS attachment_id, coalesce(transfer_name, regexp_extract(filename, '[^/]*$')) AS name, filename AS path, total_bytes AS bytes,
      CASE WHEN is_sticker = 1 THEN 3 WHEN transfer_name IS NOT NULL THEN 1 ELSE 0 END AS kind FROM files""",
)
def raw_attachments(d):
    """Files of events: hidden ones left out, names from the transfer name or the path, kinds by their ending."""
    return raw_source.attachments(raw(d)).select("attachment_id", F.col("filename").alias("name"), "path", "bytes", "kind")


@query(
    "raw_quarantine",
    """SELECT coalesce(reason, 'good') AS reason, count(*) AS n, CAST(sum(event_id) AS BIGINT) AS ids FROM (SELECT event_id, CASE WHEN event_id % 11 = 0 THEN 'no id'
      WHEN event_id % 13 = 0 THEN 'no guid' WHEN event_id % 17 = 0 THEN 'bad date' END AS reason FROM events) GROUP BY 1""",
)
def raw_quarantine(d):
    """Rows with damaged ids, guids and times are kept apart with the reason."""
    e = d.table("events")
    rows = e.select(
        "event_id",
        F.when(e.event_id % 11 == 0, "x").otherwise(e.event_id.cast("string")).alias("rowid"),
        F.when(e.event_id % 13 != 0, "G").alias("guid"),
        F.when(e.event_id % 17 == 0, "soon").otherwise("5").alias("date"),
    )
    good, bad = raw_source.split_valid(rows)
    both = bad.select("reason", "event_id").unionByName(good.select(F.lit("good").alias("reason"), "event_id"))
    return both.groupBy("reason").agg(F.count(F.lit(1)).alias("n"), F.sum("event_id").alias("ids"))


@query(
    "attachment_flags",
    v.with_(v.HANDLES, v.ORDER_MESSAGES, v.ATTACHMENTS, v.MANIFEST, v.DIRECT_CHATS)
    + """SELECT a.attachment_id, c.title, coalesce(h.name, h.address) AS sender, a.path IN (SELECT path FROM manifest) AS on_disk,
      a.bytes % 5 = 0 AND '/files/' || CAST(a.bytes % 10 + 1 AS VARCHAR) || '/' || CAST(a.bytes % 100 + 1 AS VARCHAR) IN (SELECT path FROM manifest) AS in_trash
    FROM attachments a JOIN messages m ON m.message_id = a.message_id JOIN chats c ON c.chat_id = m.chat_id JOIN handles h ON h.handle_id = m.handle_id
    WHERE a.kind = 1 AND NOT m.from_me""",
)
def attachment_flags(d):
    """Title, sender, on-disk and in-trash flags of all received videos; every fifth file was moved."""
    a = d.attachments()
    moved = F.concat(F.lit("/files/"), (a.bytes % 10 + 1).cast("string"), F.lit("/"), (a.bytes % 100 + 1).cast("string"))
    removed = a.where(a.bytes % 5 == 0).select("attachment_id", moved.alias("new_path"))
    m = d.order_messages().select("message_id", "chat_id", "handle_id", "from_me", "ts").where("NOT from_me")
    page = a.where("kind = 1").join(m, "message_id")
    titled = chats.titles(d.direct_chats(), d.direct_members(), d.handles())
    rows = storage.enrich(page, titled, d.handles(), removed, d.file_manifest())
    return rows.select("attachment_id", "title", "sender", "on_disk", "in_trash")


class Lengths:
    """A model of one dimension that rejects texts about a certain number."""

    model_id, dims, max_distance, query_prefix, passage_prefix = "lengths", 1, 0.5, "query: ", "passage: "

    def load(self) -> None:
        pass

    def embed(self, texts: list[str]) -> list[list[float]]:
        if any(t.endswith("7.") for t in texts):
            raise ValueError("no sevens")
        return [[float(len(t))] for t in texts]


@query(
    "embed_model",
    """SELECT doc_id AS id, CASE WHEN doc_id % 10 = 7 THEN 'rejected' ELSE 'embedded' END AS status,
      CASE WHEN doc_id % 10 <> 7 THEN CAST(length(text) + length(CAST(doc_id AS VARCHAR)) + 11 AS DOUBLE) END AS value FROM documents""",
)
def embed_model(d):
    """Every document by a plug-in model in batches; one rejected text costs no other."""
    docs = d.table("documents")
    rows = docs.select(docs.doc_id.alias("id"), F.concat("text", F.lit(" "), docs.doc_id.cast("string"), F.lit(".")).alias("text"))
    done = embed.embed_with(rows, "id", "text", Lengths())
    return done.select("id", "status", F.get("v", F.lit(0)).alias("value"))


class Parts(Lengths):
    """The same without rejections, for at most 100 words at a time, of which 20 are read again."""

    model_id, max_tokens, overlap = "lengths-100", 100, 20

    def embed(self, texts: list[str]) -> list[list[float]]:
        return [[float(len(t))] for t in texts]


@query(
    "embed_parts",
    """WITH w AS (SELECT doc_id, text, regexp_extract_all(text, '\\s*\\S+') AS w FROM documents),
    p AS (SELECT *, unnest(range(0, greatest(len(w) - 20, 1), 80)) AS off FROM w),
    q AS (SELECT doc_id, CASE WHEN len(w) <= 100 THEN text ELSE array_to_string(w[off + 1 : off + 100], '') END AS part,
      greatest(least(100, len(w) - off), 1) AS n FROM p)
    SELECT doc_id, 'embedded' AS status, round(CAST(sum((length(part) + 9) * n) AS DOUBLE) / sum(n), 6) AS value FROM q GROUP BY doc_id""",
)
def embed_parts(d):
    """Every document wholly embedded: long ones in overlapping parts, averaged by their words."""
    done = embed.embed_with(d.table("documents"), "doc_id", "text", Parts(), budget=2000)
    return done.select("doc_id", "status", F.round(F.get("v", F.lit(0)), 6).alias("value"))


@query(
    "transcript_patterns",
    f"""WITH t AS (SELECT item_id AS query_id, regexp_extract_all(text, '[\\p{{L}}\\p{{N}}]+') AS w FROM benchmark),
    u AS (SELECT query_id, list_filter(w, lambda x: length(x) > 1 AND lower(x) NOT IN ({', '.join(f"'{x}'" for x in sorted(text.TRANSCRIPT_STOPWORDS))})) AS useful FROM t)
    SELECT query_id, len(useful) AS n, list_sum(list_transform(useful, lambda x: length(x) + 17)) + len(useful) - 1 + 7 AS size FROM u WHERE len(useful) > 0""",
)
def transcript_patterns(d):
    """The pattern that marks a passage's words in a transcript: number of words, and length."""
    asked = d.table("benchmark")
    parsed = querytable.parse(asked.select(asked.item_id.alias("query_id"), "text"))
    found = querytable.transcript_pattern(parsed).where("pattern IS NOT NULL")
    n = F.size(F.split("pattern", r"\(\?<!")) - 1
    return found.select("query_id", n.cast("long").alias("n"), F.length("pattern").cast("long").alias("size"))

"""Source clean-up and incremental merge."""

from __future__ import annotations

from pyspark.sql import functions as F

from chatlake.catalog import views as v
from chatlake.catalog.registry import query
from chatlake.functions import address, kinds, text, times
from chatlake.operators import chats, ingest, storage
from chatlake.sources import raw


@query("handle_scan", v.with_(v.HANDLES) + "SELECT handle_id, address, digits FROM handles")
def handle_scan(d):
    h = d.handles()
    return h.select("handle_id", "address", address.phone_digits(F.col("address")).alias("digits"))


@query(
    "chat_scan",
    v.with_(v.GROUP_MEMBERS) + "SELECT chat_id, count(DISTINCT handle_id) AS n_people, count(DISTINCT handle_id) > 1 AS is_group FROM members GROUP BY chat_id",
)
def chat_scan(d):
    n = chats.member_counts(d.group_members())
    return n.select("chat_id", "n_people", chats.is_group(F.lit("+1"), F.col("n_people")).alias("is_group"))


@query(
    "message_scan_since",
    "SELECT event_id AS message_id, epoch_us(ts) // 1000 AS ts_ms FROM events WHERE ts >= TIMESTAMP '2024-01-14'",
)
def message_scan_since(d):
    """Events as source rows (nanoseconds since 2001), read from 15 January with a day of slack."""
    nanos = (F.unix_micros("ts") - times.SOURCE_EPOCH_MICROS) * 1000
    rows = d.event_messages().select(F.col("message_id").alias("rowid"), nanos.alias("date"))
    kept = raw.since(rows, F.lit("2024-01-15 10:00:00").cast("timestamp"))
    return kept.select(
        F.col("rowid").alias("message_id"), F.unix_millis(times.from_source_nanos("date")).alias("ts_ms")
    )


@query(
    "text_cleanup",
    """SELECT doc_id AS message_id, md5(nullif(regexp_replace(translate(text, chr(65532), ''), '^\\s+|\\s+$', '', 'g'), '')) AS body,
    coalesce(contains(text, 'http://') OR contains(text, 'https://') OR contains(text, 'www.'), FALSE) AS has_link
    FROM (SELECT doc_id, chr(65532) || ' ' || text || chr(10) || ' ' AS text FROM documents)""",
)
def text_cleanup(d):
    padded = F.concat(F.lit("￼ "), F.col("text"), F.lit("\n "))
    rows = d.table("documents").select("doc_id", padded.alias("text"))
    return rows.select(
        F.col("doc_id").alias("message_id"), F.md5(text.clean(F.col("text"))).alias("body"),
        text.has_link(F.col("text")).alias("has_link"),
    )


@query(
    "attachment_kinds",
    """SELECT CASE WHEN sticker THEN 3 WHEN starts_with(mime, 'image/') THEN 0 WHEN starts_with(mime, 'video/') THEN 1
      WHEN starts_with(mime, 'audio/') THEN 2 WHEN ext IN ('heic', 'jpg', 'jpeg', 'png', 'gif', 'webp', 'tiff') THEN 0
      WHEN ext IN ('mov', 'mp4', 'm4v') THEN 1 WHEN ext IN ('caf', 'm4a', 'mp3', 'amr', 'wav', 'aac') THEN 2 ELSE 4 END AS kind,
      count(*) AS n
    FROM (SELECT p_size % 11 = 0 AS sticker, lower(p_type) || '/x' AS mime,
      (['HEIC', 'mov', 'mp3', 'pdf', 'Jpeg', 'wav', 'zip'])[CAST(p_partkey % 7 AS INTEGER) + 1].lower() AS ext FROM part) GROUP BY 1""",
)
def attachment_kinds(d):
    p = d.table("part")
    endings = F.array(*[F.lit(e) for e in ("HEIC", "mov", "mp3", "pdf", "Jpeg", "wav", "zip")])
    name = F.concat_ws(".", "p_name", F.get(endings, (p.p_partkey % 7).cast("int")))
    kind = kinds.attachment_kind(F.concat(F.lower("p_type"), F.lit("/x")), name, p.p_size % 11 == 0)
    return p.select(kind.cast("int").alias("kind")).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


@query(
    "contact_keys",
    """SELECT c_custkey AS handle_id, CASE WHEN contains(a, '@') THEN lower(trim(a))
      WHEN length(regexp_replace(a, '[^0-9]', '', 'g')) >= 5 THEN right(regexp_replace(a, '[^0-9]', '', 'g'), 10) END AS contact_key
    FROM (SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN ' User' || CAST(c_custkey AS VARCHAR) || '@Mail.Example '
      WHEN 1 THEN '+1 (555) ' || lpad(CAST(c_custkey AS VARCHAR), 7, '0') ELSE CAST(c_custkey AS VARCHAR) END AS a FROM customer)""",
)
def contact_keys(d):
    c = d.table("customer")
    key = c.c_custkey.cast("string")
    a = (
        F.when(c.c_custkey % 3 == 0, F.concat(F.lit(" User"), key, F.lit("@Mail.Example ")))
        .when(c.c_custkey % 3 == 1, F.concat(F.lit("+1 (555) "), F.lpad(key, 7, "0")))
        .otherwise(key)
    )
    return c.select(c.c_custkey.alias("handle_id"), address.contact_key(a).alias("contact_key"))


CONTACTS = """contacts AS (
  SELECT right(digits, 10) AS contact_key, arg_min('Contact ' || CAST(c_custkey AS VARCHAR), c_custkey) AS contact_name
  FROM (SELECT c_custkey, '1555' || lpad(CAST(c_custkey - c_custkey % 2 AS VARCHAR), 7, '0') AS digits, c_acctbal FROM customer)
  WHERE c_acctbal > 0 GROUP BY 1)"""


def _contacts(d):
    """An address book: customers in credit, two to a number, the first wins; some have only a nickname."""
    c = d.table("customer").filter("c_acctbal > 0")
    name = F.concat(F.lit("Contact "), c.c_custkey.cast("string"))
    return c.select(
        F.concat(F.lit("(1) 555 "), F.lpad((c.c_custkey - c.c_custkey % 2).cast("string"), 7, "0")).alias("address"),
        c.c_custkey.alias("position"),
        F.when(c.c_custkey % 5 != 0, name).otherwise(F.lit(" ")).alias("full_name"),
        name.alias("nickname"),
    )


@query(
    "contact_resolution",
    v.with_(v.HANDLES, CONTACTS)
    + """SELECT h.handle_id, coalesce(c.contact_name, h.name) AS name FROM handles h LEFT JOIN contacts c ON c.contact_key = right(h.digits, 10)""",
)
def contact_resolution(d):
    return ingest.resolve_contacts(d.handles(), _contacts(d)).select("handle_id", "name")


@query(
    "renamed_chats",
    v.with_(v.HANDLES, CONTACTS, v.GROUP_MEMBERS)
    + """SELECT DISTINCT m.chat_id FROM handles h JOIN contacts c ON c.contact_key = right(h.digits, 10) JOIN members m ON m.handle_id = h.handle_id
    WHERE c.contact_name IS DISTINCT FROM h.name""",
)
def renamed_chats(d):
    before = d.handles()
    return ingest.renamed_chats(before, ingest.resolve_contacts(before, _contacts(d)), d.group_members()).select("chat_id")


@query(
    "handle_upsert",
    v.with_(v.HANDLES)
    + """, held AS (SELECT h.* FROM handles h JOIN customer ON c_custkey = handle_id WHERE c_mktsegment <> 'BUILDING'),
    fresh AS (SELECT handle_id, '+44' || CAST(handle_id AS VARCHAR) AS address, CASE WHEN c_acctbal > 0 THEN 'New ' || CAST(handle_id AS VARCHAR) END AS name
      FROM handles h JOIN customer ON c_custkey = handle_id WHERE c_mktsegment IN ('BUILDING', 'MACHINERY'))
    SELECT coalesce(f.handle_id, h.handle_id) AS handle_id, coalesce(f.address, h.address) AS address, coalesce(f.name, h.name) AS name
    FROM held h FULL JOIN fresh f ON f.handle_id = h.handle_id""",
)
def handle_upsert(d):
    """Stored: all but the builders; read anew: builders and machinists, moved abroad, some without a name."""
    c = d.table("customer").withColumnRenamed("c_custkey", "handle_id")
    h = d.handles().join(c, "handle_id")
    key = F.col("handle_id").cast("string")
    fresh = h.filter("c_mktsegment IN ('BUILDING', 'MACHINERY')").select(
        "handle_id", F.concat(F.lit("+44"), key).alias("address"),
        F.when(F.col("c_acctbal") > 0, F.concat(F.lit("New "), key)).alias("name"),
    )
    return ingest.upsert_handles(h.filter("c_mktsegment <> 'BUILDING'"), fresh).select("handle_id", "address", "name")


@query(
    "chat_upsert",
    v.with_(v.GROUP_MEMBERS)
    + """SELECT CAST(1000000 + n_nationkey AS BIGINT) AS chat_id,
      CASE WHEN n_regionkey = 1 THEN NULL WHEN n_nationkey % 2 = 0 THEN n_name END AS display_name,
      (SELECT count(*) FROM members m JOIN customer c ON c.c_custkey = m.handle_id WHERE m.chat_id = 1000000 + n_nationkey
        AND (n_regionkey <> 1 OR c.c_mktsegment = 'BUILDING')) AS n_people
    FROM nation""",
)
def chat_upsert(d):
    """The chats of region 1 come again: with a blank name and only some of their members."""
    again = d.table("nation").filter("n_regionkey = 1").select((F.col("n_nationkey") + 1000000).cast("long").alias("chat_id"))
    batch = d.group_chats().join(again, "chat_id", "left_semi").withColumn("display_name", F.lit("  "))
    builders = d.table("customer").filter("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("handle_id"))
    batch_members = d.group_members().join(again, "chat_id", "left_semi").join(builders, "handle_id", "left_semi")
    merged = ingest.upsert_chats(d.group_chats(), batch)
    n = chats.member_counts(ingest.upsert_members(d.group_members(), batch, batch_members))
    return merged.join(n, "chat_id", "left").select(
        "chat_id", "display_name", F.coalesce("n_people", F.lit(0)).alias("n_people")
    )


MERGE = v.with_(v.EVENT_MESSAGES) + """, held AS (SELECT *, CASE WHEN text = 'view' THEN 'seen' ELSE text END AS old FROM messages WHERE text <> 'signup'),
  fresh AS (SELECT * FROM messages WHERE text IN ('signup', 'view', 'click')),
  merged AS (SELECT coalesce(f.message_id, h.message_id) AS message_id, coalesce(f.chat_id, h.chat_id) AS chat_id, coalesce(f.ts, h.ts) AS ts,
    coalesce(f.text, h.old) AS text,
    CASE WHEN h.message_id IS NULL THEN 'insert' WHEN f.message_id IS NULL THEN 'kept' WHEN f.text <> h.old THEN 'update' ELSE 'same' END AS change
    FROM held h FULL JOIN fresh f ON f.message_id = h.message_id)
"""


def _merged(d):
    """Stored: all but sign-ups, with views under another text; read again: sign-ups, views and clicks, twice."""
    m = d.event_messages().withColumn("attach_count", F.lit(0).cast("long"))
    held = m.filter("text <> 'signup'").withColumn("text", F.when(F.col("text") == "view", "seen").otherwise(F.col("text")))
    fresh = m.filter("text IN ('signup', 'view', 'click')")
    return held, ingest.merge_messages(held, fresh.unionByName(fresh))


@query("message_upsert", MERGE + "SELECT message_id, text, change FROM merged")
def message_upsert(d):
    return _merged(d)[1].select("message_id", "text", "change")


@query(
    "touched_chats",
    MERGE + "SELECT chat_id, epoch_us(min(ts)) // 1000 AS from_ms FROM merged WHERE change IN ('insert', 'update') GROUP BY chat_id",
)
def touched_chats(d):
    return ingest.touched_chats(_merged(d)[1]).select("chat_id", F.unix_millis("from_ts").alias("from_ms"))


@query(
    "dirty_merge",
    MERGE + """SELECT chat_id, epoch_us(min(ts)) // 1000 AS from_ms FROM (
      SELECT chat_id, ts FROM merged WHERE change IN ('insert', 'update') UNION ALL SELECT chat_id, ts FROM messages WHERE text = 'purchase')
    GROUP BY chat_id""",
)
def dirty_merge(d):
    pending = d.event_messages().filter("text = 'purchase'").select("chat_id", F.col("ts").alias("from_ts"))
    return ingest.merge_dirty(pending, ingest.touched_chats(_merged(d)[1])).select(
        "chat_id", F.unix_millis("from_ts").alias("from_ms")
    )


@query(
    "attachments_replaced",
    """SELECT l_orderkey AS message_id, count(*) AS n, CAST(sum(CASE WHEN o_orderpriority = '1-URGENT' THEN 1 ELSE floor(l_extendedprice) END) AS BIGINT) AS bytes
    FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY l_orderkey""",
)
def attachments_replaced(d):
    """Urgent orders changed: their attachments come again with one byte each."""
    urgent = d.order_messages().filter("text = '1-URGENT'").select("message_id", F.lit("update").alias("change"))
    files = d.attachments()
    now = ingest.replace_attachments(files, files.withColumn("bytes", F.lit(1).cast("long")), urgent)
    return storage.per_message(now)


@query("chat_statistics", v.with_(v.EVENT_MESSAGES) + "SELECT chat_id, epoch_us(max(ts)) // 1000 AS last_ms, count(*) AS message_count FROM messages GROUP BY chat_id")
def chat_statistics(d):
    return chats.statistics(d.event_messages()).select("chat_id", F.unix_millis("last_ts").alias("last_ms"), "message_count")


@query("delete_reconcile", "SELECT event_id AS message_id FROM events WHERE event_type = 'error'")
def delete_reconcile(d):
    m = d.event_messages()
    return ingest.deleted(m, m.filter("text <> 'error'")).select("message_id")


@query("delete_touched", "SELECT user_id AS chat_id, epoch_us(min(ts)) // 1000 AS from_ms FROM events WHERE event_type = 'error' GROUP BY 1")
def delete_touched(d):
    m = d.event_messages()
    gone = ingest.deleted(m, m.filter("text <> 'error'"))
    return ingest.deleted_touched(gone).select("chat_id", F.unix_millis("from_ts").alias("from_ms"))


@query(
    "late_bound",
    """SELECT least(epoch_us(TIMESTAMP '2024-01-20'), epoch_us(min(ts))) // 1000 AS since_ms FROM events
    WHERE event_id > (SELECT count(*) * 9 // 10 FROM events) - (SELECT count(*) // 2 FROM events)""",
)
def late_bound(d):
    """The last source id seen lies in the middle of the history: rows after it arrived late."""
    m = d.event_messages()
    seen = m.agg((F.expr("count(1) * 9 div 10") - F.expr("count(1) div 2")).alias("n")).scalar()
    bound = ingest.read_bound(m, F.lit("2024-01-20").cast("timestamp"), seen)
    return bound.select(F.unix_millis("since").alias("since_ms"))


@query(
    "next_cursor",
    "SELECT least(epoch_us(max(ts)), epoch_us(TIMESTAMP '2024-01-16')) // 1000 AS last_ms, max(event_id) AS last_source_id FROM events",
)
def next_cursor(d):
    """Now is 15 January: times past tomorrow don't move the cursor."""
    c = ingest.next_cursor(d.event_messages(), F.lit("2024-01-02").cast("timestamp"), F.lit("2024-01-15").cast("timestamp"))
    return c.select(F.unix_millis("last_ts").alias("last_ms"), "last_source_id")


@query(
    "corpus_stats",
    """SELECT 'messages' AS metric, count(*) AS value FROM orders UNION ALL SELECT 'chats', count(DISTINCT o_custkey) FROM orders
    UNION ALL SELECT 'oldest', epoch_ms(min(o_orderdate)) FROM orders UNION ALL SELECT 'newest', epoch_ms(max(o_orderdate)) FROM orders
    UNION ALL SELECT 'attachments', count(*) FROM lineitem""",
)
def corpus_stats(d):
    return ingest.corpus_stats(d.order_messages(), d.attachments())

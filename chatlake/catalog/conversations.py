"""Conversation windows, views and reaction state."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from chatlake import schemas
from chatlake.catalog import views as v
from chatlake.catalog.registry import query
from chatlake.operators import chats, insights, reactions, views, windows
from chatlake.session import ensure_checkpoint_dir
from chatlake.sources.tables import History
from chatlake.streaming import sessions

DAY_MINUTES = 1440
NO_MODEL = "none"
EVENT_COLUMNS = {"message_id", "source_id", "guid", "chat_id", "handle_id", "from_me", "ts", "text", "kind", "edited", "unsent", "has_link"}

EVENT_LINES = """lines AS (
  SELECT m.chat_id, m.ts, m.message_id, (CASE WHEN m.from_me THEN 'Me' ELSE 'Them' END) || ': ' || m.text AS line,
         'User ' || CAST(m.chat_id AS VARCHAR) AS title
  FROM messages m WHERE m.kind = 0)"""
TURN_LINES = """lines AS (
  SELECT chat_id, ts, message_id, who || ': ' || text AS line, title FROM messages WHERE text IS NOT NULL)"""


def window_ctes(gap_minutes: int, lines="lines", p="") -> str:
    """SQL of the window rules: gap sessions, then the greedy caps as a recursion over rows."""
    return f"""{p}marked AS (
  SELECT *, CASE WHEN lag(ts) OVER w IS NULL OR epoch_us(ts) - epoch_us(lag(ts) OVER w) > {gap_minutes * 60_000_000} THEN 1 ELSE 0 END AS brk
  FROM {lines} WINDOW w AS (PARTITION BY chat_id ORDER BY ts, message_id)),
{p}sessions AS (SELECT *, sum(brk) OVER (PARTITION BY chat_id ORDER BY ts, message_id) AS session FROM {p}marked),
{p}numbered AS (SELECT *, row_number() OVER (PARTITION BY chat_id, session ORDER BY ts, message_id) AS i, strlen(line) AS size FROM {p}sessions),
{p}fold AS (
  SELECT chat_id, session, i, message_id, message_id AS first_id, 1 AS n, size + 1 AS used FROM {p}numbered WHERE i = 1
  UNION ALL
  SELECT r.chat_id, r.session, r.i, r.message_id,
    CASE WHEN f.n >= 16 OR f.used + r.size > 900 THEN r.message_id ELSE f.first_id END,
    CASE WHEN f.n >= 16 OR f.used + r.size > 900 THEN 1 ELSE f.n + 1 END,
    CASE WHEN f.n >= 16 OR f.used + r.size > 900 THEN r.size + 1 ELSE f.used + r.size + 1 END
  FROM {p}fold f JOIN {p}numbered r ON r.chat_id = f.chat_id AND r.session = f.session AND r.i = f.i + 1),
{p}windows AS (
  SELECT n.chat_id, f.first_id, min(n.ts) AS start_ts, max(n.ts) AS end_ts, arg_max(n.message_id, n.i) AS last_id, count(*) AS n_messages,
    max(n.title) || ' · ' || strftime(min(n.ts), '%Y-%m-%d') || chr(10) || string_agg(n.line, chr(10) ORDER BY n.i) AS text
  FROM {p}fold f JOIN {p}numbered n ON n.message_id = f.message_id GROUP BY n.chat_id, n.session, f.first_id)"""


EVENT_WINDOWS = v.with_(v.EVENT_MESSAGES, EVENT_LINES, window_ctes(DAY_MINUTES), recursive=True)
TURN_WINDOWS = v.with_(v.TURN_MESSAGES, TURN_LINES, window_ctes(45), recursive=True)


def event_chats(d):
    users = d.event_messages().select("chat_id").distinct()
    return users.withColumn("title", F.concat(F.lit("User "), F.col("chat_id").cast("string")))


def event_lines(d, messages=None):
    m = d.event_messages() if messages is None else messages
    return windows.lines(m.withColumn("attach_count", F.lit(0)), d.handles().limit(0))


def turn_lines(d):
    return windows.lines(d.turn_messages(), d.turn_handles())


# ------------------------------------------------------------------- windows
@query(
    "window_gaps",
    EVENT_WINDOWS + "SELECT message_id, chat_id, CAST(session AS BIGINT) AS session FROM sessions",
)
def window_gaps(d):
    rows = windows.gap_sessions(event_lines(d), DAY_MINUTES)
    return rows.select("message_id", "chat_id", "session")


@query("window_caps", TURN_WINDOWS + "SELECT message_id, first_id FROM fold")
def window_caps(d):
    return windows.assign(turn_lines(d)).select("message_id", "first_id")


@query(
    "window_text",
    TURN_WINDOWS + "SELECT chat_id, first_id, last_id, n_messages, text, epoch_ms(start_ts) AS start_ms, epoch_ms(end_ts) AS end_ms FROM windows",
)
def window_text(d):
    built = windows.build(windows.assign(turn_lines(d)), d.turn_chats())
    return built.select(
        "chat_id", "first_id", "last_id", "n_messages", "text", F.unix_millis("start_ts").alias("start_ms"),
        F.unix_millis("end_ts").alias("end_ms"),
    )


@query("window_rebuild_all", EVENT_WINDOWS + "SELECT chat_id, first_id, last_id, n_messages FROM windows")
def window_rebuild_all(d):
    built = windows.build(windows.assign(event_lines(d), DAY_MINUTES), event_chats(d))
    return built.select("chat_id", "first_id", "last_id", "n_messages")


@query("window_stream", EVENT_WINDOWS + "SELECT chat_id, first_id, last_id, n_messages, text FROM windows")
def window_stream(d):
    """The same windows from a stream of three parts: early events, later ones, which extend open windows, and sign-ups, which are late."""
    ensure_checkpoint_dir(d.spark)
    folder = f"{d.spark.sparkContext.getCheckpointDir()}/{uuid.uuid4().hex}"
    history = History(d.spark, f"{folder}/history")
    history.replace("chats", event_chats(d).selectExpr("chat_id", "'' AS identifier", "'' AS display_name", "'s' AS service", "title", "false AS is_group"))
    columns = [F.expr(f"CAST({c if c in EVENT_COLUMNS else 'NULL'} AS {kind}) AS {c}") for c, kind in (f.split() for f in schemas.MESSAGES.split(", "))]
    rows = d.event_messages().select(columns)
    late, early = F.col("text") == "signup", F.col("ts") < "2024-01-15"
    for part in (rows.filter(early & ~late), rows.filter(~early & ~late), rows.filter(late)):
        part.write.mode("append").parquet(f"{folder}/landed")
        stream = sessions.start(history, f"{folder}/landed", f"{folder}/stream", gap_minutes=DAY_MINUTES)
        stream.trigger(availableNow=True).start().awaitTermination()
    return history.read("windows").select("chat_id", "first_id", "last_id", "n_messages", "text")


LATE = "event_type = 'signup'"
LATE_WINDOWS = v.with_(
    v.EVENT_MESSAGES,
    EVENT_LINES,
    "old_lines AS (SELECT * FROM lines WHERE message_id NOT IN (SELECT event_id FROM events WHERE event_type = 'signup' AND ts >= TIMESTAMP '2024-01-20'))",
    window_ctes(DAY_MINUTES, "old_lines", "old_"),
    "dirty AS (SELECT user_id AS chat_id, min(ts) AS from_ts FROM events WHERE event_type = 'signup' AND ts >= TIMESTAMP '2024-01-20' GROUP BY 1)",
    f"""near AS (SELECT w.chat_id, min(w.start_ts) AS start_ts FROM old_windows w JOIN dirty d ON d.chat_id = w.chat_id
      WHERE epoch_us(w.end_ts) >= epoch_us(d.from_ts) - {DAY_MINUTES * 60_000_000} GROUP BY w.chat_id)""",
    "cut AS (SELECT d.chat_id, least(d.from_ts, coalesce(n.start_ts, d.from_ts)) AS cut_ts FROM dirty d LEFT JOIN near n ON n.chat_id = d.chat_id)",
    "new_lines AS (SELECT l.* FROM lines l JOIN cut c ON c.chat_id = l.chat_id WHERE l.ts >= c.cut_ts)",
    window_ctes(DAY_MINUTES, "new_lines", "new_"),
    recursive=True,
)


def _late_events(d):
    """Sign-ups from 20 January on arrive after everything else."""
    m = d.event_messages()
    late = (F.col("text") == "signup") & (F.col("ts") >= F.lit("2024-01-20").cast("timestamp"))
    return m.filter(~late), m.filter(late)


@query("window_dirty_cut", LATE_WINDOWS + "SELECT chat_id, epoch_us(cut_ts) // 1000 AS cut_ms FROM cut")
def window_dirty_cut(d):
    old, late = _late_events(d)
    built = windows.build(windows.assign(event_lines(d, old), DAY_MINUTES), event_chats(d))
    dirty = late.groupBy("chat_id").agg(F.min("ts").alias("from_ts"))
    return windows.dirty_cut(dirty, built, DAY_MINUTES).select("chat_id", F.unix_millis("cut_ts").alias("cut_ms"))


@query(
    "window_diff",
    LATE_WINDOWS
    + f""", affected AS (SELECT w.* FROM old_windows w JOIN cut c ON c.chat_id = w.chat_id
      WHERE w.start_ts >= c.cut_ts AND epoch_us(w.end_ts) >= epoch_us(c.cut_ts) - {DAY_MINUTES * 60_000_000})
    SELECT coalesce(o.chat_id, n.chat_id) AS chat_id, coalesce(o.first_id, n.first_id) AS first_id,
      CASE WHEN o.chat_id IS NULL THEN 'insert' WHEN n.chat_id IS NULL THEN 'delete' ELSE 'keep' END AS action
    FROM affected o FULL JOIN new_windows n ON n.chat_id = o.chat_id AND n.start_ts = o.start_ts AND n.text = o.text""",
)
def window_diff(d):
    old, late = _late_events(d)
    titled = event_chats(d)
    stored = windows.build(windows.assign(event_lines(d, old), DAY_MINUTES), titled)
    stored = stored.withColumn("window_id", windows.window_id(F.col("chat_id"), F.col("start_ts"), F.col("text_hash")))
    cut = windows.dirty_cut(late.groupBy("chat_id").agg(F.min("ts").alias("from_ts")), stored, DAY_MINUTES)
    rows = windows.to_rebuild(event_lines(d, old.unionByName(late)), cut)
    rebuilt = windows.build(windows.assign(rows, DAY_MINUTES), titled)
    changes = windows.diff(stored, rebuilt, cut, DAY_MINUTES)
    return changes.select("chat_id", "first_id", "action")


@query(
    "window_span_members",
    TURN_WINDOWS
    + """SELECT m.message_id, w.first_id FROM windows w JOIN messages m ON m.chat_id = w.chat_id
    AND (m.ts, m.message_id) >= (w.start_ts, w.first_id) AND (m.ts, m.message_id) <= (w.end_ts, w.last_id)""",
)
def window_span_members(d):
    built = windows.build(windows.assign(turn_lines(d)), d.turn_chats()).withColumn("window_id", F.col("first_id"))
    found = windows.span_members(built, d.turn_messages())
    return found.select("message_id", F.col("window_id").alias("first_id"))


@query(
    "window_pending",
    TURN_WINDOWS + "SELECT first_id, text FROM windows WHERE chat_id % 2 = 1",
)
def window_pending(d):
    """Windows of conversations with an even number are embedded already; all others wait."""
    built = windows.build(windows.assign(turn_lines(d)), d.turn_chats()).withColumn("window_id", F.col("first_id"))
    done = built.filter("chat_id % 2 = 0").select("window_id", F.lit(NO_MODEL).alias("model_id"))
    return windows.pending(built, done, NO_MODEL).select("first_id", "text")


# --------------------------------------------------------------------- views
GROUPS = v.with_(v.HANDLES, v.ORDER_MESSAGES, v.GROUP_MEMBERS, v.GROUP_MESSAGES, v.GROUP_TITLES)


@query("chat_titles", GROUPS + "SELECT chat_id, title, is_group FROM chats")
def chat_titles(d):
    return chats.titles(d.group_chats(), d.group_members(), d.handles()).select("chat_id", "title", "is_group")


@query(
    "chat_list",
    v.with_(v.HANDLES, v.ORDER_MESSAGES, v.DIRECT_CHATS)
    + """SELECT c.chat_id, c.title, s.message_count, epoch_ms(s.last_ts) AS last_ms, s.last_text FROM (
      SELECT chat_id, max(ts) AS last_ts, count(*) AS message_count,
        arg_max(text, ts + to_microseconds(message_id)) FILTER (WHERE kind = 0) AS last_text
      FROM messages GROUP BY chat_id ORDER BY last_ts DESC, chat_id LIMIT 50 OFFSET 20) s JOIN chats c ON c.chat_id = s.chat_id""",
)
def chat_list(d):
    titled = chats.titles(d.direct_chats(), d.direct_members(), d.handles())
    page = views.chat_list(titled, d.order_messages(), 50, 20)
    return page.select("chat_id", "title", "message_count", F.unix_millis("last_ts").alias("last_ms"), "last_text")


@query(
    "chat_participants",
    GROUPS + """SELECT s.chat_id, p.people FROM (
      SELECT chat_id, max(ts) AS last_ts FROM group_messages GROUP BY chat_id ORDER BY last_ts DESC, chat_id LIMIT 10) s
    JOIN (SELECT chat_id, string_agg(who, '|' ORDER BY place) AS people FROM people GROUP BY chat_id) p ON p.chat_id = s.chat_id""",
)
def chat_participants(d):
    titled = chats.titles(d.group_chats(), d.group_members(), d.handles())
    page = views.with_participants(views.chat_list(titled, d.group_messages(), 10), d.group_members(), d.handles())
    who = F.transform("participants", lambda p: F.coalesce(p["name"], p["address"]))
    return page.select("chat_id", F.array_join(who, "|").alias("people"))


@query(
    "chat_subtitles",
    GROUPS + """SELECT chat_id, string_agg(short, ', ' ORDER BY place) FILTER (WHERE place < n)
      || ' & ' || max(short) FILTER (WHERE place = n) AS subtitle
    FROM (SELECT *, CASE WHEN name IS NULL THEN address ELSE split_part(name, ' ', 1) END AS short FROM people) GROUP BY chat_id""",
)
def chat_subtitles(d):
    titled = chats.titles(d.group_chats(), d.group_members(), d.handles())
    return chats.subtitles(titled, d.group_members(), d.handles())


NUMBERED = v.with_(
    v.EVENT_MESSAGES,
    "numbered AS (SELECT *, row_number() OVER (PARTITION BY chat_id ORDER BY ts, message_id) AS rn FROM messages)",
)


@query(
    "context_around",
    NUMBERED + """SELECT a.message_id AS anchor_id, m.message_id, m.rn - a.rn AS "offset" FROM numbered a
    JOIN numbered m ON m.chat_id = a.chat_id AND m.rn BETWEEN a.rn - 3 AND a.rn + 2 WHERE a.text = 'purchase'""",
)
def context_around(d):
    m = d.event_messages()
    around = views.context(m.filter("text = 'purchase'"), m, 3, 2)
    return around.select("anchor_id", "message_id", "offset")


@query(
    "keyset_page",
    NUMBERED + """SELECT a.message_id AS cursor_id, m.message_id FROM numbered a JOIN numbered m ON m.chat_id = a.chat_id
    AND ((a.from_me AND m.rn BETWEEN a.rn + 1 AND a.rn + 4) OR (NOT a.from_me AND m.rn BETWEEN a.rn - 4 AND a.rn - 1))
    WHERE a.text IN ('click', 'error')""",
)
def keyset_page(d):
    """Clicks page forward, errors page back."""
    m = d.event_messages()
    cursors = m.filter("text IN ('click', 'error')").select(
        F.col("message_id").alias("cursor_id"), "chat_id", "ts", "message_id", F.col("from_me").alias("newer")
    )
    return views.keyset_page(cursors, m, 4).select("cursor_id", "message_id")


@query(
    "latest_messages",
    NUMBERED + "SELECT chat_id, message_id FROM (SELECT *, max(rn) OVER (PARTITION BY chat_id) AS n FROM numbered) WHERE rn > n - 5",
)
def latest_messages(d):
    return views.latest(d.event_messages(), 5).select("chat_id", "message_id")


REACTION_STATE = v.with_(
    v.REACTIONS,
    """live AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY target_id, part, from_me, handle_id ORDER BY ts DESC, reaction_id DESC) AS k
      FROM reactions) WHERE k = 1 AND NOT removed)""",
)


@query("reaction_state", REACTION_STATE + "SELECT 'e' || CAST(target_id AS VARCHAR) AS target_guid, part, from_me, handle_id, emoji FROM live")
def reaction_state(d):
    return reactions.live(d.reaction_events()).select("target_guid", F.col("part").cast("int").alias("part"), "from_me", "handle_id", "emoji")


@query(
    "nested_messages",
    v.with_(
        v.HANDLES, v.ORDER_MESSAGES, v.ATTACHMENTS,
        "newest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY chat_id ORDER BY ts DESC, message_id DESC) AS k FROM messages) WHERE k <= 3)",
    )
    + """SELECT n.message_id, CASE WHEN NOT n.from_me THEN coalesce(h.name, h.address) END AS sender, coalesce(a.files, '') AS files,
      coalesce(r.marks, '') AS marks
    FROM newest n JOIN handles h ON h.handle_id = n.handle_id
    LEFT JOIN (SELECT message_id, string_agg(attachment_id, ' ' ORDER BY attachment_id) AS files FROM attachments GROUP BY message_id) a
      ON a.message_id = n.message_id
    LEFT JOIN (SELECT event_id // 10 AS message_id, string_agg(event_type, ' ' ORDER BY ts, event_id) AS marks FROM events GROUP BY 1) r
      ON r.message_id = n.message_id""",
)
def nested_messages(d):
    page = views.latest(d.order_messages(), 3)
    log = d.reaction_events().withColumn("target_guid", F.concat(F.lit("o"), F.col("target_id").cast("string")))
    rows = views.message_views(page, d.attachments(), log, d.handles())
    return rows.select(
        "message_id", "sender", F.array_join(F.col("attachments.attachment_id"), " ").alias("files"),
        F.array_join(F.col("reactions.emoji"), " ").alias("marks"),
    )


@query(
    "message_items",
    v.with_(v.ORDER_MESSAGES, v.ATTACHMENTS)
    + """SELECT message_id, 'attachment' AS item, row_number() OVER (PARTITION BY message_id ORDER BY attachment_id) AS place,
      filename AS label FROM attachments
    UNION ALL SELECT m.message_id, 'reaction', row_number() OVER (PARTITION BY m.message_id ORDER BY e.ts, CAST(e.event_id AS VARCHAR)), e.event_type
    FROM events e JOIN messages m ON m.message_id = e.event_id // 10""",
)
def message_items(d):
    log = d.reaction_events().withColumn("target_guid", F.concat(F.lit("o"), F.col("target_id").cast("string")))
    return views.message_items(d.attachments(), log, d.order_messages())


@query(
    "transcript_runs",
    v.with_(
        v.EVENT_MESSAGES,
        """near AS (SELECT *, lag(ts) OVER w AS p_ts, lag(from_me) OVER w AS p_me, lag(kind) OVER w AS p_kind,
          lead(ts) OVER w AS n_ts, lead(from_me) OVER w AS n_me, lead(kind) OVER w AS n_kind
          FROM messages WINDOW w AS (PARTITION BY chat_id ORDER BY ts, message_id))""",
        """flags AS (SELECT *, p_ts IS NULL OR epoch_us(ts) - epoch_us(p_ts) > 3600000000 AS show_time,
          coalesce(kind = 0 AND p_kind = 0 AND from_me = p_me AND epoch_us(ts) - epoch_us(p_ts) < 900000000, FALSE) AS with_previous,
          coalesce(kind = 0 AND n_kind = 0 AND from_me = n_me AND epoch_us(n_ts) - epoch_us(ts) < 900000000, FALSE) AS with_next FROM near)""",
    )
    + """SELECT chat_id, message_id, show_time, with_previous, NOT from_me AND kind = 0 AND NOT with_previous AS show_name,
      NOT with_next AS tail FROM flags""",
)
def transcript_runs(d):
    return views.transcript_runs(d.event_messages())


@query(
    "replies",
    v.with_(v.EVENT_MESSAGES)
    + """SELECT m.message_id, t.message_id AS target_id, t.message_id IS NOT NULL AS resolved FROM messages m
    LEFT JOIN messages t ON t.message_id = m.message_id - 7 AND t.text <> 'view' WHERE m.text <> 'click'""",
)
def replies(d):
    """Every event but a click answers the seventh before it, unless that was a view."""
    m = d.event_messages()
    guid = F.when(F.col("text") != "view", F.col("guid"))
    answers = F.when(F.col("text") != "click", F.concat(F.lit("e"), (F.col("message_id") - 7).cast("string")))
    return views.replies(m.withColumns({"reply_to": answers, "guid": guid})).select("message_id", "target_id", "resolved")


@query(
    "link_hosts",
    """WITH spans AS (
      SELECT page_id, unnest(regexp_extract_all(html, '(?i)((?:https?://|www\\.)[^\\s<]+[^\\s<.,:;"''\\)\\]!?])', 1)) AS span
      FROM (SELECT page_id, url || ' ' || html AS html FROM pages)),
    hrefs AS (SELECT page_id, CASE WHEN regexp_matches(span, '(?i)^https?://') THEN span ELSE 'https://' || span END AS href FROM spans)
    SELECT regexp_replace(lower(regexp_extract(href, '(?i)^https?://(?:[^/?#@]*@)?([^/?#:]+)', 1)), '^www\\.', '') AS host,
      count(*) AS n, count(DISTINCT page_id) AS pages,
      count(*) FILTER (WHERE regexp_extract(href, '(?i)^https?://[^/?#]*([^#]*)', 1) IN ('', '/')) AS bare
    FROM hrefs GROUP BY 1""",
)
def link_hosts(d):
    pages = d.table("pages").select("page_id", F.concat_ws(" ", "url", "html").alias("body"))
    found = views.links(pages, "page_id", "body")
    return found.groupBy("host").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("page_id").alias("pages"), F.count_if(F.col("rest") == "").alias("bare")
    )


@query(
    "link_only_pages",
    "SELECT page_id, url FROM pages WHERE regexp_matches(url, '(?i)^(?:https?://|www\\.)\\S+$')",
)
def link_only_pages(d):
    p = d.table("pages")
    return p.filter(views.link_only(p.url)).select("page_id", "url")


@query(
    "gallery",
    v.with_(v.ORDER_MESSAGES, v.ATTACHMENTS)
    + """SELECT m.chat_id, epoch_ms(m.ts) AS ts_ms, a.attachment_id, a.kind FROM attachments a
    JOIN messages m ON m.message_id = a.message_id WHERE a.kind IN (0, 1, 3)""",
)
def gallery(d):
    shown = views.gallery(d.attachments(), d.order_messages())
    return shown.select("chat_id", F.unix_millis("ts").alias("ts_ms"), "attachment_id", "kind")

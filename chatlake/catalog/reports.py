"""Storage and activity reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from chatlake.catalog import views as v
from chatlake.catalog.registry import query
from chatlake.operators import chats, insights, storage

A = v.with_(v.HANDLES, v.ORDER_MESSAGES, v.ATTACHMENTS, v.DIRECT_CHATS)


def day_text(column="day"):
    return F.date_format(column, "yyyy-MM-dd")


# ------------------------------------------------------------------- storage
@query("storage_by_kind", A + "SELECT kind, count(*) AS n, CAST(sum(bytes) AS BIGINT) AS bytes FROM attachments GROUP BY kind")
def storage_by_kind(d):
    return storage.by_kind(d.attachments())


@query("storage_totals", A + "SELECT count(*) AS total_count, CAST(sum(bytes) AS BIGINT) AS total_bytes FROM attachments")
def storage_totals(d):
    return storage.totals(d.attachments())


@query(
    "storage_top_chats",
    A + """SELECT m.chat_id, c.title, count(*) AS n, CAST(sum(a.bytes) AS BIGINT) AS bytes
    FROM attachments a JOIN messages m ON m.message_id = a.message_id LEFT JOIN chats c ON c.chat_id = m.chat_id
    GROUP BY m.chat_id, c.title ORDER BY bytes DESC, chat_id LIMIT 20""",
)
def storage_top_chats(d):
    titled = chats.titles(d.direct_chats(), d.direct_members(), d.handles())
    return storage.by_chat(d.attachments(), d.order_messages(), titled)


@query(
    "storage_top_groups",
    v.with_(v.HANDLES, v.ORDER_MESSAGES, v.ATTACHMENTS, v.GROUP_MEMBERS, v.GROUP_MESSAGES, v.GROUP_TITLES)
    + """SELECT g.chat_id, c.title, count(*) AS n, CAST(sum(a.bytes) AS BIGINT) AS bytes,
      coalesce((SELECT string_agg(p.who, ', ' ORDER BY p.place) FROM people p WHERE p.chat_id = g.chat_id AND p.place <= 4), '') AS people
    FROM attachments a JOIN group_messages g ON g.message_id = a.message_id LEFT JOIN chats c ON c.chat_id = g.chat_id
    GROUP BY g.chat_id, c.title ORDER BY bytes DESC, g.chat_id LIMIT 20""",
)
def storage_top_groups(d):
    """Group chats by attachment bytes, with their first people."""
    titled = chats.titles(d.group_chats(), d.group_members(), d.handles())
    top = storage.by_chat(d.attachments(), d.group_messages(), titled)
    return storage.with_people(top, d.group_members(), d.handles()).withColumn("people", F.array_join("people", ", "))


@query(
    "storage_present_bytes",
    v.with_(v.ATTACHMENTS, v.MANIFEST)
    + "SELECT CAST(sum(bytes) AS BIGINT) AS bytes_on_disk FROM attachments WHERE path IN (SELECT path FROM manifest)",
)
def storage_present_bytes(d):
    return storage.present_bytes(d.attachments(), d.file_manifest())


@query(
    "attachment_page",
    A + """SELECT a.attachment_id, a.message_id, m.chat_id, c.title,
        CASE WHEN NOT m.from_me THEN coalesce(h.name, h.address) END AS sender, epoch_ms(m.ts) AS ts_ms, a.filename,
        a.bytes, a.kind
    FROM attachments a JOIN messages m ON m.message_id = a.message_id JOIN chats c ON c.chat_id = m.chat_id
    JOIN handles h ON h.handle_id = m.handle_id
    WHERE a.kind = 0 AND a.bytes >= 50000 ORDER BY a.bytes DESC, m.ts DESC, a.attachment_id DESC LIMIT 100 OFFSET 50""",
)
def attachment_page(d):
    f = storage.AttachmentFilter(kind=0, min_bytes=50_000, limit=100, offset=50)
    page = storage.listing(d.attachments(), d.order_messages(), f)
    titled = chats.titles(d.direct_chats(), d.direct_members(), d.handles())
    nothing = d.attachments().select("attachment_id", F.col("path").alias("new_path")).limit(0)
    rows = storage.enrich(page, titled, d.handles(), nothing, d.file_manifest())
    return rows.select(
        "attachment_id", "message_id", "chat_id", "title", "sender", F.unix_millis("ts").alias("ts_ms"), "filename",
        "bytes", "kind",
    )


@query(
    "attachment_page_newest",
    A + """SELECT a.attachment_id, a.bytes, epoch_ms(m.ts) AS ts_ms FROM attachments a
    JOIN messages m ON m.message_id = a.message_id ORDER BY m.ts DESC, a.attachment_id DESC LIMIT 10000""",
)
def attachment_page_newest(d):
    f = storage.AttachmentFilter(sort="date", limit=10_000)
    page = storage.listing(d.attachments(), d.order_messages(), f)
    return page.select("attachment_id", "bytes", F.unix_millis("ts").alias("ts_ms"))


@query(
    "attachment_page_totals",
    A + """SELECT count(*) AS total_count, CAST(coalesce(sum(a.bytes), 0) AS BIGINT) AS total_bytes
    FROM attachments a JOIN messages m ON m.message_id = a.message_id WHERE a.kind = 1 AND a.bytes >= 20000""",
)
def attachment_page_totals(d):
    f = storage.AttachmentFilter(kind=1, min_bytes=20_000)
    return storage.listing_totals(d.attachments(), d.order_messages(), f)


@query(
    "cleanup_outcome",
    v.with_(v.ATTACHMENTS, v.MANIFEST)
    + """, requested AS (
      SELECT attachment_id FROM attachments WHERE bytes >= 40000
      UNION SELECT 'x' || attachment_id FROM attachments WHERE kind = 3),
    gone AS (SELECT attachment_id FROM attachments WHERE kind = 1),
    plan AS (
      SELECT r.attachment_id, a.bytes, CASE WHEN a.attachment_id IS NULL THEN 'unknown id'
        WHEN r.attachment_id IN (SELECT attachment_id FROM gone) THEN 'already removed'
        WHEN a.path NOT IN (SELECT path FROM manifest) THEN 'not present' ELSE 'moved' END AS outcome
      FROM requested r LEFT JOIN attachments a ON a.attachment_id = r.attachment_id)
    SELECT outcome, count(*) AS n, CAST(sum(CASE WHEN outcome = 'moved' THEN bytes ELSE 0 END) AS BIGINT) AS bytes
    FROM plan GROUP BY outcome""",
)
def cleanup_outcome(d):
    a = d.attachments()
    missing = a.filter("kind = 3").select(F.concat(F.lit("x"), "attachment_id").alias("attachment_id"))
    requested = a.filter("bytes >= 40000").select("attachment_id").unionByName(missing)
    removed = a.filter("kind = 1").select("attachment_id", F.col("path").alias("new_path"))
    return storage.cleanup_outcome(storage.cleanup_plan(requested, a, removed, d.file_manifest()))


@query(
    "size_bands",
    v.with_(v.ATTACHMENTS)
    + """SELECT band, count(*) AS n, CAST(sum(bytes) AS BIGINT) AS bytes FROM (
      SELECT bytes * 1000 AS bytes FROM attachments) a
    JOIN (VALUES ('any', 0), ('1 MB', 1000000), ('10 MB', 10000000), ('50 MB', 50000000), ('100 MB', 100000000)) b(band, lo)
      ON a.bytes >= b.lo GROUP BY band""",
)
def size_bands(d):
    return storage.size_bands(d.attachments().withColumn("bytes", F.col("bytes") * 1000))


@query(
    "kind_shares",
    v.with_(v.ATTACHMENTS)
    + """SELECT kind, CAST(sum(bytes) AS BIGINT) AS bytes, round(sum(bytes) / greatest(sum(sum(bytes)) OVER (), 1), 9) AS share
    FROM attachments GROUP BY kind HAVING sum(bytes) > 0""",
)
def kind_shares(d):
    return storage.kind_shares(d.attachments()).withColumn("share", F.round("share", 9))


@query(
    "attachment_look_up",
    A + """SELECT a.attachment_id, a.path, a.filename, a.kind FROM attachments a
    WHERE a.attachment_id IN (SELECT max(attachment_id) FROM attachments GROUP BY message_id)""",
)
def attachment_look_up(d):
    a = d.attachments()
    ids = a.groupBy("message_id").agg(F.max("attachment_id").alias("attachment_id"))
    return storage.look_up(ids, a)


# ------------------------------------------------------------------ activity
ORDERS = v.with_(v.HANDLES, v.ORDER_MESSAGES, v.ATTACHMENTS, v.DIRECT_CHATS, "act AS (SELECT * FROM messages WHERE kind = 0)")
NY = "America/New_York"
EVENTS = v.with_(
    v.EVENT_MESSAGES,
    "act AS (SELECT *, CAST(timezone('America/New_York', timezone('UTC', ts)) AS TIMESTAMP) AS wall FROM messages WHERE kind = 0)",
)
DAYS = "day_counts AS (SELECT CAST(ts AS DATE) AS day, count(*) AS n FROM act GROUP BY 1)"
ORDER_DAYS = ORDERS.rstrip() + ",\n" + DAYS + "\n"


@query("activity_days", ORDER_DAYS + "SELECT strftime(day, '%Y-%m-%d') AS day, n FROM day_counts")
def activity_days(d):
    return insights.days(insights.activity(d.order_messages())).select(day_text().alias("day"), "n")


@query(
    "activity_days_local",
    EVENTS + "SELECT strftime(wall, '%Y-%m-%d') AS day, count(*) AS n FROM act GROUP BY 1",
)
def activity_days_local(d):
    return insights.days(insights.activity(d.event_messages(), tz=NY)).select(day_text().alias("day"), "n")


@query(
    "activity_hours",
    EVENTS + """SELECT h.hour, coalesce(n, 0) AS n FROM (SELECT unnest(range(24)) AS hour) h
    LEFT JOIN (SELECT hour(wall) AS hour, count(*) AS n FROM act GROUP BY 1) c ON c.hour = h.hour""",
)
def activity_hours(d):
    return insights.hours(insights.activity(d.event_messages(), tz=NY))


@query(
    "activity_weekdays",
    EVENTS + """SELECT w.weekday, coalesce(n, 0) AS n FROM (SELECT unnest(range(7)) AS weekday) w
    LEFT JOIN (SELECT dayofweek(wall) AS weekday, count(*) AS n FROM act GROUP BY 1) c ON c.weekday = w.weekday""",
)
def activity_weekdays(d):
    return insights.weekdays(insights.activity(d.event_messages(), tz=NY))


@query(
    "activity_totals",
    ORDERS + """SELECT count(*) AS total, count(*) FILTER (WHERE from_me) AS sent, count(*) FILTER (WHERE NOT from_me) AS received,
    count(DISTINCT chat_id) AS chats, epoch_ms(min(ts)) AS first_ms, epoch_ms(max(ts)) AS last_ms
    FROM act WHERE ts >= TIMESTAMP '1997-01-01' AND ts < TIMESTAMP '1998-01-01'""",
)
def activity_totals(d):
    t = insights.totals(insights.activity(d.order_messages(), year=1997))
    return t.select(
        "total", "sent", "received", "chats",
        F.unix_millis("first_ts").alias("first_ms"), F.unix_millis("last_ts").alias("last_ms"),
    )


@query(
    "activity_per_chat",
    ORDERS + """SELECT chat_id, count(*) FILTER (WHERE from_me) AS sent, count(*) FILTER (WHERE NOT from_me) AS received,
    count(*) AS total FROM act GROUP BY chat_id""",
)
def activity_per_chat(d):
    return insights.per_chat(insights.activity(d.order_messages()))


@query(
    "activity_years",
    ORDERS + "SELECT unnest(range(min(year(ts)), max(year(ts)) + 1)) AS year FROM act",
)
def activity_years(d):
    return insights.years(d.order_messages())


@query(
    "streaks",
    ORDER_DAYS.rstrip() + """,
    runs AS (SELECT count(*) AS length, max(day) AS last_day FROM (
      SELECT day, day - CAST(row_number() OVER (ORDER BY day) AS INTEGER) AS island FROM day_counts) GROUP BY island)
    SELECT max(length) AS longest,
      CASE WHEN max(last_day) IN (DATE '2001-08-02', DATE '2001-08-01') THEN arg_max(length, last_day) ELSE 0 END AS current
    FROM runs""",
)
def streaks(d):
    day_counts = insights.days(insights.activity(d.order_messages()))
    return insights.streaks(day_counts, F.lit("2001-08-02").cast("date"))


@query("busiest_day", ORDER_DAYS + "SELECT strftime(day, '%Y-%m-%d') AS day, n FROM day_counts ORDER BY n DESC, day LIMIT 1")
def busiest_day(d):
    return insights.busiest_day(insights.days(insights.activity(d.order_messages()))).select(day_text().alias("day"), "n")


PARTNER = """partner AS (SELECT c.chat_id, h.name, h.address FROM chats c JOIN handles h ON h.handle_id = c.chat_id)"""


@query(
    "top_people",
    ORDERS.rstrip() + ",\n" + PARTNER.replace("h.name,", "CASE WHEN h.name IS NULL THEN NULL ELSE 'Person ' || CAST(h.handle_id % 100 AS VARCHAR) END AS name,") + """,
    t AS (SELECT chat_id, count(*) FILTER (WHERE from_me) AS sent, count(*) AS total FROM act GROUP BY chat_id)
    SELECT max(p.name) AS name, arg_max(t.chat_id, t.total * 10000000 - t.chat_id) AS chat_id, CAST(sum(sent) AS BIGINT) AS sent,
      CAST(sum(total) - sum(sent) AS BIGINT) AS received, CAST(sum(total) AS BIGINT) AS total
    FROM t JOIN partner p ON p.chat_id = t.chat_id
    GROUP BY coalesce(p.name, CAST(t.chat_id AS VARCHAR)) ORDER BY total DESC, chat_id LIMIT 20""",
)
def top_people(d):
    titled = chats.titles(d.direct_chats(), d.direct_members(), d.handles())
    shared = F.when(F.col("name").isNotNull(), F.concat(F.lit("Person "), (F.col("handle_id") % 100).cast("string")))
    people = d.handles().withColumn("name", shared)
    chat_totals = insights.per_chat(insights.activity(d.order_messages()))
    return insights.top_people(chat_totals, titled, d.direct_members(), people)


GROUPS = v.with_(v.HANDLES, v.ORDER_MESSAGES, v.GROUP_MEMBERS, v.GROUP_MESSAGES, v.GROUP_TITLES)


@query(
    "top_groups",
    GROUPS + """SELECT t.chat_id, c.title, t.total, p.people FROM (
      SELECT chat_id, count(*) AS total FROM group_messages WHERE kind = 0 GROUP BY chat_id ORDER BY total DESC, chat_id LIMIT 10) t
    JOIN chats c ON c.chat_id = t.chat_id
    JOIN (SELECT chat_id, string_agg(who, ', ' ORDER BY place) AS people FROM people WHERE place <= 4 GROUP BY chat_id) p
      ON p.chat_id = t.chat_id""",
)
def top_groups(d):
    titled = chats.titles(d.group_chats(), d.group_members(), d.handles())
    chat_totals = insights.per_chat(insights.activity(d.group_messages()))
    return insights.top_groups(chat_totals, titled, d.group_members(), d.handles())


@query(
    "activity_attachments",
    ORDERS + """SELECT count(*) AS attachments, CAST(sum(a.bytes) AS BIGINT) AS bytes FROM attachments a
    JOIN messages m ON m.message_id = a.message_id WHERE m.ts >= TIMESTAMP '1998-01-01' AND m.ts < TIMESTAMP '1999-01-01'""",
)
def activity_attachments(d):
    return insights.attachment_totals(d.order_messages(), d.attachments(), year=1998)


HEAT = ORDER_DAYS.rstrip() + """,
ranked AS (SELECT day, n, row_number() OVER (ORDER BY n, day) - 1 AS i, count(*) OVER () AS size FROM day_counts),
cuts AS (SELECT max(CASE WHEN i = least(size - 1, floor(0.25 * size)) THEN n END) AS t1,
                max(CASE WHEN i = least(size - 1, floor(0.5 * size)) THEN n END) AS t2,
                max(CASE WHEN i = least(size - 1, floor(0.75 * size)) THEN n END) AS t3 FROM ranked),
levels AS (SELECT day, n, CASE WHEN n <= t1 THEN 1 WHEN n <= t2 THEN 2 WHEN n <= t3 THEN 3 ELSE 4 END AS level FROM ranked, cuts)
"""


@query("heat_levels", HEAT + "SELECT strftime(day, '%Y-%m-%d') AS day, n, CAST(level AS BIGINT) AS level FROM levels")
def heat_levels(d):
    return insights.heat_levels(insights.days(insights.activity(d.order_messages()))).select(
        day_text().alias("day"), "n", "level"
    )


@query(
    "calendar_grid",
    HEAT.rstrip() + """,
    b AS (SELECT max(day) AS last, max(day) - CAST(364 + dayofweek(max(day)) AS INTEGER) AS start FROM day_counts),
    cells AS (SELECT start, last, CAST(unnest(range(CAST(start - CAST(dayofweek(start) AS INTEGER) AS TIMESTAMP),
       CAST(last + CAST(7 - dayofweek(last) AS INTEGER) AS TIMESTAMP), INTERVAL 1 DAY)) AS DATE) AS day,
       start - CAST(dayofweek(start) AS INTEGER) AS first FROM b)
    SELECT strftime(c.day, '%Y-%m-%d') AS day, CAST(floor((c.day - c.first) / 7) AS BIGINT) AS week,
      dayofweek(c.day) AS weekday, coalesce(l.n, 0) AS n, CAST(coalesce(l.level, 0) AS BIGINT) AS level,
      NOT (c.day BETWEEN c.start AND c.last) AS outside
    FROM cells c LEFT JOIN levels l ON l.day = c.day""",
)
def calendar_grid(d):
    grid = insights.calendar_grid(insights.days(insights.activity(d.order_messages())))
    return grid.withColumn("day", day_text())


@query(
    "calendar_grid_year",
    ORDERS.rstrip() + ",\n" + DAYS.replace("FROM act", "FROM act WHERE year(ts) = 1999") + """,
    cells AS (SELECT CAST(unnest(range(TIMESTAMP '1998-12-27', TIMESTAMP '2000-01-02', INTERVAL 1 DAY)) AS DATE) AS day)
    SELECT strftime(c.day, '%Y-%m-%d') AS day, CAST(floor((c.day - DATE '1998-12-27') / 7) AS BIGINT) AS week, coalesce(n, 0) AS n,
      year(c.day) <> 1999 AS outside
    FROM cells c LEFT JOIN day_counts k ON k.day = c.day""",
)
def calendar_grid_year(d):
    grid = insights.calendar_grid(insights.days(insights.activity(d.order_messages(), year=1999)), 1999)
    return grid.select(day_text().alias("day"), "week", "n", "outside")

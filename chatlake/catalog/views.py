"""SQL spellings of the canonical tables in ``chatlake.sources.testdata``."""

HANDLES = """handles AS (
  SELECT c_custkey AS handle_id, '+1555' || lpad(CAST(c_custkey AS VARCHAR), 7, '0') AS address,
         CASE WHEN c_custkey % 7 <> 0 THEN c_name END AS name,
         '1555' || lpad(CAST(c_custkey AS VARCHAR), 7, '0') AS digits
  FROM customer)"""

ORDER_MESSAGES = """messages AS (
  SELECT o_orderkey AS message_id, o_custkey AS chat_id, o_custkey AS handle_id, (o_orderstatus = 'F') AS from_me,
         o_orderdate AS ts, o_orderpriority AS text, CASE WHEN o_orderpriority = '5-LOW' THEN 1 ELSE 0 END AS kind
  FROM orders)"""

ATTACHMENTS = """attachments AS (
  SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS attachment_id, l_orderkey AS message_id,
         'IMG_' || CAST(l_partkey AS VARCHAR) AS filename,
         '/files/' || CAST(l_suppkey AS VARCHAR) || '/' || CAST(l_partkey AS VARCHAR) AS path,
         CAST(floor(l_extendedprice) AS BIGINT) AS bytes,
         CASE WHEN l_returnflag = 'R' AND l_linestatus = 'O' THEN 0 WHEN l_returnflag = 'R' THEN 1
              WHEN l_returnflag = 'N' AND l_linestatus = 'O' THEN 2 WHEN l_returnflag = 'N' THEN 3 ELSE 4 END AS kind
  FROM lineitem)"""

MANIFEST = """manifest AS (
  SELECT DISTINCT '/files/' || CAST(l_suppkey AS VARCHAR) || '/' || CAST(l_partkey AS VARCHAR) AS path
  FROM lineitem WHERE l_discount >= 0.05)"""

DIRECT_CHATS = """chats AS (
  SELECT handle_id AS chat_id, address AS identifier, NULL AS display_name, coalesce(name, address) AS title,
         FALSE AS is_group FROM handles)"""

GROUP_MEMBERS = """members AS (
  SELECT CAST(1000000 + c_nationkey AS BIGINT) AS chat_id, c_custkey AS handle_id FROM customer)"""

GROUP_MESSAGES = """group_messages AS (
  SELECT m.message_id, g.chat_id, m.handle_id, m.from_me, m.ts, m.text, m.kind
  FROM messages m JOIN members g ON g.handle_id = m.handle_id)"""

GROUP_TITLES = """people AS (
  SELECT g.chat_id, h.handle_id, h.address, h.name, coalesce(h.name, h.address) AS who,
         row_number() OVER (PARTITION BY g.chat_id ORDER BY h.name IS NULL, h.name, h.address, h.handle_id) AS place,
         count(*) OVER (PARTITION BY g.chat_id) AS n
  FROM members g JOIN handles h ON h.handle_id = g.handle_id),
chats AS (
  SELECT c.chat_id, c.identifier, c.display_name, (coalesce(p.n, 0) > 1 OR starts_with(c.identifier, 'chat')) AS is_group,
         CASE WHEN c.display_name IS NOT NULL THEN c.display_name
              WHEN p.n IS NULL THEN c.identifier
              WHEN p.n > 3 THEN p.names || ' +' || CAST(p.n - 3 AS VARCHAR)
              ELSE p.names END AS title
  FROM (SELECT CAST(1000000 + n_nationkey AS BIGINT) AS chat_id, 'chat' || CAST(n_nationkey AS VARCHAR) AS identifier,
               CASE WHEN n_nationkey % 2 = 0 THEN n_name END AS display_name FROM nation) c
  LEFT JOIN (SELECT chat_id, max(n) AS n,
                    string_agg(CASE WHEN n > 1 AND NOT contains(who, '@') AND NOT starts_with(who, '+')
                                    THEN split_part(who, ' ', 1) ELSE who END, ', ' ORDER BY place) AS names
             FROM people WHERE place <= 3 GROUP BY chat_id) p ON p.chat_id = c.chat_id)"""

EVENT_MESSAGES = """messages AS (
  SELECT event_id AS message_id, user_id AS chat_id, user_id AS handle_id, event_type IN ('click', 'view') AS from_me,
         ts, event_type AS text, CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS kind, FALSE AS unsent
  FROM events)"""

REACTIONS = """reactions AS (
  SELECT event_id // 10 AS target_id, 0 AS part, user_id % 3 AS handle_id, (user_id % 3 = 0) AS from_me,
         event_type AS emoji, (event_type = 'error') AS removed, ts, event_id AS reaction_id
  FROM events)"""

TURN_MESSAGES = """messages AS (
  SELECT conv_id * 100 + turn AS message_id, conv_id AS chat_id,
         CASE role WHEN 'assistant' THEN 1 WHEN 'system' THEN 2 END AS handle_id, (role = 'user') AS from_me,
         make_timestamp((1704067200 + conv_id * 86400 + turn * 60) * 1000000) AS ts, text,
         CASE WHEN role = 'user' THEN 'Me' ELSE role END AS who, 'Conversation ' || CAST(conv_id AS VARCHAR) AS title
  FROM conversations)"""

DOCUMENT_MESSAGES = """messages AS (
  SELECT doc_id AS message_id, CAST(regexp_extract(source, '(\\d+)', 1) AS BIGINT) AS chat_id,
         CAST(ascii(lang) * 256 + ascii(substring(lang, 2, 1)) AS BIGINT) AS handle_id, (lang = 'en') AS from_me,
         make_timestamp((1704067200 + doc_id * 60) * 1000000) AS ts, text, 0 AS kind, lang,
         CASE WHEN lang = 'en' THEN 'Me' ELSE 'Author ' || lang END AS who, source AS title,
         coalesce(contains(text, 'http://') OR contains(text, 'https://') OR contains(text, 'www.'), FALSE) AS has_link
  FROM documents)"""


def with_(*parts: str, recursive: bool = False) -> str:
    return ("WITH RECURSIVE " if recursive else "WITH ") + ",\n".join(parts) + "\n"

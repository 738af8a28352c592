"""URL rules by a sort-merge range join over reversed-host keys.

Keys. A host is written backwards by its labels, a slash and the path follow: ``www.example.com`` with ``/en/a``
becomes ``com.example.www//en/a``. A host has no slash, so keys cannot be confused, and the urls that a rule fits at
its own host are one interval of keys, those that its key begins. Intervals of such a kind are nested or apart, never
half over each other.

Subdomains. A url is looked up at every host it lies below (``com.example.www``, ``com.example``, ``com``) that
has rules at all: one point per host, found by an equality join with the distinct hosts of the rules, and never more
points than the rules' hosts have labels.

Sweep. Points and rules are sorted together, rules first where keys are equal. Going through them, a stack holds the
rules whose intervals are open, each nested in the one below; whatever a new key does not continue is taken off. The top
of the stack is a point's longest rule at that host; the longest over a url's points wins.

Scale. Equal (host, path) pairs are judged once. Points are cut into ranges of about ``range_rows`` by (key, hash of
the host), so that one key (the root page of a million subdomains) can fill many ranges. The cuts come from a bounded
sample, ``SAMPLE`` keys for each range, at most ``CUT_CHARS`` characters of each; they decide balance, not results. A
rule goes to every range its interval meets; each cut lies in at most one nested chain of rules, so this adds no more
rows than cuts times the depth of nesting. A task holds one stack.

Cases. Null url, or one without ``://``: host and path empty. Only A-Z are lower-cased. The longest rule has
the most characters of host and path together; of equal ones that with the longer host. Rules with equal host and path
and different verdicts block. A rule with null host is left out, null path is empty and fits any path; an empty host fits
every host. Urls that no rule fits get ``default`` and a null rule. Rows with equal or null ids each get their own
row. Empty tables of urls or rules work. Columns other than those named do not matter.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from string import ascii_lowercase, ascii_uppercase

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chatlake.llm.common import query, spark_schema, table
from chatlake.session import durable

RANGE_ROWS = 100_000
SAMPLE = 32
CUT_CHARS = 1000
#: The largest signed 64-bit number: above any hash.
_LAST = (1 << 63) - 1
EVENTS = "range int, key string, point boolean, host string, path string, verdict string"


def host_of(url: Column) -> Column:
    """What stands after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased."""
    return F.translate(F.regexp_extract(_after(url), r"^[^/?#]*", 0), ascii_uppercase, ascii_lowercase)


def path_of(url: Column) -> Column:
    """What follows the host, up to ``?``, ``#`` or the end."""
    rest = _after(url)
    return F.regexp_extract(F.substring(rest, F.length(F.regexp_extract(rest, r"^[^/?#]*", 0)) + 1, F.length(rest)), r"^[^?#]*", 0)


def _after(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.coalesce(F.when(at > 0, F.substring(url, at + 3, F.length(url))), F.lit(""))


def _backwards(host: Column) -> Column:
    return F.array_join(F.reverse(F.split(host, r"\.")), ".")


def _rules(rules: DataFrame) -> DataFrame:
    """One row per host and path: host, path, verdict, at (the host backwards), key."""
    clean = rules.select(
        F.translate(rules["host"], ascii_uppercase, ascii_lowercase).alias("host"),
        F.coalesce(rules["path"], F.lit("")).alias("path"),
        F.coalesce(rules["verdict"], F.lit("block")).alias("verdict"),
    ).where("host IS NOT NULL")
    one = clean.groupBy("host", "path").agg(F.max("verdict").alias("verdict"))  # of allow and block the latter is larger
    return one.withColumn("at", _backwards(F.col("host"))).withColumn("key", F.concat("at", F.lit("/"), "path"))


def _points(places: DataFrame, rules: DataFrame) -> DataFrame:
    """(host, path, at, key, salt): the urls at every host above or equal to theirs that has rules."""
    hosts = rules.select("at").distinct()
    labels = rules.agg(F.max(F.size(F.split("at", r"\.")))).first()[0] or 0
    back = F.reverse(F.split("host", r"\."))
    above = F.transform(F.sequence(F.lit(1), F.least(F.size(back), F.lit(max(labels, 1)))), lambda k: F.array_join(F.slice(back, F.lit(1), k), "."))
    # the empty host lies above all others
    spread = places.select("host", "path", F.explode(F.array_distinct(F.concat(above, F.array(F.lit(""))))).alias("at"))
    return spread.join(hosts, "at").select(
        "host", "path", F.concat("at", F.lit("/"), "path").alias("key"), F.xxhash64("host", "path").alias("salt")
    )


def _cuts(points: DataFrame, range_rows: int) -> list[tuple[str, int]]:
    ranges = -(-points.count() // range_rows)
    if ranges < 2:
        return []
    short = points.select(F.substring("key", 1, CUT_CHARS).alias("key"), "salt")
    some = sorted((r["key"], r["salt"]) for r in short.orderBy(F.xxhash64("key", "salt")).limit(ranges * SAMPLE).collect())
    return sorted({some[len(some) * k // ranges] for k in range(1, ranges)})


def _past(key: str) -> str | None:
    """The least string that is larger than everything ``key`` begins."""
    while key:
        last = ord(key[-1])
        if last < 0x10FFFF:
            return key[:-1] + chr(last + 1)
        key = key[:-1]
    return None


def _rule_ranges(key: str, cuts: list[tuple[str, int]]) -> range:
    """The ranges in which points may stand that ``key`` begins."""
    start = key[:CUT_CHARS]
    past = _past(start)
    last = len(cuts) if past is None else bisect_left(cuts, (past, -_LAST - 1))
    return range(bisect_left(cuts, (start, -_LAST - 1)), last + 1)


def sweep(batches):
    """Of each point, the longest open rule; rows come ordered by (range, key, point)."""
    stack: list[tuple[str, str, str, str]] = []
    now = None
    for batch in batches:
        rows = []
        for number, key, point, host, path, verdict in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if number != now:
                stack.clear()
                now = number
            while stack and not key.startswith(stack[-1][0]):
                stack.pop()
            if not point:
                stack.append((key, host, path, verdict))
            elif stack:
                rows.append((host, path, *stack[-1][1:]))
        names = ["host", "path", "rule_host", "rule_path", "verdict"]
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.string()) for k in range(5)], names=names)


def longest_rules(places: DataFrame, rules: DataFrame, range_rows: int = RANGE_ROWS) -> DataFrame:
    """(host, path, rule_host, rule_path, verdict) of the distinct (host, path) that some rule fits."""
    known = durable(_rules(rules))
    points = durable(_points(places, known))
    cuts = _cuts(points, range_rows)
    schema = spark_schema(places.sparkSession, EVENTS)

    def place(batches):
        for batch in batches:
            host, path, key, salt = (c.to_pylist() for c in batch.columns)
            number = [bisect_right(cuts, (k[:CUT_CHARS], s)) for k, s in zip(key, salt, strict=True)]
            n = len(key)
            yield pa.RecordBatch.from_pydict(
                {"range": number, "key": key, "point": [True] * n, "host": host, "path": path, "verdict": [None] * n}, schema=schema
            )

    def open_in(batches):
        for batch in batches:
            for row in batch.to_pylist():
                numbers = _rule_ranges(row["key"], cuts)
                for at in range(0, len(numbers), 10_000):
                    some = numbers[at : at + 10_000]
                    same = {c: [row[c]] * len(some) for c in ("key", "host", "path", "verdict")}
                    yield pa.RecordBatch.from_pydict({"range": list(some), "point": [False] * len(some), **same}, schema=schema)

    events = points.mapInArrow(place, EVENTS).unionByName(known.select("key", "host", "path", "verdict").mapInArrow(open_in, EVENTS))
    ordered = events.repartition(max(1, len(cuts) + 1), "range").sortWithinPartitions("range", "key", "point")
    found = ordered.mapInArrow(sweep, "host string, path string, rule_host string, rule_path string, verdict string")
    size = F.struct((F.length("rule_host") + F.length("rule_path")).alias("n"), F.length("rule_host").alias("h"))
    best = found.groupBy("host", "path").agg(F.max_by(F.struct("rule_host", "rule_path", "verdict"), size).alias("r"))
    return best.select("host", "path", "r.rule_host", "r.rule_path", "r.verdict")


def judge(
    pages: DataFrame,
    rules: DataFrame,
    id_col: str = "page_id",
    url_col: str = "url",
    default: str = "allow",
    range_rows: int = RANGE_ROWS,
) -> DataFrame:
    """(id, host, path, rule, verdict) of every row of ``pages``.

    ``rules`` has the columns host, path and verdict (allow or block).
    """
    urls = pages.select(pages[id_col].alias(id_col), host_of(pages[url_col]).alias("host"), path_of(pages[url_col]).alias("path"))
    found = longest_rules(urls.select("host", "path").distinct(), rules, range_rows)
    return urls.join(found, ["host", "path"], "left").select(
        id_col,
        "host",
        "path",
        F.concat("rule_host", "rule_path").alias("rule"),
        F.coalesce("verdict", F.lit(default)).alias("verdict"),
    )


#: The rules of the registered query: host, path, verdict.
RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]

SQL = f"""
WITH rules(rule_host, rule_path, rule_verdict) AS (VALUES {", ".join(str(r) for r in RULES)}),
rest AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), cut AS (
  SELECT page_id, rest, regexp_extract(rest, '^[^/?#]*') AS raw FROM rest
), urls AS (
  SELECT row_number() OVER () AS row_no, page_id, translate(raw, '{ascii_uppercase}', '{ascii_lowercase}') AS host,
         regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path
  FROM cut
), fitting AS (
  SELECT row_no, rule_host || rule_path AS rule, rule_verdict
  FROM urls JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
  QUALIFY row_number() OVER (PARTITION BY row_no ORDER BY length(rule_host || rule_path) DESC, length(rule_host) DESC) = 1
)
SELECT page_id, host, path, rule, coalesce(rule_verdict, 'allow') AS verdict
FROM urls LEFT JOIN fitting USING (row_no)
"""


@query("op11_url_rules", SQL)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    return judge(table(spark, sf_dir, "pages"), rules)

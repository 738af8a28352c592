"""WARC archives and an external merge of their capture indexes.

Writing. Each page becomes a WARC/1.1 record, a gzip member of its own. Of equal payloads from ``MIN_SHARED`` bytes on, the
page with the largest id is a response and the others are revisits that refer to it and hold HTTP headers
only. Equality is by SHA-1 of the whole payload. A task sorts its pages by (URL key, time, id) and writes one archive,
so the records of an archive are a locally sorted run of captures. Archives go through Spark's text writer, whose commit
makes lost tasks harmless; its row separator is a zero byte, which gzip takes for padding.

Merging. Reading an archive gives its run, cut at the bounds of key ranges. A task gets the parts of all runs that
fall in one range and merges them by a loser tree; ranges follow each other, so the captures of all archives are in one
global order by URL key and time. Bounds are whole keys (URL key, time, id), so a URL with a third of all
captures is spread over ranges; they come from at most ``SAMPLE`` keys per range.

Cases: null html is an empty payload; null URLs have an empty key; pages without a time get one from their id; rows that
share the largest id of equal payloads are all responses; rows with null id are responses and are never referred
to. An empty table gives an empty folder and index. Further columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from bisect import bisect_right
from collections.abc import Iterator
from datetime import datetime, timedelta, timezone
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chatlake.llm.common import query, small, spark_schema, table
from chatlake.session import ensure_checkpoint_dir

MIN_SHARED = 1000
RANGE_ROWS = 50_000
SAMPLE = 16
LEVEL = 4
EPOCH = datetime(2020, 1, 1, tzinfo=timezone.utc)

INDEX = "urlkey string, captured long, page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, archive string, offset long, length long"


def url_key(url: Column) -> Column:
    """Host turned round, then path and query: captures of a site stand together."""
    url = F.coalesce(url, F.lit(""))
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    rest = F.lower(F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)?([^#]*)", 1))
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), ","), F.lit(")"), F.when(rest == "", "/").otherwise(rest))


def captured(page_id: Column) -> Column:
    """The pages hold no time; seconds counted by their id stand for it."""
    return F.coalesce(F.pmod(page_id.cast("long"), F.lit(1 << 32)), F.lit(0))


def captures(pages: DataFrame, min_shared: int = MIN_SHARED) -> DataFrame:
    """(urlkey, captured, page_id, url, payload, refers_to) of (page_id, url, html)."""
    rows = pages.select(
        pages["page_id"].cast("long").alias("page_id"),
        pages["url"].cast("string").alias("url"),
        F.coalesce(pages["html"].cast("string"), F.lit("")).cast("binary").alias("payload"),
    )
    rows = rows.withColumn("digest", F.sha1("payload"))
    hashed = rows.where(F.col("page_id").isNotNull() & (F.octet_length("payload") >= min_shared)).select("page_id", "digest")
    shared = hashed.groupBy("digest").agg(F.max("page_id").alias("refers_to"), F.count("*").alias("n")).where("n > 1").select("digest", "refers_to")
    # ids and digests only; the payloads meet their target by both, which spreads equal payloads and keeps apart different
    # payloads of one id
    again = hashed.join(shared, "digest").where("page_id <> refers_to").groupBy("page_id", "digest").agg(F.max("refers_to").alias("refers_to"))
    return rows.join(again, ["page_id", "digest"], "left").select(
        url_key(F.col("url")).alias("urlkey"), captured(F.col("page_id")).alias("captured"), "page_id", "url", "payload", "refers_to"
    )


# ---------------------------------------------------------------- records
def record(urlkey: str, captured: int, page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """One gzip member. A revisit has the headers of the response without its payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + payload if refers_to is None else http
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <urn:page:{page_id}>",
        f"WARC-Date: {(EPOCH + timedelta(seconds=captured)).strftime('%Y-%m-%dT%H:%M:%SZ')}",
        f"WARC-Target-URI: {quote(url or '', safe=':/?#[]@!$&()*+,;=%~' + chr(39))}",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"X-Url-Key: {quote(urlkey, safe=',)/?=&;:@+$!*(~%' + chr(39))}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if refers_to is not None:
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    whole = "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"
    pack = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return pack.compress(whole) + pack.flush()


def members(content: memoryview) -> Iterator[tuple[int, int, bytes]]:
    """(offset, length, bytes) of each gzip member; zero bytes are padding."""
    at, step = 0, 1 << 14
    while at < len(content) and content[at] != 0:
        unpack, parts, end = zlib.decompressobj(31), [], at
        while not unpack.eof:
            if end >= len(content):
                raise ValueError("archive is cut off")
            parts.append(unpack.decompress(content[end : end + step]))
            end = min(end + step, len(content))
        end -= len(unpack.unused_data)
        yield at, end - at, b"".join(parts)
        at = end


def parse(whole: bytes) -> dict:
    """The index entry of one record; what a response says of its payload is checked against the payload."""
    head, _, block = whole.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = block[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(dict(line.split(": ", 1) for line in http.decode().split("\r\n")[1:])["Content-Length"])
    digest = base64.b32decode(fields["WARC-Payload-Digest"].removeprefix("sha1:"))
    if fields["WARC-Type"] == "response" and (len(payload) != size or hashlib.sha1(payload).digest() != digest):
        raise ValueError(f"payload of {fields['WARC-Record-ID']} is damaged")

    def page(name: str) -> int | None:
        got = fields[name][len("<urn:page:") : -1] if name in fields else "None"
        return None if got == "None" else int(got)

    from urllib.parse import unquote

    when = datetime.strptime(fields["WARC-Date"], "%Y-%m-%dT%H:%M:%SZ").replace(tzinfo=timezone.utc)
    return {
        "urlkey": unquote(fields["X-Url-Key"]),
        "captured": int((when - EPOCH).total_seconds()),
        "page_id": page("WARC-Record-ID"),
        "payload_bytes": size,
        "payload_digest": digest.hex(),
        "record_type": fields["WARC-Type"],
        "refers_to": page("WARC-Refers-To"),
    }


def write(pages: DataFrame, folder: str) -> None:
    """One archive per partition, its records sorted."""

    def run(batches):
        parts = []
        for batch in small(batches):
            parts += [record(*row) for row in zip(*(c.to_pylist() for c in batch.columns), strict=True)]
        if parts:
            yield pa.RecordBatch.from_arrays([pa.array([b"".join(parts)], pa.binary())], names=["archive"])

    rows = captures(pages).sortWithinPartitions("urlkey", "captured", "page_id")
    rows.mapInArrow(run, "archive binary").select(F.col("archive").cast("string")).write.option("lineSep", "\0").text(folder)


# ---------------------------------------------------------------- the merge
class LoserTree:
    """Merges sorted runs; an inner node keeps the loser of its match, the winner goes up."""

    def __init__(self, runs: list[Iterator[tuple]]):
        self.runs = runs
        self.heads = [next(r, None) for r in runs]
        k = len(runs)
        self.losers = [-1] * k
        winners = [0] * k + list(range(k))
        for node in range(k - 1, 0, -1):
            a, b = winners[2 * node], winners[2 * node + 1]
            winners[node], self.losers[node] = (a, b) if self._first(a, b) else (b, a)
        self.best = winners[1] if k > 1 else 0

    def _first(self, a: int, b: int) -> bool:
        x, y = self.heads[a], self.heads[b]
        if x is None or y is None:
            return y is None and (x is not None or a < b)
        return (x, a) < (y, b)

    def __iter__(self) -> Iterator[tuple[tuple, int]]:
        """(key, run) in order."""
        heads, losers, k = self.heads, self.losers, len(self.runs)
        while k and heads[self.best] is not None:
            run = self.best
            yield heads[run], run
            heads[run] = next(self.runs[run], None)
            node = (run + k) >> 1
            while node:
                if self._first(losers[node], run):
                    losers[node], run = run, losers[node]
                node >>= 1
            self.best = run


def bounds(pages: DataFrame) -> list[tuple]:
    """Keys that cut the captures into ranges of about RANGE_ROWS."""
    ranges = -(-pages.count() // RANGE_ROWS)
    if ranges < 2:
        return []
    key = pages.select(url_key(pages["url"]).alias("urlkey"), captured(pages["page_id"]).alias("captured"), pages["page_id"].cast("long").alias("page_id"))
    some = key.orderBy(F.xxhash64("urlkey", "captured", "page_id")).limit(ranges * SAMPLE).collect()
    keys = sorted(_order(r.asDict()) for r in some)
    return [keys[len(keys) * k // ranges] for k in range(1, ranges)]


def _order(row: dict) -> tuple:
    return row["urlkey"].encode(), row["captured"], -1 if row["page_id"] is None else row["page_id"]


def read(spark: SparkSession, folder: str, cuts: list[tuple]) -> DataFrame:
    """The captures of all archives: INDEX, and (range, place), by which they are in order."""
    one = spark_schema(spark, INDEX)
    run_schema = pa.schema([("range", pa.int32()), ("rows", pa.list_(pa.struct(list(one))))])

    def runs(batches):
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                parts: dict[int, list[dict]] = {}
                for offset, length, whole in members(memoryview(content.as_buffer())):
                    row = parse(whole) | {"archive": path, "offset": offset, "length": length}
                    parts.setdefault(bisect_right(cuts, _order(row)), []).append(row)
                yield pa.RecordBatch.from_pydict({"range": list(parts), "rows": list(parts.values())}, schema=run_schema)

    def merge(got: pa.Table) -> pa.Table:
        lists = got.column("rows").to_pylist()
        place = [iter(x) for x in lists]
        tree = LoserTree([map(_order, x) for x in lists])
        rows = [next(place[run]) for _, run in tree]
        out = pa.Table.from_pylist(rows, schema=one)
        n = len(rows)
        return out.append_column("range", pa.array([got.column("range")[0].as_py()] * n, pa.int32())).append_column("place", pa.array(range(n), pa.int64()))

    files = spark.read.format("binaryFile").load(folder).where("length > 1").select("path", "content")
    fields = INDEX.replace(" string", ": string").replace(" long", ": long")
    parts = files.mapInArrow(runs, f"range int, rows array<struct<{fields}>>")
    return parts.groupBy("range").applyInArrow(merge, f"{INDEX}, range int, place long")


@query("op2_warc_index_merge")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    ensure_checkpoint_dir(spark)
    pages = table(spark, sf_dir, "pages")
    folder = f"{spark.sparkContext.getCheckpointDir()}/warc-{uuid.uuid4().hex}"
    write(pages, folder)
    found = read(spark, folder, bounds(pages))
    first = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    return found.select(*first, *(c for c in found.columns if c not in first))

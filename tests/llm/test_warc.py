import gzip
import hashlib
import heapq
import random

from chatlake.llm import warc

BIG = "<p>" + "equal payload " * 200


def test_loser_tree():
    rng = random.Random(1)
    for k in range(0, 12):
        runs = [sorted((rng.randrange(30), rng.randrange(3)) for _ in range(rng.randrange(6))) for _ in range(k)]
        assert [key for key, _ in warc.LoserTree([iter(r) for r in runs])] == list(heapq.merge(*runs))


def test_records_and_index(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "RANGE_ROWS", 3)
    rows = [
        (1, "http://B.example.com/x?q=1#f", BIG), (2, "https://a.example.com:8080", BIG), (9, "http://a.example.com/é \n", BIG), (3, None, None),
        (4, "http://a.example.com/", ""), (5, "http://a.example.com/", "small"), (6, "http://c.org/", "small"), (5, "http://a.example.com/", "small"),
        (None, "not a url", BIG), (-7, "http://user@d.org/a", "ü" * 700), (8, "http://d.org/a", "ü" * 700),
    ]
    pages = spark.createDataFrame([(*r, "x", 1) for r in rows], "page_id long, url string, html string, payload string, refers_to int").repartition(4)
    folder = f"{tmp_path}/warc"
    warc.write(pages, folder)
    cuts = warc.bounds(pages)
    assert len(cuts) > 1
    got = sorted(warc.read(spark, folder, cuts).collect(), key=lambda r: (r.range, r.place))
    keys = [warc._order(r.asDict()) for r in got]
    assert keys == sorted(keys) and len(got) == len(rows)
    payload = {(i, h) for i, _, h in rows}
    for r in got:
        html = next(h for i, h in payload if i == r.page_id) or ""
        assert (r.payload_bytes, r.payload_digest) == (len(html.encode()), hashlib.sha1(html.encode()).hexdigest())
    kinds = {(r.page_id, r.record_type, r.refers_to) for r in got}
    assert {(1, "revisit", 9), (2, "revisit", 9), (9, "response", None), (None, "response", None), (5, "response", None), (-7, "revisit", 8)} <= kinds
    assert {r.urlkey for r in got if r.page_id in (1, 2)} == {"com,example,b)/x?q=1", "com,example,a)/"}
    one = next(r for r in got if r.page_id == 8)
    raw = open(one.archive.removeprefix("file:"), "rb").read()
    assert gzip.decompress(raw).count(b"WARC/1.1\r\n") >= 1  # any gzip reader takes an archive
    assert gzip.decompress(raw[one.offset : one.offset + one.length]).startswith(b"WARC/1.1\r\nWARC-Type: response\r\n")


def test_revisits_against_grouping_by_digest(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "RANGE_ROWS", 7)
    other = BIG.replace("equal", "other")
    rng = random.Random(2)
    rows = [(7, "A"), (9, "A"), (7, "B"), (7, "small"), (3, "B"), (3, "B"), (None, "B"), (None, "A"), (4, None), (9, "A"), (5, "A")]
    rows += [(rng.randrange(40), rng.choice("ABC")) for _ in range(60)]
    body = {"A": BIG, "B": other, "C": "é" * 499, "small": "small", None: None}
    rows = [(i, f"http://h{k % 5}.org/{k}", body[h]) for k, (i, h) in enumerate(rows)]
    pages = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, digest string").repartition(3)
    warc.write(pages, f"{tmp_path}/w")
    found = warc.read(spark, f"{tmp_path}/w", warc.bounds(pages))
    got = sorted((str(r.page_id), r.payload_digest, r.payload_bytes, r.record_type, str(r.refers_to)) for r in found.collect())
    largest = {}
    for i, _, h in rows:
        if i is not None and len((h or "").encode()) >= 1000:
            largest[h] = max(i, largest.get(h, i))
    want = []
    for i, _, h in rows:
        raw = (h or "").encode()
        target = largest.get(h) if i is not None else None
        again = target is not None and target != i
        want.append((str(i), hashlib.sha1(raw).hexdigest(), len(raw), "revisit" if again else "response", str(target if again else None)))
    assert got == sorted(want)
    payloads = set()
    for path in {r.archive for r in found.collect()}:
        for member in gzip.decompress(open(path.removeprefix("file:"), "rb").read()[:-1]).split(b"WARC/1.1\r\n")[1:]:
            payloads.add(member.split(b"\r\n\r\n", 2)[2].removesuffix(b"\r\n\r\n"))  # headers of the record, of the response
    assert {(h or "").encode() for _, _, h in rows} <= payloads  # nothing is lost


def test_empty_table(spark, tmp_path):
    none = spark.createDataFrame([], "page_id long, url string, html string")
    warc.write(none, f"{tmp_path}/none")
    assert warc.read(spark, f"{tmp_path}/none", warc.bounds(none)).count() == 0

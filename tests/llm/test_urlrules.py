import random

import oracle
import pytest

from chatlake.llm import urlrules

RULE = "host string, path string, verdict string"


def expected(url, rules, default="allow"):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    stop = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
    raw = rest[:stop]
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in raw)
    path = rest[stop:].split("?")[0].split("#")[0]
    fitting = [
        (len(h + (p or "")), len(h), v or "block", h + (p or ""))
        for h, p, v in rules
        if h is not None and (h in ("", host) or host.endswith("." + h)) and path.startswith(p or "")
    ]
    best = max(fitting, default=None)
    return host, path, best and best[3], best[2] if best else default


def check(spark, urls, rules, **options):
    pages = spark.createDataFrame([(k, u, "x", "y") for k, u in enumerate(urls)], "page_id long, url string, host string, verdict string")
    got = {r["page_id"]: tuple(r)[1:] for r in urlrules.judge(pages, spark.createDataFrame(rules, RULE), **options).collect()}
    assert got == {k: expected(u, rules) for k, u in enumerate(urls)}


CASES = [
    None, "", "no scheme", "http://", "://", "HTTP://WWW.Example.COM/en/A?x#y", "https://example.com/en/", "https://badexample.com/en/",
    "https://example.com", "https://example.com?/en/", "https://a.net/es/1", "https://net/es/", "https://x.y.z.net/fr", "https://example.com:80/en/",
    "https://a..com./en/", "x://y://z/en/", "http://ÄÖ.com/Ä", "http://com/\U0010ffff\U0010ffff", "http://" + "a." * 3000 + "com/" + "p/" * 3000,
]


def test_cases_by_the_rules_of_the_query(spark):
    check(spark, CASES, urlrules.RULES)


def test_rules_with_empty_and_null_parts(spark):
    rules = [("", "", "block"), ("", "/en/", "allow"), (None, "/", "block"), ("com", None, None), ("example.com", "/en/", "allow"), ("EXAMPLE.com", "/en/", "block")]
    pages = spark.createDataFrame([(1, "http://example.com/en/"), (2, None), (3, "http://a.org/en/")], "page_id long, url string")
    got = {r["page_id"]: (r["rule"], r["verdict"]) for r in urlrules.judge(pages, spark.createDataFrame(rules, RULE)).collect()}
    assert got == {1: ("example.com/en/", "block"), 2: ("", "block"), 3: ("/en/", "allow")}


@pytest.mark.parametrize("range_rows", [7, 100_000])
def test_random_nested_rules_in_many_ranges(spark, range_rows):
    rng = random.Random(5)
    host = lambda: ".".join(rng.choice("abc") for _ in range(rng.randint(1, 4)))
    path = lambda: "".join("/" + rng.choice(["", "a", "ab", "b"]) for _ in range(rng.randint(0, 4)))
    rules = list({(h, p): (h, p, rng.choice(["allow", "block"])) for h, p in ((host(), path()) for _ in range(120))}.values())
    urls = [f"http://{host()}{path()}" for _ in range(400)] + ["http://a.b/a"] * 200
    check(spark, urls, rules, range_rows=range_rows)


def test_one_key_fills_many_ranges(spark):
    rules = [("com", "/", "block"), ("a.com", "/", "allow")]
    urls = [f"http://h{k}.com/" for k in range(300)] + ["http://x.a.com/"]
    places = spark.createDataFrame([(urlrules_host(u), "/") for u in urls], "host string, path string")
    known = urlrules._rules(spark.createDataFrame(rules, RULE))
    assert len(urlrules._cuts(urlrules._points(places, known), 20)) > 8
    check(spark, urls, rules, range_rows=20)


def urlrules_host(url):
    return expected(url, [])[0]


def test_rows_with_equal_or_null_ids_and_empty_tables(spark):
    rules = spark.createDataFrame(urlrules.RULES, RULE)
    pages = spark.createDataFrame([(1, "http://a.com/"), (1, "http://a.com/"), (1, "http://b.net/es/"), (None, "http://c.org/")], "page_id long, url string")
    got = sorted((str(r["page_id"]), r["host"], str(r["rule"]), r["verdict"]) for r in urlrules.judge(pages, rules).collect())
    assert got == [("1", "a.com", "com/", "allow")] * 2 + [("1", "b.net", "net/es/", "block"), ("None", "c.org", "None", "allow")]
    assert urlrules.judge(pages.where("1=0"), rules).count() == 0
    assert {r["verdict"] for r in urlrules.judge(pages, rules.where("1=0"), default="block").collect()} == {"block"}


def test_query_against_sql(spark):
    at = "/root/testdata/sf0.001"
    assert oracle.compare(urlrules.op11(spark, at), oracle.connect(at), urlrules.SQL) is None

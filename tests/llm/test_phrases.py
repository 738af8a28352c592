import hashlib

from chatlake.llm import phrases
from chatlake.llm.common import pair


def test_parse():
    assert len(phrases.phrases([1, 1, 1, 1, 1, 1])) == 3  # 1, 11, 111
    assert len(phrases.phrases([1, 2, 1, 3, 1, 2, 1])) == 4  # 1, 2, 13, 12, (1)
    assert phrases.phrases([]) == set()


def test_likeness_follows_common_phrases():
    a = " ".join(f"word{k % 97} and{k % 31}" for k in range(2000))
    b = a[: len(a) - len(a) // 10]
    c = " ".join(f"other{k % 89} thing{k % 23}" for k in range(2000))
    s = [phrases.signature(x) for x in (a, b, c)]
    assert phrases.likeness(s[0], s[0]) == 1 and phrases.likeness(s[0], s[1]) > 0.6 > 0.2 > phrases.likeness(s[0], s[2])
    assert phrases.likeness(None, None) == 1 and phrases.likeness(None, s[0]) == 0
    assert len(phrases.units("x" * 100)) == 7


def expected(texts):
    rows = sorted(((i, t or "") for i, t in texts), key=lambda r: (r[0] is None, -(r[0] or 0), r[1]))
    out = []
    for k, (i, t) in enumerate(rows):
        following = rows[(k + 1) % len(rows)][1]
        e = t[: len(t) - len(t) // 2] + following[: len(t) // 2]
        own, its, other = (phrases.signature(x) for x in (t, following, e))
        fp = lambda s: phrases.fingerprint(s).hex()
        out.append((str(i), len(t), hashlib.sha256(e.encode()).hexdigest(), fp(own), fp(other), phrases.likeness(own, other), phrases.likeness(own, its)))
    return sorted(out)


def got(table):
    return sorted((str(r[0]), *r[1:]) for r in phrases.with_neighbours(table).collect())


def test_rows(spark, docs, texts, nothing):
    assert got(pair(docs)) == expected(texts)
    one = [(4, "a b c d e f")]
    assert got(spark.createDataFrame(one, "doc_id long, text string")) == expected(one)
    assert got(pair(nothing)) == []

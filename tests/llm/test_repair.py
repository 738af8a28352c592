import hashlib
import itertools
import random
import re
import zlib

import pytest

from chatlake.llm import repair

SCHEMA = "conv_id long, turn long, role string, text string, cost long, conv string"
RIGHT = re.compile(r"(s?(ua)+)?")


def options(row):
    """(initial, cost, role kept or None) of everything that may become of a row (role, blank or duplicate, truncated)."""
    role, gone, cut = row
    out = [("D", 2, None)]
    if not gone:
        more = 5 if cut else 0
        out += [("K", more, role[:1] or "?"), ("R", 1 + more, "u"), ("R", 1 + more, "a")]
    return out


def by_hand(rows):
    """Everything tried: the least (cost, audit) with at most two inserts at each place."""
    inserts = ["", "u", "a", "ua", "au", "uu", "aa"]
    best = None
    for chosen in itertools.product(*(options(r) for r in rows)):
        if best is not None and sum(c[1] for c in chosen) > best[0]:
            continue
        for places in itertools.product(inserts, repeat=len(rows) + 1):
            cost = sum(c[1] for c in chosen) + 5 * sum(map(len, places))
            if best is not None and cost > best[0]:
                continue
            roles = places[0] + "".join((c[2] or "") + p for c, p in zip(chosen, places[1:]))
            if RIGHT.fullmatch(roles):
                audit = "I" * len(places[0]) + "".join(c[0] + "I" * len(p) for c, p in zip(chosen, places[1:]))
                best = min(best or (cost, audit), (cost, audit))
    return best


def by_table(rows):
    """The least (cost, audit, kept) of every state, row after row; states are regular-expression prefixes."""
    after = lambda state, c: {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("a", "u"): "u", ("u", "a"): "a"}.get((state, c))

    def insert(ways):
        for _ in range(3):
            for state, (cost, audit, kept) in list(ways.items()):
                for c, name in (("u", "user"), ("a", "assistant")):
                    to = after(state, c)
                    new = (cost + 5, audit + "I", kept + [f"{name}:"])
                    if to is not None and (to not in ways or new[:2] < ways[to][:2]):
                        ways[to] = new
        return ways

    ways = insert({"": (0, "", [])})
    for role, gone, cut, text in rows:
        new = {}
        for state, (cost, audit, kept) in ways.items():
            for letter, more, c in options((role, gone, cut)):
                to = state if c is None else after(state, c)
                if to is None:
                    continue
                name = role if letter == "K" else {"u": "user", "a": "assistant"}.get(c)
                one = (cost + more, audit + letter, kept + ([] if c is None else [f"{name}:{text}"]))
                if to not in new or one[:2] < new[to][:2]:
                    new[to] = one
        ways = insert(new)
    return min((ways[s] for s in ("", "a") if s in ways), key=lambda w: w[:2])


def expected(rows, damaged=True):
    """The whole contract in plain Python over (conv_id, turn, role, text)."""
    out = {}
    for conv, turn, role, text in rows:
        lines = out.setdefault(conv, [])
        role, text = " " if role is None else role, " " if text is None else text
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        fate = zlib.crc32(key.encode()) % 20 if damaged else 99
        if fate == 0:
            continue
        if fate == 1:
            text = ""
        if fate == 2:
            text = re.sub("[.!?]", "", text)
        if fate == 4:
            role = "user"
        lines += [(turn is not None, turn or 0, role, hashlib.sha256(text.encode()).digest(), text)] * (2 if fate == 3 else 1)
    result = {}
    for conv, lines in out.items():
        lines.sort()
        seen, marked, counts = set(), [], {"blank": 0, "duplicate": 0, "truncated": 0}
        for _, _, role, _, text in lines:
            visible = re.sub(r"[\x20\x09-\x0D]", "", text)
            fault = "blank" if not visible else "duplicate" if (role, text) in seen else "truncated" if visible[-1] not in ".!?" else None
            seen.add((role, text))
            if fault:
                counts[fault] += 1
            marked.append((role, fault in ("blank", "duplicate"), fault == "truncated", text))
        turns = {x[1] for x in lines if x[0]}
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(lines, lines[1:]))
        cost, audit, kept = by_table(marked)
        result[conv] = (gaps, *counts.values(), illegal, cost, audit, hashlib.sha256("\n".join(kept).encode()).hexdigest())
    return result


def symbol(role, gone, cut):
    letter = role[:1] if role[:1] in ("s", "u", "a") else "x"
    return "d" if gone else letter.upper() if cut else letter


def some_rows(rng, n):
    return [(rng.choice(["system", "user", "assistant", "tool"]), rng.random() < 0.2, rng.random() < 0.25) for _ in range(n)]


def test_searches_against_everything_tried():
    rng = random.Random(1)
    for n in (1, 1, 2, 2, 2, 3, 3, 3, 3, 3):
        rows = some_rows(rng, n)
        assert repair.whole_path("".join(symbol(*r) for r in rows)) == by_hand(rows), rows


@pytest.mark.parametrize("block", [1, 2, 5, 512])
def test_searches_against_a_table(block):
    rng = random.Random(block)
    for _ in range(150):
        rows = some_rows(rng, rng.randint(0, 30))
        want = by_table([(*r, "") for r in rows])[:2]
        assert repair.whole_path("".join(symbol(*r) for r in rows), block) == want, rows


def test_one_of_equally_cheap_audits():
    # a lone assistant: delete it (2), not change it and add another (1 + 5)
    assert repair.whole_path("a") == (2, "D")
    # two users: one goes, the first by the alphabet
    assert repair.whole_path("uua") == (2, "DKK")
    assert repair.whole_path("") == (0, "")


def history(seed, convs=14, most=40):
    rng = random.Random(seed)
    rows = []
    for conv in range(convs):
        for turn in range(rng.randint(1, most)):
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None])
            text = rng.choice(["Yes.", "No!", "who", " \n", "", None, f"line {turn}.", f"cut {turn}", "Ends. \r\n"])
            rows.append((conv, rng.choice([turn, turn, turn + 2, None]), role, text))
    rows += [(None, 1, "user", "no id."), (None, 2, "assistant", "none."), (None, None, "user", "x")]
    return rows + rows[3:9]


def table(spark, rows):
    return spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA).repartition(3)


@pytest.mark.parametrize("slice_rows,block", [(50_000, 512), (6, 512), (5, 3)])
def test_damage_and_repair(spark, slice_rows, block):
    rows = history(3)
    got = repair.repaired_digests(table(spark, rows), slice_rows=slice_rows, block=block)
    assert got.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    assert {r[0]: tuple(r)[1:] for r in got.collect()} == {c: tuple(v) for c, v in expected(rows).items()}


def test_one_long_conversation_in_slices(spark):
    rng = random.Random(9)
    rows = [(1, t, rng.choice(["user", "assistant"]), rng.choice(["Same.", "Same", f"Text {t}."])) for t in range(900)]
    rows += [(1, 5, "user", "Same.")] * 700 + [(2, 1, "user", "Short.")]
    got = repair.repaired_digests(table(spark, rows), slice_rows=100, block=64)
    assert {r[0]: tuple(r)[1:] for r in got.collect()} == {c: tuple(v) for c, v in expected(rows).items()}


def test_repaired_rows_and_their_edits(spark):
    rows = [(1, 0, "system", "Be kind."), (1, 1, "user", "Hi?"), (1, 2, "user", "Hi?"), (1, 3, "assistant", "Hello."), (1, 4, "assistant", "Well.")]
    lines = table(spark, rows)
    summary, edits = repair.repair(lines)
    assert summary.first().asDict() == {"conv": "1", "gaps": 0, "blank": 0, "duplicate": 1, "truncated": 0, "illegal": 2, "cost": 4, "audit": "KKDDK"}
    got = [tuple(r) for r in repair.repaired(lines, edits).orderBy("place").collect()]
    assert got == [("1", 0, "system", "Be kind.", "K"), ("1", 1, "user", "Hi?", "K"), ("1", 2, "assistant", "Well.", "K")]


def test_dropped_conversations_and_empty_table(spark):
    dropped = next(c for c in itertools.count(10) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    got = repair.repaired_digests(table(spark, [(dropped, 0, "user", "Gone.")]))
    assert [tuple(r) for r in got.collect()] == [(dropped, 0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest())]
    assert repair.repaired_digests(table(spark, [(1, 1, "user", "x")]).where("1=0")).count() == 0


def test_query_on_a_whole_table(spark):
    at = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{at}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = {r[0]: tuple(r)[1:] for r in repair.op12(spark, at).collect()}
    assert got == {c: tuple(v) for c, v in expected(rows).items()} | {c: (0,) * 6 + ("", hashlib.sha256().hexdigest()) for c in {r[0] for r in rows} - expected(rows).keys()}

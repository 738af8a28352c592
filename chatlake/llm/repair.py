"""Repair of the role order of conversations: cheapest edits by bidirectional Dijkstra over the edit lattice.

Faults. A row is blank (nothing but ASCII white space), else a duplicate (its role and text stood earlier in the
conversation), else truncated (its last visible character is none of ``.!?``); the first that holds counts.

Lattice. A node is (rows used up, state); the state is what the kept rows end with: nothing (0), a system row (1), a user
row (2) or an assistant row (3). Edges use up a row (Keep 0, Rerole 1, Delete 2; 5 more for a truncated row that
stays) or add one (Insert 5). Blank rows and duplicates have a Delete edge only. What may be added, or a row may be made,
is settled by the state: an assistant after a user, else a user. A whole conversation starts in state 0 and ends in
0 or 3.

Search. One heap runs forward from the start, one backward from the end, each by (cost, rows, audit), the audit being
the edits' initials; so every node is settled with its least cost and, of equal costs, its ASCII-least audit. (No audit
of two equally cheap ways to a node begins the other: the rest would be inserts, which cost.) The heaps have met
when their least costs together exceed the best crossing; up to there every equally cheap crossing edge, from a node
settled forward to one settled backward, is looked at, and the least audit of both parts together wins.

Scale. Rows are counted by (conversation, turn, role, digest of text) first, so repeats cost one row; duplicates
are told by a second count and a join, both on keys with the digest. Texts meet nothing before the repaired rows
are put out. Conversations are taken in runs of at most ``BLOCK`` rows: of each run the cheapest edits for every
pair of states at its ends, joined run after run. Conversations of over ``slice_rows`` rows are cut into slices by a
range partitioning and solved slice by slice in different tasks; then one row per slice gives the states between them. A
task holds one slice without texts. A digest of a whole repaired conversation has to see its rows one after
the other; it is made from a sorted stream, which holds one row at a time.

Cases. Null role or text is one space; null turns come first; a null conversation id is a conversation. Rows of
equal turn are ordered by role, then by the digest of the text, repeats beside each other. An empty table gives an empty
result. Columns other than those named do not matter.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from heapq import heappop, heappush

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chatlake.llm.common import query, spark_schema, table
from chatlake.plans.ordered import Ordered
from chatlake.session import durable

BLANKS = " \t\n\x0b\f\r"
BLOCK = 512
SLICE_ROWS = 50_000
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
ORDER = ["has_turn", "turn", "role", "digest"]

#: The state that an added or changed row leads to.
_TARGET = (2, 2, 3, 2)
_NAME = {2: "user", 3: "assistant"}
_KEPT = {"s": {0: 1}, "u": {0: 2, 1: 2, 3: 2}, "a": {2: 3}}
_LEGAL = ("su", "ua", "au")


def _edges(symbol: str) -> list[list[tuple[str, int, int]]]:
    """(initial, cost, next state) of the edges that use up a row, by state."""
    out = []
    for state in range(4):
        here = [("D", DELETE, state)]
        if symbol != "d":
            more = TRUNCATED if symbol.isupper() else 0
            kept = _KEPT.get(symbol.lower(), {}).get(state)
            if kept is not None:
                here.append(("K", KEEP + more, kept))
            if kept != _TARGET[state]:
                here.append(("R", REROLE + more, _TARGET[state]))
        out.append(here)
    return out


#: By symbol: initial of the role (other: x), in capitals if truncated, or d for a row that has to go.
AHEAD = {symbol: _edges(symbol) for symbol in "suaxSUAXd"}
BACK = {
    symbol: [[(letter, cost, a) for a in range(4) for letter, cost, b in edges[a] if b == state] for state in range(4)]
    for symbol, edges in AHEAD.items()
}
_INSERTED = [[a for a in range(4) if _TARGET[a] == state] for state in range(4)]


def least_path(symbols: str, entry: int, exits: tuple[int, ...]) -> tuple[int, str] | None:
    """(cost, audit) of the cheapest edits of at least one row from state ``entry`` to one of ``exits``, ASCII-least of equals."""
    n = len(symbols)
    ahead, back = [(0, 0, "", entry)], [(0, 0, "", s) for s in exits]
    done: dict[tuple[int, int], tuple[int, str]] = {}
    done_back: dict[tuple[int, int], tuple[int, str]] = {}
    best: tuple[int, str] | None = None
    while ahead or back:
        if best is not None and (ahead[0][0] if ahead else 0) + (back[0][0] if back else 0) > best[0]:
            break
        if ahead and (not back or ahead[0][:2] <= back[0][:2]):
            cost, used, audit, state = heappop(ahead)
            if (used, state) in done:
                continue
            done[used, state] = cost, audit
            steps = [("I", INSERT, used, _TARGET[state])]
            if used < n:
                steps += [(letter, c, used + 1, s) for letter, c, s in AHEAD[symbols[used]][state]]
            for letter, c, to, s in steps:
                met = done_back.get((to, s))
                if met is not None:
                    whole = cost + c + met[0], audit + letter + met[1]
                    if best is None or whole < best:
                        best = whole
                if (to, s) not in done:
                    heappush(ahead, (cost + c, to, audit + letter, s))
        else:
            cost, left, audit, state = heappop(back)
            at = n - left
            if (at, state) in done_back:
                continue
            done_back[at, state] = cost, audit
            steps = [("I", INSERT, at, s) for s in _INSERTED[state]]
            if at:
                steps += [(letter, c, at - 1, s) for letter, c, s in BACK[symbols[at - 1]][state]]
            for letter, c, origin, s in steps:
                met = done.get((origin, s))
                if met is not None:
                    whole = met[0] + c + cost, met[1] + letter + audit
                    if best is None or whole < best:
                        best = whole
                if (origin, s) not in done_back:
                    heappush(back, (cost + c, n - origin, letter + audit, s))
    return best


def extend(ways: dict[int, tuple[int, str]], pieces: dict[tuple[int, int], tuple[int, str]]) -> dict[int, tuple[int, str]]:
    """The cheapest ways on to each state after a further run, ASCII-least of equals."""
    out: dict[int, tuple[int, str]] = {}
    for (a, b), (cost, audit) in pieces.items():
        if a in ways:
            whole = ways[a][0] + cost, ways[a][1] + audit
            if b not in out or whole < out[b]:
                out[b] = whole
    return out


def blocks(symbols: str, block: int) -> Iterator[dict[tuple[int, int], tuple[int, str]]]:
    """The cheapest edits of each run of rows for every pair of states at its ends."""
    for at in range(0, len(symbols), block):
        run = symbols[at : at + block]
        found = {(a, b): least_path(run, a, (b,)) for a in range(4) for b in range(4) if b >= min(a, 2)}
        yield {k: v for k, v in found.items() if v is not None}


def whole_path(symbols: str, block: int = BLOCK) -> tuple[int, str]:
    """(cost, audit) of the edits of a conversation."""
    if not symbols:
        return 0, ""
    if len(symbols) <= block:
        return least_path(symbols, 0, (0, 3))
    ways = {0: (0, "")}
    for pieces in blocks(symbols, block):
        ways = extend(ways, pieces)
    return min(ways[s] for s in (0, 3) if s in ways)


def spread_audit(audit: str, state: int, symbols: list[str], counts: list[int]) -> tuple[list[str], int]:
    """The edits of each group of equal rows, each insert and rerole followed by the initial it leads to; the state at the end."""
    out, at = [], 0
    for k, n in enumerate(counts):
        edits, left = [], n
        while at < len(audit) and (left or (k == len(counts) - 1)):
            letter = audit[at]
            at += 1
            left -= letter != "I"
            if letter in "IR":
                state = _TARGET[state]
                letter += _NAME[state][0]
            elif letter == "K":
                state = _KEPT[symbols[k].lower()][state]
            edits.append(letter)
        out.append("".join(edits))
    return out, state


def named(rows: DataFrame) -> DataFrame:
    """conv (the id as text, a space if null), has_turn, turn, role, text, digest; nothing null but turn."""
    role, text = F.coalesce(rows["role"].cast("string"), F.lit(" ")), F.coalesce(rows["text"].cast("string"), F.lit(" "))
    return rows.select(
        F.coalesce(rows["conv_id"].cast("string"), F.lit(" ")).alias("conv"),
        rows["turn"].isNotNull().alias("has_turn"),
        rows["turn"].cast("long").alias("turn"),
        role.alias("role"),
        text.alias("text"),
        F.unhex(F.sha2(text.cast("binary"), 256)).alias("digest"),
    )


def groups(lines: DataFrame) -> DataFrame:
    """One row per (conv, turn, role, digest) with the number of its rows, blank, truncated, and first: nothing equal before."""
    seen = F.rtrim(F.col("text"), F.lit(BLANKS))
    counted = durable(
        lines.withColumns({"blank": seen == "", "truncated": ~F.right(seen, F.lit(1)).isin(".", "!", "?")})
        .groupBy("conv", *ORDER)
        .agg(F.count(F.lit(1)).alias("n"), F.first("blank").alias("blank"), F.first("truncated").alias("truncated"))
    )
    first = counted.groupBy("conv", "role", "digest").agg(F.min(F.struct("has_turn", "turn")).alias("t"))
    first = first.select(
        F.col("conv").alias("_conv"), F.col("t.has_turn").alias("_has_turn"), F.col("t.turn").alias("_turn"), F.col("role").alias("_role"), F.col("digest").alias("_digest")
    )
    same = F.expr("conv = _conv AND has_turn = _has_turn AND turn <=> _turn AND role = _role AND digest = _digest")
    return counted.join(first, same, "left").withColumn("first", F.col("_conv").isNotNull()).drop(*first.columns)


def _symbol(role: str, blank: bool, truncated: bool, first: bool, n: int) -> str:
    if blank or not first:
        return "d" * n
    letter = role[:1] if role[:1] in ("s", "u", "a") else "x"
    return (letter.upper() if truncated else letter) + "d" * (n - 1)


SUMMARY = "least long, most long, turns long, blank long, duplicate long, truncated long, illegal long, opening string, closing string"
SOLVED = (
    f"conv string, slice int, {SUMMARY}, cost long, audit string, pieces array<struct<a: int, b: int, cost: long, audit: string>>, "
    "rows array<struct<has_turn: boolean, turn: bigint, role: string, digest: binary, symbol: string, n: bigint>>, edits array<string>"
)


def _tally(rows: list[tuple]) -> dict:
    """Counts of one slice; rows are (has_turn, turn, role, digest, n, blank, truncated, first) in order."""
    turns = [r[1] for r in rows if r[0]]
    pairs = [(a[2][:1] + b[2][:1], 1) for a, b in zip(rows, rows[1:])] + [(r[2][:1] * 2, r[4] - 1) for r in rows]
    return {
        "least": turns[0] if turns else None,
        "most": turns[-1] if turns else None,
        "turns": len(set(turns)),
        "blank": sum(r[4] for r in rows if r[5]),
        "duplicate": sum(r[4] - r[7] for r in rows if not r[5]),
        "truncated": sum(1 for r in rows if not r[5] and r[7] and r[6]),
        "illegal": sum(k for pair, k in pairs if pair not in _LEGAL),
        "opening": rows[0][2][:1],
        "closing": rows[-1][2][:1],
    }


def _solve(conv: str, number: int, rows: list[tuple], block: int) -> dict:
    symbols = [_symbol(r[2], r[5], r[6], r[7], r[4]) for r in rows]
    line = "".join(symbols)
    out = {"conv": conv, "slice": number} | _tally(rows)
    out["rows"] = [dict(zip(("has_turn", "turn", "role", "digest", "symbol", "n"), (*r[:4], s[:1], r[4]))) for r, s in zip(rows, symbols)]
    if number < 0:
        out["cost"], out["audit"] = whole_path(line, block)
        out["edits"] = spread_audit(out["audit"], 0, [s[:1] for s in symbols], [r[4] for r in rows])[0]
    else:
        ends = {a: {a: (0, "")} for a in range(4)}
        for pieces in blocks(line, block):
            ends = {a: extend(ways, pieces) for a, ways in ends.items()}
        out["pieces"] = [{"a": a, "b": b, "cost": c, "audit": t} for a, ways in ends.items() for b, (c, t) in ways.items()]
    return out


def solved(kinds: DataFrame, slice_rows: int = SLICE_ROWS, block: int = BLOCK) -> DataFrame:
    """One row per slice (a whole conversation where slice is -1), see SOLVED."""
    ordered = Ordered(kinds, ["conv"], ORDER, slice_rows)
    rows = ordered.df.repartition("conv", "_slice").sortWithinPartitions("conv", "_slice", *ORDER)
    schema = spark_schema(kinds.sparkSession, SOLVED)

    def run(batches):
        at, held = None, []

        def flush():
            return pa.RecordBatch.from_pylist([_solve(*at, held, block)], schema=schema)

        for batch in batches:
            done = []
            for conv, number, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (conv, number) != at:
                    if at is not None:
                        done.append(_solve(*at, held, block))
                    at, held = (conv, number), []
                held.append(tuple(row))
            yield pa.RecordBatch.from_pylist(done, schema=schema)
        if at is not None:
            yield flush()

    return rows.select("conv", "_slice", *ORDER, "n", "blank", "truncated", "first").mapInArrow(run, SOLVED)


JOINED = f"conv string, {SUMMARY}, cost long, audit string, slice int, a int, b int"


def _fold(batches):
    """Slices of a conversation in order: a row with the whole conversation (slice null), and the states at each slice's ends."""
    schema = _JOINED_SCHEMA
    at, ways, steps, total = None, {}, [], {}

    def flush():
        cost, audit = min(ways[s] for s in (0, 3) if s in ways)
        state = next(s for s in (0, 3) if s in ways and ways[s] == (cost, audit))
        rows = [total | {"cost": cost, "audit": audit}]
        for number, came in reversed(steps):
            rows.append({"conv": at, "slice": number, "a": came[state], "b": state})
            state = came[state]
        return pa.RecordBatch.from_pylist(rows, schema=schema)

    for batch in batches:
        for row in batch.to_pylist():
            if row["conv"] != at:
                if at is not None:
                    yield flush()
                at, ways, steps, total = row["conv"], {0: (0, "")}, [], None
            out, came = {}, {}
            for p in row["pieces"]:
                if p["a"] in ways:
                    whole = ways[p["a"]][0] + p["cost"], ways[p["a"]][1] + p["audit"]
                    if p["b"] not in out or whole < out[p["b"]]:
                        out[p["b"]], came[p["b"]] = whole, p["a"]
            ways = out
            steps.append((row["slice"], came))
            total = _added(total, row)
    if at is not None:
        yield flush()


_COUNTS = ("blank", "duplicate", "truncated", "illegal", "turns")
_JOINED_SCHEMA = pa.schema(
    [("conv", pa.string()), ("least", pa.int64()), ("most", pa.int64())]
    + [(c, pa.int64()) for c in ("turns", "blank", "duplicate", "truncated", "illegal")]
    + [("opening", pa.string()), ("closing", pa.string()), ("cost", pa.int64()), ("audit", pa.string())]
    + [(c, pa.int32()) for c in ("slice", "a", "b")]
)


def _added(total: dict | None, row: dict) -> dict:
    """The counts of a conversation so far and those of its next slice."""
    new = {k: row[k] for k in ("conv", "least", "most", "opening", "closing", *_COUNTS)}
    if total is None:
        return new
    new |= {c: total[c] + row[c] for c in _COUNTS}
    new["illegal"] += total["closing"] + row["opening"] not in _LEGAL
    new["opening"] = total["opening"]
    if total["most"] is not None:
        new["turns"] -= total["most"] == row["least"]
        new["least"] = total["least"]
        new["most"] = total["most"] if row["most"] is None else row["most"]
    return new


def repair(rows: DataFrame, slice_rows: int = SLICE_ROWS, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """(conversations, edits) of a table with conv_id, turn, role and text.

    conversations: conv, gaps, blank, duplicate, truncated, illegal, cost, audit. edits: conv, has_turn, turn, role,
    digest and the edits of these equal rows, such as ``IuKD``: initials, insert and rerole followed by that of the role.
    """
    made = durable(solved(groups(named(rows)), slice_rows, block))
    plain = made.where("slice < 0")
    sliced = made.where("slice >= 0")
    # rows of slices without a conversation of that size: an empty table, and so are the two below
    run = sliced.select("conv", "slice", *[c.split()[0] for c in SUMMARY.split(", ")], "pieces")
    folded = durable(run.repartition("conv").sortWithinPartitions("conv", "slice").mapInArrow(_fold, JOINED))
    summary = plain.unionByName(folded.where("slice IS NULL"), allowMissingColumns=True).select(
        "conv",
        F.when(F.col("turns") > 0, F.col("most") - F.col("least") + 1 - F.col("turns")).otherwise(F.lit(0)).cast("long").alias("gaps"),
        "blank",
        "duplicate",
        "truncated",
        "illegal",
        "cost",
        "audit",
    )
    picked = folded.where("slice IS NOT NULL").select("conv", "slice", "a", "b")
    pieces = sliced.join(picked, ["conv", "slice"]).select(
        "conv", "rows", F.col("a").alias("state"), F.filter("pieces", lambda p: (p["a"] == F.col("a")) & (p["b"] == F.col("b")))[0]["audit"].alias("audit")
    )
    fields = spark_schema(rows.sparkSession, SOLVED)
    shape = pa.schema([("conv", pa.string()), fields.field("rows"), fields.field("edits")])

    def walk(batches):
        for batch in batches:
            for row in batch.to_pylist():
                got = row["rows"]
                edits, _ = spread_audit(row["audit"], row["state"], [r["symbol"] for r in got], [r["n"] for r in got])
                yield pa.RecordBatch.from_pylist([{"conv": row["conv"], "rows": got, "edits": edits}], schema=shape)

    rows_type = SOLVED[SOLVED.index("rows array") : SOLVED.index(", edits")]
    late = pieces.mapInArrow(walk, f"conv string, {rows_type}, edits array<string>")
    every = plain.select("conv", "rows", "edits").unionByName(late)
    one = every.select("conv", F.explode(F.arrays_zip("rows", "edits")).alias("e"))
    edits = one.select("conv", *[f"e.rows.{c}" for c in ORDER], F.col("e.edits").alias("edits"))
    return summary, edits


REPAIRED = "conv string, place long, role string, text string, edit string"


def repaired(rows: DataFrame, edits: DataFrame) -> DataFrame:
    """The conversations after their edits, see REPAIRED; each conversation in one partition, in order of place."""
    lines = named(rows)
    empty = F.lit(None).cast("string")
    events = edits.select("conv", *ORDER, F.lit(False).alias("line"), empty.alias("text"), "edits").unionByName(
        lines.select("conv", *ORDER, F.lit(True).alias("line"), "text", empty.alias("edits"))
    )
    ordered = events.repartition("conv").sortWithinPartitions("conv", *ORDER, "line")
    schema = spark_schema(rows.sparkSession, REPAIRED)

    def run(batches):
        at, place, waiting = None, 0, None
        for batch in batches:
            out = []
            for conv, role, line, text, plan in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if conv != at:
                    at, place = conv, 0
                if line and waiting is None:
                    continue  # a further one of equal rows
                todo, waiting = waiting if line else plan, None
                k = 0
                while k < len(todo):
                    letter = todo[k]
                    if letter in "KR" and not line:
                        waiting = todo[k:]
                        break
                    k += 1
                    if letter in "IR":
                        named_role = "user" if todo[k] == "u" else "assistant"
                        k += 1
                    if letter != "D":
                        out.append((conv, place, role if letter == "K" else named_role, "" if letter == "I" else text, letter))
                        place += 1
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], f.type) for k, f in enumerate(schema)], schema=schema)

    return ordered.select("conv", "role", "line", "text", "edits").mapInArrow(run, REPAIRED)


def digests(lines: DataFrame) -> DataFrame:
    """(conv, repaired_sha256) of what ``repaired`` gave: SHA-256 of the ``role:text`` joined by newlines, made row by row."""
    schema = spark_schema(lines.sparkSession, "conv string, repaired_sha256 string")

    def run(batches):
        at, state = None, None
        for batch in batches:
            done = []
            for conv, role, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if conv != at:
                    if at is not None:
                        done.append({"conv": at, "repaired_sha256": state.hexdigest()})
                    at, state = conv, hashlib.sha256()
                else:
                    state.update(b"\n")
                state.update(f"{role}:{text}".encode())
            yield pa.RecordBatch.from_pylist(done, schema=schema)
        if at is not None:
            yield pa.RecordBatch.from_pylist([{"conv": at, "repaired_sha256": state.hexdigest()}], schema=schema)

    return lines.select("conv", "role", "text").mapInArrow(run, "conv string, repaired_sha256 string")


def fate(conv_id: Column, turn: Column) -> Column:
    """What the registered query does to a row, from 0 to 19; 5 and above: nothing."""
    one = F.lit(" ")
    key = F.concat(F.coalesce(conv_id.cast("string"), one), F.lit(":"), F.coalesce(turn.cast("string"), one))
    return F.crc32(key.cast("binary")) % 20


def damage(rows: DataFrame) -> DataFrame:
    """The rows with planted faults: 0 dropped, 1 emptied, 2 without ``.!?``, 3 twice, 4 said by the user."""
    role, text = F.coalesce(rows["role"].cast("string"), F.lit(" ")), F.coalesce(rows["text"].cast("string"), F.lit(" "))
    marked = rows.select(rows["conv_id"], rows["turn"], role.alias("role"), text.alias("text"), fate(rows["conv_id"], rows["turn"]).alias("fate"))
    return marked.where("fate <> 0").select(
        "conv_id",
        "turn",
        F.when(F.col("fate") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("fate") == 1, "").when(F.col("fate") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")).alias("text"),
        F.explode(F.when(F.col("fate") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"),
    )


def repaired_digests(conversations: DataFrame, **options) -> DataFrame:
    """One row per conversation id: the counts, cheapest edits and digest of its damaged rows after repair."""
    rows = damage(conversations)
    summary, edits = repair(rows, **options)
    hashes = digests(repaired(rows, edits))
    ids = conversations.select(conversations["conv_id"].cast("long").alias("conv_id")).distinct()
    ids = ids.withColumn("conv", F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")))
    counts = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    return ids.join(summary, "conv", "left").join(hashes, "conv", "left").select(
        "conv_id",
        *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in counts),
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"),
    )


@query("op12_conversation_repair")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repaired_digests(table(spark, sf_dir, "conversations"))

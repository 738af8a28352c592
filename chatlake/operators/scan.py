"""Keyword search of a history that has no stored index: texts are read in a few passes, nothing of them is shuffled.

The lists are those of ``keyword``. Queries come in blocks of ``QUERIES_AT_ONCE``; a block's search terms and filters are
known to every task, so a text's terms, weights and scores are worked out where the text is. The first pass counts the
messages of each term, the second keeps the best of each query and task and scores what is looked up, the third counts
what is better than the looked-up matches. What leaves a task are counts of terms, the best of each query, and counts.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chatlake.functions import kinds, splitting
from chatlake.operators import filters, querytable
from chatlake.operators.keyword import (
    B, DAY_MICROS, K1, MIN_IDF, RECENCY_DAYS, RECENCY_FLOOR, RELAX_BELOW, KeywordLists, _all_ranked,
)
from chatlake.plans.ordered import BROADCAST_ROWS, top_per_group
from chatlake.session import durable, spread

QUERIES_AT_ONCE = 512
CELLS = 1 << 20
"""Counts (search terms x messages) that a task holds at once (8 MB), as far as one message allows."""
MOST_ROWS = 1024
STRICT, RELAXED = 0, 1


class _Block:
    """A block of queries as arrays: their terms as distinct atoms, what is excluded, and filters."""

    def __init__(self, queries: list, terms: list, excluded: list, flags: list):
        number = {q: i for i, q in enumerate(queries)}
        atoms: dict[tuple, int] = {}
        at = lambda mode, tokens: atoms.setdefault((mode, tuple(tokens)), len(atoms))
        self.n = len(queries)
        self.cells = {STRICT: [], RELAXED: []}
        for r in terms:
            self.cells[STRICT if r["plan"] == "strict" else RELAXED].append((number[r["query_id"]], at(r["mode"], r["tokens"])))
        self.banned = [(number[r["query_id"]], at("exact", [r["term"]])) for r in excluded]
        self.atoms, self.names = len(atoms), list(atoms)
        self.single: dict[int, tuple] = {}  # prefixes by length, 0: whole tokens
        for (mode, tokens), i in atoms.items():
            if mode != "phrase":
                self.single.setdefault(len(tokens[0]) if mode == "prefix" else 0, ([], []))
                names, places = self.single[len(tokens[0]) if mode == "prefix" else 0]
                names.append(tokens[0])
                places.append(i)
        self.phrases = [(i, tokens) for (mode, tokens), i in atoms.items() if mode == "phrase"]
        self.groups = np.bincount([q for q, _ in self.cells[STRICT]], minlength=self.n) if self.cells[STRICT] else np.zeros(self.n, int)
        self.known = np.zeros(self.n, bool)
        self.has_from, self.me, self.has_chat, self.link = (np.zeros(self.n, bool) for _ in range(4))
        self.any_kind, self.need = np.zeros(self.n, bool), np.zeros(self.n, np.int64)
        self.after, self.before = np.full(self.n, -(2**63)), np.full(self.n, 2**63 - 1)
        self.dated = np.zeros(self.n, bool)
        for r in flags:
            i = number.get(r["query_id"])
            if i is None:
                continue
            self.known[i], self.has_from[i], self.me[i], self.has_chat[i] = True, r["has_from"], r["from_me_too"], r["has_chat"]
            self.link[i], self.any_kind[i] = "link" in r["has"], "attachment" in r["has"]
            self.need[i] = sum(1 << kind for name, kind in filters.HAS_KINDS.items() if name in r["has"])
            self.dated[i] = r["_after"] is not None or r["_before"] is not None
            self.after[i] = self.after[i] if r["_after"] is None else r["_after"]
            self.before[i] = self.before[i] if r["_before"] is None else r["_before"]

    def matrix(self, cells: list, kind) -> np.ndarray:
        out = np.zeros((self.n, max(self.atoms, 1)), kind)
        if cells:
            q, a = np.array(cells).T
            np.add.at(out, (q, a), 1)
        return out


class _Task:
    """Works through a task's messages, a few at a time."""

    def __init__(self, block: _Block, idf: np.ndarray | None = None, average: float = 1.0, newest: int | None = None, few: np.ndarray | None = None, all_words: bool = True):
        self.b, self.average, self.newest, self.all_words = block, average, newest, all_words
        self.single = {size: (pa.array(names, pa.large_string()), np.array(at)) for size, (names, at) in block.single.items()}
        self.counted = block.matrix(block.cells[STRICT], np.float32)
        self.banned = block.matrix(block.banned, np.float32) if block.banned else None
        if idf is not None:
            self.strict = block.matrix(block.cells[STRICT], np.float64) * idf
            self.few = np.flatnonzero(few)
            self.relaxed = block.matrix(block.cells[RELAXED], np.float64)[self.few] * idf

    def parts(self, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        """(rows, number of tokens of each, atoms that occur, how often in each row)."""
        size = max(1, min(MOST_ROWS, CELLS // max(self.b.atoms, 1)))
        for batch in batches:
            for at in range(0, batch.num_rows, size):
                part = batch.slice(at, size)
                part, words, n = splitting.words(part)
                yield part, n, *self._occurrences(words, n)

    def _occurrences(self, words: pa.Array, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        rows, nothing = len(n), np.zeros(0, np.int64)
        if not len(words) or not self.b.atoms:
            return nothing, np.zeros((0, rows))
        coded = words.dictionary_encode()
        names, codes = coded.dictionary, coded.indices.to_numpy().astype(np.int64)
        row = np.repeat(np.arange(rows), n)
        which, whose = [], []
        for size, (tokens, at) in self.single.items():
            found = pc.index_in(pc.utf8_slice_codeunits(names, 0, size) if size else names, tokens)
            term = np.flatnonzero(found.is_valid().to_numpy(zero_copy_only=False))
            which.append(term)
            whose.append(at[found.drop_null().to_numpy().astype(np.int64)])
        which, whose = np.concatenate(which or [nothing]), np.concatenate(whose or [nothing])
        order = np.argsort(which, kind="stable")
        which, whose = which[order], whose[order]
        first = np.searchsorted(which, np.arange(len(names) + 1))
        wide = np.diff(first)
        kept = np.flatnonzero(wide[codes] > 0)
        times = wide[codes[kept]]
        inner = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
        atom, where = [whose[np.repeat(first[codes[kept]], times) + inner]], [np.repeat(row[kept], times)]
        for i, tokens in self.b.phrases:
            wanted = pc.index_in(pa.array(tokens, pa.large_string()), names)
            if wanted.null_count:
                continue
            wanted = wanted.to_numpy()
            start = np.flatnonzero(codes == wanted[0])
            start = start[start + len(wanted) <= len(codes)]
            for k, c in enumerate(wanted[1:], 1):
                start = start[(codes[start + k] == c) & (row[start + k] == row[start])]
            atom.append(np.full(len(start), i))
            where.append(row[start])
        atom, where = np.concatenate(atom), np.concatenate(where)
        present = np.unique(atom)
        count = np.bincount(np.searchsorted(present, atom) * rows + where, minlength=len(present) * rows)
        return present, count.reshape(len(present), rows).astype(np.float64)

    def passing(self, part: pa.RecordBatch, present: np.ndarray, count: np.ndarray) -> np.ndarray:
        """(queries, rows): text messages under the query's filters and without its excluded terms."""
        b = self.b
        column = lambda name: part.column(name).to_numpy(zero_copy_only=False)
        listed = lambda name: self._marked(part.column(name))
        me, mask = column("me"), column("mask").astype(np.int64)
        undated = part.column("ts").is_null().to_numpy(zero_copy_only=False)
        ts = pc.fill_null(part.column("ts"), 0).to_numpy()
        ok = b.known[:, None] & column("shown")[None, :]
        ok &= ~b.dated[:, None] | (~undated & (ts >= b.after[:, None]) & (ts < b.before[:, None]))
        ok &= ~b.link[:, None] | column("link")[None, :]
        ok &= (~b.any_kind[:, None] | (mask > 0)) & ((mask & b.need[:, None]) == b.need[:, None])
        if b.has_from.any():
            ok &= ~b.has_from[:, None] | (b.me[:, None] & (me == 1)) | (listed("people") & (me == 0))
        if b.has_chat.any():
            ok &= ~b.has_chat[:, None] | listed("chats")
        if self.banned is not None:
            ok &= ~(self.banned[:, present] @ (count > 0).astype(np.float32) > 0)
        return ok

    def _marked(self, lists: pa.Array) -> np.ndarray:
        out = np.zeros((self.b.n, len(lists)), bool)
        row = np.repeat(np.arange(len(lists)), pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        out[lists.flatten().to_numpy(), row] = True
        return out

    def whole(self, present: np.ndarray, count: np.ndarray) -> np.ndarray:
        """(queries, rows): messages that hold every group of the query."""
        held = self.counted[:, present] @ (count > 0).astype(np.float32)
        return (self.b.groups[:, None] > 0) & (held == self.b.groups[:, None])

    def scored(self, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        """(rows, plan, (queries, rows) of scores; -1: no match). Any-word matches leave out all-words ones."""
        for part, n, present, count in self.parts(batches):
            if not len(present):
                continue
            ok = self.passing(part, present, count)
            strict = self.whole(present, count) & ok
            weight = count * (K1 + 1) / (count + K1 * (1 - B + B * n / self.average))
            age = np.maximum((self.newest or 0) - pc.fill_null(part.column("ts"), self.newest or 0).to_numpy(), 0) / float(DAY_MICROS)
            fresh = RECENCY_FLOOR + (1 - RECENCY_FLOOR) * np.exp(-age / RECENCY_DAYS)
            some = np.flatnonzero(strict.any(axis=0))
            if len(some) and self.all_words:
                scores = np.round(self.strict[:, present] @ weight[:, some] * fresh[some], 9)
                yield part.take(pa.array(some)), STRICT, np.where(strict[:, some], scores, -1.0)
            if len(self.few):
                scores = self.relaxed[:, present] @ weight * fresh
                out = np.full(ok.shape, -1.0)
                out[self.few] = np.where((scores > 0) & ok[self.few] & ~strict[self.few], np.round(scores, 9), -1.0)
                yield part, RELAXED, out


_COUNTED = "what string, i int, n long"


def _count(block: _Block):
    """Pass one: messages of each atom, all-words matches of each query, messages, tokens, newest time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = _Task(block)
        df, found, messages, tokens, newest = np.zeros(block.atoms, np.int64), np.zeros(block.n, np.int64), 0, 0, None
        for part, n, present, count in task.parts(batches):
            messages, tokens = messages + part.num_rows, tokens + int(n.sum())
            last = pc.max(part.column("ts")).as_py()
            newest = last if newest is None else newest if last is None else max(newest, last)
            if len(present):
                df[present] += (count > 0).sum(axis=1)
                whole = task.whole(present, count)
                if whole.any():
                    found += (whole & task.passing(part, present, count)).sum(axis=1)
        rows = [("df", i, int(df[i])) for i in np.flatnonzero(df)] + [("found", i, int(found[i])) for i in np.flatnonzero(found)]
        rows += [("messages", 0, messages), ("tokens", 0, tokens), ("newest", 0, newest)]
        what, i, n = zip(*rows)
        yield pa.RecordBatch.from_arrays([pa.array(what), pa.array(i, pa.int32()), pa.array(n, pa.int64())], names=["what", "i", "n"])

    return run


_FOUND = "plan int, q int, message_id long, score double, asked boolean"


def _best(make, k: int | None):
    """Pass two: the best ``k`` of each query and task (None: all), and all looked-up matches."""

    def batch(rows: list[tuple], asked: bool) -> pa.RecordBatch:
        plan, q, ids, scores = (np.concatenate(c) for c in zip(*rows))
        return pa.RecordBatch.from_arrays(
            [pa.array(plan.astype(np.int32)), pa.array(q.astype(np.int32)), pa.array(ids), pa.array(scores), pa.array(np.full(len(q), asked))],
            names=["plan", "q", "message_id", "score", "asked"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = make()
        floors, pool, held = np.zeros((2, task.b.n)), [], 0

        def prune() -> None:
            nonlocal pool, held
            plan, q, ids, scores = (np.concatenate(c) for c in zip(*pool))
            key = plan * task.b.n + q
            order = np.lexsort((-ids, -scores, key))
            key = key[order]
            first = np.searchsorted(key, key)
            kept = order[np.arange(len(key)) - first < k]
            pool, held = [(plan[kept], q[kept], ids[kept], scores[kept])], len(kept)
            sizes = np.bincount(key, minlength=2 * task.b.n)
            last = np.searchsorted(key, np.arange(2 * task.b.n)) + k - 1
            full = np.flatnonzero(sizes >= k)
            floors.reshape(-1)[full] = scores[order][last[full]]

        for part, plan, scores in task.scored(batches):
            ids = part.column("message_id").to_numpy()
            asked = part.column("asked")
            if asked.null_count < len(asked):
                q, row = np.nonzero(task._marked(asked) & (scores >= 0))
                if len(q):
                    yield batch([(np.full(len(q), plan), q, ids[row], scores[q, row])], True)
            q, row = np.nonzero(scores >= floors[plan][:, None])
            if not len(q):
                continue
            pool.append((np.full(len(q), plan), q, ids[row], scores[q, row]))
            held += len(q)
            if k is None:
                yield batch(pool, False)
                pool = []
            elif held > max(4 * k * task.b.n, 1 << 17):
                prune()
        if pool:
            prune()
            yield batch(pool, False)

    return run


_BETTER = "i int, n long"


def _better(make, keys: tuple[np.ndarray, ...]):
    """Pass three: for every looked-up match ``keys`` (plan, q, score, message_id) the number of better ones."""
    plans, queries, floor, ids_asked = keys

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = make()
        total = np.zeros(len(plans), np.int64)
        least = np.full((2, task.b.n), np.inf)
        np.minimum.at(least, (plans, queries), floor)
        for part, plan, scores in task.scored(batches):
            mine = np.flatnonzero(plans == plan)
            q, row = np.nonzero((scores >= 0) & (scores >= least[plan][:, None]))
            if not len(mine) or not len(q):
                continue
            ids = part.column("message_id").to_numpy()
            every = np.concatenate([q, queries[mine]])
            is_key = np.arange(len(every)) >= len(q)
            # a looked-up match meets itself: among equals it comes first, so that it does not count
            order = np.lexsort((~is_key, -np.concatenate([ids[row], ids_asked[mine]]), -np.concatenate([scores[q, row], floor[mine]]), every))
            seen = np.cumsum(~is_key[order])
            sorted_q = every[order]
            before = np.concatenate([[0], seen])[np.searchsorted(sorted_q, sorted_q)]
            at = np.flatnonzero(is_key[order])
            total[mine[order[at] - len(q)]] += seen[at] - before[at]
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(total[some])], names=["i", "n"])

    return run


def _rows(messages: DataFrame, resolved: filters.Resolved, numbers: DataFrame, looked_up: DataFrame | None) -> DataFrame:
    """Messages as the passes read them, with the queries that allow their chat and sender, or look them up."""
    rows = messages.select(
        F.col("message_id").cast("long").alias("message_id"), F.unix_micros("ts").alias("ts"), F.coalesce(F.col("kind") == kinds.TEXT, F.lit(False)).alias("shown"),
        F.coalesce(F.col("from_me").cast("int"), F.lit(-1)).alias("me"), F.coalesce("has_link", F.lit(False)).alias("link"),
        F.coalesce(F.col("kind_mask").cast("int"), F.lit(0)).alias("mask"), "chat_id", "handle_id", "text",
    )

    def whose(pairs: DataFrame, key: str, name: str) -> DataFrame:
        return pairs.join(F.broadcast(numbers), "query_id").groupBy(key).agg(F.collect_set("q").alias(name))

    for pairs, key, name in ((resolved.chats, "chat_id", "chats"), (resolved.people, "handle_id", "people")):
        found = durable(whose(pairs, key, name))
        n = found.count()
        rows = rows.join(F.broadcast(found) if n <= BROADCAST_ROWS else found, key, "left") if n else rows.withColumn(name, F.lit(None).cast("array<int>"))
    if looked_up is None:
        rows = rows.withColumn("asked", F.lit(None).cast("array<int>"))
    else:
        found = durable(whose(looked_up, "message_id", "asked"))
        rows = rows.join(F.broadcast(found) if found.count() <= BROADCAST_ROWS else found, "message_id", "left")
    return rows.select(
        "message_id", "ts", "shown", "me", "link", "mask", "chats", "people", "asked",
        *splitting.columns(F.col("text")),
    )


def _search_block(parsed: DataFrame, messages: DataFrame, resolved: filters.Resolved, k: int | None, relax_below: int, looked_up: DataFrame | None, all_words: bool):
    spark = parsed.sparkSession
    queries = sorted(r[0] for r in parsed.select("query_id").collect())
    kind = parsed.schema["query_id"].dataType.simpleString()
    numbers = spark.createDataFrame(list(zip(queries, range(len(queries)))), f"query_id {kind}, q int")
    terms = querytable.strict_terms(parsed).unionByName(querytable.relaxed_terms(parsed)).select("query_id", "plan", "mode", "tokens")
    flags = resolved.flags.join(F.broadcast(numbers.select("query_id")), "query_id", "left_semi")
    flags = flags.withColumns({"_after": F.unix_micros("after_ts"), "_before": F.unix_micros("before_ts")})
    said = terms.collect(), querytable.excluded_terms(parsed).collect(), flags.collect()
    block = _Block(queries, *said)
    rows = _rows(messages, resolved, numbers, looked_up)
    total = F.when(F.col("what") == "newest", F.max("n")).otherwise(F.sum("n")).alias("n")
    counts = rows.mapInArrow(_count(block), _COUNTED).groupBy("what", "i").agg(total).collect()
    figures = {r["what"]: r["n"] for r in counts if r["what"] in ("messages", "tokens", "newest")}
    df, found = np.zeros(block.atoms), np.zeros(block.n, np.int64)
    for r in counts:
        if r["what"] == "df":
            df[r["i"]] = r["n"]
        elif r["what"] == "found":
            found[r["i"]] = r["n"]
    n = figures.get("messages") or 0
    average = (figures.get("tokens") or 0) / n if n else 0.0
    ratio = (n - df + 0.5) / (df + 0.5)
    idf = np.where(ratio > 1, np.log(ratio), MIN_IDF)
    few = (found < relax_below) & (block.groups > 0)
    newest = figures.get("newest")
    if not all_words:  # the other queries have no any-word list, so the second pass leaves their terms alone
        queries = [queries[q] for q in np.flatnonzero(few)]
        if not queries:
            nothing = spark.createDataFrame([], f"query_id {kind}, message_id long, score double, rank long")
            return {STRICT: nothing, RELAXED: nothing}
        kept, known = set(queries), dict(zip(block.names, idf))
        block = _Block(queries, *([r for r in rows if r["query_id"] in kept] for rows in said))
        idf, few = np.array([known[x] for x in block.names]), np.ones(block.n, bool)
        numbers = spark.createDataFrame(list(zip(queries, range(len(queries)))), f"query_id {kind}, q int")
        rows = _rows(messages, resolved, numbers, looked_up)

    def make() -> _Task:
        return _Task(block, idf, average or 1.0, newest, few, all_words)

    hits = durable(rows.mapInArrow(_best(make, k), _FOUND)).join(F.broadcast(numbers), "q")
    if k is None:
        lists = hits.select("plan", "query_id", "message_id", "score")
        return {p: _all_ranked(lists.filter(F.col("plan") == p)) for p in (STRICT, RELAXED)}
    top = durable(top_per_group(hits.filter("NOT asked"), ["plan", "query_id"], [F.desc("score"), F.desc("message_id")], k))
    lists = top.select("plan", "query_id", "message_id", "score", "rank")
    deep = hits.filter("asked").join(top, ["plan", "query_id", "message_id"], "left_anti").select("plan", "q", "score", "message_id")
    keys = [] if looked_up is None else deep.collect()  # of a block of queries, near windows bound their number
    if keys:
        arrays = tuple(np.array([r[c] for r in keys], t) for c, t in (("plan", int), ("q", int), ("score", float), ("message_id", np.int64)))
        better = rows.mapInArrow(_better(make, arrays), _BETTER).groupBy("i").agg(F.sum("n").alias("n")).collect()
        ranks = {r["i"]: r["n"] + 1 for r in better}
        ranked = [(r["plan"], queries[r["q"]], r["message_id"], r["score"], ranks.get(i, 1)) for i, r in enumerate(keys)]
        lists = lists.unionByName(spark.createDataFrame(ranked, f"plan int, query_id {kind}, message_id long, score double, rank long"))
    return {p: lists.filter(F.col("plan") == p).drop("plan") for p in (STRICT, RELAXED)}


def keyword_search(
    parsed: DataFrame,
    messages: DataFrame,
    resolved: filters.Resolved,
    depth: int | None,
    relax_below: int = RELAX_BELOW,
    looked_up: DataFrame | None = None,
    all_words: bool = True,
) -> KeywordLists:
    """``keyword.keyword_search`` over messages without an index: the best ``depth`` of each list (None: whole lists), and
    what of ``looked_up`` is in it, all with ranks in the whole list. Without ``all_words`` only the any-word lists are
    made; the others are empty."""
    k = None if depth is None else max(depth, relax_below, 1)
    blocks = max(1, -(-parsed.count() // QUERIES_AT_ONCE))
    messages = spread(messages)
    made = [
        _search_block(parsed.filter(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == i), messages, resolved, k, relax_below, looked_up, all_words) for i in range(blocks)
    ]
    strict, relaxed = (reduce(DataFrame.unionByName, (m[p] for m in made)) for p in (STRICT, RELAXED))
    columns = ["query_id", "message_id", "score", "rank"]
    return KeywordLists(durable(strict.select(columns)), durable(relaxed.select(columns)))

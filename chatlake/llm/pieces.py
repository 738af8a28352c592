"""Encoding of texts piece by piece, each different piece once per Python worker.

A piece is what stands between two safe blanks; no pre-token reaches over one.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: A blank with no other white space beside it always starts a pre-token: white-space runs are the only pre-tokens that
#: hold white space after their first character, and this blank is in none. What follows does not look back over it.
_SAFE = re.compile(r"(?<=\S) (?=\S)")
_ODD_AFTER, _ODD_BEFORE = re.compile(r" \s"), re.compile(r"[^\S ] ")
_SIZE = 1 << 22


def regular(text: str) -> bool:
    """Are all of the text's blanks safe."""
    return not (text[:1].isspace() or text[-1:].isspace() or _ODD_AFTER.search(text) or _ODD_BEFORE.search(text))


class PieceMemo:
    """Encodes texts. ``encode_many`` encodes a list of strings, each to its ids as bytes, ``width`` of them an id;
    ``encode_words`` does the same for strings that each have a blank before them.

    The pieces of about four megabytes of texts are numbered by Arrow and looked up in an Arrow array of those met before;
    only new ones become Python strings and are encoded. The ids of all known pieces lie in one array, from which those of a
    text are gathered by number. Of more than ``limit`` pieces the half that was met last stays. Null texts are not
    allowed; an empty text is one empty piece.
    """

    def __init__(
        self,
        encode_many: Callable[[list[str]], list[bytes]],
        limit: int = 600_000,
        width: int = 4,
        encode_words: Callable[[list[str]], list[bytes]] | None = None,
    ):
        self.encode_many, self.limit = encode_many, limit
        self.encode_words = encode_words or (lambda words: encode_many([" " + w for w in words]))
        self.words = pa.array([], pa.string())
        self.ids = np.empty(0, np.dtype(f"<u{width}"))
        self.start, self.size, self.met = (np.empty(0, np.int64) for _ in range(3))
        self.turn = 0

    def encode(self, texts: Iterable[str]) -> list[bytes]:
        out: list[bytes] = []
        held: list[str] = []
        size = 0
        for text in texts:
            held.append(text)
            size += len(text)
            if size > _SIZE:
                out += self._flush(held)
                held, size = [], 0
        return out + self._flush(held) if held else out

    def _flush(self, held: list[str]) -> list[bytes]:
        plain = [k for k, text in enumerate(held) if regular(text)]
        odd = sorted(set(range(len(held))).difference(plain))
        lists = pc.split_pattern(pa.array([held[k] for k in plain], pa.string()), " ")
        if odd:
            lists = pa.concat_arrays([lists, pa.array([_SAFE.split(held[k]) for k in odd], lists.type)])
        edges = lists.offsets.to_numpy()
        flat = lists.flatten()
        heads = self.encode_many(flat.take(pa.array(edges[:-1])).to_pylist())
        coded = flat.dictionary_encode()
        number = self._look_up(coded.dictionary)[coded.indices.to_numpy()]
        each = self.size[number]
        each[edges[:-1]] = 0
        ends = np.cumsum(each)
        at = np.repeat(self.start[number] - (ends - each), each) + np.arange(int(ends[-1]))
        raw = self.ids[at].tobytes()
        cuts = (np.concatenate([[0], ends])[edges] * self.ids.itemsize).tolist()
        out: list[bytes] = [b""] * len(held)
        for k, head, a, z in zip(plain + odd, heads, cuts[:-1], cuts[1:], strict=True):
            out[k] = head + raw[a:z]
        if len(self.words) > self.limit:
            self._forget()
        return out

    def _look_up(self, words: pa.Array) -> np.ndarray:
        """The numbers of different words among the known ones, to which new ones are added."""
        number = pc.index_in(words, value_set=self.words).fill_null(-1).to_numpy().astype(np.int64)
        fresh = np.flatnonzero(number < 0)
        self.turn += 1
        if len(fresh):
            new = words.take(pa.array(fresh))
            coded = self.encode_words(new.to_pylist())
            size = np.fromiter(map(len, coded), np.int64, len(coded)) // self.ids.itemsize
            number[fresh] = len(self.words) + np.arange(len(fresh))
            self.words = pa.concat_arrays([self.words, new])
            self.start = np.concatenate([self.start, len(self.ids) + np.cumsum(size) - size])
            self.size = np.concatenate([self.size, size])
            self.met = np.concatenate([self.met, np.zeros(len(fresh), np.int64)])
            self.ids = np.concatenate([self.ids, np.frombuffer(b"".join(coded), self.ids.dtype)])
        self.met[number] = self.turn
        return number

    def _forget(self) -> None:
        kept = np.sort(np.argsort(-self.met, kind="stable")[: self.limit // 2])
        size = self.size[kept]
        ends = np.cumsum(size)
        self.ids = self.ids[np.repeat(self.start[kept] - (ends - size), size) + np.arange(int(ends[-1]) if len(ends) else 0)]
        self.words, self.start, self.size, self.met = self.words.take(pa.array(kept)), ends - size, size, self.met[kept]


def packed(ids: list[int]) -> bytes:
    return np.array(ids, "<u4").tobytes()

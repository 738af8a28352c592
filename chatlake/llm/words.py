"""Hashes of the words of many texts at once."""

from __future__ import annotations

import numpy as np

_BASE = 0x100000001B3
_MIX = np.uint64(0xD6E8FEB86659FD93)
_POWERS: dict[int, np.ndarray] = {}
#: Letters and digits of ASCII, and every byte beyond it.
WORD_BYTE = np.array([chr(b).isalnum() if b < 128 else True for b in range(256)])


def _series(factor: int, n: int) -> np.ndarray:
    have = _POWERS.get(factor)
    if have is None or len(have) < n:
        steps = np.full(max(n, 1 << 20), factor, np.uint64)
        steps[0] = 1
        have = _POWERS[factor] = np.cumprod(steps, dtype=np.uint64)
    return have[:n]


def word_hashes(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, start) of each word in the bytes."""
    n = len(raw)
    inside = WORD_BYTE[raw]
    edge = np.flatnonzero(np.diff(np.concatenate([[False], inside, [False]]).astype(np.int8)))
    first, stop = edge[::2], edge[1::2]
    sums = np.concatenate([[np.uint64(0)], np.cumsum(np.where(inside, (raw.astype(np.uint64) + np.uint64(1)) * _series(_BASE, n), np.uint64(0)))])
    code = (sums[stop] - sums[first]) * _series(pow(_BASE, -1, 1 << 64), n)[first] if len(first) else np.empty(0, np.uint64)
    code ^= code >> np.uint64(32)
    code *= _MIX
    code ^= code >> np.uint64(29)
    return code, first


def words_of(texts: list[str | None], block: int = 1 << 20) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the lower-cased words of all texts, one text after the other, and the texts' starts (one more at the end)."""
    hashes, counts, held, size = [], [], [], 0

    def flush():
        raw = np.frombuffer(b" ".join(held), np.uint8)
        code, first = word_hashes(raw)
        edges = np.cumsum([0] + [len(t) + 1 for t in held])
        counts.append(np.diff(np.searchsorted(first, edges)))
        hashes.append(code)

    for text in texts:
        one = (text or "").lower().encode()
        if held and size + len(one) > block:
            flush()
            held, size = [], 0
        held.append(one)
        size += len(one) + 1
    if held:
        flush()
    if not hashes:
        return np.empty(0, np.uint64), np.zeros(1, np.int64)
    return np.concatenate(hashes), np.concatenate([[0], np.cumsum(np.concatenate(counts))])

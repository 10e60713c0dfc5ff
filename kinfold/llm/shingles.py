"""Vectorised word and shingle hashing over the UTF-8 bytes of whole texts.

Words are runs of bytes outside 0x20 and 0x09-0x0D, with A-Z lower-cased; every other byte counts as it
is. A word's hash is a polynomial of its bytes modulo 2**64, mixed; a shingle's is a mix of its words'
hashes. Both are the same on every machine and in every run.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np

U = np.uint64
BASE = 0x9E3779B97F4A7C15
BLOCK = 1 << 20

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


class _Powers:
    """Powers of BASE modulo 2**64, extended as longer words come."""

    def __init__(self) -> None:
        self.table = np.ones(1, dtype=U)

    def upto(self, n: int) -> np.ndarray:
        if len(self.table) < n:
            more = np.full(max(n, 4096), BASE, dtype=U)
            more[0] = 1
            self.table = np.multiply.accumulate(more)
        return self.table


_powers = _Powers()


def word_hashes(data: bytes) -> np.ndarray:
    """One 64-bit hash for each word of data, in order; BLOCK bytes at a time, cut between words."""
    if len(data) <= BLOCK:
        return _block_hashes(data)[0]
    parts, at = [], 0
    while at < len(data):
        end = at + BLOCK
        while end < len(data) and not _SPACE[data[end]]:
            end += 1
        parts.append(_block_hashes(data[at:end])[0])
        at = end
    return np.concatenate(parts)


def _block_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and start offsets of the words of data."""
    raw = np.frombuffer(data, dtype=np.uint8)
    if not len(raw):
        return np.zeros(0, dtype=U), np.zeros(0, dtype=np.int64)
    inside = ~_SPACE[raw]
    edge = np.diff(inside.astype(np.int8), prepend=0, append=0)
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if not len(start):
        return np.zeros(0, dtype=U), start
    length = end - start
    within = np.arange(len(raw))
    within[start[0] :] -= np.repeat(start, np.diff(start, append=len(raw)))
    term = np.where(inside, (_LOWER[raw].astype(U) + U(1)) * _powers.upto(int(length.max()) + 1)[np.minimum(within, length.max())], U(0))
    return mix(np.add.reduceat(term, start) + length.astype(U) * U(0xD6E8FEB86659FD93)), start


def many_word_hashes(texts: Iterable[bytes]) -> Iterator[np.ndarray]:
    """word_hashes of each text; short texts are hashed together, BLOCK bytes at a time."""
    held: list[bytes] = []
    size = 0

    def flush() -> Iterator[np.ndarray]:
        if held:
            hashes, start = _block_hashes(b"\n".join(held))
            ends = np.cumsum([len(x) + 1 for x in held])
            yield from np.split(hashes, np.searchsorted(start, ends[:-1]))

    for text in texts:
        if len(text) > BLOCK // 4:
            yield from flush()
            held, size = [], 0
            yield word_hashes(text)
            continue
        held.append(text)
        size += len(text) + 1
        if size >= BLOCK:
            yield from flush()
            held, size = [], 0
    yield from flush()


def shingle_set(words: np.ndarray, k: int) -> np.ndarray:
    """Sorted distinct hashes of the k-word shingles; fewer words make one shingle; no words, none."""
    if not len(words):
        return words
    if len(words) < k:
        h = np.array([len(words)], dtype=U)
        for i in range(len(words)):
            h = mix(h * U(BASE) + words[i : i + 1])
        return h
    n = len(words) - k + 1
    h = words[:n].copy()
    for j in range(1, k):
        h = mix(h * U(BASE) + words[j : j + n])
    return np.unique(h)

"""Words of many texts at once, as 64-bit hashes in numpy arrays.

A word is a longest run of ASCII letters and digits and of all characters from
U+0080 on; hand in lower-cased texts where case does not count.
"""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

_FACTOR = 0x9E3779B97F4A7C15 | 1
_IN_WORD = np.array([chr(b).isascii() and chr(b).isalnum() or b >= 128 for b in range(256)])
_powers = np.ones(1, np.uint64), np.ones(1, np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that spreads every bit over all."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_LETTER = mix(np.arange(1, 257, dtype=np.uint64))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``n`` powers of the factor and of its inverse, modulo 2^64."""
    global _powers
    if len(_powers[0]) < n:
        made = []
        for base in (_FACTOR, pow(_FACTOR, -1, 1 << 64)):
            steps = np.full(n, base, np.uint64)
            steps[0] = 1
            made.append(np.multiply.accumulate(steps))
        _powers = tuple(made)
    return _powers


class Words:
    """Words of ``texts``: ``hash`` of each, and ``first``: words of text i are first[i] to first[i + 1]."""

    def __init__(self, texts: pa.Array):
        data, self.ends = _bytes(texts)
        inside = np.empty(len(data) + 1, bool)
        inside[:-1], inside[-1] = _IN_WORD[data], False
        fresh = np.zeros(len(data) + 1, bool)
        fresh[self.ends[:-1]] = True  # a text begins, so no word goes on
        follows = np.zeros(len(data) + 1, bool)
        follows[1:] = inside[:-1]
        begin = np.flatnonzero(inside & (~follows | fresh))
        end = np.flatnonzero(follows & (~inside | fresh))
        up, down = powers(len(data) + 1)
        total = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_LETTER[data] * up[: len(data)], out=total[1:])
        self.hash = mix((total[end] - total[begin]) * down[begin])
        self.begin, self.end, self.data = begin, end, data
        self.first = np.searchsorted(begin, self.ends)

    def shingles(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """(hashes, first): of every ``n`` words in a row; a text with fewer words, but some, is one shingle."""
        size = np.diff(self.first)
        count = np.where(size >= n, size - n + 1, np.minimum(size, 1))
        first = np.concatenate([[0], np.cumsum(count)])
        at = np.arange(first[-1]) + np.repeat(self.first[:-1] - first[:-1], count)
        last = np.repeat(self.first[1:], count)
        padded = np.concatenate([self.hash, np.zeros(n, np.uint64)])
        out = np.zeros(len(at), np.uint64)
        for k in range(n):
            out = mix(out * np.uint64(_FACTOR) + np.where(at + k < last, padded[at + k], np.uint64(k + 1)))
        return out, first


def _bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of all texts, offsets); no nulls."""
    wide = texts.cast(pa.large_string())
    _, offsets, data = wide.buffers()
    ends = np.frombuffer(offsets, np.int64)[wide.offset : wide.offset + len(wide) + 1] if len(wide) else np.zeros(1, np.int64)
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[ends[0] : ends[-1]], ends - ends[0]


_caches: list[Callable[[], None]] = []


def hold(drop: Callable[[], None]) -> None:
    """Name how to drop a cache that this worker keeps from task to task."""
    if drop not in _caches:
        _caches.append(drop)


def release() -> None:
    """Give memory that is free back to the system, where it can be asked to take it; workers live through many stages."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def pieces(batches: Iterator[pa.RecordBatch], text: int, most_bytes: int = 512 << 10) -> Iterator[pa.RecordBatch]:
    """The batches in slices of up to about ``most_bytes`` of text (one text at least), which bounds working memory.

    Caches that an earlier stage's tasks kept in this worker go first, and the
    memory of this one at the end.
    """
    while _caches:
        _caches.pop()()
    try:
        for batch in batches:
            if not batch.num_rows:
                continue
            _, ends = _bytes(batch.column(text))
            begin = 0
            while begin < batch.num_rows:
                end = max(begin + 1, int(np.searchsorted(ends, ends[begin] + most_bytes, "right")) - 1)
                yield batch.slice(begin, end - begin)
                begin = end
    finally:
        release()

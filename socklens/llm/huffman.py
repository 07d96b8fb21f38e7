"""Canonical length-limited Huffman codes over integer ids, vectorised.

Bits are written from the most significant on. A block of ids is independent of
all others; it keeps the bit offset of every ``LANE``-th id, so a reader starts
at any of them, or decodes all lanes of a block side by side from one table.
"""

from __future__ import annotations

import numpy as np

LIMIT = 16  # bits of the longest code
LANE = 64


def code_lengths(counts: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """Bits per id of the best prefix code of at most ``limit`` bits, by package-merge; 0 where the count is 0."""
    used = np.flatnonzero(counts)
    lengths = np.zeros(len(counts), np.uint8)
    if len(used) < 2:
        lengths[used] = 1
        return lengths
    if len(used) > 1 << limit:
        raise ValueError(f"{len(used)} ids need codes of more than {limit} bits")
    order = used[np.argsort(counts[used], kind="stable")]
    weights = counts[order].astype(np.int64)
    level, leaves = weights, []
    for _ in range(limit - 1):
        pairs = len(level) // 2
        both = np.concatenate([weights, level[0 : 2 * pairs : 2] + level[1 : 2 * pairs : 2]])
        place = np.argsort(both, kind="stable")
        level = both[place]
        leaves.append(place < len(weights))
    take = 2 * len(weights) - 2
    for leaf in [*reversed(leaves), np.ones(len(weights), bool)]:
        n = int(np.count_nonzero(leaf[:take]))
        lengths[order[:n]] += 1
        take = 2 * (take - n)
    return lengths


class Codebook:
    """Codes and decoding table that follow from the lengths alone."""

    def __init__(self, lengths: np.ndarray, limit: int = LIMIT):
        self.lengths = lengths.astype(np.int64)
        self.limit = limit
        used = np.flatnonzero(lengths)
        order = used[np.lexsort((used, lengths[used]))]
        span = np.int64(1) << (limit - self.lengths[order])
        first = np.cumsum(span) - span
        self.codes = np.zeros(len(lengths), np.uint64)
        self.codes[order] = (first >> (limit - self.lengths[order])).astype(np.uint64)
        # every value of the next ``limit`` bits: the id it begins with, and its bits
        self.id_at = np.zeros(1 << limit, np.uint32)
        self.bits_at = np.ones(1 << limit, np.int64)
        total = int(span.sum())
        self.id_at[:total] = np.repeat(order, span)
        self.bits_at[:total] = np.repeat(self.lengths[order], span)

    def pack(self, ids: np.ndarray) -> tuple[bytes, np.ndarray]:
        """(bits, bit offset of every ``LANE``-th id)."""
        if not len(ids):
            return b"", np.empty(0, np.int64)
        size = self.lengths[ids]
        begin = np.cumsum(size) - size
        word = begin >> 5
        value = self.codes[ids] << (64 - (begin & 31) - size).astype(np.uint64)
        change = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
        words = np.zeros(int(word[-1]) + 2, np.uint64)
        at = word[change]
        words[at] += np.add.reduceat(value >> np.uint64(32), change)
        words[at + 1] += np.add.reduceat(value & np.uint64(0xFFFFFFFF), change)
        n = (int(begin[-1] + size[-1]) + 7) // 8
        return words.astype(">u4").tobytes()[:n], begin[::LANE]

    def unpack(self, bits: bytes, offsets: np.ndarray, n: int) -> np.ndarray:
        """The ``n`` ids of a block; all lanes advance together, one table look-up an id."""
        if not n:
            return np.empty(0, np.uint32)
        data = np.frombuffer(bits + bytes(LANE * self.limit // 8 + 8), np.uint8).astype(np.uint32)
        ahead = (data[:-3] << 24) | (data[1:-2] << 16) | (data[2:-1] << 8) | data[3:]
        at = offsets.astype(np.int64)
        out = np.empty((LANE, len(at)), np.uint32)
        mask, down = (1 << self.limit) - 1, 32 - self.limit
        for step in range(LANE):
            peek = (ahead[at >> 3] >> (down - (at & 7)).astype(np.uint32)) & mask
            out[step] = self.id_at[peek]
            at += self.bits_at[peek]
        return out.T.reshape(-1)[:n]

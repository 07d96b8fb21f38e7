"""Byte-level BPE as a monoid: encode halves, join them at the boundary.

Encodings of byte strings form a monoid under "encoding of the concatenation".
A piece is halved down to vocabulary tokens and joined up the tree. A join
re-encodes a window around the boundary, which grows on the sides where it is
not settled. A side is settled when the pair of the first token outside and the
outermost token of the window encodes to itself: a token sequence is the
encoding of its bytes exactly if every adjacent pair is the encoding of its
own bytes, and pairs outside the window were adjacent before. Decoding
concatenates the bytes of ids up a tree in the same way.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, types as T

from socklens.llm.pretokens import PieceCache, split
from socklens.llm.words import hold

# Entries of the caches of a worker; they bound its memory and change no result.
MOST_PIECES = 250_000
MOST_PAIRS = 250_000
MOST_HALVES = 150_000


class BytePairs:
    """A vocabulary of ranked byte strings; all single bytes must be in it."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes = {rank: data for data, rank in ranks.items()}
        self.pairs: dict[int, tuple[int, ...] | None] = {}  # None: the pair encodes to itself
        self.own: dict[bytes, bool] = {}
        self.halves: dict[bytes, tuple[int, ...]] = {}

    def merge(self, data: bytes) -> tuple[int, ...]:
        """The encoding of a short string by its definition: merge the leftmost pair of lowest rank while there is one."""
        if len(data) > 48:
            return self._merge_long(data)
        parts = [data[i : i + 1] for i in range(len(data))]
        get = self.ranks.get
        while len(parts) > 1:
            found = [(rank, i) for i in range(len(parts) - 1) if (rank := get(parts[i] + parts[i + 1])) is not None]
            if not found:
                break
            i = min(found)[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return tuple(self.ranks[p] for p in parts)

    def _merge_long(self, data: bytes) -> tuple[int, ...]:
        """The same with the pairs in a heap, for windows that hardly ever settle (one letter repeated)."""
        n, get = len(data), self.ranks.get
        part: list[bytes | None] = [data[i : i + 1] for i in range(n)]
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        heap = [(rank, i, 2) for i in range(n - 1) if (rank := get(data[i : i + 2])) is not None]
        heapify(heap)
        while heap:
            _, i, size = heappop(heap)
            j = after[i]
            if part[i] is None or j >= n or len(part[i]) + len(part[j]) != size:
                continue
            part[i], part[j], after[i] = part[i] + part[j], None, after[j]
            if after[i] < n:
                before[after[i]] = i
                if (rank := get(part[i] + part[after[i]])) is not None:
                    heappush(heap, (rank, i, size + len(part[after[i]])))
            k = before[i]
            if k >= 0 and (rank := get(part[k] + part[i])) is not None:
                heappush(heap, (rank, k, len(part[k]) + size))
        return tuple(self.ranks[p] for p in part if p is not None)

    def pair(self, a: int, b: int) -> tuple[int, ...]:
        """The encoding of two adjacent tokens."""
        key = a << 32 | b
        known = self.pairs.get(key, ())
        if known == ():
            if len(self.pairs) >= MOST_PAIRS:
                self.pairs.clear()
            known = self.merge(self.bytes[a] + self.bytes[b])
            known = self.pairs[key] = None if known == (a, b) else known
        return (a, b) if known is None else known

    def stable(self, a: int, b: int) -> bool:
        return self.pair(a, b) == (a, b)

    def is_token(self, data: bytes) -> bool:
        """Whether the string is a token that is its own encoding."""
        if data not in self.ranks:
            return False
        known = self.own.get(data)
        if known is None:
            known = self.own[data] = len(self.merge(data)) == 1
        return known

    def join(self, left: tuple[int, ...], right: tuple[int, ...]) -> tuple[int, ...]:
        """The encoding of a concatenation from the encodings of its two parts."""
        window = self.pair(left[-1], right[0])
        i = j = 1
        while True:
            left_done = i >= len(left) or self.stable(left[-i - 1], window[0])
            right_done = j >= len(right) or self.stable(window[-1], right[j])
            if left_done and right_done:
                return left[:-i] + window + right[j:]
            i = i if left_done else min(2 * i, len(left))
            j = j if right_done else min(2 * j, len(right))
            window = self.merge(b"".join(map(self.bytes.__getitem__, left[-i:] + right[:j])))

    def encode(self, data: bytes) -> tuple[int, ...]:
        """The encoding of one piece; a piece that is a vocabulary token is that token."""
        whole = self.ranks.get(data)
        return (whole,) if whole is not None else self._tree(data) if data else ()

    def _tree(self, data: bytes) -> tuple[int, ...]:
        if self.is_token(data):
            return (self.ranks[data],)
        known = self.halves.get(data)
        if known is None:
            middle = len(data) // 2
            known = self.join(self._tree(data[:middle]), self._tree(data[middle:]))
            if len(data) <= 8:
                if len(self.halves) >= MOST_HALVES:
                    self.halves.clear()
                self.halves[data] = known
        return known

    def decode(self, ids: list[int]) -> bytes:
        if len(ids) <= 1024:
            return b"".join(map(self.bytes.__getitem__, ids))
        middle = len(ids) // 2
        return self.decode(ids[:middle]) + self.decode(ids[middle:])


@lru_cache(maxsize=2)
def load(path: str) -> BytePairs:
    """A rank file (base64 token and rank a line) on this machine."""
    with open(path, "rb") as lines:
        return BytePairs({base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)})


@lru_cache(maxsize=2)
def _cache(path: str) -> PieceCache:
    pairs = load(path)
    return PieceCache(lambda piece: np.array(pairs.encode(piece.encode()), "<i4").tobytes(), MOST_PIECES)


def drop_caches() -> None:
    _cache.cache_clear()
    load.cache_clear()


def encode_text(text: str, path: str) -> np.ndarray:
    """The ids of a whole text: its pieces one by one, one after the other."""
    return np.frombuffer(b"".join(map(_cache(path).__getitem__, split(text))), "<i4")


def _added(df: DataFrame, name: str, kind: T.DataType) -> tuple[DataFrame, T.StructType]:
    df = df.drop(*[c for c in df.columns if c.lower() == name])
    return df, T.StructType([*df.schema.fields, T.StructField(name, kind)])


def encode(docs: DataFrame, path: str, text: str = "text", decoded: bool = False) -> DataFrame:
    """Add ``ids`` (array of int): the encoding of every whole text by the rank file at ``path``.

    With ``decoded`` also add ``decoded`` (binary), what :func:`decode` makes of
    the ids, in the same task.

    ``path`` must exist on every executor. A null or empty text has no ids.
    Rows and their other columns stay as they are, a column ``ids`` is replaced;
    no rows give none. No shuffle; a task holds one Arrow batch and a bounded
    cache of pieces.
    """
    docs, schema = _added(docs, "ids", T.ArrayType(T.IntegerType()))
    if decoded:
        docs = docs.drop(*[c for c in docs.columns if c.lower() == "decoded"])
        schema = T.StructType([*docs.schema.fields, schema["ids"], T.StructField("decoded", T.BinaryType())])
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hold(drop_caches)
        for batch in batches:
            ids = [encode_text(t or "", path) for t in batch.column(at).to_pylist()]
            ends = np.cumsum([0, *map(len, ids)]).astype(np.int32)
            values = np.concatenate(ids) if ids else np.empty(0, np.int32)
            added = [pa.ListArray.from_arrays(ends, values)]
            if decoded:
                pairs = load(path)
                added.append(pa.array([pairs.decode(i.tolist()) for i in ids], pa.binary()))
            yield pa.RecordBatch.from_arrays([*batch.columns, *added], schema.names)

    return docs.mapInArrow(run, schema)


def decode(encoded: DataFrame, path: str, ids: str = "ids") -> DataFrame:
    """Add ``decoded`` (binary): the bytes of every array of ids; a null array decodes to null, an empty one to no bytes."""
    encoded, schema = _added(encoded, "decoded", T.BinaryType())
    at = encoded.columns.index(ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs = load(path)
        for batch in batches:
            texts = [None if i is None else pairs.decode(i) for i in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.binary())], [*batch.schema.names, "decoded"])

    return encoded.mapInArrow(run, schema)

"""Benchmark decontamination by latent semantic retrieval and word overlap.

Passages are weighted by TF-IDF, with the document frequency over all documents.
A randomised SVD of all passages of the documents and of the benchmark, computed by
Spark tasks that each multiply the rows they hold, spans one latent space of
``RANK`` dimensions that knows all their words. All items and every window of
every document are folded in. A window retrieves an item from a cosine of
``COSINE`` on, and holds it if the answer, the last words of the item, stands
there too: so paraphrases in other words are found. An answer of words that may
stand there by chance, as common ones do, is no sign of the item.

Windows that may share ``SURE`` of the item's words, or ``PARAPHRASE`` of them with its
answer, are a second source, so that no near copy depends on the space: the longest
common subsequence of words decides on them. Every passage that these checks
accept shares so many words, so every one is checked. Answers are looked up once, in the text,
so windows without the answer are held against the higher bound alone.

Documents are read in windows that begin at every ``STRIDE``-th word and are as
long as an item plus ``STRIDE - 1``, rounded up to strides, so every occurrence of
an item lies whole in a window of its size; a window is checked with a stride
before and after it. Folding in, and what an overlap can be at most, are linear in
the words, so each stride is worked out once and windows are differences of
running sums. All windows of all documents are compared with all items, in
blocks of ``BLOCK`` items.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import InitVar, dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F, types as T

from socklens.llm.shared import stash, text_key, whole_text
from socklens.llm.words import Words, mix, pieces, release

FEATURE_BITS = 18  # words are counted in 2^18 cells, by their hash
STRIDE = 16
LEAST_WORDS = 5  # shorter items say nothing and are not searched
SURE = 0.8  # share of an item's words, in order, that decides by itself
PARAPHRASE = 0.5  # and the share that decides if the answer stands there too
ANSWER = 0.2  # share of an item's words, from its end, that count as the answer
RANK = 32  # dimensions of the latent space
COSINE = 0.4  # in it, from which on a window retrieves an item
CHANCE = 0.01  # times that an answer may stand in all documents by the shares of its words, to be a sign of its item
PASSAGE = 64  # words of the passages that fit the space
FIT_WORDS = 1 << 24  # of the passages of a task, or more where fewer tasks can run
PASSAGES = 1 << 15  # that a task multiplies at once
DENSE = 1 << 8  # features that are multiplied as a matrix
SUMMED = 64  # rows of a sum at a time; longer sums are added up from such
SUMMED_AT_ONCE = 1 << 12
FEW = 4  # rows of a sum that are added one by one
ROWS_AT_ONCE = 1 << 14
NOISE = 1e-13  # share of the largest square from which on columns say something
PACKED = ["low", "high", "times", "size"]
COPY_BITS = 1 << 15  # of a bitmap
WINDOWS = 4096  # that are compared with a block of items at once
BLOCK = 256  # items compared at once
BLOCKS_A_PASS = 8
POWER_ROUNDS = 2
SUM_GROUPS = 16
PIECE_BYTES = 256 << 10  # of text that a task compares at once
MASK_WORDS = 64  # an item up to so long has a bit for every word
MASKED = 1 << 18  # words whose masks are in memory at once
HITS = "array<struct<item_id:bigint,cosine:double,lcs:double,answer:boolean>>"


def features(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - FEATURE_BITS)).astype(np.int64)


def passages(texts: DataFrame) -> DataFrame:
    """(id, item, key) and the features of all passages of every text of ``texts`` (item, text), for a table that is kept.

    The features of a passage stand in order, 16 bits of each in ``low`` and the
    others in ``high``, ``times`` says how often each stands there, ``size`` how
    many a passage has. Only equal texts share a key, no two rows an id.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, 2, PIECE_BYTES):
            words = Words(piece.column(2))
            count = -(-np.diff(words.first) // PASSAGE)
            first = np.concatenate([[0], np.cumsum(count)])
            owner = np.repeat(np.arange(piece.num_rows), np.diff(words.first))
            number = first[owner] + (np.arange(len(owner)) - words.first[owner]) // PASSAGE
            cells = np.sort((number << FEATURE_BITS) | features(words.hash))
            fresh = np.flatnonzero(np.append(True, cells[1:] != cells[:-1])[: len(cells)])
            feature, times = cells[fresh] & ((1 << FEATURE_BITS) - 1), np.diff(fresh, append=len(cells))
            size = np.bincount(cells[fresh] >> FEATURE_BITS, minlength=first[-1])
            ends = np.concatenate([[0], np.cumsum(size)])[first]
            parts = (feature, np.uint16, ends), (feature >> 16, np.uint8, ends), (times, np.uint8, ends), (size, np.uint8, first)
            yield pa.RecordBatch.from_arrays([*piece.columns[:2], *(_blobs(v.astype(kind), at) for v, kind, at in parts)], ["item", "key", *PACKED])

    schema = ", ".join(["item boolean", "key binary", *(f"{name} binary" for name in PACKED)])
    rows = texts.select("item", text_key(F.col("text")).alias("key"), "text").mapInArrow(run, schema)
    return rows.withColumn("id", F.monotonically_increasing_id())


def _blobs(values: np.ndarray, first: np.ndarray) -> pa.Array:
    """The bytes of ``values`` from each of ``first`` to the next."""
    ends = (first * values.itemsize).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(first) - 1, [None, pa.py_buffer(ends), pa.py_buffer(values)])


def unpacked(columns: list[pa.Array]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(features, times, features of each passage) of all passages in the columns ``PACKED``."""
    low, high, times, size = (np.frombuffer(b"".join(c.to_pylist()), kind) for c, kind in zip(columns, (np.uint16, np.uint8, np.uint8, np.uint8)))
    return low | high.astype(np.int32) << 16, times, size.astype(np.int64)


def document_frequency(rows: DataFrame) -> tuple[np.ndarray, np.ndarray, int]:
    """(texts each feature stands in, times it stands there, texts) over all of ``rows``, as ``passages`` gives them; each task sends its counts once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, times, rows = np.zeros(1 << FEATURE_BITS, np.int64), np.zeros(1 << FEATURE_BITS, np.int64), 0
        for batch in batches:
            feature, stands, _ = unpacked(batch.columns)
            owner = np.repeat(np.arange(batch.num_rows), pc.binary_length(batch.column(1)).to_numpy())
            np.add.at(times, feature, stands.astype(np.int64))
            each = np.sort((owner << FEATURE_BITS) | feature)
            fresh = np.append(True, each[1:] != each[:-1])[: len(each)]
            np.add.at(counts, each[fresh] & ((1 << FEATURE_BITS) - 1), 1)
            rows += batch.num_rows
        used = np.flatnonzero(counts)
        columns = [pa.array(np.append(of, one)) for of, one in ((used, -1), (counts[used], rows), (times[used], 0))]
        yield pa.RecordBatch.from_arrays(columns, ["feature", "n", "times"])

    counts = rows.select(*PACKED).mapInArrow(run, "feature long, n long, times long").groupBy("feature")
    counted = counts.agg(F.sum("n").alias("n"), F.sum("times").alias("times")).toPandas()
    frequency, times = np.zeros(1 << FEATURE_BITS, np.int64), np.zeros(1 << FEATURE_BITS, np.int64)
    known = counted[counted["feature"] >= 0]
    frequency[known["feature"]], times[known["feature"]] = known["n"], known["times"]
    return frequency, times, int(counted.loc[counted["feature"] < 0, "n"].sum())


def first_copies(rows: DataFrame) -> dict[int, np.ndarray]:
    """Which ids of ``rows`` are those of the first text of its copies, a bit for each, by ``id // COPY_BITS``."""
    first = rows.groupBy("item", "key").agg(F.min("id").alias("id")).select((F.col("id") + 1).alias("id"))
    bits = first.groupBy(F.bitmap_bucket_number("id").alias("part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("id")).alias("bits"))
    return {part.as_py() - 1: np.frombuffer(some.as_py(), np.uint8) for part, some in zip(*bits.toArrow().columns)}


@dataclass
class Space:
    """The latent space of all passages."""

    place: np.ndarray  # feature to row of ``table``, the last row for features that the space does not know
    table: np.ndarray  # what one word adds to a passage that is folded in

    def fold(self, feature: np.ndarray, begin: np.ndarray) -> np.ndarray:
        """The sum over the words from each of ``begin`` to the next one, the last to the end; none is empty."""
        out = np.zeros((len(begin), self.table.shape[1]), np.float32)
        row = self.place[feature]
        held = np.flatnonzero(row < len(self.table) - 1)
        if len(held):
            part = np.searchsorted(begin, held, "right") - 1
            change = np.flatnonzero(np.r_[True, part[1:] != part[:-1]])
            out[part[change]] = np.add.reduceat(self.table[row[held]], change, axis=0)
        return out


class Strides:
    """The strides of ``words``, and running sums of their folded words."""

    def __init__(self, words: Words, space: Space):
        self.words, self.feature = words, features(words.hash)
        size = np.diff(words.first)
        count = -(-size // STRIDE)  # strides of each text, the last may be short
        self.first = np.concatenate([[0], np.cumsum(count)])
        self.owner = np.repeat(np.arange(len(size)), count)
        self.begin = words.first[self.owner] + (np.arange(len(self.owner)) - self.first[self.owner]) * STRIDE
        self.edges = np.append(self.begin, len(words.hash))
        at = self.begin[:, None] + np.arange(STRIDE)
        self.at = np.where(at < self.edges[1:, None], at, len(words.hash))
        self.folded = np.zeros((len(self.owner) + 1, space.table.shape[1]))
        np.cumsum(self.sums(space.table, space.place[self.feature]), axis=0, out=self.folded[1:])

    def sums(self, table: np.ndarray, row: np.ndarray) -> np.ndarray:
        """The sum over the words of each stride of their rows of ``table``; its last row is zero."""
        # one word of every stride at a time: rows are taken and added whole
        rows = np.append(row, len(table) - 1)[self.at.T]
        out = table.take(rows[0], axis=0)
        for k in range(1, STRIDE):
            out += table.take(rows[k], axis=0)
        return out

    def vectors(self, length: int, windows: np.ndarray) -> np.ndarray:
        """The windows of so many strides in the latent space, of length one."""
        end = np.minimum(windows + length, self.first[self.owner[windows] + 1])
        return unit((self.folded[end] - self.folded[windows]).astype(np.float32))


def unit(vectors: np.ndarray) -> np.ndarray:
    return vectors / np.maximum(np.sqrt(np.einsum("ij,ij->i", vectors, vectors)), 1e-6)[:, None]


@dataclass
class Block:
    """Items that are compared at once, by length of their windows."""

    item_ids: list[int]
    words: list[list[int]]  # hashes, in order
    place: np.ndarray  # feature to column of ``present``, the last one for features of no item
    latent: np.ndarray  # the items in the latent space, of length one
    length: np.ndarray  # of the windows for each item, in strides
    times: InitVar[np.ndarray]  # of each feature in all documents

    def __post_init__(self, times: np.ndarray) -> None:
        self.masks = [self._mask(w) for w in self.words]
        share = times / max(1, times.sum())
        self._bounds(share)
        spoken: dict[tuple[int, ...], int] = {}
        self.answer = np.array([spoken.setdefault(tuple(w[-self.answer_words(w) :]), len(spoken)) for w in self.words])
        answers = [np.array(a, np.uint64) for a in spoken]
        # whether an answer says something
        self.telling = np.array([times.sum() * share[features(a)].prod() < CHANCE for a in answers])
        self.size = np.array([len(a) for a in answers])
        self.stop, self.spoken = np.cumsum(self.size), np.concatenate(answers)
        # answers by their last three words; the shortest has as many
        ends = np.array([triples(a)[-1] for a in answers])
        self.by_end = np.argsort(ends)
        self.ends = ends[self.by_end]
        self.maybe = np.zeros(1 << FEATURE_BITS, bool)
        self.maybe[features(self.ends)] = True

    def answers(self, words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(answer, begin, end) of every place in a text where an answer stands."""
        key, found = triples(words.hash), [np.zeros((3, 0), np.int64)]
        ending = np.flatnonzero(self.maybe[features(key)])
        step = max(1, MASKED // len(self.ends))
        for at in (ending[k : k + step] for k in range(0, len(ending), step)):
            lo, hi = (np.searchsorted(self.ends, key[at], side) for side in ("left", "right"))
            count = hi - lo
            which = self.by_end[np.repeat(lo - np.cumsum(count) + count, count) + np.arange(count.sum())]
            end = np.repeat(at + 3, count)
            begin = end - self.size[which]
            inside = (begin >= 0) & (np.searchsorted(words.first, begin, "right") == np.searchsorted(words.first, end - 1, "right"))
            place, back = np.stack([which, begin, end])[:, inside], 1
            while back <= self.size[place[0]].max(initial=0):
                which, _, end = place
                # back from the end; an answer that is through stays at its first word
                behind = np.minimum(back, self.size[which])
                place = place[:, words.hash[end - behind] == self.spoken[self.stop[which] - behind]]
                back += 1
            found.append(place)
        return tuple(np.concatenate(found, axis=1))

    def _bounds(self, share: np.ndarray) -> None:
        """What bounds the words that an item and the words of a window have in common.

        ``counted`` has 1 for the features of an item that a window is expected to
        hold less often than the item; the others count as all there. So a window
        in which fewer than ``least`` words are counted shares less than
        ``PARAPHRASE`` of the item's words, and with fewer than ``alone`` less than
        ``SURE``. ``present`` has a bit for every word of an item with the feature,
        0 where the item is longer than ``MASK_WORDS``.
        """
        rows, items = int(self.place.max()) + 1, len(self.words)
        # eight items to an integer: a stride has at most STRIDE of each, so no byte of a sum runs over
        self.counted, self.present = np.zeros((rows, -(-items // 8) * 8), np.uint8), np.zeros((items, rows), np.uint64)
        self.need, self.sure = (np.array([-int(-(part * len(w) - 1e-9) // 1) for w in self.words]) for part in (PARAPHRASE, SURE))
        self.least, self.alone = self.need.copy(), self.sure.copy()
        for i, own in enumerate(self.words):
            feature = features(np.array(own, np.uint64))
            kinds, times = np.unique(feature, return_counts=True)
            rare = share[kinds] * (self.length[i] + 2) * STRIDE <= times
            self.counted[self.place[kinds[rare]], i] = 1
            self.least[i] -= times[~rare].sum()
            self.alone[i] -= times[~rare].sum()
            if len(own) <= MASK_WORDS:
                bits = np.uint64(1) << np.arange(len(own), dtype=np.uint64)
                np.bitwise_or.at(self.present[i], self.place[feature], bits)

    @staticmethod
    def _mask(words: list[int]) -> dict[int, int]:
        masks: dict[int, int] = {}
        for i, w in enumerate(words):
            masks[w] = masks.get(w, 0) | 1 << i
        return masks

    def common(self, item: int, words: list[int]) -> float:
        """Share of the item's words that stand in ``words`` in the same order (longest common subsequence)."""
        masks, n = self.masks[item], len(self.words[item])
        full = (1 << n) - 1
        row = full
        for w in words:
            m = masks.get(w)
            if m:
                row = ((row + (row & m)) | (row & ~m)) & full
        return (n - row.bit_count()) / n

    @staticmethod
    def answer_words(words: list[int]) -> int:
        return max(3, round(ANSWER * len(words)))


def triples(hashes: np.ndarray) -> np.ndarray:
    """A hash of every three words side by side."""
    return mix(hashes[:-2] * np.uint64(3) + mix(hashes[1:-1] * np.uint64(5) + hashes[2:]))


def packed(batch: pa.RecordBatch, idf: np.ndarray, first: dict[int, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(features, weights, features of each passage) of the passages, as TF-IDF vectors of length one, in a batch of ``passages``, copies of a text once."""
    ids = batch.column(0).to_numpy()
    part, held = ids // COPY_BITS, np.zeros(len(ids), bool)
    for some in np.unique(part):
        own, bits = np.flatnonzero(part == some), np.unpackbits(first.get(int(some), np.zeros(COPY_BITS // 8, np.uint8)), bitorder="little")
        held[own] = bits[ids[own] % COPY_BITS]
    feature, times, size = unpacked(batch.filter(pa.array(held)).columns[1:])
    weight = times * idf[feature]
    length = np.sqrt(np.bincount(np.repeat(np.arange(len(size)), size), weight * weight, len(size)))
    return feature, weight / np.repeat(length, size).astype(idf.dtype), size


def listed(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(features, weights, features of each passage) of passages that are rows of two arrays."""
    size = np.diff(batch.column(0).offsets.to_numpy())
    return batch.column(0).flatten().to_numpy(), batch.column(1).flatten().to_numpy(), size


def row_sums(table: np.ndarray, row: np.ndarray, weight: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Sums of the rows ``row`` of ``table``, times their weights, over so many places each; none is empty."""
    count = -(-size // SUMMED)
    first = np.cumsum(count) - count
    within = (np.arange(count.sum()) - np.repeat(first, count)) * SUMMED
    begin = np.repeat(np.cumsum(size) - size, count) + within
    length = np.minimum(np.repeat(size, count) - within, SUMMED)
    # sums of as many rows are made at once
    order = np.argsort(length.astype(np.uint8), kind="stable")
    ends = np.cumsum(np.bincount(length, minlength=SUMMED + 1))
    out = np.empty((len(order), table.shape[1]), table.dtype)
    for n in np.flatnonzero(np.diff(ends)).tolist():
        n, step = n + 1, max(1, SUMMED_AT_ONCE // (n + 1))
        for some in (order[k : min(k + step, ends[n])] for k in range(ends[n - 1], ends[n], step)):
            at = begin[some, None] + np.arange(n)
            if n > FEW:
                out[some] = np.matmul(weight[at][:, None], table.take(row[at], axis=0))[:, 0]
                continue
            total = 0
            for place in at.T:
                taken = table.take(row[place], axis=0)
                taken *= weight[place, None]
                total += taken
            out[some] = total
    return out if len(out) == len(size) else row_sums(out, np.arange(len(out)), np.ones(len(out), out.dtype), count)


def orthonormal(rows: np.ndarray) -> np.ndarray:
    """Makes an orthonormal basis of what the columns span, in their place; columns beyond that are zero."""
    for _ in range(2):  # the second time for what the first one rounds
        some = [rows[k : k + ROWS_AT_ONCE] for k in range(0, len(rows), ROWS_AT_ONCE)]
        value, vector = np.linalg.eigh(sum(part.T @ part for part in (p.astype(np.float64) for p in some)))
        held = value > value.max() * NOISE
        turn = vector * np.where(held, 1 / np.sqrt(np.where(held, value, 1)), 0)
        for part in some:
            part[:] = part @ turn
    return rows


def randomised_svd(rows: DataFrame, support: np.ndarray, rank: int, read: Callable[[pa.RecordBatch], tuple] = listed, kind: type = np.float64) -> np.ndarray:
    """An orthonormal basis (a row per feature of the support) of the leading right singular space.

    ``rows`` has the passages that ``read`` takes from a batch, such as
    (features array<long>, weights array<double>), one passage each;
    features that are not in the support do not count.
    The first basis is A' times random numbers, and every power round multiplies
    A'A with the basis so far: a task adds up what its rows give, a sum over
    tasks follows, and only that sum, a row per feature of the support, comes to
    the driver to be made orthonormal.
    """
    context, known = rows.sparkSession.sparkContext, len(support)
    place = np.full(1 << FEATURE_BITS, known, np.int32)
    place[support] = np.arange(known)
    basis = None
    for _ in range(POWER_ROUNDS + 1):
        shared = context.broadcast((place, basis))

        def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            place, basis = shared.value
            total = np.zeros((known, rank), kind)
            for batch in batches:
                feature, weight, size = read(batch)
                row, ends = place[feature].astype(np.int64), np.concatenate([[0], np.cumsum(size)])
                for some in range(0, len(size), PASSAGES):
                    end = min(some + PASSAGES, len(size))
                    add_product(total, basis, *(of[ends[some] : ends[end]] for of in (row, weight)), size[some:end])
            for group in range(SUM_GROUPS):
                yield pa.RecordBatch.from_arrays([pa.array([group]), pa.array([total[group::SUM_GROUPS].tobytes()])], ["group", "rows"])
            del total
            release()

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            totals: dict[int, np.ndarray] = {}
            for batch in batches:
                for group, part in zip(batch.column(0).to_pylist(), batch.column(1)):
                    values = np.frombuffer(part.as_buffer(), kind)
                    totals[group] = totals.get(group, 0) + values.astype(np.float64)
            for group, total in totals.items():
                yield pa.RecordBatch.from_arrays([pa.array([group]), pa.array([total.astype(kind).tobytes()])], ["group", "rows"])

        # a group holds a share of the features, with one row a task
        parts = rows.mapInArrow(multiply, "group long, rows binary").repartition(SUM_GROUPS, "group").mapInArrow(add, "group long, rows binary")
        summed = np.zeros((known, rank), kind)
        for group, part in zip(*parts.toArrow().columns):
            summed[group.as_py() :: SUM_GROUPS] = np.frombuffer(part.as_buffer(), kind).reshape(-1, rank)
        basis = orthonormal(summed)
        shared.destroy()
    return basis


def add_product(total: np.ndarray, basis: np.ndarray | None, row: np.ndarray, weight: np.ndarray, size: np.ndarray) -> None:
    """Add A'A times the basis, or A' times random numbers, to ``total``, for the passages A of so many features each; rows behind the last do not count."""
    owner, first = np.repeat(np.arange(len(size)), size), min(DENSE, len(total))
    # most words are of a few features, the first ones: a matrix with all of them
    dense = np.zeros((len(size), first), total.dtype)
    few = np.flatnonzero(row < first)
    dense.reshape(-1)[owner[few] * first + row[few]] = weight[few]
    rest = np.flatnonzero((row >= first) & (row < len(total)))
    own, row_of, weight = owner[rest], row[rest], weight[rest].astype(total.dtype)
    if basis is None:
        products = drawn(row, size, total.shape[1]).astype(total.dtype)
    else:
        products = dense @ basis[:first]
        here = np.flatnonzero(np.diff(own, prepend=-1))
        products[own[here]] += row_sums(basis, row_of, weight, np.diff(here, append=len(rest)))
    total[:first] += dense.T @ products
    order = np.sort(row_of << 32 | np.arange(len(rest))) & ((1 << 32) - 1)
    row_of = row_of[order]
    change = np.flatnonzero(np.diff(row_of, prepend=-1))
    total[row_of[change]] += row_sums(products, own[order], weight[order], np.diff(change, append=len(rest)))


def drawn(row: np.ndarray, size: np.ndarray, rank: int) -> np.ndarray:
    """Numbers from -1 to 1 for every passage, by its features, so that they are the same in any task."""
    ends = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(row.astype(np.uint64) + np.uint64(1)))])
    at = np.cumsum(size)
    seed = ends[at] - ends[at - size]
    return np.stack([mix(seed + mix(np.full(1, k, np.uint64))) for k in range(1, rank + 1)], axis=1) / 2.0**63 - 1


def latent_space(rows: DataFrame, idf: np.ndarray, times: np.ndarray) -> Space:
    """One space of ``RANK`` dimensions for all passages of documents and items, ``rows`` as ``passages`` gives them, copies of a text once.

    ``times`` says how often each feature stands in documents. Every feature of either table is known.
    """
    support = np.flatnonzero((times > 0) | (document_frequency(rows.where("item"))[0] > 0))
    # the most frequent ones side by side, which caches like
    support = support[np.argsort(-times[support], kind="stable")]
    place = np.full(1 << FEATURE_BITS, len(support), np.int32)
    place[support] = np.arange(len(support))
    table = np.zeros((len(support) + 1, min(RANK, len(support))), np.float32)
    if len(support):
        context = rows.sparkSession.sparkContext
        # what a task sends does not grow with its rows, so there are no more tasks than can run
        tasks = max(1, min(-(-int(times.sum()) // FIT_WORDS), context.defaultParallelism))
        shared = context.broadcast((idf.astype(np.float32), first_copies(rows)))
        basis = randomised_svd(rows.select("id", *PACKED).coalesce(tasks), support, table.shape[1], lambda batch: packed(batch, *shared.value), np.float32)
        table[:-1] = idf[support, None] * basis
    return Space(place, table)


def blocks(items: DataFrame, space: Space, times: np.ndarray) -> Iterator[list[Block]]:
    """``items`` (item_id, text) in blocks of ``BLOCK``, some at a time; those without ``LEAST_WORDS`` words are left out."""
    group: list[Block] = []
    pending: list = []
    # the items stream through the driver one block at a time
    for row in items.orderBy("item_id", "text").toLocalIterator():
        hashes = Words(pa.array([row["text"]])).hash
        if len(hashes) >= LEAST_WORDS:
            pending.append((row["item_id"], hashes))
        if len(pending) == BLOCK:
            group.append(_block(pending, space, times))
            pending = []
        if len(group) == BLOCKS_A_PASS:
            yield group
            group = []
    if pending:
        group.append(_block(pending, space, times))
    if group:
        yield group


def _block(items: list, space: Space, times: np.ndarray) -> Block:
    items = sorted(items, key=lambda item: len(item[1]))
    own = [features(h) for _, h in items]
    support = np.unique(np.concatenate(own))
    place = np.full(1 << FEATURE_BITS, len(support), np.int32)
    place[support] = np.arange(len(support))
    latent = unit(space.fold(np.concatenate(own), np.cumsum([0, *map(len, own[:-1])])))
    words = [h.tolist() for _, h in items]
    return Block([i for i, _ in items], words, place, latent, np.array([-(-(len(w) + STRIDE - 1) // STRIDE) for w in words]), times)


def search(strides: Strides, block: Block) -> list[tuple[int, int, float, float, bool]]:
    """(text, item, cosine, common share, answer) of every item that the checks confirm in a text, the best window of each."""
    words, first, owner, begin, edges = strides.words, strides.first, strides.owner, strides.begin, strides.edges
    if not len(owner):
        return []
    row = block.place[strides.feature]
    # sums may wrap around, their differences do not
    counted = np.zeros((len(owner) + 1, len(block.item_ids)), np.uint16 if (block.length.max() + 2) * STRIDE < 1 << 16 else np.uint32)
    counted[1:] = strides.sums(block.counted.view(np.uint64), row).view(np.uint8)[:, : counted.shape[1]]
    np.cumsum(counted, axis=0, out=counted)
    least, alone_from = (np.maximum(n, 0).astype(counted.dtype) for n in (block.least, block.alone))
    at = np.arange(len(owner))
    places = block.answers(words)
    best: dict[tuple[int, int], tuple[float, float, bool]] = {}
    for length in np.unique(block.length):
        lo, hi = np.searchsorted(block.length, [length, length + 1])
        before = np.maximum(at - 1, first[owner])
        after = np.minimum(at + length + 1, first[owner + 1])
        # only a window that shares ``SURE`` of the words needs no answer, so the other bound is for windows with the answer
        answered = _answered(strides, block, length, lo, hi, edges[before], edges[after], places)
        window, item = answered // (hi - lo), answered % (hi - lo) + lo
        overlap = answered[counted[after[window], item] - counted[before[window], item] >= least[item]]
        alone = np.flatnonzero(counted[after, lo:hi] - counted[before, lo:hi] >= alone_from[lo:hi])
        overlap, alone = (
            pairs[_present(row, edges[before[pairs // (hi - lo)]], edges[after[pairs // (hi - lo)]], pairs % (hi - lo) + lo, block) >= enough[pairs % (hi - lo) + lo]]
            for pairs, enough in ((overlap, block.need), (alone, block.sure))
        )
        latent = _retrieve(strides, block, length, lo, hi, answered)
        pairs = np.union1d(np.union1d(overlap, alone), latent)
        window, item = pairs // (hi - lo), pairs % (hi - lo) + lo
        cosines = np.einsum("ij,ij->i", strides.vectors(length, window), block.latent[item])
        columns = window, item, cosines, np.isin(pairs, answered), np.isin(pairs, latent)
        for w, i, cosine, answer, retrieved in zip(*(c.tolist() for c in columns)):
            common = block.common(i, words.hash[edges[before[w]] : edges[after[w]]].tolist())
            if common >= SURE or answer and (common >= PARAPHRASE or retrieved):
                found = (common, cosine, answer)
                key = (int(owner[w]), i)
                best[key] = max(best.get(key, found), found)
    return [(text, block.item_ids[item], cosine, common, answer) for (text, item), (common, cosine, answer) in sorted(best.items())]


def _answered(strides: Strides, block: Block, length: int, lo: int, hi: int, begin: np.ndarray, end: np.ndarray, places: tuple) -> np.ndarray:
    """Windows whose words from ``begin`` to ``end`` hold the answer of an item from ``lo`` to ``hi``: window x items + item, in order."""
    found, kinds, step = [np.zeros(0, np.int64)], len(block.size), max(1, MASKED // (length + 3))
    for which, answer, after in ([p[k : k + step] for p in places] for k in range(0, len(places[0]), step)):
        # the windows that may reach an answer lie about its stride
        near = (np.searchsorted(strides.begin, answer, "right") - 1)[:, None] + np.arange(-length - 1, 2)
        near = np.clip(near, 0, len(begin) - 1)
        held = (begin[near] <= answer[:, None]) & (after[:, None] <= end[near])
        found.append(np.unique((near * kinds + which[:, None])[held]))
    each = np.unique(np.concatenate(found))
    windows, row = np.unique(each // kinds, return_inverse=True)
    stands = np.zeros((len(windows), kinds), bool)
    stands[row, each % kinds] = True
    row, item = np.nonzero(stands[:, block.answer[lo:hi]])
    return windows[row] * (hi - lo) + item


def _retrieve(strides: Strides, block: Block, length: int, lo: int, hi: int, answered: np.ndarray) -> np.ndarray:
    """Those of ``answered`` whose answer says something and that retrieve their item, from ``lo`` to ``hi``, in the latent space."""
    answered = answered[block.telling[block.answer[answered % (hi - lo) + lo]]]
    found, count = [], len(strides.owner)
    for some in range(0, count, WINDOWS):
        windows = np.arange(some, min(some + WINDOWS, count))
        retrieved = strides.vectors(length, windows) @ block.latent[lo:hi].T >= COSINE
        a, b = np.searchsorted(answered, [some * (hi - lo), (windows[-1] + 1) * (hi - lo)])
        found.append(answered[a:b][retrieved.ravel()[answered[a:b] - some * (hi - lo)]])
    return np.concatenate(found)


def _present(row: np.ndarray, begin: np.ndarray, end: np.ndarray, item: np.ndarray, block: Block) -> np.ndarray:
    """How many words of an item are present between ``begin`` and ``end`` at most; all of those of an item too long for masks."""
    out = np.array([len(w) for w in block.words])[item]
    ask = np.flatnonzero(out <= MASK_WORDS)
    if not len(ask):
        return out
    rows = block.present.shape[1]
    reach = int((end[ask] - begin[ask]).max())
    padded = np.append(row, np.full(reach, rows - 1, row.dtype))
    spans = np.lib.stride_tricks.sliding_window_view(padded, reach)
    masks_of, inside = block.present.reshape(-1), np.arange(reach)
    step = max(1, MASKED // reach)
    for some in (ask[k : k + step] for k in range(0, len(ask), step)):
        # what stands behind the end has no bits
        held = np.where(inside < (end[some] - begin[some])[:, None], spans[begin[some]], rows - 1)
        out[some] = np.bitwise_count(np.bitwise_or.reduce(masks_of.take(held + item[some, None] * rows), axis=1))
    return out


def find_contamination(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """Add ``hits``: (item_id, cosine, lcs, answer) of every benchmark item that a document holds, by item.

    ``lcs`` is the share of the item's words found in order, ``answer`` whether
    its last words stand there side by side. An item is held from ``SURE`` on,
    or from ``PARAPHRASE`` on with its answer. Null and empty texts hold nothing;
    items that are null or have fewer than ``LEAST_WORDS`` words are held by
    none; repeated items count once, two texts of one item as two hits. Rows and
    their other columns stay, a column ``hits`` is replaced; no rows or no items
    give no hits. Documents are never shuffled.
    """
    docs = docs.drop(*[c for c in docs.columns if c.lower() in ("hits", "__text")])
    items = benchmark.select(F.col(item_col).cast("long").alias("item_id"), F.lower(whole_text(item_text)).alias("text")).distinct()
    texts = docs.select(F.lit(False).alias("item"), F.lower(whole_text(text)).alias("text")).unionByName(items.select(F.lit(True).alias("item"), "text"))
    rows = stash(passages(texts), "passages")
    frequency, times, n_docs = document_frequency(rows.where("not item"))
    idf = np.log((1 + n_docs) / (1 + frequency)) + 0.01
    space = latent_space(rows, idf, times)
    found = docs.withColumns({"hits": F.array().cast(HITS), "__text": F.lower(whole_text(text))})
    at, hits = found.columns.index("__text"), found.columns.index("hits")
    schema: T.StructType = found.schema
    kind = pa.list_(pa.struct([("item_id", pa.int64()), ("cosine", pa.float64()), ("lcs", pa.float64()), ("answer", pa.bool_())]))
    for group in blocks(items, space, times):
        shared = docs.sparkSession.sparkContext.broadcast((group, space))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            group, space = shared.value
            for piece in pieces(batches, at, PIECE_BYTES):
                strides = Strides(Words(piece.column(at)), space)
                own = piece.column(hits).to_pylist()
                for block in group:
                    for t, item, cosine, common, answer in search(strides, block):
                        own[t].append({"item_id": item, "cosine": cosine, "lcs": common, "answer": answer})
                columns = list(piece.columns)
                columns[hits] = pa.array(own, kind)
                yield pa.RecordBatch.from_arrays(columns, piece.schema.names)

        found = found.mapInArrow(run, schema)
    return found.drop("__text")

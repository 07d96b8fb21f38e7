"""Periodic runs of words by seeds on diagonals.

A run is a stretch of consecutive words with the smallest period q, words q apart being
identical, of at least ``max(LEAST, TIMES * q)`` words, that no neighbouring word
extends. All of them are found, in time n log n for a text of n words.

Seeds: a run of period q has ``TIMES * q - q`` words at least that equal the word q
further, the minimum overlap it guarantees with itself. For periods from 2^j to
2^(j+1) - 1 the grams of 2^(j+1) words, which that overlap always holds, are indexed.
They are no shorter than the period, so inside a run the same gram comes again q
words later and not before (two shifts of it would make a common divisor the
period). Hence neighbouring occurrences of a gram are all the pairs needed: never
more than there are words, however often a gram occurs. Grams of twice the length are
made from pairs of grams, and only those are followed up that occur again.

Extension: pairs of one text and lag, by position, lie on a diagonal. The furthest
position covered on it so far tells whether a pair lies in what is covered already
and only carries it on, or starts a new extension; each extension long enough is
then carried on word by word to both sides.
"""

from __future__ import annotations

from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F, types as T

from socklens.llm.shared import whole_text
from socklens.llm.words import _bytes, pieces
from socklens.settings import free_names

LEAST = 6
TIMES = 4
RUNS = T.ArrayType(T.StructType([T.StructField(n, T.LongType()) for n in ("start", "length", "period")]))
_BLANK = np.zeros(256, bool)
_BLANK[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


def split_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """(words of all texts, first word of each text): a word is what stands between blanks, as bytes."""
    data, ends = _bytes(texts)
    inside = ~_BLANK[data]
    fresh = np.zeros(len(data) + 1, bool)
    fresh[ends[:-1]] = True  # a text begins, so no word goes on
    begin = np.flatnonzero(inside & (fresh[:-1] | ~np.concatenate([[False], inside[:-1]])))
    letters = np.concatenate([[0], np.cumsum(inside)])
    offsets = np.concatenate([letters[begin], letters[-1:]]).astype(np.int64)
    buffers = [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data[inside]))]
    words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(begin), buffers)
    return words, np.searchsorted(begin, ends)


def find_runs(ids: np.ndarray, first: np.ndarray) -> np.ndarray:
    """(text, start, length, period) of every run, by text, start and period.

    ``ids`` are the words of all texts as numbers, those of text i from
    first[i] to first[i + 1]; starts count from the text's own first word.
    """
    size = np.diff(first)
    text = np.repeat(np.arange(len(size)), size)
    end = first[1:][text]  # where the text of a word ends
    at, name = np.arange(len(ids)), ids.astype(np.int64)  # positions whose gram is followed up, ascending, and its name
    found, gram = [np.zeros((0, 4), np.int64)], 1
    while len(at):
        # grams of twice the length: both halves must have been followed up
        named = np.full(len(ids) + gram, -1, np.int64)
        named[at] = name
        second = named[at + gram]
        fits = (at + 2 * gram <= end[at]) & (second >= 0)
        at, key = at[fits], name[fits] << 32 | second[fits]
        gram *= 2
        order = np.argsort(key, kind="stable")
        seen = at[order]
        same = (np.diff(key[order]) == 0) & (np.diff(text[seen]) == 0)
        lag = np.diff(seen)
        pair = same & (lag >= gram // 2) & (lag < gram)
        found.append(_extend(ids, first, text, seen[:-1][pair], lag[pair], gram))
        again, name = np.zeros(len(at), bool), np.zeros(len(at), np.int64)
        again[order] = np.concatenate([same, [False]]) | np.concatenate([[False], same]) if len(at) else False
        name[order] = np.cumsum(np.concatenate([[True], ~same])) - 1 if len(at) else 0
        at, name = at[again], name[again]
    runs = np.concatenate(found)
    return runs[np.lexsort((runs[:, 3], runs[:, 1], runs[:, 0]))]


def _extend(ids: np.ndarray, first: np.ndarray, text: np.ndarray, at: np.ndarray, lag: np.ndarray, gram: int) -> np.ndarray:
    """Runs from pairs (at, at + lag) of equal grams."""
    if not len(at):
        return np.zeros((0, 4), np.int64)
    order = np.lexsort((at, lag, text[at]))
    at, lag = at[order], lag[order]
    doc = text[at]
    # the pair before on the diagonal has covered all up to its gram's end
    covered = np.concatenate([[False], (np.diff(doc) == 0) & (np.diff(lag) == 0) & (np.diff(at) <= gram)])
    begins = np.flatnonzero(~covered)
    ends = np.concatenate([begins[1:], [len(at)]]) - 1
    start, stop, lag, doc = at[begins], at[ends] + gram, lag[begins], doc[begins]  # equal to the word lag further
    long = stop + lag - start >= np.maximum(LEAST, TIMES * lag)
    start, stop, lag, doc = start[long], stop[long], lag[long], doc[long]
    low, high = first[doc], first[doc + 1] - lag
    more = np.ones(len(start), bool)
    while more.any():
        more = more & (start > low)
        more[more] = ids[start[more] - 1] == ids[start[more] - 1 + lag[more]]
        start = start - more
    more = np.ones(len(start), bool)
    while more.any():
        more = more & (stop < high)
        more[more] = ids[stop[more]] == ids[stop[more] + lag[more]]
        stop = stop + more
    length = stop + lag - start
    whole = length >= np.maximum(LEAST, TIMES * lag)
    return np.unique(np.stack([doc, start - low, length, lag], axis=1)[whole], axis=0)


def damage(n: int, doc_id: str | None) -> np.ndarray | None:
    """Which original word stands at each place of a text of ``n`` words after the damage its id calls for; None without.

    Makes periodic tails: with h the checksum of the id and g = h // 10, one text
    in ten repeats p words from word a on.
    """
    if doc_id is None or not n:
        return None
    g, kind = divmod(crc32(doc_id.encode()), 10)
    if kind:
        return None
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    at = np.arange(n)
    at[a:] = a + (at[a:] - a) % p
    return at


def dropped(runs: np.ndarray, n: int) -> np.ndarray:
    """Which of ``n`` words stand in a run behind its first period."""
    edges = np.zeros(n + 1, np.int64)
    np.add.at(edges, runs[:, 0] + runs[:, 2], 1)
    np.add.at(edges, runs[:, 0] + runs[:, 1], -1)
    return np.cumsum(edges[:-1]) > 0


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text: str = "text", damaged: bool = False) -> DataFrame:
    """All rows of ``docs`` with ``runs`` (start, length, period, by start and then period) and ``collapsed``.

    Words are what stands between blanks (space, tab, line feeds, form feed and
    carriage return) and are numbered from 0. ``collapsed`` is the text's words joined by
    single spaces, without those that repeat the period of a run: only the
    first period of each stays. A null or empty text, or one of blanks, has no
    runs and collapses to an empty text. Texts are taken whole, and each row by
    itself, so ties and repeated rows give equal results and no rows give none;
    columns named like the added ones are replaced. With ``damaged`` texts are
    first damaged as their ids say (see :func:`damage`; null ids: not).
    """
    docs = docs.drop(*[c for c in docs.columns if c.lower() in ("runs", "collapsed")])
    whole, number = free_names([*docs.columns, "runs", "collapsed"], "_whole", "_number")
    added = T.StructType().add("runs", RUNS).add("collapsed", "string")
    schema = T.StructType([*docs.schema.fields, *added.fields])
    staged = docs.withColumns({whole: whole_text(text), number: F.col(id_col).cast("string") if damaged else F.lit(None).cast("string")})
    at, id_at = staged.columns.index(whole), staged.columns.index(number)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, at):
            words, first = split_words(piece.column(at))
            coded = words.dictionary_encode()
            ids = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
            place = np.arange(len(ids))
            if damaged:
                for i, doc_id in enumerate(piece.column(id_at).to_pylist()):
                    moved = damage(int(first[i + 1] - first[i]), doc_id)
                    if moved is not None:
                        place[first[i] : first[i + 1]] = first[i] + moved
                ids = ids[place]
            runs = find_runs(ids, first)
            cut = np.searchsorted(runs[:, 0], np.arange(piece.num_rows + 1))
            keep = np.ones(len(ids), bool)
            for i in np.flatnonzero(np.diff(cut)):
                mine = runs[cut[i] : cut[i + 1], 1:]
                keep[first[i] : first[i + 1]] = ~dropped(mine, int(first[i + 1] - first[i]))
            offsets = np.concatenate([[0], np.cumsum(keep)])[first]
            kept = pa.LargeListArray.from_arrays(pa.array(offsets, pa.int64()), words.take(pa.array(place[keep])))
            collapsed = pc.binary_join(kept, pa.scalar(b" ", pa.large_binary())).view(pa.large_string()).cast(pa.string())
            spans = pa.StructArray.from_arrays([pa.array(runs[:, k + 1]) for k in range(3)], ["start", "length", "period"])
            lists = pa.ListArray.from_arrays(pa.array(cut, pa.int32()), spans)
            columns = [c for i, c in enumerate(piece.columns) if i not in (at, id_at)]
            yield pa.RecordBatch.from_arrays([*columns, lists, collapsed], schema.names)

    return staged.mapInArrow(run, schema)


def digests(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Per row: number of runs, the run of the greatest exponent (ties: smallest start, then period) and digests."""
    best = F.aggregate(
        F.slice("runs", 2, F.greatest(F.size("runs"), F.lit(1))),
        F.try_element_at("runs", F.lit(1)),
        # lengths and periods are below 2^31: products are exact; earlier runs win ties
        lambda a, b: F.when(b["length"] * a["period"] > a["length"] * b["period"], b).otherwise(a),
    )
    line = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    rows = found.withColumn("_best", best)
    return rows.select(
        id_col,
        F.size("runs").cast("long").alias("n_runs"),
        F.col("_best.start").alias("start"),
        F.col("_best.length").alias("length"),
        F.col("_best.period").alias("period"),
        F.expr("1000 * _best.length div _best.period").alias("exponent_milli"),
        F.sha2(F.array_join(line, ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )

"""Language identification by prediction by partial matching.

Each language has a byte model: contexts of up to ``ORDER`` bytes with the bytes
seen after them, in texts of that language. A byte is coded in the longest known
context; where it was not seen there, an escape is coded and the next shorter
context is asked, down to equal chances. The escape probability is that of
method C: kinds of bytes seen over all bytes seen and kinds. Statistics are
frozen after training, so the code length of a text in a language is the sum of
fixed costs, and the language with the shortest code is predicted.

All languages share one automaton: its states are the contexts of any language
(a set closed under dropping first or last bytes), the state after a byte is
the longest context that ends the text so far, and a table holds the exact cost
of every byte in every state for every language.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F, types as T

from socklens.llm.shared import stash
from socklens.llm.words import _bytes, mix, pieces

ORDER = 4  # bytes of the longest context
TRAIN_DOCS = 300  # texts a language learns from, at most
TRAIN_PIECES = 4  # pieces of a text it learns from, at most, spread over the whole text by hash
TRAIN_BYTES = 500  # bytes of a piece
LEAST_SEEN = 20  # a longer context is kept if it was seen so often, in all languages together
COUNT_TASKS = 4
PIECE_BYTES = 2 << 20  # of text whose lanes advance together
LANE = 1_024  # bytes a lane of the automaton scores
UNKNOWN = "und"


@dataclass
class Model:
    """Frozen statistics: ``step[state, symbol]``, ``cost[state * symbols + symbol, language]`` in bits."""

    languages: list[str]
    symbol: np.ndarray
    step: np.ndarray
    cost: np.ndarray

    def bits(self, data: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Code length of every text (bytes between ``ends``) in every language.

        Texts are cut into lanes, which advance side by side. The state depends
        on the last ``ORDER`` bytes alone, so a lane that begins inside a text
        reads that many bytes before without counting them.
        """
        n_texts, size = len(ends) - 1, np.diff(ends)
        out = np.zeros((n_texts, len(self.languages)))
        lanes = -(-size // LANE)
        owner = np.repeat(np.arange(n_texts), lanes)
        if not len(owner):
            return out
        first = np.cumsum(lanes) - lanes
        begin = ends[owner] + (np.arange(len(owner)) - first[owner]) * LANE
        end = np.minimum(begin + LANE, ends[owner + 1])
        symbols = np.append(self.symbol[data], 0)
        width = self.step.shape[1]
        state = np.zeros(len(owner), np.int64)
        flat = self.step.reshape(-1)
        for back in range(ORDER, 0, -1):
            at = begin - back
            inside = at >= ends[owner]
            state = np.where(inside, flat[state * width + symbols[np.where(inside, at, 0)]], state)
        order = np.argsort(begin - end, kind="stable")  # longest first, so that the active lanes are a prefix
        begin, end, state, owner = begin[order], end[order], state[order], owner[order]
        total = np.zeros((len(owner), len(self.languages)))
        length = end - begin
        for t in range(int(length[0])):
            active = int(np.searchsorted(-length, -t, "left"))
            at = state[:active] * width + symbols[begin[:active] + t]
            total[:active] += self.cost[at]
            state[:active] = flat[at]
        np.add.at(out, owner, total)
        return out


def spread_pieces(data: bytes) -> list[bytes]:
    """Up to ``TRAIN_PIECES`` pieces of a text, those with the smallest hashes of text and place."""
    places = np.arange(-(-len(data) // TRAIN_BYTES), dtype=np.uint64)
    order = np.argsort(mix(places + np.uint64(crc32(data) << 32)), kind="stable")[:TRAIN_PIECES]
    return [data[i * TRAIN_BYTES : (i + 1) * TRAIN_BYTES] for i in sorted(order.tolist())]


def train(docs: DataFrame, text: str = "text", lang: str = "lang", train_docs: int = TRAIN_DOCS) -> Model:
    """Learn from a bounded sample of ``docs``: per language the ``train_docs`` distinct texts with the smallest hash.

    Rows without text or language are not learnt from. Of each text
    ``TRAIN_PIECES`` pieces are learnt, which a hash picks from all over it. What comes to the
    driver are counts of contexts and bytes of the sample, which these bounds limit.
    """
    known = docs.where(F.col(lang).isNotNull() & (F.length(text) > 0)).select(
        F.col(lang).cast("string").alias("lang"), F.col(text).cast("string").alias("text"), F.xxhash64(text).alias("h")
    )
    # ranked within hash ranges first, so that no task ranks a whole language
    known = known.withColumn("range", F.col("h").bitwiseAND(F.lit(255)))
    least = known.groupBy("lang", "range", "h").agg(F.lit(1).alias("one"))
    near = Window.partitionBy("lang", "range").orderBy("h")
    far = Window.partitionBy("lang").orderBy("h")
    least = least.withColumn("n", F.row_number().over(near)).where(F.col("n") <= train_docs)
    least = least.withColumn("n", F.row_number().over(far)).where(F.col("n") <= train_docs).select("lang", "h")
    sample = known.join(F.broadcast(least), ["lang", "h"]).groupBy("lang", "h").agg(F.first("text").alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[tuple[str, bytes], int] = {}
        for batch in batches:
            for language, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for data in spread_pieces(value.encode()):
                    for n in range(1, ORDER + 2):
                        for i in range(len(data) - n + 1):
                            key = (language, data[i : i + n])
                            seen[key] = seen.get(key, 0) + 1
        languages, grams = [k[0] for k in seen], [k[1] for k in seen]
        yield pa.RecordBatch.from_arrays([pa.array(languages, pa.string()), pa.array(grams, pa.binary()), pa.array(list(seen.values()), pa.int64())], ["lang", "gram", "n"])

    # few tasks, as the sample is small and each sends what it counted
    counted = sample.select("lang", "text").coalesce(COUNT_TASKS).mapInArrow(count, "lang string, gram binary, n long")
    counts = stash(counted.groupBy("lang", "gram").agg(F.sum("n").alias("n")), "contexts")
    # only what follows a context that is kept
    kept = counts.groupBy("gram").agg(F.sum("n").alias("n")).where((F.length("gram") == 1) | (F.col("n") >= LEAST_SEEN))
    context = F.substring(F.col("gram"), F.lit(1), F.length("gram") - 1)
    follow = counts.join(kept.select(F.col("gram").alias("context")), context == F.col("context"), "left_semi")
    return build(counts.where(F.length("gram") == 1).unionByName(follow).toPandas())


def build(counts: pd.DataFrame, least_seen: int = LEAST_SEEN) -> Model:
    """The automaton from (lang, gram, n): how often a context with the byte after it stands in texts of a language."""
    languages = sorted(counts["lang"].unique())
    number = {language: i for i, language in enumerate(languages)}
    grams: dict[bytes, np.ndarray] = {}
    for language, gram, n in zip(counts["lang"], counts["gram"], counts["n"]):
        grams.setdefault(bytes(gram), np.zeros(len(languages), np.float32))[number[language]] += n
    letters = sorted({g[0] for g in grams if len(g) == 1})
    symbol = np.zeros(256, np.int64)  # 0 stands for all bytes that were never seen
    symbol[letters] = np.arange(1, len(letters) + 1)
    contexts = {b""} | {g for g, n in grams.items() if len(g) <= ORDER and (len(g) == 1 or n.sum() >= least_seen)}
    states = sorted(contexts, key=lambda c: (len(c), c))
    # closed already: what is seen less often than its parts is never longer than they
    place = {c: i for i, c in enumerate(states)}
    width = len(letters) + 1
    seen = np.zeros((len(states), width, len(languages)), np.float32)
    for gram, n in grams.items():
        if gram[:-1] in place:
            seen[place[gram[:-1]], symbol[gram[-1]]] = n
    chance = np.empty_like(seen)
    step = np.zeros((len(states), width), np.int64)
    for i, context in enumerate(states):
        shorter = chance[place[context[1:]]] if context else np.full((width, len(languages)), 1 / 256, np.float32)
        total, kinds = seen[i].sum(0), (seen[i] > 0).sum(0)
        both = np.maximum(total + kinds, 1)
        escape = np.where(total > 0, kinds / both, 1.0)
        chance[i] = np.where(seen[i] > 0, seen[i] / both, escape * shorter)
        for letter in letters:
            follow = (context + bytes([letter]))[-ORDER:]
            while follow not in place:
                follow = follow[1:]
            step[i, symbol[letter]] = place[follow]
    return Model(languages, symbol, step, -np.log2(chance).reshape(len(states) * width, len(languages)).astype(np.float32))


def predict(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """Add ``lang_pred`` and ``score`` to every row of ``docs``, from its whole text alone.

    ``score`` is the probability of the predicted language among all, each
    byte-averaged code length taken over at most 32 bytes' worth of evidence,
    so long texts still differ. Equal code lengths go to the first language in
    order of name. ``und`` with score 0 where the text is null or has no letter,
    or nothing was learnt. Rows and their other columns stay, columns named
    like the added ones are replaced; no rows give none.
    """
    spark: SparkSession = docs.sparkSession
    docs = docs.drop(*[c for c in docs.columns if c.lower() in ("lang_pred", "score")])
    value = F.coalesce(F.col(text).cast("string"), F.lit(""))
    docs = docs.withColumns({"__text": value, "__letter": value.rlike(r"\p{L}")})
    rest = [f for f in docs.schema.fields if f.name not in ("__text", "__letter")]
    schema = T.StructType([*rest, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    shared = spark.sparkContext.broadcast(model)
    at, letter = docs.columns.index("__text"), docs.columns.index("__letter")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for piece in pieces(batches, at, PIECE_BYTES):
            data, ends = _bytes(piece.column(at))
            has_letter = piece.column(letter).to_numpy(zero_copy_only=False)
            if model.languages:
                bits = model.bits(data, ends)
                best = bits.argmin(1)
                size = np.maximum(np.diff(ends), 1)
                more = (bits - bits.min(1, keepdims=True)) * (np.minimum(size, 32) / size)[:, None]
                score = 1 / np.exp2(-more).sum(1)
                names = np.where(has_letter, np.array(model.languages, object)[best], UNKNOWN)
            else:
                names, score = np.full(piece.num_rows, UNKNOWN, object), np.zeros(piece.num_rows)
            columns = [c for i, c in enumerate(piece.columns) if i not in (at, letter)]
            added = [pa.array(names, pa.string()), pa.array(np.where(has_letter, score, 0.0), pa.float64())]
            yield pa.RecordBatch.from_arrays([*columns, *added], schema.names)

    return docs.mapInArrow(run, schema)

"""Quality classification by co-training of a text view and a metadata view.

The text view sees which words a document holds and how it is written (shares
of each ASCII character, capitals, digits, distinct words); the metadata view
sees its source, language and length. Both are logistic regressions. In each
round every view scores unlabelled documents and hands the other the ones it is
surest of, as pseudo-labels; a view that is never sure hands over nothing. Each
view is calibrated on labelled documents that neither learnt from, the
calibrated views are combined there, and the combination scores all documents.

The models are fitted in one task from bounded samples: ``LABELLED`` labelled
and ``POOL`` unlabelled documents, those with the smallest hashes of id and text.
Only the fitted model comes to the driver.
Scoring is one narrow pass over all documents and whole texts.
"""

from __future__ import annotations

import hashlib
import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F, types as T

from socklens.llm.shared import apart, whole_text
from socklens.llm.words import Words, _bytes, mix, pieces

LABELLED = 8_000
POOL = 4_000
WORD_BITS = 18
MOST_WORDS = 700  # words the text view weighs: those whose presence differs most between the classes
LEAST_Z = 4.0
ROUNDS = 3
SURE = 0.98
HANDED = 500  # pseudo-labels a view hands over per round and class, at most
CALIBRATE = 4  # every so many-th labelled document calibrates and teaches nothing
REJECT_BELOW = 0.5
SHAPE = 128 + 5
META_BITS = 10
_SAMPLE = [
    ("h", pa.int64()), ("known", pa.bool_()), ("good", pa.int32()),
    ("words", pa.list_(pa.int32())), ("shape", pa.list_(pa.float32())), ("meta", pa.list_(pa.int32())),
]
SAMPLE = "h long, known boolean, good int, words array<int>, shape array<float>, meta array<int>"


def shape_features(texts: pa.Array, words: Words) -> np.ndarray:
    """Per text: share of every ASCII character that is neither letter nor digit, then capitals, digits, distinct words, word length, length."""
    data, ends = _bytes(texts)
    n = len(texts)
    owner = np.repeat(np.arange(n), np.diff(ends))
    counts = np.bincount(owner * 256 + data, minlength=256 * n).reshape(n, 256).astype(np.float32)
    size = np.maximum(counts.sum(1), 1)
    upper, digit, lower = counts[:, 65:91].sum(1), counts[:, 48:58].sum(1), counts[:, 97:123].sum(1)
    out = np.zeros((n, SHAPE), np.float32)
    out[:, :128] = np.log1p(100 * counts[:, :128] / size[:, None])
    out[:, 48:58] = out[:, 65:91] = out[:, 97:123] = 0
    n_words = np.diff(words.first)
    each = np.repeat(np.arange(n), n_words)
    distinct = np.bincount(np.unique((each << WORD_BITS) | word_features(words)) >> WORD_BITS, minlength=n)
    out[:, 128] = upper / np.maximum(upper + lower, 1)
    out[:, 129] = digit / size
    out[:, 130] = distinct / np.maximum(n_words, 1)
    out[:, 131] = np.log1p(size / np.maximum(n_words, 1))
    out[:, 132] = np.log1p(size)
    return out


def word_features(words: Words) -> np.ndarray:
    return (words.hash >> np.uint64(64 - WORD_BITS)).astype(np.int64)


def meta_features(source: pa.Array, lang: pa.Array, size: np.ndarray) -> np.ndarray:
    """Cells of the whole source, the whole language and the length class (powers of two), by hash; nulls are values of their own."""
    cells = []
    for column, turn in ((source, 1), (lang, 2)):
        kinds = pc.dictionary_encode(pc.cast(column, pa.string()), null_encoding="encode")
        named = [b"" if k is None else b"=" + k.encode() for k in kinds.dictionary.to_pylist()]
        hashes = [int.from_bytes(hashlib.blake2b(k, digest_size=8, salt=bytes([turn])).digest()) for k in named]
        cells.append(np.array(hashes, np.uint64)[kinds.indices.to_numpy(zero_copy_only=False)])
    cells.append(mix(np.floor(np.log2(size + 1)).astype(np.uint64) + np.uint64(1 << 20)))
    return np.stack([(c >> np.uint64(64 - META_BITS)).astype(np.int32) for c in cells], axis=1)


@dataclass
class Logistic:
    """P(good) = sigmoid(x w + b) for standardised x."""

    weights: np.ndarray
    bias: float
    mean: np.ndarray
    scale: np.ndarray

    def logit(self, x: np.ndarray) -> np.ndarray:
        slope = (self.weights / self.scale).astype(np.float32)
        return x.astype(np.float32, copy=False) @ slope + (self.bias - float(self.mean / self.scale @ self.weights))


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def fit(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3, steps: int = 250) -> Logistic:
    """Logistic regression by accelerated gradient steps, deterministic; columns that never vary weigh nothing."""
    mean = x.mean(0, dtype=np.float64)
    scale = np.sqrt(np.maximum([np.dot(c := x[:, k] - mean[k], c) / len(x) for k in range(x.shape[1])], 0))  # a column at a time
    used = np.flatnonzero(scale > 1e-6)
    scale = np.where(scale > 1e-6, scale, 1.0)
    z = x[:, used].astype(np.float32)  # the one copy; everything else is a vector
    z -= mean[used].astype(np.float32)
    z /= scale[used].astype(np.float32)
    y = y.astype(np.float32)
    n, d = z.shape
    probe, top = np.ones(d, np.float32) / np.sqrt(max(d, 1)), 1.0
    for _ in range(20):  # largest eigenvalue, which bounds the step
        probe = z.T @ (z @ probe) / n
        top = float(np.linalg.norm(probe)) or 1.0
        probe = (probe / top).astype(np.float32)
    rate = np.float32(1 / (0.3 * (top + 1) + ridge))
    prior = float(np.clip(y.mean(), 1e-3, 1 - 1e-3))
    w, b = np.zeros(d, np.float32), np.float32(np.log(prior / (1 - prior)))
    ahead_w, ahead_b = w, b
    for k in range(steps):
        error = sigmoid(z @ ahead_w + ahead_b) - y
        new_w = ahead_w - rate * (z.T @ error / np.float32(n) + np.float32(ridge) * ahead_w)
        new_b = ahead_b - rate * error.mean()
        push = np.float32(k / (k + 3))
        ahead_w, ahead_b = new_w + push * (new_w - w), new_b + push * (new_b - b)
        w, b = new_w, new_b
    weights = np.zeros(x.shape[1])
    weights[used] = w
    return Logistic(weights, float(b), mean, scale)


@dataclass
class QualityModel:
    """Both views and their combination; ``constant`` instead where the labels have one class only."""

    constant: float | None
    place: np.ndarray | None = None  # word cell to column of the text view, or -1
    n_words: int = 0
    text: Logistic | None = None
    meta: Logistic | None = None
    joint: Logistic | None = None
    meta_place: np.ndarray | None = None  # cell to column of the metadata view, or -1

    def text_matrix(self, words: list[np.ndarray], shape: np.ndarray) -> np.ndarray:
        return text_matrix(words, shape, self.place, self.n_words)

    def score(self, text: np.ndarray, meta: np.ndarray) -> np.ndarray:
        both = np.stack([self.text.logit(text), self.meta.logit(meta)], axis=1)
        return sigmoid(self.joint.logit(both))


def text_matrix(words: list[np.ndarray], shape: np.ndarray, place: np.ndarray, n_words: int) -> np.ndarray:
    out = np.zeros((len(words), n_words + SHAPE), np.float32)
    for i, cells in enumerate(words):
        at = place[cells]
        out[i, at[at >= 0]] = 1
    out[:, n_words:] = shape
    return out


def meta_matrix(cells: np.ndarray, place: np.ndarray) -> np.ndarray:
    """``place``: cell to column of the metadata view, or -1 for cells of no document of the samples."""
    out = np.zeros((len(cells), place.max(initial=-1) + 1), np.float32)
    for k in range(3):
        at = place[(k << META_BITS) + cells[:, k]]
        out[np.flatnonzero(at >= 0), at[at >= 0]] = 1
    return out


def _batch_features(batch: pa.RecordBatch, at: dict[str, int]) -> tuple[Words, np.ndarray, np.ndarray]:
    texts = batch.column(at["text"])
    words = Words(pc.utf8_lower(texts))
    size = np.diff(_bytes(texts)[1])
    meta = meta_features(batch.column(at["source"]), batch.column(at["lang"]), size)
    return words, shape_features(texts, words), meta


def sample_features(docs: DataFrame) -> DataFrame:
    """(h, known, good, words, shape, meta) of a sample; ``docs`` has h, known, good, text, source and lang."""
    at = {"text": 3, "source": 4, "lang": 5}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, at["text"]):
            words, shape, meta = _batch_features(piece, at)
            cells = word_features(words).astype(np.int32)
            held = [np.unique(cells[a:b]) for a, b in zip(words.first[:-1], words.first[1:])]
            columns = [*piece.columns[:3], pa.array(held, pa.list_(pa.int32())), pa.array(list(shape), pa.list_(pa.float32())), pa.array(list(meta), pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays(columns, ["h", "known", "good", "words", "shape", "meta"])

    columns = docs.select("h", "known", "good", "text", "source", "lang")
    return columns.mapInArrow(run, SAMPLE)


def sample(docs: DataFrame, ids: DataFrame, n: int) -> DataFrame:
    """The documents of the ``n`` ids with the smallest hashes, equal rows once, with a hash ``h``.

    ``ids`` has doc_id and good. Ids are chosen without their texts and sent to
    all tasks, ``n`` rows at most, so no text is shuffled but those of the sample.
    """
    least = ids.distinct().orderBy(F.xxhash64("doc_id"), "doc_id", "good").limit(n)
    return docs.join(F.broadcast(least), "doc_id").withColumn("h", F.xxhash64("doc_id", "text", "good")).dropDuplicates(["h"])


def train(docs: DataFrame, labels: DataFrame, labelled: int = LABELLED, pool: int = POOL, rounds: int = ROUNDS) -> QualityModel:
    """Co-train on ``labels`` (doc_id, quality, toxic): a document is good if its quality is 1 and it is not toxic.

    Labels with a null id, quality or toxicity are left out. With labels of one
    class or none, every document gets the share of good ones among them (1
    without any), so nothing is rejected for want of examples.
    """
    marked = labels.select("doc_id", ((F.col("quality") == 1) & (F.col("toxic") == 0)).cast("int").alias("good")).dropna()
    base = docs.select("doc_id", whole_text().alias("text"), F.col("source").cast("string"), F.col("lang").cast("string"))
    ids = base.select("doc_id")
    known = sample(base, ids.join(marked, "doc_id"), labelled).withColumn("known", F.lit(True))
    others = ids.where("doc_id IS NOT NULL").join(marked, "doc_id", "left_anti").withColumn("good", F.lit(0))
    free = sample(base, others, pool).withColumn("known", F.lit(False))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(batches, schema=pa.schema(_SAMPLE)).sort_by("h")
        known = pc.equal(rows["known"], True)
        model = fit_views(rows.filter(known), rows.filter(pc.invert(known)), rounds)
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(model)], pa.binary())], ["model"])

    # at most labelled + pool rows of features, whatever the size of the table
    fitted = sample_features(known.unionByName(free)).repartition(1).mapInArrow(run, "model binary")
    row = fitted.first()
    return pickle.loads(row.model) if row else QualityModel(1.0)


def fit_views(known: pa.Table, free: pa.Table, rounds: int = ROUNDS) -> QualityModel:
    """The model of labelled and unlabelled samples with the columns of :func:`sample_features`."""
    good = known["good"].to_numpy()
    if len(np.unique(good)) < 2 or len(good) < 2 * CALIBRATE:
        return QualityModel(float(good.mean()) if len(good) else 1.0)
    return co_train(known, free, rounds)


def co_train(known: pa.Table, free: pa.Table, rounds: int = ROUNDS) -> QualityModel:
    y = known["good"].to_numpy().astype(float)
    holds = np.arange(len(y)) % CALIBRATE == 0
    place, n_words = choose_words([w for w, h in zip(_lists(known["words"]), holds) if not h], y[~holds])

    meta_place = np.full(3 << META_BITS, -1, np.int64)
    seen = [_rows(f["meta"], 3) + (np.arange(3) << META_BITS) for f in (known, free)]
    used = np.unique(np.concatenate(seen))
    meta_place[used] = np.arange(len(used))

    def matrices(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        shape, meta = _rows(table["shape"], SHAPE), _rows(table["meta"], 3)
        return text_matrix(_lists(table["words"]), shape, place, n_words), meta_matrix(meta, meta_place)

    views, pool = matrices(known), matrices(free)
    own_x = [v[~holds] for v in views]
    handed: list[dict[int, float]] = [{}, {}]  # what the view learns from the other: row of the pool to label
    models = [fit(x, y[~holds]) for x in own_x]
    for _ in range(rounds if free.num_rows else 0):
        for view in (0, 1):
            scale = fit(models[view].logit(views[view][holds])[:, None], y[holds], ridge=1e-6)
            p = sigmoid(scale.logit(models[view].logit(pool[view])[:, None]))
            other = handed[1 - view]
            for label, sure in ((1.0, p), (0.0, 1 - p)):
                fresh = [int(i) for i in np.argsort(-sure, kind="stable") if sure[i] >= SURE and int(i) not in other]
                other.update(dict.fromkeys(fresh[:HANDED], label))
        for view in (0, 1):
            rows = np.array(list(handed[view]), int)
            x = np.concatenate([own_x[view], pool[view][rows]])
            models[view] = fit(x, np.concatenate([y[~holds], list(handed[view].values())]))
    both = np.stack([m.logit(v[holds]) for m, v in zip(models, views)], axis=1)
    return QualityModel(None, place, n_words, models[0], models[1], fit(both, y[holds], ridge=1e-6), meta_place)


def _lists(column: pa.ChunkedArray) -> list[np.ndarray]:
    whole = column.combine_chunks()
    flat, ends = whole.flatten().to_numpy(zero_copy_only=False), whole.offsets.to_numpy()
    return np.split(flat, ends[1:-1] - ends[0]) if len(whole) else []


def _rows(column: pa.ChunkedArray, width: int) -> np.ndarray:
    return column.combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def choose_words(words: list[np.ndarray], y: np.ndarray) -> tuple[np.ndarray, int]:
    """(cell to column, columns): the cells whose presence tells the classes apart most surely."""
    cells = 1 << WORD_BITS
    held = np.zeros((2, cells))
    for w, label in zip(words, y):
        held[int(label), w] += 1
    n = np.array([(y == 0).sum(), (y == 1).sum()])
    share, both = held / n[:, None], held.sum(0) / n.sum()
    z = np.abs(share[1] - share[0]) / np.sqrt(np.maximum(both * (1 - both), 1e-12) * (1 / n).sum())
    best = np.argsort(-z, kind="stable")[:MOST_WORDS]
    best = best[z[best] >= LEAST_Z]
    place = np.full(cells, -1, np.int64)
    place[best] = np.arange(len(best))
    return place, len(best)


def classify(docs: DataFrame, model: QualityModel) -> DataFrame:
    """Add ``quality_score`` (0 to 1) and ``kept`` (from ``REJECT_BELOW`` on) to every row of ``docs``.

    A null text counts as empty, null source and language as values of their
    own; equal rows get equal scores. Rows and their other columns stay, columns
    named like the added ones are replaced; no rows give none.
    """
    docs, back = apart(docs, "text", "source", "lang")
    added = [T.StructField("quality_score", T.DoubleType()), T.StructField("kept", T.BooleanType())]
    schema = T.StructType([*docs.schema.fields, *added])
    staged = docs.withColumn("__text", whole_text())
    at = {name: staged.columns.index(c) for name, c in (("text", "__text"), ("source", "source"), ("lang", "lang"))}
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for piece in pieces(batches, at["text"]):
            if model.constant is None:
                words, shape, meta = _batch_features(piece, at)
                cells = word_features(words)
                held = [cells[a:b] for a, b in zip(words.first[:-1], words.first[1:])]
                score = model.score(model.text_matrix(held, shape), meta_matrix(meta, model.meta_place))
            else:
                score = np.full(piece.num_rows, model.constant)
            columns = [c for i, c in enumerate(piece.columns) if i != at["text"]]
            kept = score >= REJECT_BELOW if model.constant is None else np.ones(piece.num_rows, bool)
            yield pa.RecordBatch.from_arrays([*columns, pa.array(score, pa.float64()), pa.array(kept)], schema.names)

    return back(staged.mapInArrow(run, schema), ["quality_score", "kept"])

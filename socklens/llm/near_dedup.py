"""Near-duplicate documents by BagMinHash signatures, banding and exact multiset overlap.

Texts are multisets of shingles of ``SHINGLE`` words; two texts are linked from
``SIMILARITY`` on, by the weighted Jaccard similarity of these multisets.
Equal texts are one node. Texts that share a band of the signature are
candidates: with ``BANDS`` bands of ``ROWS`` components a pair at the threshold
shares none with a probability of 2e-5, and a more similar pair less.

A bucket of candidates is not expanded into all pairs at first. Every text is
compared with one centre of its bucket, the text that shares most with all of
its buckets; that links most groups whole. What is left are texts in one bucket
that are not connected yet. All these pairs are compared, so that no link between
parts that are not connected otherwise is lost, but first inside the join by
sketches: one bit of each of ``SKETCH`` further components. Only pairs whose
sketches differ by less than a linked pair's may (four standard deviations) come
out of the join and are verified on their texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from socklens.llm.bagminhash import bands, signature
from socklens.llm.shared import apart, components, stash, text_key, whole_text
from socklens.llm.words import Words, mix, pieces

SHINGLE = 5
SIMILARITY = 0.8
BANDS = 28
ROWS = 5
SKETCH = 2_048


def multisets(texts: pa.Array, shingle: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(distinct shingles, times) of every text."""
    hashes, first = Words(texts).shingles(shingle)
    for a, b in zip(first[:-1], first[1:]):
        yield np.unique(hashes[a:b], return_counts=True)


def overlap(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity of two multisets; 0 if both are empty."""
    both, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    common = int(np.minimum(a[1][i], b[1][j]).sum())
    union = int(a[1].sum() + b[1].sum()) - common
    return common / union if union else 0.0


def sign(docs: DataFrame, text: str = "text", shingle: int = SHINGLE, n_bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(node, weight, bands): per row, the key of its text, its number of shingles and its bands; none for a text without words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, 1):
            weights, found = [], []
            for elements, counts in multisets(piece.column(1), shingle):
                weights.append(int(counts.sum()))
                found.append(bands(signature(elements, counts, n_bands * rows), rows) if len(elements) else [])
            columns = [piece.column(0), pa.array(weights, pa.int64()), pa.array(found, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, ["node", "weight", "bands"])

    keyed = docs.select(text_key(whole_text(text)).alias("node"), F.lower(whole_text(text)).alias("text"))
    return keyed.mapInArrow(run, "node binary, weight long, bands array<long>")


def sketch(texts: DataFrame, shingle: int) -> DataFrame:
    """(node, sketch): the lowest bit of each of ``SKETCH`` components of a signature, in 64-bit words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, 1):
            bits = [mix(signature(*m, SKETCH)) & np.uint64(1) for m in multisets(piece.column(1), shingle)]
            packed = [np.packbits(b.astype(np.uint8)).view(np.int64) for b in bits]
            yield pa.RecordBatch.from_arrays([piece.column(0), pa.array(packed, pa.list_(pa.int64()))], ["node", "sketch"])

    return texts.select("node", "text").mapInArrow(run, "node binary, sketch array<long>")


def _close(a: Column, b: Column, similarity: float) -> Column:
    """Whether two sketches can be those of a linked pair: bits of components differ in half of the cases where these do."""
    share = (1 - similarity) / 2
    most = SKETCH * share + 4 * (SKETCH * share * (1 - share)) ** 0.5
    return sum((F.bit_count(a[i].bitwiseXOR(b[i])) for i in range(SKETCH // 64)), F.lit(0)) <= most


def _comparable(a: Column, b: Column, similarity: float) -> Column:
    """The smaller weight bounds what can be common, the larger the union."""
    return F.least(a, b) >= similarity * F.greatest(a, b)


def verify(pairs: DataFrame, texts: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """The pairs (a, b) whose texts overlap enough, with their ``similarity``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, 2):
            both = zip(multisets(piece.column(2), shingle), multisets(piece.column(3), shingle))
            value = np.array([overlap(x, y) for x, y in both])
            keep = pa.array(value >= similarity)
            columns = [piece.column(0), piece.column(1), pa.array(value, pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, ["a", "b", "similarity"]).filter(keep)

    left, right = texts.select(F.col("node").alias("a"), F.col("text").alias("x")), texts.select(F.col("node").alias("b"), F.col("text").alias("y"))
    joined = pairs.select("a", "b").join(left, "a").join(right, "b").select("a", "b", "x", "y")
    return joined.mapInArrow(run, "a binary, b binary, similarity double")


def links(docs: DataFrame, text: str = "text", shingle: int = SHINGLE, similarity: float = SIMILARITY, n_bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(a, b, similarity) between keys of different texts: enough of all links to connect what any link connects."""
    signed = stash(sign(docs, text, shingle, n_bands, rows), "signatures").dropDuplicates(["node"])
    banded = signed.select("node", "weight", F.explode("bands").alias("bucket"))
    shared = banded.groupBy("bucket").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    members = stash(banded.join(shared, "bucket"), "buckets")
    score = members.groupBy("node").agg(F.sum("size").alias("score"))
    centre = members.join(score, "node").groupBy("bucket").agg(F.max(F.struct("score", "node", "weight")).alias("centre"))
    star = members.join(centre, "bucket").where(
        (F.col("node") != F.col("centre.node")) & _comparable(F.col("weight"), F.col("centre.weight"), similarity)
    )
    star = stash(star.select(F.col("node").alias("a"), F.col("centre.node").alias("b")).distinct(), "star")
    wanted = members.select("node").distinct()
    keyed = docs.select(text_key(whole_text(text)).alias("node"), F.lower(whole_text(text)).alias("text"))
    texts = stash(keyed.join(wanted, "node", "left_semi").groupBy("node").agg(F.first("text").alias("text")), "texts")
    linked = stash(verify(star, texts, shingle, similarity), "links")

    parts = components(linked, "parts")
    placed = members.join(parts, "node", "left").select("bucket", "node", "weight", F.coalesce("component", "node").alias("part"))
    open_ = placed.groupBy("bucket").agg(F.min("part").alias("lo"), F.max("part").alias("hi")).where("lo <> hi").select("bucket")
    placed = stash(placed.join(open_, "bucket", "left_semi"), "open")
    sketched = stash(sketch(texts.join(placed.select("node").distinct(), "node", "left_semi"), shingle), "sketches")
    placed = placed.join(sketched, "node").join(signed.select("node", "bands"), "node")
    columns = ("node", "weight", "part", "sketch", "bands")
    x = placed.select("bucket", *[F.col(c).alias(n) for c, n in zip(columns, "aupkm")])
    y = placed.select("bucket", *[F.col(c).alias(n) for c, n in zip(columns, "bvqln")])
    possible = _comparable(F.col("u"), F.col("v"), similarity) & _close(F.col("k"), F.col("l"), similarity)
    # a pair comes out of the first bucket it shares
    first = F.array_min(F.array_intersect("m", "n")) == F.col("bucket")
    rest = x.join(y, "bucket").where((F.col("p") < F.col("q")) & possible & first)
    done = star.unionByName(star.select(F.col("b").alias("a"), F.col("a").alias("b")))
    rest = rest.select("a", "b").distinct().join(done, ["a", "b"], "left_anti")
    return linked.unionByName(stash(verify(rest, texts, shingle, similarity), "links"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """All rows of ``docs`` with ``class_id``, ``class_size`` and ``kept``.

    A class holds all documents that links and equal texts connect. ``class_id``
    is its smallest id (null if it has null ids only), ``class_size`` its rows;
    ``kept`` marks one text of it, the one with the smallest id, nulls last and
    ties by the key of the text. Rows that share both that id and that text are
    all kept, as nothing tells them apart. Case and what stands between words do
    not count for links. A text with fewer than ``SHINGLE`` words is one shingle;
    texts without words, null or empty, are linked by equality only, null
    counting as empty. No rows give no rows. Columns named like the added ones
    are replaced.
    """
    added = ("class_id", "class_size", "kept")
    docs, back = apart(docs, id_col, text)
    parts = components(links(docs, text, **options))
    keyed = docs.withColumn("__node", text_key(whole_text(text)))
    nodes = keyed.groupBy(F.col("__node").alias("node")).agg(F.min(id_col).alias("id"), F.count(F.lit(1)).alias("n"))
    nodes = stash(nodes.join(parts, "node", "left").select("node", "id", "n", F.coalesce("component", "node").alias("part")), "nodes")
    kept = F.min(F.struct(F.col("id").isNull(), F.col("id"), F.col("node")))
    classes = nodes.groupBy("part").agg(F.min("id").alias("class_id"), F.sum("n").alias("class_size"), kept.alias("first"))
    known = nodes.join(classes, "part").select(
        F.col("node").alias("__same"), "class_id", "class_size", (F.col("node") == F.col("first.node")).alias("__first"), F.col("id").alias("__id")
    )
    out = keyed.join(known, F.col("__node") == F.col("__same"))
    kept = F.col("__first") & F.col(id_col).eqNullSafe(F.col("__id"))
    return back(out.withColumn("kept", kept), added)

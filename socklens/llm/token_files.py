"""Token ids of a corpus in Huffman-coded block files.

Files hold the ids of all documents in ascending order of document id, each
document followed by an end id. Layout of a folder:

- ``codebook``: (id, bits), the code length of every id; canonical codes follow from it.
- ``blocks``: one row per block of whole documents: ``part`` and ``block``, their
  ascending place; ``before``, the ids of the part before it; the ids and sizes
  of its documents; ``bits``, the coded ids; ``offsets``, a bit offset for every
  ``huffman.LANE``-th id.

Blocks are decoded independently of each other.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from socklens.llm.huffman import LIMIT, Codebook, code_lengths
from socklens.llm.pretokens import PieceCache, split
from socklens.llm.shared import stash, whole_text

BLOCK_IDS = 65_536  # a block is closed beyond; a longer document is a block
PART_IDS = 16_000_000  # ids of a part, about
TOKENS = "doc_id long, ids binary"
BLOCKS = (
    "part int, block int, before long, doc_ids array<long>, sizes array<int>, bits binary, offsets array<int>"
)
CODED = "doc_id long, start long, n_tokens long, ids binary"


class LibraryEncoder:
    """Ids of a text by the tokenizers library: its byte-level BPE model encodes every distinct piece once.

    The model takes a piece with every byte as the printable character that
    stands for it: itself where it has one, the next from U+0100 on otherwise.
    Texts are cut at the tokenizer's added tokens first, the longest where several
    begin at one place; those that take spaces with them or want whole words are
    left to the library.
    """

    def __init__(self, path: str, packed_as: str = "<u4"):
        from tokenizers import Tokenizer

        self.packed_as = packed_as
        self.library = Tokenizer.from_file(path)
        self.model = self.library.model
        added = self.library.get_added_tokens_decoder()
        self.added = {t.content: np.array([i], packed_as).tobytes() for i, t in added.items()}
        self.plain = not any(t.lstrip or t.rstrip or t.single_word for t in added.values())
        longest = sorted(self.added, key=len, reverse=True)
        self.find = re.compile(f"({'|'.join(map(re.escape, longest))})") if longest else None
        printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
        others = iter(range(256, 512))
        self.letters = {b: b if b in printable else next(others) for b in range(256)}
        self.cache = PieceCache(self._piece)

    def _piece(self, piece: str) -> bytes:
        letters = piece.encode().decode("latin-1").translate(self.letters)
        return np.array([t.id for t in self.model.tokenize(letters)], self.packed_as).tobytes()

    def encode(self, text: str) -> bytes:
        """The packed ids of a text in which strings of added tokens are ordinary text."""
        return b"".join(map(self.cache.__getitem__, split(text)))

    def encode_marked(self, text: str) -> bytes:
        """The packed ids of a text as the library gives them by default, with the ids of added tokens where they stand."""
        if not any(token in text for token in self.added):
            return self.encode(text)
        if not self.plain:
            return np.array(self.library.encode(text, add_special_tokens=False).ids, self.packed_as).tobytes()
        parts = self.find.split(text)  # every second one is an added token
        return b"".join(self.added[part] if k % 2 else self.encode(part) for k, part in enumerate(parts))


@lru_cache(maxsize=2)
def _encoder(path: str, packed_as: str) -> LibraryEncoder:
    return LibraryEncoder(path, packed_as)


def packing(path: str, end_id: int) -> str:
    """Two bytes an id where the whole vocabulary fits, else four."""
    from tokenizers import Tokenizer

    return "<u2" if max(*Tokenizer.from_file(path).get_vocab().values(), end_id) < 1 << 16 else "<u4"


def tokenize(
    docs: DataFrame, path: str, end_id: int = 0, id_col: str = "doc_id", text: str = "text", packed_as: str = "<u4"
) -> DataFrame:
    """(doc_id, ids): the ids of every whole text and ``end_id``, packed as unsigned little-endian integers.

    Added tokens of the tokenizer have their own ids, as by default in the library.
    A null or empty text has the end id alone.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, end = _encoder(path, packed_as), np.array([end_id], packed_as).tobytes()
        for batch in batches:
            packed = [encoder.encode_marked(text) + end for text in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(packed, pa.binary())], ["doc_id", "ids"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), whole_text(text).alias("text")).mapInArrow(run, TOKENS)


def _together(packed: pa.Array, packed_as: str) -> np.ndarray:
    """The ids of all rows of a batch, without copying them."""
    _, offsets, data = packed.buffers()
    if data is None or not len(packed):
        return np.zeros(0, packed_as)
    ends = np.frombuffer(offsets, np.int32)[packed.offset : packed.offset + len(packed) + 1]
    return np.frombuffer(data, packed_as, count=int(ends[-1] - ends[0]) // np.dtype(packed_as).itemsize, offset=int(ends[0]))


def count_ids(tokens: DataFrame, packed_as: str) -> DataFrame:
    """(id, n): how often every id occurs in all documents; each task sends its counts once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(0, np.int64)
        for batch in batches:
            own = np.bincount(_together(batch.column(0), packed_as), minlength=len(counts))
            own[: len(counts)] += counts
            counts = own
        used = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(counts[used])], ["id", "n"])

    return tokens.select("ids").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))


def write_token_files(
    docs: DataFrame, folder: str, tokenizer: str, end_id: int = 0, id_col: str = "doc_id", text: str = "text"
) -> None:
    """Encode every whole text and write the files to ``folder``, which must be shared.

    Documents are in ascending order of id, null ids first; rows of one id are
    ordered by their ids of tokens. The counts that come to the driver have at
    most one row per id of the vocabulary. No rows give a folder without blocks.
    """
    spark = docs.sparkSession
    packed_as = packing(tokenizer, end_id)
    width = np.dtype(packed_as).itemsize
    tokens = stash(tokenize(docs, tokenizer, end_id, id_col, text, packed_as), "tokens")
    counted = count_ids(tokens, packed_as).toPandas()
    counts = np.zeros(int(counted["id"].max()) + 1 if len(counted) else 1, np.int64)
    counts[counted["id"]] = counted["n"]
    limit = max(LIMIT, int(np.count_nonzero(counts)).bit_length())
    lengths = code_lengths(counts, limit)
    rows = [(int(i), int(lengths[i])) for i in np.flatnonzero(lengths)]
    spark.createDataFrame(rows, "id int, bits int").coalesce(1).write.parquet(f"{folder}/codebook")
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), int(counts.sum()) // PART_IDS + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        book, part = Codebook(lengths, limit), TaskContext.get().partitionId()
        block, before, doc_ids, held, size = 0, 0, [], [], 0

        def closed() -> pa.RecordBatch:
            sizes = [len(h) // width for h in held]
            bits, offsets = book.pack(np.frombuffer(b"".join(held), packed_as))
            columns = [
                pa.array([part], pa.int32()), pa.array([block], pa.int32()), pa.array([before], pa.int64()),
                pa.array([doc_ids], pa.list_(pa.int64())), pa.array([sizes], pa.list_(pa.int32())),
                pa.array([bits], pa.binary()), pa.array([offsets], pa.list_(pa.int32())),
            ]
            return pa.RecordBatch.from_arrays(columns, ["part", "block", "before", "doc_ids", "sizes", "bits", "offsets"])

        for batch in batches:
            for doc_id, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                doc_ids.append(doc_id)
                held.append(ids)
                size += len(ids) // width
                if size >= BLOCK_IDS:
                    yield closed()
                    block, before, doc_ids, held, size = block + 1, before + size, [], [], 0
        if held:
            yield closed()

    # rows of one id, null ids above all, are spread by the beginning of their ids of tokens
    ordered = tokens.repartitionByRange(parts, F.col("doc_id"), F.substring("ids", 1, 16)).sortWithinPartitions("doc_id", "ids")
    ordered.mapInArrow(run, BLOCKS).write.option("compression", "none").parquet(f"{folder}/blocks")


def read_token_files(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids) of all documents: the ids of all documents before, the own ones, and these packed."""
    book = spark.read.parquet(f"{folder}/codebook").toPandas()
    lengths = np.zeros(int(book["id"].max()) + 1 if len(book) else 1, np.uint8)
    lengths[book["id"]] = book["bits"]
    limit = max(LIMIT, int(lengths.max()), len(book).bit_length())
    blocks = spark.read.schema(BLOCKS).parquet(f"{folder}/blocks")
    ids_in = F.aggregate("sizes", F.lit(0).cast("long"), lambda total, n: total + n)
    totals = blocks.select("part", "sizes").groupBy("part").agg(F.sum(ids_in).alias("n"))
    # one row per part
    starts = totals.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("first"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Codebook(lengths, limit)
        for batch in batches:
            for i in range(batch.num_rows):
                sizes = batch["sizes"][i].values.to_numpy().astype(np.int64)
                ends = np.cumsum(sizes)
                ids = coder.unpack(batch["bits"][i].as_py(), batch["offsets"][i].values.to_numpy(), int(ends[-1])).astype("<u4")
                at = np.concatenate([[0], ends * 4]).astype(np.int32)
                packed = pa.BinaryArray.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(at), pa.py_buffer(ids)])
                columns = [batch["doc_ids"][i].values, pa.array(batch["first"][i].as_py() + ends - sizes), pa.array(sizes), packed]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "n_tokens", "ids"])

    placed = blocks.join(starts, "part").select((F.col("first") + F.col("before")).alias("first"), "doc_ids", "sizes", "bits", "offsets")
    return placed.mapInArrow(run, CODED)


def with_crc32(coded: DataFrame) -> DataFrame:
    """Replace the packed ids by their unsigned crc32."""
    return coded.withColumn("ids_crc32", F.crc32("ids")).drop("ids")

"""Search documents and bulk-load lines."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from socklens.catalog import FIELDS, TYPED_COLUMNS
from socklens.operators.conform import EXTRA, present_map, without
from socklens.settings import reachable

# -- fixed values: bulk action of an append-only index ---------------------
ACTION = '{"index":{}}'
# and the size of a request body, in rows and bytes, beyond which it is sent
BODY_ROWS = 10_000
BODY_BYTES = 5 << 20


def to_documents(df: DataFrame, mode: str = "json", keep: Iterable[str] = ()) -> DataFrame:
    """One JSON document per row in ``value``; NULL values have no key.

    ``json`` and ``spb`` documents hold every column, keys sorted, and the
    payload keys in ``_extra`` where there are any. ``pb``
    documents hold the columns of the typed row in its order, with 64-bit
    integers as strings.
    """
    keep = list(keep)
    if mode != "pb" and EXTRA in df.columns:
        return _with_extra(df, keep)
    if mode in ("json", "spb"):
        columns = [F.col(c) for c in sorted(set(df.columns) - set(keep))]
    elif mode == "pb":
        columns = [
            F.col(c).cast("string").alias(c) if c == "Timestamp" or (c in FIELDS and FIELDS[c].ctype == "u64") else F.col(c)
            for c in TYPED_COLUMNS
            if c in df.columns
        ]
    else:
        raise ValueError(f"unknown serialization: {mode}")
    return df.select(F.to_json(F.struct(*columns)).alias("value"), *keep)


def _with_extra(df: DataFrame, keep: list[str]) -> DataFrame:
    names = [c for c in df.columns if c not in keep and c != EXTRA]
    df = df.withColumn("_own", present_map({c: F.col(c) for c in names}, "variant"))
    df = df.withColumn("_all", F.map_concat("_own", without(F.col(EXTRA), F.col("_own"))))
    keys = F.array_sort(F.map_keys("_all"))
    ordered = F.map_from_arrays(keys, F.transform(keys, lambda k: F.element_at("_all", k)))
    return df.select(F.to_json(ordered).alias("value"), *keep)


def to_bulk_lines(documents: DataFrame, keep: Iterable[str] = ()) -> DataFrame:
    """Action line and document line in one value.

    Both lines stay in one row, so no repartitioning can part them.
    """
    return documents.select(F.concat(F.lit(ACTION + "\n"), F.col("value")).alias("value"), *keep)


def to_bulk_bodies(lines: DataFrame, rows: int = BODY_ROWS, most_bytes: int = BODY_BYTES) -> DataFrame:
    """Request bodies (``value``, ``rows``) of at most so many rows and bytes from the rows of :func:`to_bulk_lines`.

    Every task packs its rows in their order, by running sums of their bytes,
    and ends what it began; a row above the limit is a body of its own. A task
    holds one batch and one body.
    """
    if rows < 1 or most_bytes < 1:
        raise ValueError(f"a body holds at least a row and a byte: {rows}, {most_bytes}")
    reachable(lines.sparkSession)

    def body(parts: list[pa.Array]) -> pa.RecordBatch:
        texts = [t for part in parts for t in part.to_pylist()]
        return pa.RecordBatch.from_arrays([pa.array(["".join(f"{t}\n" for t in texts)]), pa.array([len(texts)], pa.int64())], ["value", "rows"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, count, size = [], 0, 0
        for batch in batches:
            values = batch.column(0).drop_null()
            sums = np.concatenate([[0], np.cumsum(pc.binary_length(values).to_numpy(zero_copy_only=False).astype(np.int64) + 1)])
            at = 0
            while at < len(values):
                fits = int(np.searchsorted(sums, sums[at] + most_bytes - size, "right")) - 1
                end = min(max(fits, at if held else at + 1), at + rows - count)
                if end > at:
                    held.append(values.slice(at, end - at))
                    count, size, at = count + end - at, size + int(sums[end] - sums[at]), end
                if at < len(values):
                    yield body(held)
                    held, count, size = [], 0, 0
        if held:
            yield body(held)

    # a filter on the value would move below the projections and work out every document once more
    return lines.select("value").mapInArrow(pack, "value string, rows long")

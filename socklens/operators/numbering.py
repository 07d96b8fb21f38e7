"""Numbering the rows of groups of any size, by prefix sums over ranges.

Rows are dealt out by ranges of (group, order), so a large group covers as many
tasks as its share of the rows asks for. Every task numbers its rows; only the
group a task begins with can have rows in the tasks before, so what the tasks
add up to is one number per task.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F, types as T

from socklens.settings import free_names, reachable, stash


@dataclass
class Dealt:
    """Rows in pieces by ranges of (group, order), written down.

    ``rows`` has the columns dealt and, by the names given here, the number of
    the ``piece``, the row's number ``nth`` in its group inside the piece, whether
    that group is the ``head`` of its piece and whether the row is at an ``edge``
    (the first or last of its piece). Pieces ascend with the ranges.
    """

    rows: DataFrame
    piece: str
    nth: str
    head: str
    edge: str
    group: list[str]

    def before(self) -> dict[int, int]:
        """Rows of the group a piece begins with in the pieces before it, where there are any.

        Reads two rows of each piece, so it is bounded by the number of tasks.
        """
        columns = [F.col(c) for c in (self.piece, self.nth, self.head)]
        ends = self.rows.where(F.col(self.edge)).select(F.struct(*self.group).alias("g"), *[c.alias(n) for c, n in zip(columns, "pnh")])
        found, last, count = {}, None, 0
        by_piece: dict[int, list] = {}
        for row in ends.collect():
            by_piece.setdefault(row.p, []).append(row)
        for piece in sorted(by_piece):
            ends = sorted(by_piece[piece], key=lambda r: (not r.h, r.n))
            if last is not None and ends[0].g == last[0]:
                found[piece] = count
            last = (ends[-1].g,)
            count = ends[-1].n + (found.get(piece, 0) if ends[-1].h else 0)
        return found


def deal(
    df: DataFrame,
    group: Sequence[str],
    order: Sequence[str | Column],
    label: str = "dealt",
    cut: Callable[[DataFrame, str], DataFrame] = stash,
) -> Dealt:
    """Deal ``df`` out by ranges of (group, order), NULL first, and write it down with ``cut``.

    Rows that tie in all of these are spread as well, in no certain order.
    Group columns are of plain types. The input is read twice if it does not
    come from a shuffle or a narrow table: once for the ranges.
    """
    reachable(df.sparkSession)
    tie, piece, nth, head, edge = free_names(df.columns, "_tie", "_piece", "_nth", "_head", "_edge")
    schema = T.StructType([*df.schema.fields, T.StructField(piece, T.IntegerType()), T.StructField(nth, T.LongType()), T.StructField(head, T.BooleanType()), T.StructField(edge, T.BooleanType())])
    at = [df.columns.index(c) for c in group]

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        piece, last, count, heads, held = TaskContext.get().partitionId(), None, 0, 0, None
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            fresh = _changes([batch.column(i) for i in at], last)
            starts = np.flatnonzero(fresh)
            since = np.full(n, -count, np.int64)  # where the group of each row began
            since[starts] = starts
            since = np.maximum.accumulate(since)
            numbers = np.arange(n) - since + 1
            first = heads + np.cumsum(fresh) == 1
            heads, count, last = heads + len(starts), int(numbers[-1]), [batch.column(i).slice(n - 1) for i in at]
            if held is not None:
                yield _marked(*held, piece, False)
            held = (batch, numbers, first, held is None)
        if held is not None:
            yield _marked(*held, piece, True)

    def _marked(batch, numbers, first, begins, piece, ends) -> pa.RecordBatch:
        border = np.zeros(batch.num_rows, bool)
        border[0], border[-1] = border[0] | begins, border[-1] | ends
        if batch.num_rows == 1:
            border[0] = begins | ends
        added = [pa.array(np.full(batch.num_rows, piece, np.int32)), pa.array(numbers), pa.array(first), pa.array(border)]
        return pa.RecordBatch.from_arrays([*batch.columns, *added], schema.names)

    keys = [F.col(c).asc_nulls_first() for c in group]
    keys += [o if isinstance(o, Column) else F.col(o).asc_nulls_first() for o in order]
    keys.append(F.col(tie))
    ranged = df.withColumn(tie, F.monotonically_increasing_id()).repartitionByRange(*keys).sortWithinPartitions(*keys)
    return Dealt(cut(ranged.drop(tie).mapInArrow(number, schema), label), piece, nth, head, edge, list(group))


def _changes(columns: list[pa.Array], last: list[pa.Array] | None) -> np.ndarray:
    """Whether each row differs from the one before it; the first one from ``last``."""
    fresh = np.zeros(len(columns[0]), bool)
    fresh[0] = last is None
    for k, column in enumerate(columns):
        before = pa.concat_arrays([column.slice(0, 1) if last is None else last[k], column.slice(0, len(column) - 1)])
        other = pc.fill_null(pc.not_equal(column, before), False)
        gone = pc.not_equal(column.is_null(), before.is_null())
        fresh |= pc.or_(other, gone).to_numpy(zero_copy_only=False)
    return fresh


def number_rows(
    df: DataFrame,
    group: Sequence[str],
    order: Sequence[str | Column],
    name: str = "_position",
    label: str = "numbered",
    cut: Callable[[DataFrame, str], DataFrame] = stash,
) -> DataFrame:
    """``df`` with ``name``: 1, 2, ... for the rows of each group in ``order`` (NULL first), whatever its size.

    Rows are shuffled once, whole, so hand in only the columns wanted. No
    rows give none; ``group`` may be empty, for numbers over all rows.
    """
    if not group:
        (all_,) = free_names(df.columns, "_all")
        return number_rows(df.withColumn(all_, F.lit(0)), [all_], order, name, label, cut).drop(all_)
    dealt = deal(df, group, order, label, cut)
    before = dealt.before()
    carried = F.lit(0)
    rows = dealt.rows
    if before:  # at most one row per task
        found, shift = free_names([*rows.columns, name], "_of", "_shift")
        starts = df.sparkSession.createDataFrame(sorted(before.items()), f"{found} int, {shift} long")
        rows = rows.join(F.broadcast(starts), F.col(dealt.piece) == F.col(found), "left")
        carried = F.when(F.col(dealt.head), F.coalesce(F.col(shift), F.lit(0))).otherwise(0)
    kept = [F.col(c) for c in df.columns if c.lower() != name.lower()]
    return rows.select(*kept, (F.col(dealt.nth) + carried).cast("bigint").alias(name))

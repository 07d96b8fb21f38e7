"""Range lookups by a sweep: addresses and ranges dealt out together by address.

Rows are dealt out by ranges of the address, sorted, and swept once; each range
found is carried along until the next one begins. A task does not see the ranges
that begin in the tasks before it, but of those only the last counts, one
per table: tasks write down the last range they saw, and what a task has left open
is settled from that. One shuffle and one pass serve tables of any size, both
families and any number of tables, and a hot stretch of addresses is spread.

Nested ranges are cut into disjoint ones first, so that the innermost range
holds an address, or of ranges that cross the narrowest: a sweep with the ranges that are open. Which ranges are open
where a task begins is known from the ranges that cross the border of two tasks.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from socklens.functions.bits import uint_bytes
from socklens.settings import reachable, stash

MOST_NESTED = 4096  # ranges open at once; networks nest 128 deep at most


def wide_key(key4: Column, key6: Column) -> Column:
    """One sortable key of both families: the family, then the address; NULL without an address."""
    v4 = F.concat(F.lit(b"\x04"), uint_bytes(key4, 4, True))
    return F.when(key4.isNotNull(), v4).when(key6.isNotNull(), F.concat(F.lit(b"\x06"), key6))


def bound_key(bound: Column, family: int) -> Column:
    return F.concat(F.lit(b"\x04"), uint_bytes(bound, 4, True)) if family == 4 else F.concat(F.lit(b"\x06"), bound)


def sweep_join(addresses: DataFrame, tables: Mapping[str, DataFrame]) -> DataFrame:
    """``addresses`` (address, key) with a column per table: the record of the range that holds the key.

    ``tables`` hold disjoint ranges (lo, hi, record) with keys as bounds. The
    sweep runs when this is called; its result lies in the shared folder.
    """
    reachable(addresses.sparkSession)
    names = list(tables)
    kinds = {n: tables[n].schema["record"].dataType for n in names}
    empty = {n: F.lit(None).cast(kinds[n]) for n in names}
    rows = [addresses.select("key", F.lit(len(names)).alias("kind"), "address", F.lit(None).cast("binary").alias("hi"), *[empty[n].alias(n) for n in names])]
    for i, n in enumerate(names):
        record = [(F.col("record") if m == n else empty[m]).alias(m) for m in names]
        rows.append(tables[n].select(F.col("lo").alias("key"), F.lit(i).alias("kind"), F.lit(None).cast("string").alias("address"), "hi", *record))
    union = rows[0]
    for more in rows[1:]:
        union = union.unionByName(more)
    # a range that begins at an address comes before it
    dealt = union.repartitionByRange("key", "kind", "address").sortWithinPartitions("key", "kind")

    found = [T.StructField(n, kinds[n]) for n in names]
    schema = T.StructType(
        [
            T.StructField("address", T.StringType()),
            T.StructField("key", T.BinaryType()),
            T.StructField("piece", T.IntegerType()),
            T.StructField("last", T.IntegerType()),  # of which table this row is the last range, NULL for an address
            T.StructField("hi", T.BinaryType()),
            T.StructField("open", T.ArrayType(T.BooleanType())),  # whether no range of the table came before in this task
            *found,
        ]
    )

    def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        piece, held = TaskContext.get().partitionId(), None
        for batch in batches:
            if not batch.num_rows:
                continue
            # the last range of each table so far stands in front
            table = pa.Table.from_batches([batch] if held is None else [*held, batch]).combine_chunks()
            skip = 0 if held is None else sum(h.num_rows for h in held)
            kind = table["kind"].to_numpy()
            at = np.arange(len(kind))
            last = [np.maximum.accumulate(np.where(kind == i, at, -1)) for i in range(len(names))]
            asked = np.flatnonzero((kind == len(names)) & (at >= skip))
            key = table["key"].take(pa.array(asked))
            records, opens = [], []
            for i, n in enumerate(names):
                before = last[i][asked]
                source = pa.array(before, pa.int64(), mask=before < 0)
                inside = pc.fill_null(pc.less_equal(key, table["hi"].take(source)), False)
                records.append(table[n].take(pc.if_else(inside, source, pa.scalar(None, pa.int64()))).combine_chunks())
                opens.append(before < 0)
            yield _answers(table["address"].take(pa.array(asked)), key, piece, opens, records)
            held = [table.slice(int(p[-1]), 1).to_batches()[0] for p in last if p[-1] >= 0]
        for i, row in enumerate(held or []):
            n = int(row["kind"][0].as_py())
            columns = [pa.nulls(1, pa.string()), row["key"], pa.array([piece], pa.int32()), pa.array([n], pa.int32()), row["hi"], pa.nulls(1, pa.list_(pa.bool_()))]
            yield pa.RecordBatch.from_arrays([*columns, *[row[m] for m in names]], schema.names)

    def _answers(address, key, piece, opens, records) -> pa.RecordBatch:
        n = len(address)
        flags = np.stack(opens, axis=1).reshape(-1)
        marks = pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * len(names), pa.int32()), pa.array(flags))
        plain = [c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in (address, key)]
        columns = [*plain, pa.array(np.full(n, piece, np.int32)), pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary()), marks]
        return pa.RecordBatch.from_arrays([*columns, *records], schema.names)

    swept = stash(dealt.mapInArrow(sweep, schema), "swept")
    # at most one row per task and table; what was last seen before each task, over so many rows
    ends = swept.where("last IS NOT NULL")
    tasks = swept.select("piece").distinct()
    earlier = Window.orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    for i, n in enumerate(names):
        mine = ends.where(F.col("last") == i).select("piece", F.struct("hi", F.col(n).alias("record")).alias(f"mine_{n}"))
        tasks = tasks.join(mine, "piece", "left")
    carried = tasks.select("piece", *[F.last(f"mine_{n}", ignorenulls=True).over(earlier).alias(f"before_{n}") for n in names])
    answers = swept.where("last IS NULL").join(F.broadcast(carried), "piece")
    columns = []
    for i, n in enumerate(names):
        held = F.when(F.col("key") <= F.col(f"before_{n}.hi"), F.col(f"before_{n}.record"))
        columns.append(F.when(F.col("open")[i], held).otherwise(F.col(n)).alias(n))
    return answers.select("address", *columns)


def flatten(ranges: DataFrame, crossing: bool = False) -> DataFrame:
    """Disjoint ranges (lo, hi, record, bad) that give each address its innermost range.

    ``ranges`` has lo, hi and record, bounds as :func:`bound_key` makes them. A
    range that crosses another, equals it, or ends before it begins is marked
    ``bad`` instead: nothing tells which of two such ranges counts. With ``crossing``,
    ranges may cross: the narrowest holds an address, of equally narrow ones
    that which begins last. Neighbouring pieces of a
    range that was cut stay apart. Written to the shared folder when called.
    """
    reachable(ranges.sparkSession)
    order = [F.col("lo").asc(), F.col("hi").desc()]
    dealt = ranges.select("lo", "hi", "record").where("lo IS NOT NULL AND hi IS NOT NULL").repartitionByRange(*order).sortWithinPartitions(*order)
    dealt = stash(dealt.withColumn("piece", F.spark_partition_id()), "ranges")
    starts = {r.piece: bytes(r.lo) for r in dealt.groupBy("piece").agg(F.min("lo").alias("lo")).collect()}  # one row per task
    pieces = sorted(starts)
    until = {p: starts[q] for p, q in zip(pieces, pieces[1:])}
    open_ = {p: [] for p in pieces}
    if until:
        borders = dealt.sparkSession.createDataFrame([(p, bytearray(v)) for p, v in until.items()], "at int, border binary")
        # ranges that are open at the border behind their task: nested in one another, so few
        reaching = dealt.join(F.broadcast(borders), F.col("piece") == F.col("at")).where("hi >= border").select("piece", "lo", "hi", "record")
        chain: list = []
        by_piece: dict[int, list] = {}
        # one more than so many a task means that one task has too many, which is refused below
        for row in reaching.limit(MOST_NESTED * len(pieces) + 1).collect():
            by_piece.setdefault(row.piece, []).append(row)
        for p, q in zip(pieces, pieces[1:]):
            chain = [r for r in [*chain, *sorted(by_piece.get(p, []), key=lambda r: (bytes(r.lo), [-b for b in bytes(r.hi)]))] if bytes(r.hi) >= starts[q]]
            if len(chain) > MOST_NESTED:
                raise ValueError(f"more than {MOST_NESTED} ranges overlap at one address")
            open_[q] = chain
    carried = [(p, r.lo, r.hi, r.record) for p, rows in open_.items() for r in rows]
    schema = T.StructType([T.StructField("piece", T.IntegerType()), *[dealt.schema[c] for c in ("lo", "hi", "record")]])
    rows = dealt.select("piece", "lo", "hi", "record", F.lit(1).alias("turn"))
    if carried:
        rows = rows.unionByName(dealt.sparkSession.createDataFrame(carried, schema).withColumn("turn", F.lit(0)))
    # each piece once more as one stream, ranges from before it first
    rows = rows.repartition("piece").sortWithinPartitions("piece", "turn", *order)
    out = T.StructType([*[dealt.schema[c] for c in ("lo", "hi")], dealt.schema["record"], T.StructField("bad", T.BooleanType())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flat = _Flat(out.names, crossing)
        for batch in batches:
            pieces, turns = batch["piece"].to_pylist(), batch["turn"].to_pylist()
            for i, (piece, turn, lo, hi) in enumerate(zip(pieces, turns, batch["lo"].to_pylist(), batch["hi"].to_pylist())):
                flat.add(piece, bool(turn), lo, hi, batch["record"].slice(i, 1), starts[piece], until.get(piece))
            yield from flat.take()
        flat.close()
        yield from flat.take()

    return stash(rows.mapInArrow(cut, out), "disjoint")


class _Flat:
    """The sweep of :func:`flatten` over one piece after another; the narrowest open range is on top of a heap."""

    def __init__(self, names: list[str], crossing: bool):
        self.names, self.crossing, self.piece, self.open, self.out = names, crossing, None, [], []

    def add(self, piece: int, own: bool, lo: bytes, hi: bytes, record: pa.Array, start: bytes, until: bytes | None) -> None:
        if piece != self.piece:
            self.close()
            self.piece, self.open, self.next, self.until, self.last, self.count = piece, [], start, until, None, 0
        if own:
            self._up_to(_before(lo))
            crosses = not self.crossing and self.open and hi > self.open[0][3]
            if hi < lo or crosses or self.last == (lo, hi):
                self.out.append((lo, hi, record, True))
                return
            self.next, self.last = lo, (lo, hi)
        begin, self.count = int.from_bytes(lo, "big"), self.count + 1
        heapq.heappush(self.open, (int.from_bytes(hi, "big") - begin, -begin, self.count, hi, record))

    def _up_to(self, end: bytes) -> None:
        """Give what the open ranges hold up to ``end``; those that end there are closed when they come to the top."""
        while self.open:
            *_, hi, record = self.open[0]
            if hi < self.next:
                heapq.heappop(self.open)
            elif self.next > end:
                return
            else:
                stop = min(hi, end)
                self.out.append((self.next, stop, record, False))
                self.next = _after(stop)

    def close(self) -> None:
        if self.open:
            self._up_to(_before(self.until) if self.until is not None else b"\xff" * 17)
            self.open = []

    def take(self) -> Iterator[pa.RecordBatch]:
        if self.out:
            lo, hi, records, bad = zip(*self.out)
            self.out = []
            columns = [pa.array(lo, pa.binary()), pa.array(hi, pa.binary()), pa.concat_arrays(records), pa.array(bad)]
            yield pa.RecordBatch.from_arrays(columns, self.names)


def _after(key: bytes) -> bytes:
    n = int.from_bytes(key, "big") + 1
    return n.to_bytes(len(key) + (n >> 8 * len(key) > 0), "big")


def _before(key: bytes) -> bytes:
    n = int.from_bytes(key, "big") - 1
    return n.to_bytes(len(key), "big") if n >= 0 else b""

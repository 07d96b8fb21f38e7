"""Per-socket counter sampling.

Sample ``n`` swallows ``n`` rows of a socket and lets the next one through, so
one row in ``n + 1`` survives; 0 turns sampling off. IPv4 and IPv6 sockets and
different tracepoints count separately because both are part of the key.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window, functions as F, types as T
from pyspark.sql.streaming import DataStreamWriter

from socklens.catalog import SOCKET_KEY
from socklens.operators.numbering import number_rows
from socklens.settings import free_names

ORDER = ("Timestamp",)
IDLE_MINUTES = 24 * 60


def check_sample(n: int) -> int:
    if n < 0:
        raise ValueError(f"negative sample: {n}")
    return n


def present_key(df: DataFrame, key: Sequence[str] | None) -> list[str]:
    """Key columns: those asked for or the socket columns, all of which must exist."""
    found = list(key) if key else list(SOCKET_KEY)
    missing = [c for c in found if c not in df.columns]
    if missing:
        raise ValueError(f"sampling needs key columns the input does not have: {missing}; name others with key")
    return found


def check_order(df: DataFrame, order: Sequence[str]) -> list[str]:
    missing = [c for c in order if c not in df.columns]
    if missing or not list(order):
        raise ValueError(f"sampling needs order columns the input does not have: {missing}")
    return list(order)


def sample_per_socket(
    df: DataFrame,
    n: int,
    key: Sequence[str] | None = None,
    order: Sequence[str] = ORDER,
    spread: bool = True,
    counters: SocketCounters | None = None,
) -> DataFrame:
    """Every ``n + 1``-th row of each socket, in ``order`` (any columns of any order type, NULL first).

    Rows are dealt out by ranges of (socket, order) and numbered by prefix sums,
    so a socket is spread over as many tasks as its rows ask for, also where all of
    them are of one second. The source is read and shuffled once; the dealt rows
    are written to the shared folder, so the job starts when this is called.
    With ``spread`` off one window numbers each socket, in one task and when
    the result is wanted. Either way the rows are the same. Rows that tie in all
    order columns are told apart arbitrarily. ``counters`` goes on counting where
    an earlier batch stopped.
    """
    if check_sample(n) == 0:
        return df
    key, order = present_key(df, key), check_order(df, order)
    (position,) = free_names(df.columns, "_position")
    if counters:
        numbered = counters.number(df, key, order, position)
    elif spread:
        numbered = number_rows(df, key, order, position, "sampled")
    else:
        numbered = df.withColumn(position, F.row_number().over(Window.partitionBy(*key).orderBy(*order)))
    return numbered.where(F.col(position) % (n + 1) == 0).drop(position)


@dataclass(frozen=True)
class SocketCounters:
    """How many rows of each socket the micro-batches before ``batch_id`` had, in a table of its own.

    The table has a version per micro-batch, in three folders that take turns, so
    it never holds more than three times the sockets that are counted. A
    micro-batch reads the last version before its own and writes its own
    before its rows are used: replayed, it finds the same counts and gives the
    same rows. Sockets without rows for ``idle_minutes`` (by ``clock``, a
    column of seconds or times, compared with the latest seen) are forgotten and start over;
    None forgets nothing.
    """

    path: str
    batch_id: int
    idle_minutes: int | None = IDLE_MINUTES
    clock: str = "Timestamp"

    def number(self, df: DataFrame, key: Sequence[str], order: Sequence[str], name: str) -> DataFrame:
        """``df`` with the number of each row in its socket, over all micro-batches so far."""
        numbered = number_rows(df, key, order, name, "sampled")
        socket, seen = free_names(numbered.columns, "_socket", "_seen")
        keyed = numbered.withColumn(socket, F.struct(*[F.col(k) for k in key]))
        counted = self._counted(df, keyed.schema[socket].dataType)
        self._write(keyed, socket, name, counted)
        before = counted.select(F.col("socket").alias("_counted"), F.col("seen").alias(seen))
        rows = keyed.join(before, F.col(socket) == F.col("_counted"), "left")
        return rows.withColumn(name, F.col(name) + F.coalesce(F.col(seen), F.lit(0))).drop(socket, "_counted", seen)

    def _counted(self, df: DataFrame, socket: T.DataType) -> DataFrame:
        """(socket, seen, at) of the last version before this micro-batch."""
        schema = T.StructType().add("version", "long").add("socket", socket).add("seen", "long").add("at", "long")
        if self.batch_id == 0:
            return df.sparkSession.createDataFrame([], schema).drop("version")
        read = df.sparkSession.read.schema(schema)
        last = read.parquet(self.path).where(F.col("version") < self.batch_id).agg(F.max("version")).first()[0]
        # its own folder alone: that of this micro-batch is written while the result is still read
        kept = read.parquet(f"{self.path}/turn={last % 3}").where(F.col("version") == last)
        return kept.where("socket IS NOT NULL").select("socket", "seen", "at")

    def _write(self, keyed: DataFrame, socket: str, name: str, counted: DataFrame) -> None:
        if self.clock in keyed.columns:
            kind = keyed.schema[self.clock].dataType
            clock = F.unix_timestamp(self.clock) if isinstance(kind, (T.TimestampType, T.TimestampNTZType)) else F.col(self.clock).cast("long")
        else:
            clock = F.lit(None).cast("long")
        now = keyed.groupBy(F.col(socket).alias("socket")).agg(F.max(name).alias("seen"), F.max(clock).alias("at"))
        both = counted.unionByName(now).groupBy("socket").agg(F.sum("seen").alias("seen"), F.max("at").alias("at"))
        if self.idle_minutes is not None:
            latest = counted.unionByName(now).agg(F.max("at")).first()[0]
            if latest is not None:
                both = both.where(F.col("at").isNull() | (F.col("at") >= latest - 60 * self.idle_minutes))
        # a row without a socket says that there is this version, also where no socket is left
        marker = both.sparkSession.range(1).select(F.lit(None).cast(both.schema["socket"].dataType).alias("socket"), F.lit(0).cast("long").alias("seen"), F.lit(None).cast("long").alias("at"))
        version = both.unionByName(marker).select(F.lit(self.batch_id).cast("long").alias("version"), "socket", "seen", "at")
        version.write.mode("overwrite").parquet(f"{self.path}/turn={self.batch_id % 3}")


def sample_stream(
    df: DataFrame,
    n: int,
    sink: Callable[[DataFrame, int], None],
    state: str,
    key: Sequence[str] | None = None,
    order: Sequence[str] = ORDER,
    idle_minutes: int | None = IDLE_MINUTES,
) -> DataStreamWriter:
    """Counter sampling of a stream; all micro-batches together equal the batch result.

    Returns a writer to start, with a checkpoint and a trigger. ``sink`` gets
    the sampled rows of each micro-batch and its number, the same ones if it is
    replayed. Counters lie apart from rows, in the folder ``state`` that every executor
    can reach (see :class:`SocketCounters`), which belongs to one stream.
    """
    check_sample(n)
    key, order = present_key(df, key), check_order(df, order)

    def sampled(batch: DataFrame, batch_id: int) -> None:
        sink(sample_per_socket(batch, n, key, order, counters=SocketCounters(state, batch_id, idle_minutes)), batch_id)

    return df.writeStream.foreachBatch(sampled)

"""Compaction of folder targets: many small micro-batch folders to few clustered files.

A run takes the finished micro-batches that no run took before, writes their
rows clustered by the columns asked for to one folder ``batch_id=-k`` beside them, and then a row
to the manifest of the target that says up to which micro-batch it covers. Readers
(:func:`read_compacted`) go by the manifest, so rows are there once at any time, also if a run
stops half way: a folder the manifest does not name is not read and is written
again. Covered folders are deleted last.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, functions as F

from socklens.streaming.flows import read_ledger

FILE_ROWS = 5_000_000  # rows of a file, about
KEEP = 2  # newest micro-batches, which a replay may still write
_MANIFEST = "run long, covers_to long"


def manifest_of(path: str) -> str:
    return f"{path.rstrip('/')}-manifest"


def _runs(spark: SparkSession, path: str) -> list:
    """Rows of the manifest, one per run."""
    where, root = fs.FileSystem.from_uri(_uri(manifest_of(path)))
    if where.get_file_info(root).type == fs.FileType.NotFound:
        return []
    return sorted(spark.read.schema(_MANIFEST).parquet(f"{manifest_of(path)}/entry=*").collect())


def _uri(path: str) -> str:
    return path if ":/" in path else f"file://{path}"


def read_compacted(spark: SparkSession, path: str, kind: str = "parquet") -> DataFrame:
    """Rows of a folder target: those of its compacted folders and of the finished micro-batches behind them."""
    runs = _runs(spark, path)
    covered = max((r.covers_to for r in runs), default=-1)
    rows = spark.read.format(kind).load(path).withColumn("batch_id", F.col("batch_id").cast("long"))
    open_ = read_ledger(spark, path).where(F.col("batch_id") > covered).select("batch_id").distinct()
    fresh = rows.where(F.col("batch_id") > covered).join(open_, "batch_id", "left_semi")
    packed = rows.where((F.col("batch_id") < 0) & (F.col("batch_id") >= -len(runs)))
    return packed.unionByName(fresh).drop("batch_id")


def compact(spark: SparkSession, path: str, order: Sequence[str], kind: str = "parquet", keep: int = KEEP, file_rows: int = FILE_ROWS) -> int:
    """Compact what is new in the folder target ``path``; the number of micro-batches taken.

    Rows are dealt out by ranges of ``order``, time and socket as a rule, into
    files of about ``file_rows`` rows, sorted. One run of a target at a time.
    """
    runs = _runs(spark, path)
    covered = max((r.covers_to for r in runs), default=-1)
    done = read_ledger(spark, path).where(F.col("batch_id") > covered)
    newest = done.agg(F.max("batch_id")).first()[0]
    if newest is None or newest - keep <= covered:
        return 0
    upto, run = newest - keep, len(runs) + 1
    taken = done.where(F.col("batch_id") <= upto).select("batch_id", "written")
    count, written = taken.agg(F.count_distinct("batch_id"), F.sum("written")).first()
    rows = spark.read.format(kind).load(path).withColumn("batch_id", F.col("batch_id").cast("long"))
    rows = rows.where((F.col("batch_id") > covered) & (F.col("batch_id") <= upto)).join(taken.select("batch_id").distinct(), "batch_id", "left_semi").drop("batch_id")
    files = max(-(-int(written) // file_rows), 1)
    clustered = rows.repartitionByRange(files, *order).sortWithinPartitions(*order)
    clustered.write.format(kind).mode("overwrite").save(f"{path}/batch_id=-{run}")
    spark.createDataFrame([(run, upto)], _MANIFEST).coalesce(1).write.mode("overwrite").parquet(f"{manifest_of(path)}/entry={run}")
    where, root = fs.FileSystem.from_uri(_uri(path))
    for old in range(covered + 1, upto + 1):
        folder = f"{root}/batch_id={old}"
        if where.get_file_info(folder).type != fs.FileType.NotFound:
            where.delete_dir(folder)
    return count

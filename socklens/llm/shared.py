"""What the operators share: sessions, the shared folder, text keys, components."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
from collections.abc import Callable, Sequence
from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

# Rows and bytes of one Arrow batch: what is in transit to a Python worker.
ARROW_ROWS = 2000
ARROW_BYTES = "8m"


def prepare(spark: SparkSession) -> SparkSession:
    """Session options the plans rely on; all can be set at run time.

    Python workers started from now on also look for this package where the
    driver found it, which counts where they share its disk.
    """
    root, environment = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))), spark.sparkContext.environment
    paths = environment.get("PYTHONPATH", "").split(os.pathsep)
    if root not in paths:
        environment["PYTHONPATH"] = os.pathsep.join([root, *filter(None, paths)])
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", ARROW_BYTES)
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``, or the session's checkpoint folder.

    A temporary one stands in only where neither is set on one machine; it is removed when the driver ends.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder is None:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
        folder = _local_folder()
    return folder


@lru_cache(maxsize=1)
def _local_folder() -> str:
    folder = tempfile.mkdtemp(prefix="llm-shared-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    return folder


def new_folder(spark: SparkSession, label: str) -> str:
    return f"{shared_folder(spark)}/llm-{label}-{uuid.uuid4().hex}"


def stash(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Cuts the lineage: what follows never repeats the work before, also when
    executors are lost. The table is needed as long as a result made from it.
    """
    path = new_folder(df.sparkSession, label)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def apart(docs: DataFrame, *needed: str) -> tuple[DataFrame, Callable[[DataFrame, Sequence[str]], DataFrame]]:
    """``docs`` with every column but the needed ones renamed, and how to undo that.

    An operator's own columns then clash with none, in whatever case. The second
    value takes the operator's result and the names it added: columns come back under their
    names and in their order, but for those named like an added one, and the added ones follow.
    """
    names = docs.columns
    inner = [n if n in needed else f"__column{i}" for i, n in enumerate(names)]

    def back(out: DataFrame, added: Sequence[str]) -> DataFrame:
        replaced = {a.lower() for a in added}
        kept = [F.col(i).alias(n) for i, n in zip(inner, names) if n.lower() not in replaced]
        return out.select(*kept, *added)

    return docs.toDF(*inner), back


def whole_text(column: str | Column = "text") -> Column:
    """The text of a document; a null text counts as empty."""
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit("")).cast("string")


def text_key(text: Column) -> Column:
    """128 bits of the SHA-256 of a text: equal texts, and only they, share it."""
    return F.substring(F.unhex(F.sha2(text, 256)), 1, 16)


def components(edges: DataFrame, label: str = "components") -> DataFrame:
    """Connected components of ``edges`` (a, b) as (node, component): the smallest node of each.

    Alternates the two star operations on the edge list: every node hands its
    larger neighbours (large star), then its smaller ones (small star), to the
    smallest node it knows. Each is a partial minimum and a join on the node,
    so a hub is never gathered in one task; the number of rounds grows with the
    logarithm of the longest path. Stops when a round changes nothing.
    """
    edges = stash(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), label)
    seen = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("low")).select("a", F.least("a", "low").alias("low"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("low").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("low"))
        small = large.join(low, "a")
        edges = stash(
            small.where("b <> low").select(F.col("b").alias("a"), F.col("low").alias("b"))
            .unionByName(low.select("a", F.col("low").alias("b")))
            .distinct(),
            label,
        )
        # no change in the number of edges and in what they hold: a star per component
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == seen:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
        seen = now

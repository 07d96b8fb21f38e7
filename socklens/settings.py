"""Session settings the library relies on."""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession

# Zone-free event times are UTC; adaptive execution sizes partitions and
# splits skewed joins at run time; generated methods beyond 8000 bytes are
# never compiled to machine code, so longer stages run operator by operator.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.codegen.hugeMethodLimit": "8000",
}


def configure(builder: SparkSession.Builder) -> SparkSession.Builder:
    """Add the library's defaults to a session builder."""
    for name, value in DEFAULTS.items():
        builder = builder.config(name, value)
    return builder


def apply(spark: SparkSession) -> SparkSession:
    """Set the defaults on a session that already runs."""
    for name, value in DEFAULTS.items():
        spark.conf.set(name, value)
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor can reach: ``spark.checkpoint.dir``, or what the session set as its checkpoint folder."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder is None:
        raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
    return folder


def reachable(spark: SparkSession) -> None:
    """Python workers started from now on also look for this package where the driver found it.

    That counts where they share its disk and the package is not installed; elsewhere it does nothing.
    """
    root, environment = os.path.dirname(os.path.dirname(os.path.abspath(__file__))), spark.sparkContext.environment
    paths = environment.get("PYTHONPATH", "").split(os.pathsep)
    if root not in paths:
        environment["PYTHONPATH"] = os.pathsep.join([root, *filter(None, paths)])


def stash(df: DataFrame, label: str) -> DataFrame:
    """``df`` written to the shared folder and read back.

    Cuts the lineage: what follows never repeats the work before, also when
    executors are lost. The table is needed as long as a result made from it.
    """
    path = f"{shared_folder(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def free_names(columns: Iterable[str], *wanted: str) -> list[str]:
    """The wanted names, with underscores before those that a column has already, in whatever case."""
    taken, found = {c.lower() for c in columns}, []
    for name in wanted:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        found.append(name)
    return found

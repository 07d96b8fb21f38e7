"""A local session for checks, tests and the bench."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession

from socklens.settings import configure


def local_session(cpus: int | None = None) -> SparkSession:
    cpus = cpus or os.cpu_count() or 4
    builder = SparkSession.builder.master(f"local[{cpus}]").appName("socklens")
    builder = (
        configure(builder)
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark

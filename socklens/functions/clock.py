"""Time and host stamps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def unix_seconds(column: Column) -> Column:
    """Whole seconds since the epoch; zone-free timestamps count as UTC."""
    return F.unix_seconds(column.cast("timestamp"))


def stamp_time(df: DataFrame, source_col: str | None = None) -> DataFrame:
    """Add ``Timestamp``, the unix second at which the row was received.

    ``source_col`` names a receive-time column; without one the query's (or the
    micro-batch's) current time is used.
    """
    moment = F.col(source_col) if source_col else F.current_timestamp()
    return df.withColumn("Timestamp", unix_seconds(moment))


def stamp_host(df: DataFrame, host: str | Column) -> DataFrame:
    """Add ``Hostname``: a constant, or a column of the input."""
    return df.withColumn("Hostname", F.lit(host) if isinstance(host, str) else host)


def event_time(df: DataFrame, name: str = "event_time") -> DataFrame:
    """Add the ``Timestamp`` seconds as a TIMESTAMP column."""
    return df.withColumn(name, F.timestamp_seconds("Timestamp"))

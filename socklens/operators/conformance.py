"""Checks of event tables against the domain tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from socklens.catalog import ALL_STATES, STATE_TRACEPOINT, TCP_STATES, TRACEPOINTS


def conformance(df: DataFrame) -> DataFrame:
    """One row per (event, broken rule): the event's columns plus ``reason``.

    The domains are a handful of constants, so this is one narrow pass over
    the table: no join and no shuffle.
    """
    states = [number for name, number in TCP_STATES.items() if name != ALL_STATES]
    outside = {
        "unknown tracepoint": ~F.coalesce(F.col("Tracepoint").isin(*TRACEPOINTS), F.lit(False)),
        "unknown state": (F.col("Tracepoint") == STATE_TRACEPOINT)
        & ~F.coalesce(F.col("NewState").isin(states), F.lit(False)),
        "wrong address family": ~F.coalesce(F.col("Inet").isin(4, 6), F.lit(False)),
    }
    reasons = F.array_compact(F.array(*[F.when(broken, reason) for reason, broken in outside.items()]))
    return df.select("*", F.explode(reasons).alias("reason"))

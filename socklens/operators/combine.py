"""Putting streams of events together."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import DataFrame

LINE_SINKS = ("csv", "jsonl")


def union_families(v4: DataFrame, v6: DataFrame) -> DataFrame:
    """IPv4 and IPv6 rows of one tracepoint, columns matched by name."""
    return v4.unionByName(v6)


def multiplex(parts: Iterable[tuple], sink: str | None = None) -> DataFrame:
    """Events of several specs for one destination: ``[(spec, df), ...]``.

    Columns a spec does not select are NULL. Line sinks write values by
    position under one header, so they need the same field list everywhere.
    """
    parts = list(parts)
    if not parts:
        raise ValueError("nothing to multiplex")
    check_one_list([spec for spec, _ in parts], sink)
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [df for _, df in parts])


def check_one_list(specs: Iterable, sink: str | None) -> None:
    """Line sinks need one field list for all specs."""
    lists = {tuple(spec.field_names) for spec in specs}
    if sink in LINE_SINKS and len(lists) > 1:
        raise ValueError(f"{sink} needs one field list, got {sorted(lists)}")

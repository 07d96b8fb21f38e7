"""Row selection: tracepoint, protocol, state, address family, field filters."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame, functions as F

from socklens.catalog import (
    ALL_STATES,
    IPPROTO_TCP,
    STATE_TRACEPOINT,
    TCP_STATES,
    check_tracepoint,
    field,
    state_name,
)
from socklens.functions import cmath
from socklens.operators.project import find_column, stored_value


def select_tracepoint(df: DataFrame, name: str) -> DataFrame:
    return df.where(F.col("Tracepoint") == check_tracepoint(name))


def filter_protocol(df: DataFrame) -> DataFrame:
    """TCP sockets only; the state-change tracepoint also fires for others."""
    return df.where(F.col("Protocol") == IPPROTO_TCP)


def filter_state(df: DataFrame, state: str) -> DataFrame:
    """Rows that enter ``state`` (any case); TCP_ALL keeps every row."""
    name = state_name(state)
    return df if name == ALL_STATES else df.where(F.col("NewState") == TCP_STATES[name])


def filter_family(df: DataFrame, inet: Iterable[int] = (4,)) -> DataFrame:
    families = list(inet) or [4]
    for family in families:
        if family not in (4, 6):
            raise ValueError(f"wrong address family: {family}")
    return df.where(F.col("Inet").isin(families))


def select_state_rows(df: DataFrame, tracepoint: str, state: str) -> DataFrame:
    """Protocol and state selection, which only the state-change tracepoint has."""
    if tracepoint != STATE_TRACEPOINT:
        return df
    return filter_state(filter_protocol(df), state)


def selection(tracepoint: str, state: str, inet: Iterable[int]) -> Column:
    """What :func:`select_tracepoint`, :func:`select_state_rows` and :func:`filter_family` keep, as one condition."""
    kept = (F.col("Tracepoint") == check_tracepoint(tracepoint)) & F.col("Inet").isin(list(inet) or [4])
    if tracepoint == STATE_TRACEPOINT:
        kept = kept & (F.col("Protocol") == IPPROTO_TCP)
        if state_name(state) != ALL_STATES:
            kept = kept & (F.col("NewState") == TCP_STATES[state_name(state)])
    return kept


def drop_where(df: DataFrame, filters: Mapping[str, str]) -> DataFrame:
    """Remove the rows that satisfy any of the per-field C conditions.

    A condition that cannot be decided (NULL) removes nothing.
    """
    drop = dropped(df, filters)
    return df if drop is None else df.where(~drop)


def dropped(df: DataFrame, filters: Mapping[str, str]) -> Column | None:
    """Whether a row satisfies any of the conditions; None without any."""
    drop = None
    for name, text in filters.items():
        if not text:
            continue
        entry = field(name)
        column = F.col(find_column(df, entry.name) or entry.name)
        hit = cmath.condition(stored_value(df, column, entry), entry.bits, entry.name, text, entry.is_text)
        hit = F.coalesce(hit, F.lit(False))
        drop = hit if drop is None else drop | hit
    return drop

"""Rows for a columnar table: positional columns with fixed types."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from socklens.catalog import TYPED_COLUMNS, typed_type
from socklens.operators.conform import held_type

# what a serialization does with a missing value
MISSING = {"json": "strict", "spb": "zero", "pb": "null"}


def _check(mapping: Mapping[str, str]) -> None:
    for name in mapping:
        if name not in TYPED_COLUMNS:
            raise ValueError(f"not a column of the typed row: {name}")


def _source(df: DataFrame, name: str) -> Column:
    return F.col(name) if name in df.columns else F.lit(None)


def _is_text(name: str) -> bool:
    return typed_type(name).simpleString() == "string"


def to_table_rows(df: DataFrame, mapping: Mapping[str, str], missing: str = "null") -> DataFrame:
    """Field -> column, cast to the typed row's types, in mapping order; 64-bit counters stay DECIMAL(20,0) where they come so.

    ``missing`` decides about absent values. ``null``: NULL. ``zero``: 0 for
    numbers, "" for texts. ``strict``: a row without one of the numbers is no
    row (see :func:`split_strict`), texts are NULL.
    """
    _check(mapping)
    if missing not in MISSING.values():
        raise ValueError(f"unknown policy for missing values: {missing}")
    if missing == "strict":
        df, _ = split_strict(df, mapping)
    columns = []
    for name, column in mapping.items():
        kind = held_type(df, name)
        value = _source(df, name).cast(kind)
        if missing == "zero":
            value = F.coalesce(value, F.lit("" if _is_text(name) else 0).cast(kind))
        columns.append(value.alias(column))
    return df.select(*columns)


def split_strict(df: DataFrame, mapping: Mapping[str, str]) -> tuple[DataFrame, DataFrame]:
    """(rows with every mapped number, rejects)."""
    _check(mapping)
    absent = F.lit(False)
    for name in mapping:
        if not _is_text(name):
            absent = absent | _source(df, name).isNull()
    return df.where(~absent), df.where(absent)


def require_numbers(df: DataFrame, mapping: Mapping[str, str]) -> DataFrame:
    """``df``, whose job fails at the first row without one of the mapped numbers: nothing is lost quietly."""
    _check(mapping)
    absent = [_source(df, name).isNull() for name in mapping if not _is_text(name)]
    if not absent:
        return df
    failed = F.raise_error(F.concat(F.lit("a row lacks a number that its table needs: "), F.to_json(F.struct(*df.columns))))
    return df.where(F.when(reduce(lambda a, b: a | b, absent), failed.cast("boolean")).otherwise(F.lit(True)))

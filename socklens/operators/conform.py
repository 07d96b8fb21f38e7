"""Row models: the typed row and the dynamic row."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, functions as F, types as T

from socklens.catalog import FIELDS, GEO_COLUMNS, TYPED_COLUMNS, canonical, typed_type

# -- fixed values: dynamic-row fields that are text ------------------------
_DYNAMIC_TEXT = ("Task", "SAddr", "DAddr")
_TEXT = {*_DYNAMIC_TEXT, "Hostname", *GEO_COLUMNS}


# map of the payload keys that are no columns, to VARIANT
EXTRA = "_extra"


def without(extra: Column, present: Column) -> Column:
    """The extra keys that no present column has."""
    return F.map_filter(F.coalesce(extra, F.create_map().cast("map<string,variant>")), lambda k, v: ~F.map_contains_key(present, k))


def held_type(df: DataFrame, name: str) -> T.DataType:
    """The type of a typed-row column for this input: 64-bit counters stay DECIMAL(20,0) where they come so."""
    counter = name in FIELDS and FIELDS[name].ctype == "u64" and name in df.columns
    return df.schema[name].dataType if counter and isinstance(df.schema[name].dataType, T.DecimalType) else typed_type(name)


def to_typed(df: DataFrame, keep: Iterable[str] = ()) -> DataFrame:
    """The fixed 61-column row; columns the input lacks are NULL.

    Names outside the typed row do not survive: OldState and NewState have no
    column there. 64-bit counters that come as DECIMAL(20,0), as flows decode them, stay so.
    """
    columns = []
    for name in TYPED_COLUMNS:
        source = F.col(name) if name in df.columns else F.lit(None)
        columns.append(source.cast(held_type(df, name)).alias(name))
    return df.select(*columns, *keep)


def dynamic_text(name: str) -> bool:
    return name in _TEXT


def to_dynamic(df: DataFrame, fields: Iterable[str], hostname: str | Column | None = None, keep: Iterable[str] = ()) -> DataFrame:
    """Dynamic rows: ``strings`` and ``numbers`` maps.

    Task and addresses are strings, every other field is a double. Hostname
    (from the column, unless given) and Timestamp are always added. Fields that
    are NULL have no key.
    """
    names = [canonical(f) for f in fields]
    host = F.lit(hostname) if isinstance(hostname, str) else hostname
    strings = {n: F.col(n) for n in names if dynamic_text(n)}
    strings["Hostname"] = F.col("Hostname") if host is None else host
    numbers = {n: F.col(n).cast("double") for n in names if not dynamic_text(n)}
    numbers["Timestamp"] = F.col("Timestamp").cast("double")
    return df.select(present_map(strings, "string").alias("strings"), present_map(numbers, "double").alias("numbers"), *keep)


def present_map(columns: dict[str, Column], value_type: str) -> Column:
    """Map of the columns that are not NULL."""
    entries = [
        F.when(c.isNotNull(), F.struct(F.lit(n).alias("key"), c.cast(value_type).alias("value")))
        for n, c in columns.items()
    ]
    array = F.array_compact(F.array(*entries)) if entries else F.array().cast(f"array<struct<key:string,value:{value_type}>>")
    return F.map_from_entries(array)


def to_variant(df: DataFrame, fields: Iterable[str], hostname: str | Column | None = None, keep: Iterable[str] = ()) -> DataFrame:
    """Dynamic rows as one VARIANT column, read with ``variant_get``."""
    names = [canonical(f) for f in fields]
    host = F.lit(hostname) if isinstance(hostname, str) else hostname
    host = F.col("Hostname") if host is None else host
    values = [F.col(n).cast("string" if dynamic_text(n) else "double").alias(n) for n in names]
    values += [host.alias("Hostname"), F.col("Timestamp").cast("double").alias("Timestamp")]
    return df.select(F.parse_json(F.to_json(F.struct(*values))).alias("row"), *keep)


def from_dynamic(df: DataFrame, fields: Iterable[str], keep: Iterable[str] = ()) -> DataFrame:
    """Read the named fields out of dynamic rows; numbers are doubles."""
    columns = []
    for name in dict.fromkeys([*fields, "Hostname", "Timestamp"]):
        source = "strings" if dynamic_text(name) else "numbers"
        columns.append(F.try_element_at(F.col(source), F.lit(name)).alias(name))
    return df.select(*columns, *keep)

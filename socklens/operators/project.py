"""Field selection and field math."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame, functions as F

from socklens.catalog import Field, canonical, field
from socklens.functions import cmath
from socklens.functions.bits import swap_bytes

STAMPS = ("Timestamp", "Hostname")


def find_column(df: DataFrame, name: str) -> str | None:
    """Spelling under which ``df`` carries a field, if it does."""
    if name in df.columns:
        return name
    return next((c for c in df.columns if c.lower() == name.lower()), None)


def project(df: DataFrame, fields: Iterable[str], keep: Iterable[str] = ()) -> DataFrame:
    """Select fields in the given order under their catalog spelling.

    ``keep`` names further columns to carry along unchanged.
    """
    columns = []
    for name in map(canonical, fields):
        found = find_column(df, name)
        if found is None:
            raise ValueError(f"the input has no column for field {name}")
        columns.append(F.col(found).alias(name))
    return df.select(*columns, *keep)


def derive_intrinsic(df: DataFrame) -> DataFrame:
    """Add RTT where only the scaled smoothed round trip time is given.

    The kernel keeps SRTT shifted left by three bits; RTT undoes that.
    """
    if find_column(df, "RTT") or not find_column(df, "SRTT"):
        return df
    return df.withColumn("RTT", F.shiftrightunsigned(F.col("SRTT").cast("bigint"), 3))


# metadata of a port column that already holds the machine's own byte order
HOST_ORDER = {"host_order": True}


def stored_value(df: DataFrame, column: Column, entry: Field) -> Column:
    """The number the kernel's C code sees for a field.

    Ports lie in memory in network order, so a little-endian machine computes
    with their bytes swapped, unless the column was decoded in host order.
    Applying it twice gives the column back.
    """
    found = find_column(df, entry.name)
    if entry.big_endian and not (found and df.schema[found].metadata.get("host_order")):
        return swap_bytes(column.cast("bigint"), entry.bits // 8)
    return column


def takes_math(entry: Field) -> bool:
    """Math does not reach the task name, the process id or addresses."""
    return not entry.is_text and not entry.from_task


def apply_math(df: DataFrame, suffixes: Mapping[str, str], where: Column | None = None) -> DataFrame:
    """Apply a C operator suffix to each named field, e.g. ``{"RTT": "/1000"}``; only in the rows of ``where``, if given."""
    changed = {}
    for name, suffix in suffixes.items():
        entry = field(name)
        if suffix and takes_math(entry):
            column = F.col(find_column(df, entry.name) or entry.name)
            value = cmath.math(stored_value(df, column, entry), entry.bits, suffix)
            value = stored_value(df, value, entry).cast(column_type(df, entry))
            changed[entry.name] = value if where is None else F.when(where, value).otherwise(column)
    kept = {n: df.schema[found].metadata for n in changed if (found := find_column(df, n))}
    df = df.withColumns(changed) if changed else df
    for name, metadata in kept.items():
        df = df.withMetadata(name, metadata) if metadata else df
    return df


def column_type(df: DataFrame, entry: Field):
    """A field's column type in ``df``; math does not change it."""
    found = find_column(df, entry.name)
    return df.schema[found].dataType if found else entry.spark_type

"""Event rows as text: JSON, CSV, array-JSON and console lines.

Every function gives one ``value`` column, ready for text files and topics.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, functions as F

from socklens.catalog import canonical, field


def _event(fields: Iterable[str], host: Column | None) -> Column:
    values = [F.col(canonical(f)).alias(canonical(f)) for f in fields]
    values.append(F.col("Timestamp"))
    if host is not None:
        values.append(host.alias("Hostname"))
    return F.to_json(F.struct(*values))


def to_event_json(
    df: DataFrame, fields: Iterable[str], hostname: str | Column | None = None, keep: Iterable[str] = ()
) -> DataFrame:
    """JSON object in field order, Timestamp after the fields.

    With ``hostname`` (a constant or a column) Hostname is the last key.
    """
    host = F.lit(hostname) if isinstance(hostname, str) else hostname
    return df.select(_event(fields, host).alias("value"), *keep)


def _quoted(name: str) -> Column:
    """A value as it stands in the event JSON: texts quoted, numbers bare."""
    if not field(name).is_text:
        return F.col(name).cast("string")
    text = F.to_json(F.struct(F.col(name).alias("v")))
    return F.when(F.col(name).isNotNull(), F.substr(text, F.lit(6), F.length(text) - 6))


def _values(fields: Iterable[str]) -> list[Column]:
    return [F.coalesce(_quoted(canonical(f)), F.lit("")) for f in fields] + [F.col("Timestamp").cast("string")]


def to_csv_lines(df: DataFrame, fields: Iterable[str], keep: Iterable[str] = ()) -> DataFrame:
    """Values in field order, then unix seconds; texts keep their quotes."""
    return df.select(F.concat_ws(",", *_values(fields)).alias("value"), *keep)


def to_array_lines(df: DataFrame, fields: Iterable[str], keep: Iterable[str] = ()) -> DataFrame:
    """As :func:`to_csv_lines`, in brackets."""
    line = F.concat(F.lit("["), F.concat_ws(",", *_values(fields)), F.lit("]"))
    return df.select(line.alias("value"), *keep)


def to_console_lines(df: DataFrame, fields: Iterable[str], keep: Iterable[str] = ()) -> DataFrame:
    """Event JSON without its braces."""
    text = _event(fields, None)
    return df.select(F.substr(text, F.lit(2), F.length(text) - 2).alias("value"), *keep)


def csv_header(fields: Iterable[str]) -> str:
    return ",".join([*map(canonical, fields), "timestamp"])


def array_header(fields: Iterable[str]) -> str:
    return f"[{csv_header(fields)}]"

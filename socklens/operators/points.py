"""Time-series points and their line protocol text."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, functions as F, types as T

from socklens.catalog import TYPED_COLUMNS
from socklens.operators.conform import EXTRA, present_map, without

_NUMBERS = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)


def point_columns(df: DataFrame, geo_field: str | None, mode: str, keep: list[str]) -> tuple[list[str], list[str]]:
    """(tags, fields): the text and the number columns of points, by name."""
    names = [c for c in df.columns if c not in keep and c != "Timestamp"]
    if mode == "pb":
        names = [c for c in TYPED_COLUMNS if c in names]
    elif mode not in ("json", "spb"):
        raise ValueError(f"unknown serialization: {mode}")
    if geo_field:
        names = [c for c in names if c != geo_field]
    texts = sorted(c for c in names if isinstance(df.schema[c].dataType, T.StringType))
    return texts, sorted(c for c in names if isinstance(df.schema[c].dataType, _NUMBERS))


def to_points(
    df: DataFrame,
    measurement: str,
    geo_field: str | None = None,
    mode: str = "json",
    keep: Iterable[str] = (),
) -> DataFrame:
    """``measurement``, ``tags``, ``fields`` and ``time`` of each row.

    Texts become tags, numbers become fields, Timestamp becomes the time.
    ``geo_field`` names the address that was looked up: its place is taken by
    the geo tags already in ``df``. ``pb`` points hold typed-row columns only.
    """
    keep = list(keep)
    texts, numbers = point_columns(df, geo_field, mode, keep)
    tags = present_map({c: F.col(c) for c in texts}, "string")
    values = present_map({c: F.col(c) for c in numbers}, "decimal(20,0)" if mode == "pb" else "double")
    if mode != "pb" and EXTRA in df.columns:
        df = df.withColumns({"_tags": tags, "_values": values})
        more = without(without(F.col(EXTRA), F.col("_tags")), F.col("_values"))
        more = F.map_filter(more, lambda k, v: k != F.lit(geo_field or ""))
        words = F.map_filter(F.transform_values(more, lambda k, v: _variant_text(v)), lambda k, v: v.isNotNull())
        digits = F.map_filter(F.transform_values(more, lambda k, v: _variant_number(v)), lambda k, v: v.isNotNull())
        tags, values = F.map_concat("_tags", words), F.map_concat("_values", digits)
    return df.select(
        F.lit(measurement).alias("measurement"),
        tags.alias("tags"),
        values.alias("fields"),
        F.timestamp_seconds("Timestamp").alias("time"),
        *keep,
    )


def _variant_text(value: Column) -> Column:
    return F.when(F.schema_of_variant(value) == "STRING", F.try_variant_get(value, "$", "string"))


def _variant_number(value: Column) -> Column:
    number = F.schema_of_variant(value).rlike("^(BIGINT|DOUBLE|DECIMAL)")
    return F.when(number, F.try_variant_get(value, "$", "double"))


def _escape(text: Column, special: str) -> Column:
    """Backslashes before the special signs; a line end becomes the two signs that stand for it."""
    for sign in special:
        text = F.replace(text, F.lit(sign), F.lit("\\" + sign))
    return F.replace(text, F.lit("\n"), F.lit("\\n"))


def _sorted(entries: Column) -> Column:
    return F.array_sort(F.map_entries(entries))


def _number(value: Column, kind: T.DataType) -> Column:
    """A whole number in digits, at any size; else the shortest decimal form."""
    if not isinstance(kind, (T.FloatType, T.DoubleType)):
        return value.cast("string")
    whole = F.when(value == F.floor(value), value.cast("decimal(38,0)").cast("string"))
    return F.coalesce(whole, value.cast("string"))


def to_lines(
    df: DataFrame,
    measurement: str,
    geo_field: str | None = None,
    mode: str = "json",
    keep: Iterable[str] = (),
) -> DataFrame:
    """Line protocol of rows, straight from their columns.

    The lines of ``to_line_protocol(to_points(...))``, where names and their
    order are known when the plan is built. Points of ``pb`` rows are marked as
    unsigned integers.
    """
    keep = list(keep)
    texts, numbers = point_columns(df, geo_field, mode, keep)
    suffix = F.lit("u" if mode == "pb" else "")
    tags = [F.when(F.col(c) != "", F.concat(F.lit(_plain(c) + "="), _escape(F.col(c), ",= "))) for c in texts]
    fields = [F.concat(F.lit(_plain(c) + "="), _number(F.col(c), df.schema[c].dataType), suffix) for c in numbers]
    values = F.concat_ws(",", *fields)
    nanos = (F.col("Timestamp").cast("bigint") * F.lit(1_000_000_000)).cast("string")
    line = F.concat_ws(" ", F.concat_ws(",", F.lit(_plain(measurement, ", ")), *tags), values, nanos)
    some = F.coalesce(*[F.col(c).cast("string") for c in numbers]).isNotNull() if numbers else F.lit(False)
    return df.where(some).select(line.alias("value"), *keep)


def _plain(name: str, special: str = ",= ") -> str:
    for sign in special:
        name = name.replace(sign, "\\" + sign)
    return name.replace("\n", "\\n")


def to_line_protocol(points: DataFrame, unsigned: bool = False, keep: Iterable[str] = ()) -> DataFrame:
    """Line protocol text: tags and fields sorted by key, nanosecond time.

    Empty tags are left out. ``unsigned`` marks whole numbers as unsigned
    integers, as points from typed rows have them. Points without a field have
    no line.
    """
    suffix, kind = "u" if unsigned else "", points.schema["fields"].dataType.valueType
    tags = F.filter(_sorted(F.col("tags")), lambda e: e["value"] != "")
    tags = F.transform(tags, lambda e: F.concat(_escape(e["key"], ",= "), F.lit("="), _escape(e["value"], ",= ")))
    fields = F.transform(
        _sorted(F.col("fields")), lambda e: F.concat(_escape(e["key"], ",= "), F.lit("="), _number(e["value"], kind), F.lit(suffix))
    )
    head = F.concat_ws(",", F.array(_escape(F.col("measurement"), ", ")), tags)
    nanos = (F.unix_seconds("time") * F.lit(1_000_000_000)).cast("string")
    line = F.concat_ws(" ", head, F.array_join(fields, ","), nanos)
    return points.where(F.size("fields") > 0).select(line.alias("value"), *keep)

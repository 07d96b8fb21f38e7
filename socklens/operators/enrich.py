"""Geo and AS-number columns by IP lookup.

A lookup table holds address ranges ``(lo, hi, ...)``: BIGINT bounds for IPv4,
BINARY(16) bounds for IPv6. Networks may nest; the innermost one holds an address.
Ranges that cross are refused, unless the narrowest is asked to hold an address.
A table with nested or crossing ranges is cut into disjoint ones when it is opened.

While the tables fit the broadcast limit, events are never shuffled: a range is
filed under the leading bytes that ``lo`` and ``hi`` share, so a lookup is an
equi-join on a byte prefix plus a bounds check. Each range filed under a prefix
crosses a boundary of the next byte, and disjoint ranges cannot share one: at
most 255 candidates per prefix and 5 (IPv4) or 17 (IPv6) prefix lengths.

Beyond the limit, distinct addresses and all ranges of all tables are swept
together (:func:`socklens.operators.sweep.sweep_join`), and events joined with
what was found by their address, where adaptive execution splits a hot one.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field
from functools import reduce

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from socklens.functions.address import add_lookup_keys
from socklens.operators.sweep import bound_key, flatten, sweep_join, wide_key
from socklens.settings import stash

LEVELS = ("asn", "city", "city-asn", "city-loc", "city-loc-asn")
CROSSINGS = ("refuse", "narrowest")
MAX_BROADCAST_BYTES = 512 << 20
_ROW_OVERHEAD = 64

# -- fixed values: what a valid address without a record resolves to -------
_ZERO = {
    "CCode": "",
    "Country": "",
    "City": "",
    "GeoLocation": "0.000000,0.000000",
    "ASN": "0",
    "ASNOrg": "",
}
_CITY = ("CCode", "Country", "City", "CSCode", "Region")
_ASN = ("ASN", "ASNOrg")


def check_level(level: str) -> str:
    if level.lower() not in LEVELS:
        raise ValueError(f"unknown geo level: {level}")
    return level.lower()


def _by_family(tables) -> dict[int, DataFrame]:
    """``{4: df, 6: df}`` from one DataFrame or a mapping."""
    if isinstance(tables, Mapping):
        return dict(tables)
    wide = isinstance(tables.schema["lo"].dataType, T.BinaryType)
    return {6 if wide else 4: tables}


def _city_record(df: DataFrame, with_location: bool) -> Column:
    text = {c: F.coalesce(F.col(c), F.lit("")) for c in ("CCode", "Country", "City")}
    subdivided = F.col("CSCode").isNotNull() | F.col("Region").isNotNull()
    for c in ("CSCode", "Region"):
        text[c] = F.when(subdivided, F.coalesce(F.col(c), F.lit("")))
    if with_location:
        lat, lon = (F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in ("lat", "lon"))
        text["GeoLocation"] = F.format_string("%f,%f", lat, lon)
    return F.struct(*[c.alias(n) for n, c in text.items()])


def _asn_record(df: DataFrame) -> Column:
    return F.struct(
        F.coalesce(F.col("ASN").cast("string"), F.lit("0")).alias("ASN"),
        F.coalesce(F.col("ASNOrg"), F.lit("")).alias("ASNOrg"),
    )


def _shared_bytes(family: int) -> Column:
    """Number of leading bytes ``lo`` and ``hi`` have in common."""
    if family == 4:
        different = F.col("lo").bitwiseXOR(F.col("hi"))
        return F.lit(4) - sum(F.when(different >= F.lit(1 << s).cast("bigint"), 1).otherwise(0) for s in (0, 8, 16, 24))
    shared = F.lit(16)
    for n in reversed(range(16)):  # the shortest mismatch is tried first
        same = F.substring("lo", 1, n + 1) == F.substring("hi", 1, n + 1)
        shared = F.when(~same, n).otherwise(shared)
    return shared


def _prefix(key: Column, family: int, length: int) -> Column:
    if family == 4:
        return F.shiftright(key, 8 * (4 - length))
    return F.substring(key, 1, length)


def _overlaps(ranges: DataFrame, family: int) -> DataFrame:
    """(bad, overlap): whether a range ends before it begins, and whether two share an address; one row.

    Ranges are compared with the one before inside blocks of equal leading
    bytes, then whole blocks with the blocks before, so no task sorts the table.
    """
    block = F.shiftright("lo", 16) if family == 4 else F.substring("lo", 1, 4)
    marked = ranges.where("lo IS NOT NULL AND hi IS NOT NULL").select("lo", "hi", block.alias("block"))
    inside = Window.partitionBy("block").orderBy("lo", "hi").rowsBetween(Window.unboundedPreceding, -1)
    near = marked.select("block", "lo", "hi", (F.col("lo") > F.col("hi")).alias("bad"), (F.max("hi").over(inside) >= F.col("lo")).alias("overlap"))
    flags = [F.bool_or(c).alias(c) for c in ("bad", "overlap")]
    blocks = near.groupBy("block").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), *flags)
    top = F.shiftright("lo", 24) if family == 4 else F.substring("lo", 1, 2)
    before = Window.partitionBy("top").orderBy("lo").rowsBetween(Window.unboundedPreceding, -1)
    reach = F.coalesce(F.max("hi").over(before) >= F.col("lo"), F.lit(False))
    tops = blocks.withColumn("top", top).withColumn("overlap", F.coalesce("overlap", F.lit(False)) | reach)
    tops = tops.groupBy("top").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), *flags)
    # one row per leading byte (IPv4) or two (IPv6)
    order = Window.orderBy("top").rowsBetween(Window.unboundedPreceding, -1)
    far = tops.select("bad", (F.coalesce("overlap", F.lit(False)) | F.coalesce(F.max("hi").over(order) >= F.col("lo"), F.lit(False))).alias("overlap"))
    return far.agg(*[F.coalesce(F.bool_or(c), F.lit(False)).alias(c) for c in ("bad", "overlap")])


def _disjoint(filed: DataFrame, family: int, crossing: str) -> tuple[DataFrame, bool]:
    """(disjoint ranges that give each address its innermost one, whether there are ranges to refuse)."""
    keyed = filed.select(bound_key(F.col("lo"), family).alias("lo"), bound_key(F.col("hi"), family).alias("hi"), "record")
    flat = flatten(keyed, crossing == "narrowest")
    refused = not flat.where("bad").isEmpty()
    bounds = []
    for c in ("lo", "hi"):
        address = F.substring(c, 2, 16)
        bounds.append((F.conv(F.hex(address), 16, 10).cast("bigint") if family == 4 else address).alias(c))
    return flat.select(*bounds, "record"), refused


@dataclass
class RangeTable:
    """One lookup table of disjoint ranges, filed by prefix length.

    ``sizes`` maps (family, prefix length) to the bytes of its ranges; it is
    measured once, when the table is opened.
    """

    name: str
    frames: dict[int, DataFrame]
    sizes: dict[tuple[int, int], int] = field(default_factory=dict)

    @classmethod
    def open(cls, name: str, tables, record, crossing: str = "refuse") -> RangeTable:
        frames, measured, read = {}, [], {}
        for family, df in _by_family(tables).items():
            lo, hi = F.col("lo"), F.col("hi")
            if family == 4:
                lo, hi = lo.cast("bigint"), hi.cast("bigint")
            read[family] = df.select(lo.alias("lo"), hi.alias("hi"), record(df).alias("record"))
            # read once: the check, the sizes and a join per prefix length share it
            frames[family] = read[family].withColumn("length", _shared_bytes(family).cast("int")).persist(StorageLevel.MEMORY_AND_DISK)
            measured += [_sizes(frames[family], family), _overlaps(frames[family], family).select(F.lit(family), F.lit(None), F.lit(None), "bad", "overlap")]
        rows = reduce(DataFrame.union, measured).collect()  # at most 24 rows
        refused = any(r.bad for r in rows)
        for family in [r.family for r in rows if r.overlap and not refused]:
            flat, refused = _disjoint(read[family], family, crossing)
            frames[family].unpersist()
            frames[family] = flat.withColumn("length", _shared_bytes(family).cast("int")).persist(StorageLevel.MEMORY_AND_DISK)
            rows = [r for r in rows if r.family != family] + _sizes(frames[family], family).collect()
        if refused:
            for frame in frames.values():
                frame.unpersist()
            raise ValueError(f"the {name} table has ranges that overlap without nesting, are listed twice or end before they begin")
        return cls(name, frames, {(r.family, r.length): r.bytes for r in rows if r.length is not None})

    def close(self) -> None:
        for frame in self.frames.values():
            frame.unpersist()

    def lookup(self, df: DataFrame, keys: Mapping[int, str]) -> DataFrame:
        """Add a ``_<name>`` record column by broadcast joins; at most one range holds an address."""
        found = []
        for family, length in sorted(self.sizes):
            tag = f"_{self.name}_{family}_{length}"
            key = F.col(keys[family])
            ranges = self.frames[family].where(F.col("length") == length).select(
                _prefix(F.col("lo"), family, length).alias(f"{tag}_at"),
                F.col("lo").alias(f"{tag}_lo"),
                F.col("hi").alias(f"{tag}_hi"),
                F.col("record").alias(tag),
            )
            inside = key.between(F.col(f"{tag}_lo"), F.col(f"{tag}_hi"))
            on = (_prefix(key, family, length) == F.col(f"{tag}_at")) & inside
            df = df.join(F.broadcast(ranges), on, "left")
            df = df.drop(f"{tag}_at", f"{tag}_lo", f"{tag}_hi")
            found.append(tag)
        record = F.coalesce(*found) if found else F.lit(None)
        return df.withColumn(f"_{self.name}", record).drop(*found)

    def keyed(self) -> DataFrame:
        """All ranges with bounds that sort over both families."""
        parts = [
            frame.where("lo IS NOT NULL AND hi IS NOT NULL").select(
                bound_key(F.col("lo"), family).alias("lo"), bound_key(F.col("hi"), family).alias("hi"), "record"
            )
            for family, frame in self.frames.items()
        ]
        return reduce(DataFrame.unionByName, parts)


def _sizes(frame: DataFrame, family: int) -> DataFrame:
    """(family, length, bytes, NULL, NULL) of each prefix length."""
    held = F.sum(F.octet_length(F.to_json("record")) + _ROW_OVERHEAD)
    sized = frame.groupBy("length").agg(held.alias("bytes"))
    return sized.select(F.lit(family).alias("family"), "length", "bytes", F.lit(None).cast("boolean").alias("bad"), F.lit(None).cast("boolean").alias("overlap"))


class GeoLookup:
    """City and AS-number tables opened for one level of detail.

    ``crossing`` says what ranges do that overlap without nesting: ``refuse`` raises,
    with ``narrowest`` the one of the fewest addresses holds what they share (of
    equally narrow ones that which begins last). A range listed twice is refused in either case.
    """

    def __init__(self, level: str, city=None, asn=None, max_broadcast_bytes: int = MAX_BROADCAST_BYTES, crossing: str = "refuse"):
        self.level = check_level(level)
        if crossing not in CROSSINGS:
            raise ValueError(f"unknown crossing: {crossing}")
        parts = self.level.split("-")
        for part, table in (("city", city), ("asn", asn)):
            if part in parts and table is None:
                raise ValueError(f"geo level {self.level} needs the {part} table")
        self.with_location = "loc" in parts
        self.tables: list[RangeTable] = []
        self.columns: list[str] = []
        if "city" in parts:
            self.tables.append(RangeTable.open("city", city, lambda d: _city_record(d, self.with_location), crossing))
            self.columns += [*_CITY, *(["GeoLocation"] if self.with_location else [])]
        if "asn" in parts:
            self.tables.append(RangeTable.open("asn", asn, _asn_record, crossing))
            self.columns += _ASN
        self.all_small = sum(size for t in self.tables for size in t.sizes.values()) <= max_broadcast_bytes

    def close(self) -> None:
        """Give back the memory of the tables; plans made so far read them again."""
        for table in self.tables:
            table.close()

    def _records(self, df: DataFrame) -> DataFrame:
        """Add ``_geo`` from the records found: a struct of the level's columns, NULL without a valid address (``_valid``)."""
        values = []
        for name in self.columns:
            source = "_asn" if name in _ASN else "_city"
            value = F.col(source)[name]
            values.append((F.coalesce(value, F.lit(_ZERO[name])) if name in _ZERO else value).alias(name))
        out = df.withColumn("_geo", F.when(F.col("_valid"), F.struct(*values)))
        return out.drop("_valid", *[f"_{t.name}" for t in self.tables])

    def attach(self, df: DataFrame, geo_field: str) -> DataFrame:
        """``df`` with a ``_geo`` struct for the address in ``geo_field``."""
        if not self.all_small:
            return self._swept(df, geo_field)
        out = add_lookup_keys(df, geo_field, "_key4", "_key6")
        for table in self.tables:
            out = table.lookup(out, {4: "_key4", 6: "_key6"})
        valid = F.col("_key4").isNotNull() | F.col("_key6").isNotNull()
        return self._records(out.withColumn("_valid", valid).drop("_key4", "_key6"))

    def _swept(self, df: DataFrame, geo_field: str) -> DataFrame:
        """Tables too large to broadcast: distinct addresses are swept with all ranges, which starts jobs at once."""
        if df.isStreaming:
            raise ValueError("a stream needs tables that can be broadcast; enrich its micro-batches instead")
        distinct = df.select(F.col(geo_field).alias("address")).where("address IS NOT NULL").distinct()
        keyed = add_lookup_keys(distinct, "address", "_key4", "_key6").select("address", wide_key(F.col("_key4"), F.col("_key6")).alias("key"))
        keyed = stash(keyed, "addresses")  # events are read and addresses worked out once
        found = sweep_join(keyed.where("key IS NOT NULL"), {t.name: t.keyed() for t in self.tables})
        names = [F.col(t.name).alias(f"_{t.name}") for t in self.tables]
        resolved = self._records(found.select(F.col("address").alias("_address"), F.lit(True).alias("_valid"), *names))
        return df.join(resolved, F.col(geo_field) == F.col("_address"), "left").drop("_address")

    def enrich(self, df: DataFrame, geo_field: str = "SAddr", merge: str = "overwrite") -> DataFrame:
        """Merge the looked-up columns into ``df``.

        ``overwrite``: a looked-up value replaces a column of the same name;
        ``fill``: the row's own value wins. Rows stay in either case, also
        without an address or without the address column.
        """
        if merge not in ("overwrite", "fill"):
            raise ValueError(f"unknown merge: {merge}")
        if geo_field not in df.columns:
            missing = [c for c in self.columns if c not in df.columns]
            return df.withColumns({c: F.lit(None).cast("string") for c in missing})
        merged = {}
        for name in self.columns:
            value = F.col("_geo")[name]
            if name in df.columns:
                pair = (value, F.col(name)) if merge == "overwrite" else (F.col(name), value)
                value = F.coalesce(*pair)
            merged[name] = value
        return self.attach(df, geo_field).withColumns(merged).drop("_geo")


def enrich_geo(
    df: DataFrame,
    level: str,
    city=None,
    asn=None,
    geo_field: str = "SAddr",
    merge: str = "overwrite",
    max_broadcast_bytes: int = MAX_BROADCAST_BYTES,
    crossing: str = "refuse",
) -> DataFrame:
    """Open the tables and enrich ``df``; see :class:`GeoLookup`."""
    return GeoLookup(level, city, asn, max_broadcast_bytes, crossing).enrich(df, geo_field, merge)

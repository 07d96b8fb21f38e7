"""Packed socket records and JSON payloads to typed columns, and back.

A packed record is the C struct of the selected fields: members in field order,
each at its natural alignment, the whole padded to the widest member. Offsets
depend on the field list only, so they are fixed when the plan is built.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, functions as F, types as T

from socklens.catalog import FIELDS, Field, event_schema, field
from socklens.functions.address import add_lookup_keys, fold_zeros, ipv4_from_key, ipv4_key, ipv6_groups
from socklens.operators.conform import EXTRA
from socklens.operators.project import HOST_ORDER
from socklens.settings import free_names
from socklens.functions.bits import cstr, cstr_bytes, raw_word, swap_bytes, uint_bytes, unsigned64

CORRUPT = "_corrupt_record"


def record_layout(fields: Iterable[str], inet: int) -> tuple[list[tuple[Field, int]], int]:
    """((field, offset) per member, padded size) of a record."""
    members, at, widest = [], 0, 1
    for entry in map(field, fields):
        align = entry.alignment(inet)
        at = -(-at // align) * align
        members.append((entry, at))
        at += entry.width(inet)
        widest = max(widest, align)
    return members, -(-at // widest) * widest


def decode_records(
    df: DataFrame,
    fields: Iterable[str],
    inet: int = 4,
    data: str = "record",
    keep: Iterable[str] = (),
    wide: bool = False,
    fix_lport: bool = False,
) -> DataFrame:
    """Decode a BINARY column into one column per field, in field order.

    Integers come as INT / BIGINT; with ``wide`` 64-bit fields are
    DECIMAL(20,0), which also holds values above 2^63 - 1. Records too short
    for the field list give NULL fields. The kernel keeps the local port in
    host order while the decoder reads network order, so LPort comes out
    byte-swapped; ``fix_lport`` undoes that.
    """
    members, _ = record_layout(fields, inet)
    needed = max((at + entry.width(inet) for entry, at in members), default=0)
    whole = F.col(data).isNotNull() & (F.length(data) >= needed)

    # integers and addresses are cut out of eight-byte words, each read once
    words: dict[int, int] = {}
    for entry, at in members:
        if entry.ctype == "char":
            continue
        for start in range(at, at + entry.width(inet), 8):
            words[start // 8] = max(words.get(start // 8, 0), start % 8 + min(entry.width(inet), 8))
    read = {f"_word{w}": raw_word(F.col(data), 8 * w, size) for w, size in words.items()}
    df = df.withColumns(read) if read else df

    def stored(at: int, width: int) -> Column:
        bits = F.shiftrightunsigned(F.col(f"_word{at // 8}"), 8 * (words[at // 8] - at % 8 - width))
        return bits if width == 8 else bits.bitwiseAND(F.lit((1 << 8 * width) - 1).cast("bigint"))

    if inet == 6:
        for entry, at in members:
            if entry.is_ip:
                df = df.withColumn(f"_groups_{entry.name}", ipv6_groups(stored(at, 8), stored(at + 8, 8)))

    def number(entry: Field, at: int) -> Column:
        width = entry.width(inet)
        bits = stored(at, width)
        big_endian = entry.big_endian and not (fix_lport and entry.name == "LPort")
        value = bits if big_endian else swap_bytes(bits, width)
        return unsigned64(value) if width == 8 and wide else value.cast(entry.spark_type)

    def text(entry: Field, at: int) -> Column:
        if entry.ctype == "char":
            return cstr(F.substring(data, at + 1, entry.width(inet)))
        if inet == 4:
            return ipv4_from_key(stored(at, 4))
        high, low = stored(at, 8), stored(at + 8, 8)
        mapped = (high == 0) & (F.shiftrightunsigned(low, 32) == 0xFFFF)
        return F.when(mapped, ipv4_from_key(low)).otherwise(fold_zeros(F.col(f"_groups_{entry.name}")))

    columns = []
    for entry, at in members:
        value = F.when(whole, text(entry, at) if entry.is_text else number(entry, at))
        host_order = fix_lport and entry.name == "LPort"
        columns.append(value.alias(entry.name, metadata=HOST_ORDER) if host_order else value.alias(entry.name))
    return df.select(*columns, *keep)


def encode_records(
    df: DataFrame, fields: Iterable[str], inet: int = 4, data: str = "record", keep: Iterable[str] = ()
) -> DataFrame:
    """Pack field columns into the BINARY record :func:`decode_records` reads."""
    members, size = record_layout(fields, inet)
    for entry, _ in members:
        if entry.is_ip and inet == 6:
            df = add_lookup_keys(df, entry.name, f"_{entry.name}4", f"_{entry.name}6")
    parts, at = [], 0
    for entry, start in members:
        if start > at:
            parts.append(F.unhex(F.lit("00" * (start - at))))
        width = entry.width(inet)
        if entry.ctype == "char":
            part = cstr_bytes(F.col(entry.name), width)
        elif entry.is_ip and inet == 6:
            mapped = F.concat(F.unhex(F.lit("00" * 10 + "FFFF")), uint_bytes(F.col(f"_{entry.name}4"), 4, True))
            part = F.coalesce(F.col(f"_{entry.name}6"), mapped)
        elif entry.is_ip:
            part = uint_bytes(ipv4_key(F.col(entry.name)), 4, True)
        else:
            part = uint_bytes(F.col(entry.name), width, entry.big_endian)
        parts.append(F.coalesce(part, F.unhex(F.lit("00" * width))))
        at = start + width
    if size > at:
        parts.append(F.unhex(F.lit("00" * (size - at))))
    return df.select(F.concat(*parts).alias(data), *keep)


_NUMBER = T.DecimalType(38, 18)  # 64-bit counters, fractions and exponents
# nothing that is no JSON
_STRICT = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT, "allowSingleQuotes": "false", "allowNonNumericNumbers": "false"}


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def _ddl(row: T.StructType) -> str:
    return ", ".join(f"{_quoted(f.name)} {f.dataType.simpleString()}" for f in row.fields)


def _one_object(text: str, row: T.StructType) -> str:
    """SQL for the one object that a payload holds, as ``row``.

    The payload is read as the elements of an array, followed by its length: a
    second object, or text that belongs to none, makes it another array or no JSON.
    """
    whole = f"v array<struct<{_ddl(row).replace('` ', '`: ')}>>, n int, {CORRUPT} string"
    options = ", ".join(f"'{k}', '{v}'" for k, v in _STRICT.items())
    return f"""from_json(concat('{{"v":[', {text}, '],"n":', length({text}), '}}'), '{whole}', map({options}))"""


def _fits(read: str, text: str) -> str:
    """SQL for whether :func:`_one_object` found the one object and nothing else."""
    one = f"{read}.{CORRUPT} IS NULL AND size({read}.v) = 1 AND get({read}.v, 0) IS NOT NULL"
    return f"coalesce({one} AND {read}.n = length({text}), false)"


def decode_json(
    df: DataFrame,
    schema: T.StructType | None = None,
    value: str = "value",
    keep: Iterable[str] = (),
    wide: bool = False,
    extra: bool = False,
) -> DataFrame:
    """Decode JSON payloads, one object each; undecodable ones land in ``_corrupt_record``.

    ``schema`` defaults to every catalog field plus the stamps. Keys outside it
    are ignored, or with ``extra`` kept in the map ``_extra``; missing ones are
    NULL, and of a repeated key the last value counts. Integer fields take any JSON
    number, cut to whole (digits behind the 18th decimal are rounded); with ``wide``
    64-bit counters are DECIMAL(20,0). A number that its column cannot hold makes
    the payload undecodable, never silently NULL; negative ones stay, as payloads do not
    say which field is unsigned. Also undecodable: any text behind the object and, with
    ``extra``, a key that is repeated inside an extra value.

    Payloads are parsed once, with whole numbers; only those that this does not
    fit are parsed again with fractions and numbers of any size; ``extra`` takes a parse of its own.
    """
    schema = schema or event_schema()
    fields = [f for f in schema.fields if f.name != CORRUPT]
    whole = {f.name for f in fields if isinstance(f.dataType, (T.IntegerType, T.LongType))}

    counters = [f.name for f in fields if wide and f.name in FIELDS and FIELDS[f.name].ctype == "u64"]
    found = T.StructType([T.StructField(f.name, T.DecimalType(20, 0) if f.name in counters else f.dataType) for f in fields])
    broad = T.StructType([T.StructField(f.name, _NUMBER if f.name in whole else f.dataType) for f in fields])

    plain, row, payload = free_names([*df.columns, *schema.names, EXTRA, CORRUPT], "_plain", "_row", "_text")
    text = F.col(payload)
    # numbers cut to whole, then what they are in their columns; the row is NULL if one does not fit
    names = [_quoted(f.name) for f in found.fields]
    cut = {n: f"CASE WHEN x.{n} < 0 THEN ceil(x.{n}) ELSE floor(x.{n}) END" for n in names}
    held = {
        _quoted(f.name): f"try_cast(CASE WHEN y.{_quoted(f.name)} < 18446744073709551616BD THEN y.{_quoted(f.name)} END AS {f.dataType.simpleString()})"
        for f in found.fields if f.name in whole
    }
    unfit = [f"(y.{n} IS NOT NULL AND {h} IS NULL)" for n, h in held.items()]

    def struct(values: list[str]) -> str:
        return f"named_struct({', '.join(v for f, e in zip(found.fields, values) for v in (_literal(f.name), e))})"

    step = struct([cut[n] if f.name in whole else f"x.{n}" for f, n in zip(found.fields, names)])
    fitted = struct([held.get(n, f"y.{n}") for n in names])
    good = f"transform(filter(array({_one_object(payload, broad)}), b -> {_fits('b', payload)}), b -> get(b.v, 0))"
    again = f"get(transform(transform({good}, x -> {step}), y -> CASE WHEN NOT ({' OR '.join(unfit) or 'false'}) THEN {fitted} END), 0)"
    kept = f"get({plain}.v, 0)"
    if counters:
        kept = f"CAST({kept} AS struct<{_ddl(found).replace('` ', '`: ')}>)"
    # unpacked by generators, so that a later filter on the marker cannot pull a second parse below itself
    rows = df.select(F.col(value).cast("string").alias(payload), *keep)
    rows = rows.select(F.expr(f"inline(array(named_struct('{plain}', {_one_object(payload, T.StructType(fields))})))"), payload, *keep)
    rows = rows.select(F.expr(f"inline(array(named_struct('{row}', CASE WHEN {_fits(plain, payload)} THEN {kept} ELSE {again} END)))"), payload, *keep)
    columns = [F.col(row)[f.name].alias(f.name) for f in fields]
    undecodable = F.coalesce(text, F.lit(""))
    if not extra:
        return rows.select(*columns, F.when(F.col(row).isNull(), undecodable).alias(CORRUPT), *keep)
    keys = F.when(F.col(row).isNotNull(), _extra_keys(text, [f.name for f in fields]))
    rows = rows.select(F.inline(F.array(F.struct(keys.alias(EXTRA)))), row, payload, *keep)
    bad = F.col(EXTRA).isNull()
    columns = [F.when(~bad, c).alias(f.name) for c, f in zip(columns, fields)]
    return rows.select(*columns, EXTRA, F.when(bad, undecodable).alias(CORRUPT), *keep)


def _literal(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _extra_keys(text: Column, known: list[str]) -> Column:
    """Map of the keys that are no column to VARIANT, the last value of each."""
    every = F.from_json(text, "map<string,variant>", _STRICT)
    entries = F.filter(F.map_entries(every), lambda e: ~e["key"].isin(known))

    def once(entries: Column) -> Column:
        keys = F.transform(entries, lambda e: e["key"])
        # rare, so the places of all keys are compared only where one is repeated
        last = F.filter(entries, lambda e, i: ~F.exists(F.slice(entries, i + 2, F.size(entries)), lambda x: x["key"] == e["key"]))
        return F.map_from_entries(F.when(F.size(F.array_distinct(keys)) < F.size(keys), last).otherwise(entries))

    # a variable of a lambda, so that the payload is not parsed again for each use of its entries
    return F.get(F.transform(F.array(entries), once), F.lit(0))


def split_malformed(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(good rows, rejects) of :func:`decode_json`.

    Rejects keep the payload and any columns carried along; good rows lose the
    marker column.
    """
    good = df.where(F.col(CORRUPT).isNull()).drop(CORRUPT)
    return good, df.where(F.col(CORRUPT).isNotNull())


def decode_protobuf(df: DataFrame, message: str, descriptor: str, value: str = "value") -> DataFrame:
    """Decode typed protobuf payloads where Spark's protobuf module is installed.

    ``descriptor`` is a descriptor-set file of the typed row's message. Bytes
    that are no such message land in ``_corrupt_record``, as base64.
    """
    from pyspark.sql.protobuf.functions import from_protobuf

    row = from_protobuf(F.col(value), message, descFilePath=descriptor, options={"mode": "PERMISSIVE"})
    marker = F.when(F.col("_row").isNull(), F.coalesce(F.base64(F.col(value)), F.lit("")))
    return df.select(row.alias("_row"), value).select("_row.*", marker.alias(CORRUPT))

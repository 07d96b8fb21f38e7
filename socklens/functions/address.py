"""IP addresses: bytes to text, text to comparable keys.

All expressions are native columns. Invalid input gives NULL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from socklens.functions.bits import raw_word

_OCTET = "(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
_IPV4 = rf"^{_OCTET}(\.{_OCTET}){{3}}$"
_MAPPED = "00000000000000000000FFFF"


def _let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once per row."""
    return F.element_at(F.transform(F.array(value), body), 1)


def ipv4_text(data: Column) -> Column:
    """Dotted quad of four bytes in network order."""
    return F.when(F.length(data) >= 4, ipv4_from_key(raw_word(data, 0, 4)))


def ipv4_from_key(key: Column) -> Column:
    """Dotted quad of an integer key."""
    byte = F.lit(255).cast("bigint")
    a, b, c, d = (F.shiftright(key, s).bitwiseAND(byte).cast("string") for s in (24, 16, 8, 0))
    dot = F.lit(".")
    return F.concat(a, dot, b, dot, c, dot, d)


def ipv6_text(data: Column) -> Column:
    """Shortest text of sixteen bytes: lower case, the longest run of zero
    groups (the first on a tie, two groups or more) as ``::``, and IPv4-mapped
    addresses as dotted quads."""
    return F.when(F.length(data) == 16, ipv6_from_words(raw_word(data, 0, 8), raw_word(data, 8, 8)))


def ipv6_from_words(high: Column, low: Column) -> Column:
    """As :func:`ipv6_text`, from the two big-endian halves of an address."""
    mapped = (high == 0) & (F.shiftrightunsigned(low, 32) == 0xFFFF)
    return F.when(mapped, ipv4_from_key(low)).otherwise(_let(ipv6_groups(high, low), fold_zeros))


def ipv6_groups(high: Column, low: Column) -> Column:
    """All eight groups of an address, as ``:a:b:...:``."""
    group = F.lit(0xFFFF).cast("bigint")
    groups = [F.hex(F.shiftright(w, s).bitwiseAND(group)) for w in (high, low) for s in (48, 32, 16, 0)]
    colon = F.lit(":")
    return F.lower(F.concat(*[part for g in groups for part in (colon, g)], colon))


def fold_zeros(joined: Column) -> Column:
    """``:a:b:...:`` without its outer colons, its longest run of zero groups
    replaced by ``::``."""
    colon = F.lit(":")
    folded = F.trim(joined, colon)
    for run in range(2, 9):  # wrapped last, tried first: the longest run
        zeros = ":" + "0:" * run
        at = F.instr(joined, zeros)
        before = F.ltrim(F.substr(joined, F.lit(1), at - 1), colon)
        after = F.rtrim(F.substr(joined, at + len(zeros)), colon)
        folded = F.when(at > 0, F.concat(before, F.lit("::"), after)).otherwise(folded)
    return F.when(F.contains(joined, F.lit(":0:0:")), folded).otherwise(F.trim(joined, colon))


def ipv4_key(text: Column) -> Column:
    """BIGINT key of a dotted quad."""
    # NULL unless valid, so that the parts below are shared and never fail
    valid = F.when(text.rlike(_IPV4), text)
    parts = F.split(valid, r"\.").cast("array<int>")
    return sum(F.get(parts, F.lit(i)).cast("bigint") * (1 << 24 - 8 * i) for i in range(4))


def ipv6_key(text: Column) -> Column:
    """BINARY(16) key of IPv6 text; compares byte by byte, unsigned."""
    return _groups_key(_spread_zeros(_zero_edges(_hex_groups_only(text))))


def _hex_groups_only(text: Column) -> Column:
    """IPv6 text with a dotted tail (``::ffff:10.0.0.1``) written as groups."""
    tail = F.substring_index(text, ":", -1)
    digits = F.lpad(F.hex(ipv4_key(tail)), 8, "0")
    head = F.substr(text, F.lit(1), F.length(text) - F.length(tail))
    spelled = F.concat(head, F.regexp_replace(digits, "^(.{4})", "$1:"))
    return F.when(F.contains(text, F.lit(":")), F.when(F.contains(text, F.lit(".")), spelled).otherwise(text))


def _zero_edges(text: Column) -> Column:
    """Write the zero group of a ``::`` at either end."""
    front = F.when(F.startswith(text, F.lit("::")), F.concat(F.lit("0"), text)).otherwise(text)
    return F.when(F.endswith(text, F.lit("::")), F.concat(front, F.lit("0"))).otherwise(front)


def _spread_zeros(text: Column) -> Column:
    """Replace ``::`` by the zero groups it stands for: one at least, which may
    be the one written at an edge."""
    missing = 8 - (F.length(text) - F.length(F.replace(text, F.lit(":"), F.lit(""))))
    spread = F.replace(text, F.lit("::"), F.concat(F.lit(":"), F.repeat(F.lit("0:"), missing)))
    at_edge = F.startswith(text, F.lit("0::")) | F.endswith(text, F.lit("::0"))
    return F.when(F.contains(text, F.lit("::")), F.when((missing > 0) | at_edge, spread)).otherwise(text)


def _groups_key(text: Column) -> Column:
    valid = F.when(text.rlike("^([0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}$"), text)
    groups = F.split(valid, ":")
    return F.unhex(F.concat(*[F.lpad(F.get(groups, F.lit(i)), 4, "0") for i in range(8)]))


def is_mapped(key: Column) -> Column:
    """True for the sixteen-byte form of an IPv4 address."""
    return F.substring(key, 1, 12) == F.lit(bytearray.fromhex(_MAPPED))


def add_lookup_keys(df: DataFrame, address: str, name4: str, name6: str) -> DataFrame:
    """Add the BIGINT IPv4 key and the BINARY IPv6 key of an address column.

    At most one is set; IPv4-mapped IPv6 text counts as IPv4.
    """
    wide, text = F.col("_wide"), F.col(address)
    mapped = F.coalesce(is_mapped(wide), F.lit(False))
    low = F.conv(F.hex(F.substring(wide, 13, 4)), 16, 10).cast("bigint")
    # step by step, so that each text is worked out once
    return (
        df.withColumn("_groups", _hex_groups_only(text))
        .withColumn("_groups", _zero_edges(F.col("_groups")))
        .withColumn("_groups", _spread_zeros(F.col("_groups")))
        .withColumn("_wide", _groups_key(F.col("_groups")))
        .withColumns({name4: F.coalesce(ipv4_key(text), F.when(mapped, low)), name6: F.when(~mapped, wide)})
        .drop("_groups", "_wide")
    )

"""Reads of fixed-width integers and texts inside a BINARY column.

Bytes go through one ``hex``/``conv`` pair per eight-byte word; everything
after that is integer arithmetic, so a record decode stays in generated code.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F, types as T

_U64 = "18446744073709551616"


def raw_word(data: Column, offset: int, width: int) -> Column:
    """``width`` (1..8) bytes at ``offset`` as a big-endian BIGINT bit pattern."""
    digits = F.hex(F.substring(data, offset + 1, width))
    return F.conv(digits, 16, -10).cast(T.LongType())


def swap_bytes(value: Column, width: int) -> Column:
    """Reverse the lowest ``width`` bytes of an integer bit pattern."""
    if width == 1:
        return value
    out = None
    for i in range(width):
        byte = F.shiftrightunsigned(value, 8 * i).bitwiseAND(F.lit(0xFF).cast("bigint"))
        byte = F.shiftleft(byte, 8 * (width - 1 - i))
        out = byte if out is None else out.bitwiseOR(byte)
    return out


def unsigned64(value: Column) -> Column:
    """A 64-bit pattern held in BIGINT as its unsigned DECIMAL(20,0) value."""
    wide = value.cast("decimal(21,0)")
    return F.when(value < 0, wide + F.lit(_U64).cast("decimal(21,0)")).otherwise(wide).cast("decimal(20,0)")


def pattern64(value: Column) -> Column:
    """Inverse of :func:`unsigned64`."""
    wide = value.cast("decimal(21,0)")
    half = F.lit(str(2**63)).cast("decimal(21,0)")
    return F.when(wide >= half, wide - F.lit(_U64).cast("decimal(21,0)")).otherwise(wide).cast("bigint")


def uint_be(data: Column, offset: int, width: int) -> Column:
    """Unsigned big-endian integer; BIGINT, or DECIMAL(20,0) for eight bytes."""
    word = raw_word(data, offset, width)
    word = F.when(F.length(data) >= offset + width, word)
    return unsigned64(word) if width == 8 else word


def uint_le(data: Column, offset: int, width: int) -> Column:
    """Unsigned little-endian integer; BIGINT, or DECIMAL(20,0) for eight bytes."""
    word = swap_bytes(raw_word(data, offset, width), width)
    word = F.when(F.length(data) >= offset + width, word)
    return unsigned64(word) if width == 8 else word


def cstr(data: Column) -> Column:
    """Text up to the first zero byte."""
    return F.substring_index(F.decode(data, "UTF-8"), "\x00", 1)


def pid_of(pid_tgid: Column) -> Column:
    """Process id: the upper half of the kernel's pid/tgid word."""
    return F.shiftrightunsigned(pid_tgid, 32)


def uint_bytes(value: Column, width: int, big_endian: bool = False) -> Column:
    """``width`` bytes holding the integer's lowest bits."""
    pattern = value.cast("bigint")
    if not big_endian:
        pattern = swap_bytes(pattern, width)
    digits = F.lpad(F.hex(pattern), 16, "0")
    return F.unhex(F.substring(digits, 17 - 2 * width, 2 * width))


def cstr_bytes(text: Column, width: int = 16) -> Column:
    """Text cut to ``width - 1`` bytes and padded with zero bytes."""
    data = F.substring(F.encode(F.coalesce(text, F.lit("")), "UTF-8"), 1, width - 1)
    return F.unhex(F.rpad(F.hex(data), 2 * width, "0"))

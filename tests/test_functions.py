import ipaddress
import random
import re

import pytest
from pyspark.sql import functions as F

from socklens.functions import address, cmath


def _python_text(data: bytes) -> str:
    value = ipaddress.IPv6Address(data)
    return str(value.ipv4_mapped or value.compressed)


def test_ipv6_text_and_key_round_trip(spark):
    rng = random.Random(7)
    data = [bytes(16), bytes(15) + b"\1", bytes(10) + b"\xff\xff\x0a\x00\x00\x01"]
    for _ in range(2000):
        groups = [rng.choice([0, 0, 0, 1, rng.randrange(256), rng.randrange(65536)]) for _ in range(8)]
        data.append(b"".join(g.to_bytes(2, "big") for g in groups))
    df = spark.createDataFrame([(bytearray(d), _python_text(d)) for d in data], "data binary, want string")
    got = df.select("data", "want", address.ipv6_text(F.col("data")).alias("got"), address.ipv6_key(F.col("want")).alias("key"))
    assert got.where("got IS NULL OR got <> want").count() == 0
    assert got.where("contains(want, ':') AND (key IS NULL OR key <> data)").count() == 0


ADDRESSES = [
    ("1.2.3.4", 0x01020304, None),
    ("255.255.255.255", 2**32 - 1, None),
    ("::ffff:10.0.0.1", 0x0A000001, None),
    ("64:ff9b::1.2.3.4", None, "0064ff9b000000000000000001020304"),
    ("::", None, "00" * 16),
    ("1:2:3:4:5:6:7::", None, "00010002000300040005000600070000"),
    ("::2:3:4:5:6:7:8", None, "00000002000300040005000600070008"),
    *[(bad, None, None) for bad in (
        "256.1.1.1", "01.2.3.4", "1.2.3", "1.2.3.4.5", "a.b.c.d", "", ":::", "1::2::3", "1:2:3:4:5:6:7:8::",
        "::1:2:3:4:5:6:7:8", "1:2:3:4::5:6:7:8", "::ffff:10.0.0.256", "fe80::1%eth0", "12345::", "g::", None,
        ":1:2:3:4:5:6:7", "1.2.3.4::",
    )],
]


def test_lookup_keys(spark):
    df = spark.createDataFrame([(i, a[0]) for i, a in enumerate(ADDRESSES)], "i int, a string")
    for row in address.add_lookup_keys(df, "a", "k4", "k6").collect():
        got = (row.a, row.k4, bytes(row.k6).hex() if row.k6 is not None else None)
        assert got == ADDRESSES[row.i]


CASES = [
    ("/1000", 32), (">> 3", 32), ("*1000", 32), ("- 5", 32), ("-5/2", 32), ("- 5 >> 1", 32), ("<<4|1", 32),
    ("*4000000000", 32), ("*0xffffffff", 32), ("/ 7 % 1000", 32), ("& 0xff00 ^ 3 | 8", 32), ("+ 1", 16), ("- 1", 16),
    ("* 70000 / 3", 16), ("- 300 >> 2", 16), ("*2", 8), ("- 5 / 2 % 7", 8), ("- 1 >> 1", 8), ("+ 5000000000", 32),
    ("- 5000000000 / 3", 32), ("/7%3", 64), ("*3", 64), ("+1", 64), ("^0xff", 64), (">>60", 64), ("- 1", 64),
    ("*12345678901234", 64), ("<< 5 & 0xffffffffff", 64), ("- 10 % 9", 64), ("*(3+4)-(1<<2)", 32),
]


class CInt:
    """A C integer, evaluated by Python's own operators."""

    def __init__(self, value, bits, signed):
        value %= 1 << bits
        self.value = value - (1 << bits) if signed and value >> (bits - 1) else value
        self.bits, self.signed = bits, signed

    def _with(self, other, op, shift=False):
        bits, signed = self.bits, self.signed
        if not shift:
            bits = max(self.bits, other.bits)
            signed = all(o.signed or o.bits < bits for o in (self, other))
        a, b = CInt(self.value, bits, signed).value, CInt(other.value, bits, signed).value
        return CInt(op(a, b), bits, signed)

    def __add__(self, o): return self._with(o, lambda a, b: a + b)
    def __sub__(self, o): return self._with(o, lambda a, b: a - b)
    def __mul__(self, o): return self._with(o, lambda a, b: a * b)
    def __and__(self, o): return self._with(o, lambda a, b: a & b)
    def __or__(self, o): return self._with(o, lambda a, b: a | b)
    def __xor__(self, o): return self._with(o, lambda a, b: a ^ b)
    def __lshift__(self, o): return self._with(o, lambda a, b: a << b, True)
    def __rshift__(self, o): return self._with(o, lambda a, b: a >> b, True)
    def __truediv__(self, o): return self._with(o, lambda a, b: abs(a) // abs(b) * (1 if (a < 0) == (b < 0) else -1))
    def __mod__(self, o): return self._with(o, lambda a, b: abs(a) % abs(b) * (1 if a >= 0 else -1))


def literal(digits):
    value = int(digits, 0)
    unsigned = digits.startswith("0x") and 2**31 <= value < 2**32
    return CInt(value, 32 if value < 2**31 or unsigned else 64, not unsigned)


def test_field_math_means_what_c_means(spark):
    """Each suffix over edge values and random ones."""
    rng = random.Random(3)
    wrong = []
    for suffix, bits in CASES:
        top = 1 << bits
        values = [0, 1, 2, 3, 4, 5, 9, top - 1, top - 2, top >> 1, (top >> 1) - 1] + [rng.randrange(top) for _ in range(40)]
        df = spark.createDataFrame([(str(v),) for v in values], "t string").withColumn("v", F.col("t").cast("decimal(20,0)"))
        column = F.col("v") if bits == 64 else F.col("v").cast("bigint")
        for row in df.select("t", cmath.math(column, bits, suffix).cast("string").alias("r")).collect():
            x = CInt(int(row.t), max(bits, 32), bits < 32)
            typed = re.sub(r"0x[0-9a-f]+|\d+", r"literal('\g<0>')", suffix)
            want = eval(f"x {typed}", {"x": x, "literal": literal}).value % top
            if row.r != str(want):
                wrong.append((suffix, bits, row.t, row.r, want))
    assert wrong == []


@pytest.mark.parametrize("suffix", ["/0", "% 0", "** 2", "// 3", "; drop", "+ RTT", "* 1.5", "<< 40", "+", "+ 010"])
def test_field_math_rejects(suffix):
    with pytest.raises(ValueError):
        cmath.math(F.lit(1), 32, suffix)


@pytest.mark.parametrize(
    "text, bits, dropped",
    [
        ("RTT < 1", 32, [0]),
        ("RTT<2||RTT>4", 32, [0, 1, 5, 4294967295]),
        ("RTT > 1 && RTT < 4 || RTT == 0", 32, [0, 2, 3]),
        ("!(RTT > 1)", 32, [0, 1]),
        ("!RTT", 32, [0]),
        ("RTT", 32, [1, 2, 3, 4, 5, 4294967295]),
        ("RTT & 1", 32, [1, 3, 5, 4294967295]),
        ("(RTT & 3) == 1", 32, [1, 5]),
        ("RTT - 1 > 100", 32, [0, 4294967295]),
        ("rtt >= 5", 32, [5, 4294967295]),
        ("RTT * 2 != RTT + 3", 32, [0, 1, 2, 4, 5, 4294967295]),
        ("RTT > 4", 64, [5, 4294967295]),
        ("10 / RTT > 3", 32, [1, 2]),
    ],
)
def test_conditions(spark, text, bits, dropped):
    df = spark.createDataFrame([(v,) for v in (0, 1, 2, 3, 4, 5, 4294967295)], "RTT bigint")
    hit = cmath.condition(F.col("RTT"), bits, "RTT", text)
    assert sorted(r.RTT for r in df.where(hit).collect()) == dropped


@pytest.mark.parametrize("text", ["SRTT > 1", "1 < RTT < 5", "RTT & 1 == 0", "RTT > 1 and RTT < 3", "RTT = 1", "~RTT", "f(RTT)"])
def test_conditions_reject(text):
    with pytest.raises(ValueError):
        cmath.condition(F.lit(1), 32, "RTT", text)

import ipaddress
import struct

import pytest
from pyspark.sql import functions as F

from socklens import decode_json, decode_records, encode_records, split_malformed
from socklens.catalog import FIELDS, event_schema
from socklens.functions import bits
from socklens.operators.decode import record_layout

FIELD_LIST = ["PID", "Task", "SRTT", "RTT", "BytesReceived", "SegsIn", "SAddr", "DAddr", "DPort"]

# records packed by the standard library, members at their own alignment
_HEAD = struct.pack("<I16sII4xQI", 70_001, b"sender\0left over", 48_000, 4_294_967_295, 2**40 + 5, 17)
RECORD_V4 = _HEAD + ipaddress.ip_address("192.168.7.9").packed + ipaddress.ip_address("203.0.113.250").packed + struct.pack(">H2x", 8443)
RECORD_V6 = (
    _HEAD + bytes(4) + ipaddress.ip_address("2001:db8::a:0:0:1").packed + ipaddress.ip_address("::ffff:198.51.100.3").packed + struct.pack(">H14x", 53)
)
_READ = (70_001, "sender", 48_000, 4_294_967_295, 2**40 + 5, 17)


def _record(spark, data):
    data = bytearray.fromhex(data) if isinstance(data, str) else bytearray(data)
    return spark.createDataFrame([(data,)], "record binary")


def test_ipv4_record(spark):
    row = decode_records(_record(spark, RECORD_V4), FIELD_LIST, 4).first()
    assert tuple(row) == (*_READ, "192.168.7.9", "203.0.113.250", 8443)


def test_ipv6_record(spark):
    row = decode_records(_record(spark, RECORD_V6), FIELD_LIST, 6).first()
    assert tuple(row) == (*_READ, "2001:db8::a:0:0:1", "198.51.100.3", 53)


def test_layout_is_naturally_aligned():
    members, size = record_layout(FIELD_LIST, 4)
    assert {e.name: at for e, at in members}["BytesReceived"] == 32
    assert size == len(RECORD_V4) == 56
    members, size = record_layout(FIELD_LIST, 6)
    assert {e.name: at for e, at in members}["SAddr"] == 48
    assert size == len(RECORD_V6) == 96


def test_short_record_is_null(spark):
    row = decode_records(_record(spark, RECORD_V4[:20]), FIELD_LIST, 4).first()
    assert set(row) == {None}


def test_all_fields_round_trip(spark):
    names = list(FIELDS)
    values = {}
    for i, (name, entry) in enumerate(FIELDS.items()):
        if entry.is_ip:
            values[name] = f"10.{i}.255.{i + 1}"
        elif entry.is_text:
            values[name] = "fifteen letters"
        else:
            values[name] = (1 << min(entry.bits, 63)) - 1 - i
    df = spark.createDataFrame([tuple(values[n] for n in names)], event_schema(names).fieldNames()[: len(names)])
    packed = encode_records(df, names, 4)
    assert decode_records(packed, names, 4).first().asDict() == values
    values["SAddr"], values["DAddr"] = "2001:db8::17", "10.1.2.3"  # the latter as mapped address
    df = spark.createDataFrame([tuple(values[n] for n in names)], names)
    assert decode_records(encode_records(df, names, 6), names, 6).first().asDict() == values


def test_wide_integers_and_local_port(spark):
    names = ["LPort", "BytesSent"]
    digits = "1f90" + "00" * 6 + "ffffffffffffffff"
    row = decode_records(_record(spark, digits), names, wide=True).first()
    assert (row.LPort, int(row.BytesSent)) == (0x1F90, 2**64 - 1)
    assert decode_records(_record(spark, digits), names, fix_lport=True).first().LPort == 0x901F


def test_bit_reads(spark):
    d = F.col("record")
    df = _record(spark, "0102030405060708ff").select(
        bits.uint_be(d, 0, 2), bits.uint_le(d, 0, 2), bits.uint_be(d, 1, 4), bits.uint_le(d, 1, 4),
        bits.uint_be(d, 0, 8), bits.uint_le(d, 1, 8), bits.uint_le(d, 4, 8),
    )
    assert list(df.first()) == [
        0x0102, 0x0201, 0x02030405, 0x05040302, 0x0102030405060708, 0xFF08070605040302, None,
    ]


def test_malformed_payloads_are_split_off(spark):
    payloads = ['{"RTT":5,"SAddr":"::1"}', '{"RTT":5', "", "null", "[1", None, '{"RTT":"text"}', '{"Other":1}']
    df = spark.createDataFrame([(p,) for p in payloads], "value string")
    good, rejects = split_malformed(decode_json(df, event_schema(["RTT", "SAddr"])))
    assert "_corrupt_record" not in good.columns
    assert sorted(r._corrupt_record for r in rejects.collect()) == ["", "", "[1", "null", '{"RTT":"text"}', '{"RTT":5']
    assert sorted((str(r.RTT), str(r.SAddr)) for r in good.collect()) == [("5", "::1"), ("None", "None")]


@pytest.mark.parametrize("value", [b'{"RTT":7}', '{"RTT":7}'])
def test_binary_and_text_payloads(spark, value):
    kind = "binary" if isinstance(value, bytes) else "string"
    df = spark.createDataFrame([(value,)], f"value {kind}")
    assert decode_json(df, event_schema(["RTT"])).first().RTT == 7


def test_json_numbers_of_any_form(spark):
    lines = ['{"BytesReceived":18446744073709551615}', '{"BytesReceived":5.9,"RTT":-1.5}', '{"BytesReceived":1.2e4}', '{"BytesReceived":18446744073709551616}', '{"RTT":"x"}', '{"RTT":true}']
    df = spark.createDataFrame([(line,) for line in lines], "value string").coalesce(1)
    schema = event_schema(["BytesReceived", "RTT"])
    good, bad = split_malformed(decode_json(df, schema, wide=True))
    assert [(str(r.BytesReceived), r.RTT) for r in good.collect()] == [("18446744073709551615", None), ("5", -1), ("12000", None)]
    assert [r._corrupt_record for r in bad.collect()] == lines[3:]
    good, bad = split_malformed(decode_json(df, schema))
    assert [r.BytesReceived for r in good.collect()] == [5, 12000] and bad.count() == 4


@pytest.mark.parametrize(
    ("payload", "good"),
    [
        ('{"RTT":1}', True), (' \n{"RTT":1}\t ', True), ('{"RTT":1,"RTT":2}', True), ('{"RTT":1}{"RTT":2}', False), ('{"RTT":1} x', False),
        ('{"RTT":1},{"RTT":2}', False), ('{"RTT":1}]', False), ('{"RTT":1}],"n":9}', False), ("[]", False), ("", False), (None, False), ("null", False),
        ("7", False), ("{'RTT':1}", False), ('{"RTT":NaN}', False), ('{"Task":"a\\"}{","RTT":1}', True),
    ],
)
@pytest.mark.parametrize("extra", [False, True])
def test_a_payload_is_one_object(spark, payload, good, extra):
    df = spark.createDataFrame([(payload,)], "value string")
    row = decode_json(df, event_schema(["Task", "RTT"]), wide=True, extra=extra).first()
    assert (row._corrupt_record is None) == good and row.RTT == ((2 if "2" in payload else 1) if good else None)
    assert good or row._corrupt_record == (payload or "")


def test_extra_keys_keep_the_last_value(spark):
    df = spark.createDataFrame([('{"A":1,"RTT":5,"B":2,"A":[3],"a":4}',), ('{"X":{"b":1,"b":2}}',)], "value string").coalesce(1)
    rows = decode_json(df, event_schema(["RTT"]), extra=True).selectExpr("to_json(_extra) AS extra", "_corrupt_record").collect()
    assert rows[0].extra == '{"B":2,"A":[3],"a":4}' and rows[0]._corrupt_record is None
    assert rows[1].extra is None and rows[1]._corrupt_record == '{"X":{"b":1,"b":2}}'

import pytest
from pyspark.sql import functions as F

from socklens import (
    from_dynamic,
    multiplex,
    Spec,
    split_strict,
    to_array_lines,
    to_bulk_bodies,
    to_bulk_lines,
    to_console_lines,
    to_csv_lines,
    to_documents,
    to_dynamic,
    to_event_json,
    to_line_protocol,
    to_points,
    to_table_rows,
    to_typed,
    to_variant,
)
from socklens.catalog import TYPED_COLUMNS, event_schema
from socklens.operators.decode import decode_json
from tests.conftest import plan_of
from workload.registry import _unpacked

# Values are our own; the layout of the expected texts is that of the formats: fixed values.
ROW = "PID long, Task string, RTT long, SAddr string, Timestamp long, Hostname string"


@pytest.fixture(scope="module")
def df(spark):
    return spark.createDataFrame([(70001, "sender", 48000, "10.0.0.1", 1700333444, "foo")], ROW)


def _value(frame):
    return frame.first().value


def test_lines(spark):
    df = spark.createDataFrame([(5, 6, 1700111222)], "RTT long, SRTT long, Timestamp long")
    assert _value(to_csv_lines(df, ["RTT", "SRTT"])) == "5,6,1700111222"
    assert _value(to_array_lines(df, ["RTT", "SRTT"])) == "[5,6,1700111222]"
    assert _value(to_event_json(df, ["SRTT", "RTT"])) == '{"SRTT":6,"RTT":5,"Timestamp":1700111222}'
    assert _value(to_event_json(df, ["rtt"], "foo")) == '{"RTT":5,"Timestamp":1700111222,"Hostname":"foo"}'
    assert _value(to_console_lines(df, ["RTT"])) == '"RTT":5,"Timestamp":1700111222'


def test_texts_keep_quotes_and_escapes(spark):
    df = spark.createDataFrame([('a"b,c', "10.0.0.1", 1700111222)], "Task string, SAddr string, Timestamp long")
    assert _value(to_array_lines(df, ["Task", "SAddr"])) == '["a\\"b,c","10.0.0.1",1700111222]'


def test_dynamic_rows(spark, df):
    row = to_dynamic(df, ["Task", "RTT", "PID"], "hostb").first()
    assert row.strings == {"Task": "sender", "Hostname": "hostb"}
    assert row.numbers == {"RTT": 48000.0, "PID": 70001.0, "Timestamp": 1700333444.0}
    back = from_dynamic(to_dynamic(df, ["Task", "RTT"]), ["Task", "RTT", "SRTT"]).first()
    assert (back.Task, back.RTT, back.SRTT, back.Hostname) == ("sender", 48000.0, None, "foo")
    variant = to_variant(df, ["Task", "RTT"]).select(F.variant_get("row", "$.RTT", "double").alias("r")).first()
    assert variant.r == 48000.0


def test_typed_row(spark, df):
    row = to_typed(df.withColumn("NewState", F.lit(7))).first().asDict()
    assert list(row) == TYPED_COLUMNS and len(row) == 61
    assert (row["RTT"], row["Task"], row["AdvMSS"], row["Timestamp"]) == (48000, "sender", None, 1700333444)


@pytest.mark.parametrize("missing", ["strict", "zero", "null"])
def test_table_row(spark, df, missing):
    mapping = {"RTT": "rtt", "SAddr": "saddr", "Timestamp": "ts", "Hostname": "host", "City": "city"}
    row = to_table_rows(df.withColumn("City", F.lit("Harbour_Town")), mapping, missing).first()
    assert tuple(row) == (48000, "10.0.0.1", 1700333444, "foo", "Harbour_Town")


def test_missing_values(spark, df):
    mapping = {"SRTT": "srtt", "Task": "task", "City": "city"}
    assert to_table_rows(df, mapping, "strict").count() == 0
    assert split_strict(df, mapping)[1].count() == 1
    assert tuple(to_table_rows(df, mapping, "zero").first()) == (0, "sender", "")
    assert tuple(to_table_rows(df, mapping, "null").first()) == (None, "sender", None)
    with pytest.raises(ValueError):
        to_table_rows(df, {"NewState": "x"})


def test_documents(spark, df):
    want = '{"Hostname":"foo","PID":70001,"RTT":48000,"Task":"sender","Timestamp":1700333444}'
    docs = to_documents(df.drop("SAddr"))
    assert _value(docs) == want
    assert _value(to_bulk_lines(docs)) == '{"index":{}}\n' + want
    typed = _value(to_documents(df.withColumn("OldState", F.lit(1)), "pb"))
    assert typed == '{"Task":"sender","PID":70001,"SAddr":"10.0.0.1","RTT":48000,"Hostname":"foo","Timestamp":"1700333444"}'


def test_points(spark, df):
    point = to_points(df.withColumn("City", F.lit("Harbour_Town")), "m", geo_field="SAddr").first()
    assert point.tags == {"City": "Harbour_Town", "Hostname": "foo", "Task": "sender"}
    assert point.fields == {"PID": 70001.0, "RTT": 48000.0}
    assert point.time.timestamp() == 1700333444 or str(point.time) == "2023-11-18 18:50:44"


def test_line_protocol(spark, df):
    points = to_points(df.drop("SAddr"), "m")
    assert _value(to_line_protocol(points)) == "m,Hostname=foo,Task=sender PID=70001,RTT=48000 1700333444000000000"
    assert _value(to_line_protocol(points, unsigned=True)).split()[1] == "PID=70001u,RTT=48000u"
    odd = df.select(F.lit("a b,c=d").alias("Task"), F.lit("").alias("City"), "RTT", "Timestamp")
    assert _value(to_line_protocol(to_points(odd, "m n"))) == "m\\ n,Task=a\\ b\\,c\\=d RTT=48000 1700333444000000000"


def test_large_numbers_in_line_protocol(spark):
    df = spark.createDataFrame([(4294967295, 2**53, 1)], "RTT long, BytesSent long, Timestamp long")
    assert _value(to_line_protocol(to_points(df, "m"))) == "m BytesSent=9007199254740992,RTT=4294967295 1000000000"


def test_line_sinks_need_one_field_list(spark, df):
    a, b = Spec(fields=["RTT"]), Spec(fields=["SRTT"])
    with pytest.raises(ValueError):
        multiplex([(a, df), (b, df)], "csv")
    assert multiplex([(a, df.select("RTT")), (b, df.select("PID"))], "kafka").columns == ["RTT", "PID"]


@pytest.mark.parametrize(("rows", "size"), [(1, 10), (3, 10_000), (1000, 60), (7, 45), (1000, 10_000)])
def test_bodies_are_packed_in_order_to_their_limits(spark, rows, size):
    texts = ["x" * (i * 7 % 23) + "é" * (i % 3) for i in range(200)] + ["y" * 500, "", "z"]
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "9")
    try:
        df = spark.createDataFrame([(t,) for t in texts], "value string").coalesce(1)
        got = to_bulk_bodies(df, rows, size).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    want, held = [], []
    for t in texts:
        if held and (len(held) == rows or sum(len(h.encode()) + 1 for h in held) + len(t.encode()) + 1 > size):
            want.append(held)
            held = []
        held.append(t)
    want.append(held)
    assert [(r.value, r.rows) for r in got] == [("".join(t + "\n" for t in w), len(w)) for w in want]


def test_bodies_work_out_a_document_once(spark):
    """Nothing on the way to the bodies repeats a document's work, for a filter or for each line of a body."""
    lines = to_bulk_lines(to_documents(spark.range(300).selectExpr("id AS PID", "concat('a', id) AS Task")))
    bodies = to_bulk_bodies(lines, 7)
    assert plan_of(bodies).count("StructsToJsonEvaluator") == 1
    plan = plan_of(_unpacked(bodies, 7, 1 << 20))
    assert plan.index("regexp_extract_all") < plan.index("explode(")
    values = bodies.sparkSession.createDataFrame([("a",), (None,), ("b",), (None,)], "value string").coalesce(1)
    assert [tuple(r) for r in to_bulk_bodies(values, 5).collect()] == [("a\nb\n", 2)]


def test_extra_keys_take_one_parse(spark):
    payloads = spark.createDataFrame([('{"A":1,"A":2,"Task":"x","B":{"c":1}}',), ('{"A":{"c":1,"c":2}}',)], "value string")
    rows = decode_json(payloads, event_schema(["Task"]), extra=True)
    assert plan_of(rows).count("from_json(") == 3  # plain, with numbers of any size, and the extra keys
    assert [r._extra and {k: str(v) for k, v in r._extra.items()} for r in rows.collect()] == [{"A": "2", "B": '{"c":1}'}, None]

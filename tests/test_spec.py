import struct

import pytest
from pyspark.sql import functions as F

from socklens import Spec, apply_math, conformance, decode_records, drop_where, multiplex, project, run_spec, run_specs, specs_from_config
from socklens.catalog import FIELDS, TCP_STATES, TRACEPOINTS, TYPED_COLUMNS, canonical, catalog, typed_schema
from tests.conftest import plan_of
from workload.views import tcp_events


def test_catalog(spark):
    assert len(FIELDS) == 53 and len(TYPED_COLUMNS) == 61 and len(TRACEPOINTS) == 7 and len(TCP_STATES) == 13
    assert set(FIELDS) - set(TYPED_COLUMNS) == {"NewState", "OldState"}
    assert len(typed_schema()) == 61
    tables = catalog(spark)
    assert tables["fields"].count() == 53 and tables["states"].count() == 13 and tables["tracepoints"].count() == 7
    assert FIELDS["SAddr"].width(4) == 4 and FIELDS["SAddr"].width(6) == 16


def test_names():
    assert canonical("srtt") == canonical("SRTT") == "SRTT"
    with pytest.raises(ValueError):
        canonical("ttr")


def test_default_spec():
    spec = Spec()
    assert (spec.tracepoint, spec.tcp_state, spec.inet, spec.sample, spec.egress) == (
        "sock:inet_sock_set_state", "TCP_CLOSE", [4], 0, "console",
    )
    assert spec.field_names == ["RTT", "TotalRetrans", "SAddr", "DAddr", "DPort"]
    assert Spec(inet=[]).inet == [4]
    assert Spec(tcp_state="tcp_listen").tcp_state == "TCP_LISTEN"


@pytest.mark.parametrize(
    "bad",
    [
        {"fields": ["ttr"]},
        {"fields": []},
        {"fields": ["RTT", "rtt"]},
        {"tracepoint": "tcp:unknown"},
        {"tcp_state": "TCP_UNKNOWN"},
        {"tcp_state": "", "tracepoint": "tcp:tcp_probe"},
        {"inet": [5]},
        {"sample": -1},
    ],
)
def test_invalid_specs(bad):
    with pytest.raises(ValueError):
        Spec(**bad)


def test_config():
    config = {
        "tracepoints": [{"name": "sock:inet_sock_set_state", "fields": "f", "tcp_state": "TCP_CLOSE", "inet": [4, 6], "egress": "e"}],
        "fields": {"f": [{"name": "rtt", "math": "/1000", "filter": "rtt < 1"}]},
        "egress": {"e": {"type": "console"}},
    }
    (spec,) = specs_from_config(config)["e"]
    assert spec.fields[0].name == "RTT" and spec.inet == [4, 6]
    for part in ("fields", "egress"):
        with pytest.raises(ValueError):
            specs_from_config({**config, part: {}})


def test_math_runs_before_filter(spark):
    df = spark.createDataFrame(
        [(i, "sock:inet_sock_set_state", 6, 4, 7, i * 500, 1) for i in range(8)],
        "id int, Tracepoint string, Protocol int, Inet int, NewState int, SRTT long, Timestamp long",
    )
    spec = Spec(fields=[{"name": "srtt", "math": "/1000", "filter": "SRTT>1"}])
    assert [r.SRTT for r in run_spec(df, spec).orderBy("SRTT").collect()] == [0, 0, 1, 1]


def test_selection_reaches_the_scan(spark, sf_dir, tmp_path):
    """State, protocol and family filters are pushed down; unused columns are not read."""
    path = str(tmp_path / "events")
    tcp_events(spark, sf_dir).write.parquet(path)
    plan = plan_of(run_spec(spark.read.parquet(path), Spec(fields=["TotalRetrans"])))
    pushed = plan[plan.index("PushedFilters") :]
    for filter_ in ("EqualTo(Tracepoint", "EqualTo(Protocol,6)", "EqualTo(NewState,7)", "Inet"):
        assert filter_ in pushed
    schema = plan[plan.index("ReadSchema") :]
    assert "TotalRetrans" in schema and "SAddr" not in schema and "SRTT" not in schema
    assert "Exchange" not in plan


def test_conformance_lists_every_reason(spark):
    df = spark.createDataFrame(
        [("tcp:unknown", 5, 42), ("sock:inet_sock_set_state", 4, 42), ("tcp:tcp_probe", 6, None), (None, None, 7)],
        "Tracepoint string, Inet int, NewState int",
    )
    got = sorted((str(r.Tracepoint), r.reason) for r in conformance(df).collect())
    assert got == [
        ("None", "unknown tracepoint"),
        ("None", "wrong address family"),
        ("sock:inet_sock_set_state", "unknown state"),
        ("tcp:unknown", "unknown tracepoint"),
        ("tcp:unknown", "wrong address family"),
    ]


def test_receive_time_is_stamped(spark):
    df = spark.createDataFrame([("tcp:tcp_probe", 4, 8)], "Tracepoint string, Inet int, SRTT long")
    spec = Spec("tcp:tcp_probe", ["RTT"], "TCP_ALL")
    row = run_spec(df, spec).first()
    assert row.RTT == 1 and row.Timestamp > 1_700_000_000
    stamped = df.withColumn("seen", F.expr("TIMESTAMP '2023-11-18 18:50:44'"))
    assert run_spec(stamped, spec, received="seen").first().Timestamp == 1700333444


@pytest.mark.parametrize("name, text, dropped", [
    ("Task", 'Task == "a!b"', ["a!b"]), ("Task", 'Task == "in"', ["in"]), ("Task", 'Task == "x && y || z//"', ["x && y || z//"]),
    ("Task", "Task == 'a~b' || Task == \"in\"", ["a~b", "in"]), ("RTT", "RTT > -1", []), ("RTT", "RTT < -1", ["a!b", "a~b", "in", "x && y || z//"]),
    ("RTT", "!(RTT - -1 > 3) && RTT != 1", ["a!b", "in"]), ("RTT", "RTT & -2", ["in", "a~b", "x && y || z//"]),
])
def test_filters_keep_quoted_texts_and_take_negative_numbers(spark, name, text, dropped):
    rows = [("a!b", 0), ("a~b", 3), ("in", 2), ("x && y || z//", 9)]
    df = spark.createDataFrame(rows, "Task string, RTT long")
    left = {r.Task for r in drop_where(df, {name: text}).collect()}
    assert {t for t, _ in rows} - left == set(dropped)


@pytest.mark.parametrize("text", ["RTT ** 2", "RTT // 2", "not RTT", "RTT in 3", "RTT > 1 ~ 2", "Task == RTT", 'RTT == "a', "RTT == a"])
def test_filters_that_are_no_c_condition(spark, text):
    with pytest.raises(ValueError):
        drop_where(spark.createDataFrame([(1,)], "RTT long"), {"RTT": text})


@pytest.mark.parametrize("fix", [False, True])
def test_math_on_a_port_that_the_kernel_keeps_in_host_order(spark, fix):
    """Port 8080 plus 1 is 8081 in the kernel's memory, whichever way the decoder shows it."""
    packed = spark.createDataFrame([(struct.pack("<H", 8080),)], "record binary")
    decoded = decode_records(packed, ["LPort"], fix_lport=fix)
    shown = (lambda port: port) if fix else (lambda port: int.from_bytes(struct.pack("<H", port)))
    assert decoded.first().LPort == shown(8080)
    added = apply_math(project(decoded, ["LPort"]), {"LPort": "+ 1"})
    assert added.first().LPort == shown(8081)
    assert drop_where(added, {"LPort": "LPort == 8081"}).count() == 0


def _three_specs(sample=(0, 0, 0)):
    return [
        Spec(fields=[{"name": "RTT", "math": "/1000", "filter": "RTT < 1"}, "SAddr"], inet=[4, 6], sample=sample[0], keep=["event_id"], order=["Timestamp", "event_id"], key=["SAddr"]),
        Spec("tcp:tcp_probe", ["SAddr", {"name": "DPort", "math": "& 0xff"}], "TCP_ALL", sample=sample[1], keep=["event_id"], order=["Timestamp", "event_id"], key=["Hostname", "DPort"]),
        Spec(fields=["RTT", {"name": "DPort", "filter": "DPort == 80"}], tcp_state="TCP_ALL", sample=sample[2], keep=["event_id"], order=["Timestamp", "event_id"], key=["Hostname"]),
    ]


@pytest.mark.parametrize("sample", [(0, 0, 0), (2, 3, 1), (0, 4, 0), (3, 0, 2)])
def test_specs_together_give_the_rows_of_each(spark, sf_dir, sample):
    events = tcp_events(spark, sf_dir).where("event_id < 600")
    together = run_specs(events, _three_specs(sample))
    apart = multiplex([(s, run_spec(events, s)) for s in _three_specs(sample)])
    assert set(together.columns) == set(apart.columns)
    assert sorted(map(str, together.collect())) == sorted(map(str, apart.select(together.columns).collect()))


def test_three_specs_scan_their_source_once(spark, tmp_path, sf_dir):
    path = str(tmp_path / "events")
    tcp_events(spark, sf_dir).limit(50).write.parquet(path)
    plan = plan_of(run_specs(spark.read.parquet(path), _three_specs()))
    assert plan.count("Scan parquet") == 2 * 1  # in the tree and in its details
    assert "PushedFilters: [Or" in plan and "Exchange" not in plan

import os

import pytest
from pyspark.sql import functions as F

from socklens import check_flows, compact, read_committed, read_compacted, read_ledger, run_agent, run_flows, write
from socklens.sources.topic import kafka_options, read_topic

# Values are our own; the layout of the expected texts is that of the formats: fixed values.
EVENTS = "RTT long, SAddr string, Timestamp long, Hostname string"


@pytest.fixture()
def df(spark):
    return spark.createDataFrame([(5, "10.0.0.1", 1700111222, "foo")], EVENTS)


def _files(path):
    return sorted(f for f in os.listdir(path) if not f.startswith(".") and f != "_SUCCESS")


@pytest.mark.parametrize("sink, header, line", [
    ("csv", "RTT,SAddr,timestamp\n", '5,"10.0.0.1",1700111222'),
    ("jsonl", "[RTT,SAddr,timestamp]\n", '[5,"10.0.0.1",1700111222]'),
])
def test_line_files_append_under_one_header(spark, df, tmp_path, sink, header, line):
    path = str(tmp_path / "out")
    for _ in range(2):
        write(df, sink, filename=path)
    assert [r.value for r in spark.read.text(path).collect()] == [line, line]
    assert (tmp_path / "out" / "_header").read_text() == header
    assert _files(path)[0].startswith("_header")


def test_sinks_need_their_settings(df):
    for sink in ("csv", "jsonl", "documents", "points", "table"):
        with pytest.raises(ValueError):
            write(df, sink)
    with pytest.raises(ValueError):
        write(df, "grpc-pb")
    with pytest.raises(ValueError):
        write(df, "kafka", path="x", compression="zip")


@pytest.fixture()
def console(tmp_path, monkeypatch):
    """What tasks print; their output is not this process's."""
    folder = str(tmp_path)

    def keep(rows):
        import uuid

        with open(f"{folder}/{uuid.uuid4().hex}.line", "w") as out:
            out.writelines(f"{r.value}\n" for r in rows)

    monkeypatch.setattr("socklens.sinks.writer._print_lines", keep)
    return lambda: [line for f in tmp_path.glob("*.line") for line in f.read_text().splitlines()]


def test_console_and_unknown_type(df, console, capfd):
    write(df, "console")
    write(df, "something else", fields=["RTT"])
    assert sorted(console()) == ['"RTT":5,"SAddr":"10.0.0.1","Timestamp":1700111222', '"RTT":5,"Timestamp":1700111222']
    write(df, "console", rows=1)
    assert '"RTT":5,"SAddr":"10.0.0.1","Timestamp":1700111222' in capfd.readouterr().out


def test_console_prints_every_line(spark, console):
    rows = spark.range(50).select(F.col("id").alias("RTT"), F.lit(7).cast("long").alias("Timestamp"))
    write(rows, "console")
    assert len(set(console())) == 50


def test_lines_are_printed(spark, capsys):
    from socklens.sinks.writer import _print_lines

    _print_lines(iter(spark.createDataFrame([("a",), ("b",)], "value string").collect()))
    assert capsys.readouterr().out == "a\nb\n"


def test_console_stream_prints_every_line(spark, console, tmp_path):
    spark.range(50).select(F.col("id").alias("RTT"), F.lit(7).cast("long").alias("Timestamp")).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("RTT long, Timestamp long").parquet(str(tmp_path / "in"))
    write(stream, "console", checkpoint=str(tmp_path / "c"), trigger={"availableNow": True}).awaitTermination()
    assert len(set(console())) == 50


def test_strict_rows_are_rejected_or_stop_the_job(spark, tmp_path):
    rows = spark.createDataFrame([(1, 2), (3, None)], "RTT long, SRTT long")
    conf = {"fields": ["RTT", "SRTT"], "columns": ["a", "b"], "serialization": "json", "path": str(tmp_path / "t")}
    with pytest.raises(Exception, match="lacks a number"):
        write(rows, "table", **conf)
    write(rows, "table", **{**conf, "mode": "overwrite"}, rejects=str(tmp_path / "r"))
    assert [tuple(r) for r in spark.read.parquet(str(tmp_path / "t")).collect()] == [(1, 2)]
    assert [tuple(r) for r in spark.read.parquet(str(tmp_path / "r")).collect()] == [('{"RTT":3}', "missing number")]


def test_typed_payload(spark, df, tmp_path):
    path = str(tmp_path / "t")
    write(df, "kafka", path=path, serialization="pb", hostname="bar")
    assert spark.read.parquet(path).first().value == '{"SAddr":"10.0.0.1","RTT":5,"Hostname":"bar","Timestamp":1700111222}'


def test_kafka_settings(spark):
    options = kafka_options({"brokers": ["a:1", "b:2"], "options": {"kafka.security.protocol": "SSL"}})
    assert options == {"kafka.bootstrap.servers": "a:1,b:2", "kafka.security.protocol": "SSL"}
    with pytest.raises(Exception, match="(?i)kafka"):  # the connector is not on this class path
        read_topic(spark, {"topic": "t"})


GOOD = {
    "ingress": {"in": {"type": "kafka"}},
    "ingestion": {"out": {"type": "points"}},
    "flow": [{"ingress": "in", "ingestion": "out", "serialization": "spb"}],
}


def test_flow_checks():
    assert len(check_flows(GOOD)) == 1
    flow = GOOD["flow"][0]
    bad = [{"flow": []}, {"ingestion": {"out": {"type": "tape"}}}]
    bad += [{"flow": [{**flow, k: ""}]} for k in flow]
    bad += [{"flow": [{**flow, k: "other"}]} for k in flow]
    bad += [{"flow": [flow, dict(flow)]}]
    for change in bad:
        with pytest.raises(ValueError):
            check_flows({**GOOD, **change})


def test_a_flow_into_a_strict_table_needs_a_place_for_rejects():
    config = {"ingress": {"in": {"config": {}}}, "ingestion": {"t": {"type": "table"}, "d": {"type": "documents"}}}
    flow = {"ingress": "in", "ingestion": "t", "serialization": "json"}
    with pytest.raises(ValueError, match="rejects"):
        check_flows({**config, "flow": [flow]})
    check_flows({**config, "flow": [{**flow, "serialization": "spb"}, {**flow, "ingestion": "d"}]})
    check_flows({**config, "ingress": {"in": {"config": {"rejects": "/r"}}}, "flow": [flow]})


def _flow_config(tmp_path, **conf):
    return {
        "ingress": {"in": {"config": {"path": str(tmp_path / "topic"), "format": "text", "rejects": str(tmp_path / "rejects")}}},
        "ingestion": {"out": {"type": "documents", "config": {"path": str(tmp_path / "out"), "trigger": {"availableNow": True}, **conf}}},
        "flow": [{"ingress": "in", "ingestion": "out", "serialization": "json"}],
    }


def _run(spark, config, tmp_path):
    for query in run_flows(spark, config, str(tmp_path / "progress")):
        query.awaitTermination()


def test_flow_survives_bad_payloads_and_restart(spark, tmp_path):
    config = _flow_config(tmp_path)
    (tmp_path / "topic").mkdir()
    for batch in ("a", "b"):
        lines = [f'{{"Task":"{batch}","RTT":1}}', "{broken", f'{{"Task":"{batch}2","SAddr":"::1"}}']
        (tmp_path / "topic" / batch).write_text("\n".join(lines))
        _run(spark, config, tmp_path)
    docs = [r.value for r in spark.read.text(str(tmp_path / "out")).collect()]
    assert sorted(d for d in docs if d != '{"index":{}}') == [
        '{"RTT":1,"Task":"a"}', '{"RTT":1,"Task":"b"}', '{"SAddr":"::1","Task":"a2"}', '{"SAddr":"::1","Task":"b2"}',
    ]
    assert [r._corrupt_record for r in spark.read.parquet(str(tmp_path / "rejects")).collect()] == ["{broken"] * 2


@pytest.mark.parametrize("small", [True, False])
def test_flow_output_does_not_depend_on_the_size_of_lookup_tables(spark, tmp_path, monkeypatch, small):
    if not small:
        monkeypatch.setattr("socklens.streaming.flows.GeoLookup", lambda level, city, asn: _tiny_limit(level, city, asn))
    (tmp_path / "topic").mkdir()
    (tmp_path / "topic" / "a").write_text('{"SAddr":"10.0.0.7"}\n{"SAddr":"10.0.1.7"}\n{"RTT":3}')
    asn = spark.createDataFrame([(167772160, 167772415, "65000", "org")], "lo long, hi long, ASN string, ASNOrg string")
    config = {**_flow_config(tmp_path), "geo": {"level": "asn", "asn": asn}}
    _run(spark, config, tmp_path)
    read = spark.read.text(str(tmp_path / "out"))
    assert read.columns == ["value", "batch_id"]
    docs = {r.value for r in read.collect()}
    assert docs == {
        '{"index":{}}', '{"ASN":"65000","ASNOrg":"org","SAddr":"10.0.0.7"}', '{"ASN":"0","ASNOrg":"","SAddr":"10.0.1.7"}', '{"RTT":3}',
    }


def _tiny_limit(level, city, asn):
    from socklens.operators.enrich import GeoLookup

    return GeoLookup(level, city, asn, max_broadcast_bytes=0)


def test_agent_stream(spark, tmp_path):
    schema = "Tracepoint string, Inet int, Protocol int, NewState int, SRTT long, Timestamp long, Hostname string"
    rows = [("sock:inet_sock_set_state", 4, 6, 7, i * 8, 100 + i, "h") for i in range(5)]
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "in"))
    config = {
        "tracepoints": [{"name": "sock:inet_sock_set_state", "fields": "f", "tcp_state": "TCP_CLOSE", "egress": "e"}],
        "fields": {"f": [{"name": "RTT"}]},
        "egress": {"e": {"type": "csv", "config": {"filename": str(tmp_path / "out"), "trigger": {"availableNow": True}}}},
    }
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    for query in run_agent(stream, config, checkpoint=str(tmp_path / "c")):
        query.awaitTermination()
    got = sorted(r.value for r in spark.read.text(str(tmp_path / "out")).collect())
    assert got == [f"{i},{100 + i}" for i in range(5)]


def test_agent_stream_samples_over_micro_batches(spark, tmp_path):
    schema = "Tracepoint string, Inet int, Protocol int, NewState int, SRTT long, Timestamp long, Hostname string"
    config = {
        "tracepoints": [
            {"name": "sock:inet_sock_set_state", "fields": "f", "tcp_state": "TCP_CLOSE", "egress": "e", "sample": 2, "key": ["Hostname"]},
            {"name": "tcp:tcp_probe", "fields": "f", "tcp_state": "TCP_ALL", "egress": "e"},
        ],
        "fields": {"f": [{"name": "RTT"}]},
        "egress": {"e": {"type": "csv", "config": {"filename": str(tmp_path / "out"), "trigger": {"availableNow": True}}}},
    }
    for part in (range(4), range(4, 9)):  # restarted in between
        rows = [("sock:inet_sock_set_state" if i != 1 else "tcp:tcp_probe", 4, 6, 7, i * 8, 100 + i, "h") for i in part]
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        for query in run_agent(stream, config, checkpoint=str(tmp_path / "c")):
            query.awaitTermination()
    got = sorted(r.value for r in spark.read.text(str(tmp_path / "out")).collect())
    assert got == ["1,101", "3,103", "6,106"]
    assert {"_header"} <= set(os.listdir(tmp_path / "out" / "batch_id=0"))


def test_ledger_counts_every_payload_of_finished_batches(spark, tmp_path):
    config = _flow_config(tmp_path)
    for lines in (['{"RTT":1}', "{broken", '{"RTT":2}'], ["nothing but this"], ['{"RTT":3}']):  # a batch each
        spark.createDataFrame([(x,) for x in lines], "value string").coalesce(1).write.mode("append").text(str(tmp_path / "topic"))
        _run(spark, config, tmp_path)
    rows = read_ledger(spark, str(tmp_path / "out")).orderBy("batch_id").collect()
    assert [tuple(r)[1:] for r in rows] == [(0, 3, 2, 1, 0), (1, 1, 0, 1, 0), (2, 1, 1, 0, 0)]
    committed = lambda: sorted(r.value for r in read_committed(spark, str(tmp_path / "out"), "text").where("value LIKE '%RTT%'").collect())
    assert committed() == ['{"RTT":1}', '{"RTT":2}', '{"RTT":3}']
    # stopped after its rows and before its row in the ledger: not read until it is replayed
    spark.createDataFrame([('{"RTT":9}',)], "value string").write.text(str(tmp_path / "out" / "batch_id=3"))
    assert committed() == ['{"RTT":1}', '{"RTT":2}', '{"RTT":3}']
    spark.createDataFrame([('{"RTT":4}',)], "value string").write.mode("append").text(str(tmp_path / "topic"))
    _run(spark, config, tmp_path)
    assert committed() == ['{"RTT":1}', '{"RTT":2}', '{"RTT":3}', '{"RTT":4}']


def test_compaction_keeps_every_row_once(spark, tmp_path):
    config = {
        "ingress": {"in": {"config": {"path": str(tmp_path / "topic"), "format": "text"}}},
        "ingestion": {"out": {"type": "table", "config": {"path": str(tmp_path / "out"), "fields": ["RTT"], "columns": ["rtt"], "trigger": {"availableNow": True}}}},
        "flow": [{"ingress": "in", "ingestion": "out", "serialization": "spb"}],
    }
    out = str(tmp_path / "out")
    rows = lambda: sorted(r.rtt for r in read_compacted(spark, out).collect())
    for i in range(6):
        spark.createDataFrame([(f'{{"RTT":{3 * i + k}}}',) for k in range(3)], "value string").coalesce(1).write.mode("append").text(str(tmp_path / "topic"))
        _run(spark, config, tmp_path)
        if i == 3:
            before = rows()
            spark.read.parquet(out).where("batch_id = 0").drop("batch_id").write.parquet(f"{out}/batch_id=-1")  # of a run that stopped
            assert rows() == before
            assert compact(spark, out, ["rtt"], keep=1) == 3 and rows() == before
    assert compact(spark, out, ["rtt"], keep=1) == 2 and compact(spark, out, ["rtt"], keep=1) == 0
    assert rows() == list(range(18))
    assert sorted(d for d in os.listdir(out) if "=" in d) == ["batch_id=-1", "batch_id=-2", "batch_id=5"]
    assert len(list((tmp_path / "out" / "batch_id=-1").glob("*.parquet"))) == 1

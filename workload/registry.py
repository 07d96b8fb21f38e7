"""One query per operator, each with the SQL that must give the same rows.

Queries run over whole tables. ``QUERIES[name](spark, sf_dir)`` gives a
DataFrame; ``ORACLES[name]`` is SQL for the same tables.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from socklens import (
    GeoLookup,
    Spec,
    apply_math,
    compact,
    catalog,
    conformance,
    decode_json,
    decode_records,
    derive_intrinsic,
    drop_where,
    encode_records,
    enrich_geo,
    event_schema,
    event_time,
    filter_family,
    filter_protocol,
    filter_state,
    multiplex,
    project,
    read_committed,
    read_compacted,
    read_ledger,
    read_packed,
    read_records,
    read_topic,
    run_agent,
    run_flows,
    run_spec,
    sample_per_socket,
    select_tracepoint,
    split_malformed,
    split_strict,
    stamp_host,
    stamp_time,
    to_array_lines,
    to_bulk_bodies,
    to_bulk_lines,
    to_console_lines,
    to_csv_lines,
    to_documents,
    to_dynamic,
    to_event_json,
    to_line_protocol,
    to_lines,
    to_points,
    to_table_rows,
    to_typed,
    to_variant,
    union_families,
    write,
    write_packed,
)
from socklens import settings
from socklens.plans.spec import stream_specs
from socklens.catalog import FIELDS, STATE_TRACEPOINT, TRACEPOINTS, TYPED_COLUMNS, typed_type
from socklens.functions import bits
from socklens.functions.address import add_lookup_keys, ipv4_text, ipv6_text
from workload import views
from workload.views import duckdb_with, scratch, tcp_events

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query and, where SQL can say it, its counterpart."""

    def register(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = duckdb_with(sql)
        return fn

    return register


RECORD_FIELDS = ["PID", "Task", "SRTT", "TotalRetrans", "AdvMSS", "BytesReceived", "SAddr", "DAddr", "DPort", "LPort", "BytesSent", "NewState"]
ARRIVAL = ("Timestamp", "event_id")
LINE_FIELDS = ["Task", "SRTT", "TotalRetrans", "SAddr", "DAddr", "DPort", "BytesSent"]
SPEC = dict(
    fields=[
        {"name": "RTT", "math": "/1000", "filter": "RTT < 1"},
        "TotalRetrans", "SAddr", "DAddr", "DPort", "LPort", "BytesReceived", "BytesSent",
    ],
    tcp_state="TCP_CLOSE",
    inet=[4, 6],
)
_RTT = "CAST(FLOOR(SRTT / 8) AS BIGINT)"
_RTT_MS = "CAST(FLOOR(FLOOR(SRTT / 8) / 1000) AS BIGINT)"
_CLOSED = f"Tracepoint = '{STATE_TRACEPOINT}' AND Protocol = 6 AND NewState = 7"
_SWAP = "(({0} % 256) * 256 + CAST(FLOOR({0} / 256) AS INT))"
_SOCKET = "Tracepoint, Inet, Hostname, SAddr, LPort, DAddr, DPort"


def _v4_key(column: str) -> str:
    parts = [f"CAST(split_part({column}, '.', {i}) AS BIGINT) * {256 ** (4 - i)}" for i in range(1, 5)]
    return f"CASE WHEN Inet = 4 THEN {' + '.join(parts)} END"


def _v6_hex(column: str) -> str:
    return (
        f"CASE WHEN Inet = 6 THEN UPPER(CONCAT(split_part({column}, ':', 1), '000000000000000000000000', "
        f"LPAD(split_part({column}, ':', 3), 4, '0'))) END"
    )


# -- domain tables and checks ----------------------------------------------


@query(
    "catalog_states",
    """SELECT StateName, COUNT(*) AS events FROM tcp_events JOIN (VALUES ('TCP_ESTABLISHED', 1), ('TCP_SYN_SENT', 2),
    ('TCP_SYN_RECV', 3), ('TCP_FIN_WAIT1', 4), ('TCP_FIN_WAIT2', 5), ('TCP_TIME_WAIT', 6), ('TCP_CLOSE', 7),
    ('TCP_CLOSE_WAIT', 8), ('TCP_LAST_ACK', 9), ('TCP_LISTEN', 10), ('TCP_CLOSING', 11), ('TCP_NEW_SYN_RECV', 12),
    ('TCP_ALL', 99)) AS s(StateName, State) ON NewState = State GROUP BY StateName""",
)
def catalog_states(spark, sf_dir):
    counts = tcp_events(spark, sf_dir).groupBy("NewState").agg(F.count(F.lit(1)).alias("events"))
    states = catalog(spark)["states"]
    return counts.join(states, F.col("NewState") == F.col("State")).select("StateName", "events")


# -- fixed values: all fields and their C types, written out beside the catalog they are compared with
_CTYPES = dict(
    entry.split(":")
    for entry in """
    TCPHeaderLen:u16 NewState:u16 OldState:u16 SRTT:u32 RTT:u32 MDev:u32 MDevMax:u32 RTTVar:u32 RcvRTT:u32 PacketsOut:u32
    RetransOut:u32 MaxPacketsOut:u32 MaxPacketsSeq:u32 TotalRetrans:u32 AdvMSS:u16 SAddr:u32 DAddr:u32 DPort:u16 LPort:u16
    BytesReceived:u64 BytesSent:u64 BytesAcked:u64 NumSAcks:u8 UserMSS:u16 RACKRTT:u32 MSSClamp:u16 Task:char PID:u32
    SegsIn:u32 SegsOut:u32 DsackDups:u32 RateDelivered:u32 RateInterval:u32 SndSSThresh:u32 GSOSegs:u16 DataSegsIn:u32
    MaxWindow:u32 SndWnd:u32 WindowClamp:u32 RcvSSThresh:u32 ECNFlags:u8 SndCwnd:u32 PrrOut:u32 Delivered:u32
    DeliveredCe:u32 Lost:u32 LostOut:u32 PriorSSThresh:u32 DataSegsOut:u32 RcvSpace:u32 UnAcked:u32 SAcked:u32 RTO:u32
    """.split()
)
_SHOWN = set(
    "OldState NewState Task PID SAddr LPort DAddr DPort SRTT TotalRetrans AdvMSS BytesReceived BytesSent".split()
)


@query(
    "catalog_fields",
    " UNION ALL ".join(
        f"SELECT '{n}' AS Field, '{ctype}' AS CType, {f'COUNT({n})' if n in _SHOWN else 'COUNT(NULL)'} AS present FROM tcp_events"
        for n, ctype in _CTYPES.items()
    ),
)
def catalog_fields(spark, sf_dir):
    """Every field of the catalog with its type, and how many events carry it."""
    events, fields = tcp_events(spark, sf_dir), catalog(spark)["fields"].select("Field", "CType")
    shown = [n for n in FIELDS if n in events.columns]
    long = events.agg(*[F.count(n).alias(n) for n in shown]).unpivot([], shown, "Field", "present")
    return fields.join(long, "Field", "left").select("Field", "CType", F.coalesce("present", F.lit(0)).alias("present"))


@query(
    "catalog_tracepoints",
    "SELECT Tracepoint, CAST(SUM(n) AS BIGINT) AS events FROM (SELECT Tracepoint, COUNT(*) AS n FROM tcp_events GROUP BY Tracepoint "
    + " ".join(f"UNION ALL SELECT '{t}', 0" for t in TRACEPOINTS)
    + ") AS t GROUP BY Tracepoint",
)
def catalog_tracepoints(spark, sf_dir):
    counts = tcp_events(spark, sf_dir).groupBy("Tracepoint").agg(F.count(F.lit(1)).alias("events"))
    joined = catalog(spark)["tracepoints"].join(counts, "Tracepoint", "left")
    return joined.select("Tracepoint", F.coalesce("events", F.lit(0)).alias("events"))


_ODD = {
    "Tracepoint": "CASE WHEN event_id % 89 = 0 THEN 'tcp:unknown' ELSE Tracepoint END",
    "Inet": "CAST(CASE WHEN event_id % 97 = 0 THEN 5 ELSE Inet END AS INT)",
    "NewState": "CAST(CASE WHEN event_id % 83 = 0 THEN 42 ELSE NewState END AS INT)",
}
_ODD_SELECT = ", ".join(f"{e} AS {n}" for n, e in _ODD.items())


@query(
    "event_conformance",
    f"""SELECT event_id, 'unknown tracepoint' AS reason FROM (SELECT event_id, {_ODD_SELECT} FROM tcp_events) AS o
    WHERE Tracepoint = 'tcp:unknown'
    UNION ALL SELECT event_id, 'wrong address family' FROM (SELECT event_id, {_ODD_SELECT} FROM tcp_events) AS o WHERE Inet = 5
    UNION ALL SELECT event_id, 'unknown state' FROM (SELECT event_id, {_ODD_SELECT} FROM tcp_events) AS o
    WHERE NewState = 42 AND Tracepoint = '{STATE_TRACEPOINT}'""",
)
def event_conformance(spark, sf_dir):
    odd = tcp_events(spark, sf_dir).selectExpr("event_id", *[f"{e} AS {n}" for n, e in _ODD.items()])
    return conformance(odd).select("event_id", "reason")


# -- decoding --------------------------------------------------------------

_PLAIN = ", ".join(["event_id", *RECORD_FIELDS])


def _records(spark, sf_dir, inet) -> DataFrame:
    rows = tcp_events(spark, sf_dir).where(F.col("Inet") == inet)
    rows = rows.withColumn("received", F.timestamp_seconds("Timestamp"))
    return encode_records(rows, RECORD_FIELDS, inet, keep=["Tracepoint", "Inet", "received", "event_id"])


@query("decode_ipv4_records", f"SELECT {_PLAIN} FROM tcp_events WHERE Inet = 4")
def decode_ipv4_records(spark, sf_dir):
    return decode_records(_records(spark, sf_dir, 4), RECORD_FIELDS, 4, keep=["event_id"])


@query("decode_ipv6_records", f"SELECT {_PLAIN} FROM tcp_events WHERE Inet = 6")
def decode_ipv6_records(spark, sf_dir):
    return decode_records(_records(spark, sf_dir, 6), RECORD_FIELDS, 6, keep=["event_id"])


@query("raw_records_source", f"SELECT {', '.join(RECORD_FIELDS)} FROM tcp_events")
def raw_records_source(spark, sf_dir):
    """Records of both families from capture files, cut at record borders."""
    parts = []
    for inet in (4, 6):
        path = scratch(spark, "captures")
        write_packed(_records(spark, sf_dir, inet), path)
        parts.append(decode_records(read_packed(spark, path, RECORD_FIELDS, inet, split_bytes=1 << 20), RECORD_FIELDS, inet))
    return union_families(*parts)


def record_files(spark, sf_dir) -> tuple[str, object]:
    path = scratch(spark, "records")
    records = _records(spark, sf_dir, 4).unionByName(_records(spark, sf_dir, 6))
    records.write.parquet(path)
    return path, records.schema


def _decode_families(records: DataFrame, fields, keep) -> DataFrame:
    v4, v6 = (decode_records(records.where(F.col("Inet") == i), fields, i, keep=keep) for i in (4, 6))
    return union_families(v4, v6)


@query("records_source", f"SELECT {_PLAIN}, Timestamp FROM tcp_events")
def records_source(spark, sf_dir):
    path, schema = record_files(spark, sf_dir)
    records = stamp_time(read_records(spark, path, schema=schema), "received")
    return _decode_families(records, RECORD_FIELDS, ["event_id", "Timestamp"])


@query("records_stream", f"SELECT {_PLAIN}, Timestamp FROM tcp_events")
def records_stream(spark, sf_dir):
    path, schema = record_files(spark, sf_dir)
    records = stamp_time(read_records(spark, path, streaming=True, schema=schema), "received")
    return _drain(spark, _decode_families(records, RECORD_FIELDS, ["event_id", "Timestamp"]))


def _drain(spark, stream: DataFrame) -> DataFrame:
    """Run a stream over all of its input; the rows it wrote."""
    out = scratch(spark, "stream")
    writer = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", f"{out}-progress")
    writer.trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


_PAYLOAD = "event_id, Task, PID, SRTT, TotalRetrans, SAddr, DAddr, DPort, BytesSent, Timestamp, Hostname"
_PAYLOAD_SCHEMA = event_schema("Task PID SRTT TotalRetrans SAddr DAddr DPort BytesSent".split())


@query("json_payloads", f"SELECT {_PAYLOAD} FROM tcp_events WHERE event_id % 101 <> 0")
def json_payloads(spark, sf_dir):
    decoded = decode_json(views.topic(spark, sf_dir), _PAYLOAD_SCHEMA, keep=["event_id"])
    return split_malformed(decoded)[0]


@query("malformed_payloads", "SELECT event_id, value AS payload FROM topic WHERE event_id % 101 = 0")
def malformed_payloads(spark, sf_dir):
    decoded = decode_json(views.topic(spark, sf_dir), _PAYLOAD_SCHEMA, keep=["event_id"])
    return split_malformed(decoded)[1].select("event_id", F.col("_corrupt_record").alias("payload"))


def _topic_files(spark, sf_dir) -> str:
    path = scratch(spark, "topic")
    views.topic(spark, sf_dir).select("value").write.parquet(path)
    return path


# the payloads carry the event id as RTT
_FROM_TOPIC = "event_id AS RTT, Task, PID, SRTT, TotalRetrans, SAddr, DAddr, DPort, BytesSent, Timestamp, Hostname"
_TOPIC_FIELDS = "RTT Task PID SRTT TotalRetrans SAddr DAddr DPort BytesSent".split()


@query("topic_source", f"SELECT {_FROM_TOPIC} FROM tcp_events WHERE event_id % 101 <> 0")
def topic_source(spark, sf_dir):
    payloads = read_topic(spark, {"path": _topic_files(spark, sf_dir)}, streaming=False)
    return split_malformed(decode_json(payloads, event_schema(_TOPIC_FIELDS)))[0]


@query("topic_stream", f"SELECT {_FROM_TOPIC} FROM tcp_events WHERE event_id % 101 <> 0")
def topic_stream(spark, sf_dir):
    payloads = read_topic(spark, {"path": _topic_files(spark, sf_dir)})
    return _drain(spark, split_malformed(decode_json(payloads, event_schema(_TOPIC_FIELDS)))[0])


@query(
    "dynamic_rows",
    """SELECT event_id, Task, SAddr, Hostname, CAST(SRTT AS DOUBLE) AS SRTT, CAST(DPort AS DOUBLE) AS DPort,
    CAST(Timestamp AS DOUBLE) AS Timestamp, 4 AS string_count, 5 AS number_count FROM tcp_events""",
)
def dynamic_rows(spark, sf_dir):
    rows = to_dynamic(tcp_events(spark, sf_dir), LINE_FIELDS, keep=["event_id"])
    text = [F.col("strings")[n].alias(n) for n in ("Task", "SAddr", "Hostname")]
    number = [F.col("numbers")[n].alias(n) for n in ("SRTT", "DPort", "Timestamp")]
    counts = [F.size("strings").alias("string_count"), F.size("numbers").alias("number_count")]
    return rows.select("event_id", *text, *number, *counts)


@query(
    "variant_rows",
    "SELECT event_id, Task, DAddr, CAST(SRTT AS DOUBLE) AS SRTT, CAST(BytesSent AS DOUBLE) AS BytesSent FROM tcp_events",
)
def variant_rows(spark, sf_dir):
    rows = to_variant(tcp_events(spark, sf_dir), LINE_FIELDS, keep=["event_id"])
    kinds = {"Task": "string", "DAddr": "string", "SRTT": "double", "BytesSent": "double"}
    return rows.select("event_id", *[F.variant_get("row", f"$.{n}", k).alias(n) for n, k in kinds.items()])


_SQL_TYPE = {"int": "INT", "bigint": "BIGINT", "string": "VARCHAR"}
_EVENT_COLUMNS = "SRTT TotalRetrans AdvMSS BytesReceived BytesSent SAddr DAddr DPort LPort Task PID Hostname Timestamp".split()


@query(
    "typed_rows",
    "SELECT event_id, "
    + ", ".join(
        f"CAST({n if n in _EVENT_COLUMNS else 'NULL'} AS {_SQL_TYPE[typed_type(n).simpleString()]}) AS {n}"
        for n in TYPED_COLUMNS
    )
    + " FROM tcp_events",
)
def typed_rows(spark, sf_dir):
    return to_typed(tcp_events(spark, sf_dir), keep=["event_id"])


# -- projections and scalars -----------------------------------------------


@query("field_projection", f"SELECT event_id, {', '.join(LINE_FIELDS)} FROM tcp_events")
def field_projection(spark, sf_dir):
    return project(tcp_events(spark, sf_dir), [n.lower() for n in LINE_FIELDS], keep=["event_id"])


@query("intrinsic_rtt", f"SELECT event_id, SRTT, {_RTT} AS RTT FROM tcp_events")
def intrinsic_rtt(spark, sf_dir):
    return derive_intrinsic(tcp_events(spark, sf_dir)).select("event_id", "SRTT", "RTT")


@query(
    "field_math",
    f"""SELECT event_id, {_RTT_MS} AS RTT, (SRTT * 1000003) % 4294967296 AS SRTT,
    (TotalRetrans - 5 + 4294967296) % 4294967296 AS TotalRetrans, AdvMSS * 50 % 65536 AS AdvMSS,
    CAST(FLOOR((BytesReceived + 7) / 3) AS BIGINT) % 1000 AS BytesReceived,
    {_SWAP.format("(" + _SWAP.format("DPort") + " + 1) % 65536")} AS DPort, PID, Task FROM tcp_events""",
)
def field_math(spark, sf_dir):
    suffixes = {
        "RTT": "/1000", "SRTT": "* 1000003", "TotalRetrans": "- 5", "AdvMSS": "*50", "DPort": "+ 1", "PID": "/2",
    }
    rows = apply_math(derive_intrinsic(tcp_events(spark, sf_dir)), suffixes)
    # a suffix follows C precedence, so parentheses cannot reach back over the field: two steps
    rows = apply_math(apply_math(rows, {"BytesReceived": "+7"}), {"BytesReceived": "/3 % 1000"})
    return rows.select("event_id", "RTT", "SRTT", "TotalRetrans", "AdvMSS", "BytesReceived", "DPort", "PID", "Task")


@query(
    "address_keys",
    f"""SELECT event_id, {_v4_key('SAddr')} AS source_v4, {_v6_hex('SAddr')} AS source_v6,
    {_v4_key('DAddr')} AS target_v4, {_v6_hex('DAddr')} AS target_v6 FROM tcp_events""",
)
def address_keys(spark, sf_dir):
    rows = tcp_events(spark, sf_dir)
    rows = add_lookup_keys(rows, "SAddr", "source_v4", "_s6")
    rows = add_lookup_keys(rows, "DAddr", "target_v4", "_d6")
    return rows.select("event_id", "source_v4", F.hex("_s6").alias("source_v6"), "target_v4", F.hex("_d6").alias("target_v6"))


@query("ipv4_texts", "SELECT event_id, SAddr, DAddr FROM tcp_events WHERE Inet = 4")
def ipv4_texts(spark, sf_dir):
    rows = tcp_events(spark, sf_dir).where("Inet = 4")
    for name in ("SAddr", "DAddr"):
        rows = add_lookup_keys(rows, name, f"_{name}", "_wide").drop("_wide")
    return rows.select(
        "event_id", *[ipv4_text(bits.uint_bytes(F.col(f"_{n}"), 4, True)).alias(n) for n in ("SAddr", "DAddr")]
    )


# eight 16-bit groups, each zero for about half of the users
_GROUPS = [f"CASE WHEN (CAST(FLOOR(user_id / {2**i}) AS BIGINT) + event_id) % 2 = 0 THEN 0 ELSE (user_id * {p} + event_id) % 65536 END"
           for i, p in enumerate((3, 5, 7, 11, 13, 17, 19, 23))]
_JOINED = "CONCAT(':', " + ", ':', ".join(f"FORMAT('{{:x}}', {g})" for g in _GROUPS) + ", ':')"
_FOLDED = " ".join(
    f"WHEN CONTAINS(j, ':{'0:' * n}') THEN REGEXP_REPLACE(j, ':{'0:' * n}', '::')" for n in range(8, 1, -1)
)


@query(
    "ipv6_texts",
    f"""SELECT event_id, CASE WHEN LEFT(f, 2) = '::' AND RIGHT(f, 2) = '::' THEN f
      WHEN LEFT(f, 2) = '::' THEN SUBSTRING(f, 1, LENGTH(f) - 1)
      WHEN RIGHT(f, 2) = '::' THEN SUBSTRING(f, 2)
      ELSE SUBSTRING(f, 2, LENGTH(f) - 2) END AS address
    FROM (SELECT event_id, CASE {_FOLDED} ELSE j END AS f FROM (SELECT event_id, {_JOINED} AS j FROM events) AS a) AS b""",
)
def ipv6_texts(spark, sf_dir):
    groups = [F.lpad(F.hex(F.expr(g)), 4, "0") for g in _GROUPS]
    rows = views.table(spark, sf_dir, "events").select("event_id", F.unhex(F.concat(*groups)).alias("data"))
    return rows.select("event_id", ipv6_text(F.col("data")).alias("address"))


@query(
    "bit_reads",
    f"""SELECT event_id, DPort AS be16, {_SWAP.format('DPort')} AS le16, SRTT AS be32, SRTT AS le32, BytesReceived AS le64,
    Task, PID FROM tcp_events""",
)
def bit_reads(spark, sf_dir):
    pack = bits.uint_bytes
    data = F.concat(
        pack(F.col("DPort"), 2, True), pack(F.col("SRTT"), 4, True), pack(F.col("SRTT"), 4), pack(F.col("BytesReceived"), 8)
    )
    text = F.concat(F.encode(F.concat("Task", F.lit("\x00left over")), "UTF-8"))
    thread = F.shiftleft("PID", 32) + F.col("event_id")
    rows = tcp_events(spark, sf_dir).select("event_id", data.alias("d"), text.alias("t"), thread.alias("w"))
    d = F.col("d")
    return rows.select(
        "event_id",
        bits.uint_be(d, 0, 2).cast("int").alias("be16"),
        bits.uint_le(d, 0, 2).cast("int").alias("le16"),
        bits.uint_be(d, 2, 4).alias("be32"),
        bits.uint_le(d, 6, 4).alias("le32"),
        bits.uint_le(d, 10, 8).cast("bigint").alias("le64"),
        bits.cstr(F.col("t")).alias("Task"),
        bits.pid_of(F.col("w")).alias("PID"),
    )


@query(
    "stamped_events",
    "SELECT event_id, CAST(FLOOR(epoch(ts)) AS BIGINT) AS Timestamp, 'collector-1' AS Hostname, "
    "strftime(ts, '%Y-%m-%d %H:%M:%S') AS moment FROM events",
)
def stamped_events(spark, sf_dir):
    settings.apply(spark)
    rows = stamp_host(stamp_time(views.table(spark, sf_dir, "events"), "ts"), "collector-1")
    moment = F.date_format("event_time", "yyyy-MM-dd HH:mm:ss").alias("moment")
    return event_time(rows).select("event_id", "Timestamp", "Hostname", moment)


# -- predicates ------------------------------------------------------------


@query("tracepoint_selection", "SELECT event_id, SRTT FROM tcp_events WHERE Tracepoint = 'tcp:tcp_retransmit_skb'")
def tracepoint_selection(spark, sf_dir):
    return select_tracepoint(tcp_events(spark, sf_dir), "tcp:tcp_retransmit_skb").select("event_id", "SRTT")


@query("tcp_only", "SELECT event_id, Protocol FROM tcp_events WHERE Protocol = 6")
def tcp_only(spark, sf_dir):
    return filter_protocol(tcp_events(spark, sf_dir)).select("event_id", "Protocol")


@query("state_selection", "SELECT event_id, NewState FROM tcp_events WHERE NewState = 7")
def state_selection(spark, sf_dir):
    return filter_state(tcp_events(spark, sf_dir), "tcp_close").select("event_id", "NewState")


@query("state_all", "SELECT event_id, NewState FROM tcp_events")
def state_all(spark, sf_dir):
    return filter_state(tcp_events(spark, sf_dir), "TCP_ALL").select("event_id", "NewState")


@query("family_selection", "SELECT event_id, SAddr FROM tcp_events WHERE Inet = 6")
def family_selection(spark, sf_dir):
    return filter_family(tcp_events(spark, sf_dir), [6]).select("event_id", "SAddr")


@query(
    "drop_filters",
    f"""SELECT event_id, SRTT, TotalRetrans, AdvMSS, DPort, Task FROM tcp_events
    WHERE NOT (SRTT < 4000 OR SRTT > 20000 AND SRTT <> 24000) AND NOT (NOT (TotalRetrans % 4 > 0)) AND NOT (AdvMSS % 8 = 4)
    AND NOT ({_SWAP.format('DPort')} < 21000) AND NOT (Task = 'click')""",
)
def drop_filters(spark, sf_dir):
    filters = {
        "srtt": "SRTT < 4000 || SRTT > 20000 && SRTT != 24000",
        "TotalRetrans": "!(TotalRetrans % 4)",
        "AdvMSS": "(AdvMSS & 7) == 4",
        "DPort": "DPort < 21000",
        "Task": 'Task == "click"',
    }
    rows = drop_where(tcp_events(spark, sf_dir), filters)
    return rows.select("event_id", "SRTT", "TotalRetrans", "AdvMSS", "DPort", "Task")


# -- specs, sampling, combining --------------------------------------------

_SPEC_COLUMNS = f"{_RTT_MS} AS RTT, TotalRetrans, SAddr, DAddr, DPort, LPort, BytesReceived, BytesSent, Timestamp, event_id"


@query("spec_events", f"SELECT {_SPEC_COLUMNS} FROM tcp_events WHERE {_CLOSED} AND NOT ({_RTT_MS} < 1)")
def spec_events(spark, sf_dir):
    return run_spec(tcp_events(spark, sf_dir), Spec(**SPEC, keep=["event_id"]))


@query(
    "default_spec",
    f"SELECT {_RTT} AS RTT, TotalRetrans, SAddr, DAddr, DPort, Timestamp FROM tcp_events WHERE {_CLOSED} AND Inet = 4",
)
def default_spec(spark, sf_dir):
    return run_spec(tcp_events(spark, sf_dir), Spec())


def _sampled(where: str, step: int, columns: str = "event_id, SAddr, SRTT") -> str:
    return f"""SELECT {columns} FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY {_SOCKET} ORDER BY Timestamp, event_id) AS rn
    FROM tcp_events WHERE {where}) AS r WHERE rn % {step} = 0"""


@query(
    "spec_sampled",
    _sampled(f"{_CLOSED} AND NOT ({_RTT_MS} < 1)", 3, _SPEC_COLUMNS),
)
def spec_sampled(spark, sf_dir):
    return run_spec(tcp_events(spark, sf_dir), Spec(**SPEC, sample=2, keep=["event_id"], order=ARRIVAL))


@query("socket_sampling", _sampled("TRUE", 4))
def socket_sampling(spark, sf_dir):
    return sample_per_socket(tcp_events(spark, sf_dir), 3, order=ARRIVAL).select("event_id", "SAddr", "SRTT")


# every user's rows as one socket, so that sockets are large; the split path
# numbers those with more than 40 rows piece by piece
_HOT = "ROW_NUMBER() OVER (PARTITION BY Hostname ORDER BY Timestamp, event_id)"


@query("hot_socket_sampling", f"SELECT event_id, Hostname FROM (SELECT event_id, Hostname, {_HOT} AS rn FROM tcp_events) AS r WHERE rn % 6 = 0")
def hot_socket_sampling(spark, sf_dir):
    rows = sample_per_socket(tcp_events(spark, sf_dir), 5, key=["Hostname"], order=ARRIVAL)
    return rows.select("event_id", "Hostname")


@query("socket_sampling_stream", _sampled(_CLOSED, 3))
def socket_sampling_stream(spark, sf_dir):
    path = scratch(spark, "events")
    rows = tcp_events(spark, sf_dir)
    rows.write.parquet(path)
    stream = spark.readStream.schema(rows.schema).parquet(path)
    spec = Spec(fields=["SAddr", "SRTT"], inet=[4, 6], sample=2, keep=["event_id"], order=ARRIVAL)
    out = scratch(spark, "sampled")
    write_batch = lambda rows, batch_id: rows.write.mode("overwrite").parquet(f"{out}/batch_id={batch_id}")
    writer = stream_specs(stream, [spec], write_batch, f"{out}-sockets").option("checkpointLocation", f"{out}-progress")
    writer.trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(out).select("event_id", "SAddr", "SRTT")


@query(
    "hot_socket_sampling_nulls",
    """SELECT event_id, CAST(rn AS BIGINT) AS position FROM (SELECT event_id, ROW_NUMBER() OVER (PARTITION BY Hostname
    ORDER BY CASE WHEN event_id % 5 = 0 THEN NULL ELSE Timestamp END NULLS FIRST, event_id) AS rn FROM tcp_events) AS t WHERE rn % 6 = 0""",
)
def hot_socket_sampling_nulls(spark, sf_dir):
    rows = tcp_events(spark, sf_dir).withColumn("Timestamp", F.when(F.col("event_id") % 5 != 0, F.col("Timestamp")))
    kept = sample_per_socket(rows, 5, ["Hostname"], ARRIVAL)
    place = F.row_number().over(Window.partitionBy("Hostname").orderBy("Timestamp", "event_id"))
    return kept.select("event_id", (place * 6).cast("bigint").alias("position"))


@query("family_union", "SELECT event_id, SAddr, SRTT FROM tcp_events WHERE Tracepoint = 'tcp:tcp_probe'")
def family_union(spark, sf_dir):
    rows = select_tracepoint(tcp_events(spark, sf_dir), "tcp:tcp_probe")
    v4, v6 = (filter_family(rows, [i]).select("event_id", "SAddr", "SRTT") for i in (4, 6))
    return union_families(v4, v6)


@query(
    "tracepoint_multiplex",
    f"""SELECT event_id, {_RTT} AS RTT, SAddr, CAST(NULL AS INT) AS DPort, Timestamp FROM tcp_events WHERE {_CLOSED}
    UNION ALL SELECT event_id, NULL, SAddr, DPort, Timestamp FROM tcp_events WHERE Tracepoint = 'tcp:tcp_retransmit_skb'""",
)
def tracepoint_multiplex(spark, sf_dir):
    events = tcp_events(spark, sf_dir)
    specs = [
        Spec(fields=["RTT", "SAddr"], inet=[4, 6], keep=["event_id"]),
        Spec("tcp:tcp_retransmit_skb", ["SAddr", "DPort"], inet=[4, 6], keep=["event_id"]),
    ]
    return multiplex([(s, run_spec(events, s)) for s in specs], "kafka")


# -- enrichment ------------------------------------------------------------


def _geo_sql(columns: str, *, city="geo_city", asn="geo_asn", address="DAddr", where="TRUE") -> str:
    """Range joins spelled out; misses are '' and '0'."""
    return f"""SELECT e.event_id, e.{address}, {columns}
    FROM (SELECT *, {_v4_key(address)} AS k FROM tcp_events WHERE {where}) AS e
    LEFT JOIN {city} AS c ON e.k BETWEEN c.lo AND c.hi LEFT JOIN {asn} AS a ON e.k BETWEEN a.lo AND a.hi"""


_CITY_SQL = "COALESCE(CCode, '') AS CCode, COALESCE(Country, '') AS Country, COALESCE(City, '') AS City, CSCode, Region"
_LOC_SQL = "PRINTF('%.6f,%.6f', COALESCE(lat, 0), COALESCE(lon, 0)) AS GeoLocation"
_ASN_SQL = "COALESCE(ASN, '0') AS ASN, COALESCE(ASNOrg, '') AS ASNOrg"


def _enriched(spark, sf_dir, level, rows=None, **kwargs) -> DataFrame:
    rows = tcp_events(spark, sf_dir) if rows is None else rows
    kwargs = {"geo_field": "DAddr", "city": views.geo_city(spark, sf_dir), "asn": views.geo_asn(spark, sf_dir)} | kwargs
    out = enrich_geo(rows.select("event_id", kwargs["geo_field"]), level, **kwargs)
    return out


@query("geo_city_lookup", _geo_sql(_CITY_SQL))
def geo_city_lookup(spark, sf_dir):
    return _enriched(spark, sf_dir, "city")


@query("geo_asn_lookup", _geo_sql(_ASN_SQL))
def geo_asn_lookup(spark, sf_dir):
    return _enriched(spark, sf_dir, "asn")


@query("geo_location_lookup", _geo_sql(f"{_CITY_SQL}, {_LOC_SQL}"))
def geo_location_lookup(spark, sf_dir):
    return _enriched(spark, sf_dir, "city-loc")


@query("geo_city_asn_lookup", _geo_sql(f"{_CITY_SQL}, {_ASN_SQL}"))
def geo_city_asn_lookup(spark, sf_dir):
    return _enriched(spark, sf_dir, "CITY-ASN")


@query("geo_full_lookup", _geo_sql(f"{_CITY_SQL}, {_LOC_SQL}, {_ASN_SQL}"))
def geo_full_lookup(spark, sf_dir):
    return _enriched(spark, sf_dir, "city-loc-asn")


@query("geo_full_lookup_shuffled", _geo_sql(f"{_CITY_SQL}, {_LOC_SQL}, {_ASN_SQL}", city="geo_customers", address="SAddr"))
def geo_full_lookup_shuffled(spark, sf_dir):
    """The way for tables too large to broadcast."""
    city = views.geo_customers(spark, sf_dir)
    return _enriched(spark, sf_dir, "city-loc-asn", city=city, geo_field="SAddr", max_broadcast_bytes=0)


@query("geo_many_ranges", _geo_sql(f"{_CITY_SQL}, {_LOC_SQL}", city="geo_customers", address="SAddr"))
def geo_many_ranges(spark, sf_dir):
    return _enriched(spark, sf_dir, "city-loc", city=views.geo_customers(spark, sf_dir), geo_field="SAddr")


@query(
    "geo_ipv6_lookup",
    f"""SELECT e.event_id, e.DAddr, COALESCE(a4.ASN, a6.ASN, '0') AS ASN, COALESCE(a4.ASNOrg, a6.ASNOrg, '') AS ASNOrg
    FROM (SELECT *, {_v4_key('DAddr')} AS k, {_v6_hex('DAddr')} AS h FROM tcp_events) AS e
    LEFT JOIN geo_asn AS a4 ON e.k BETWEEN a4.lo AND a4.hi LEFT JOIN geo_v6 AS a6 ON e.h BETWEEN a6.lo_hex AND a6.hi_hex""",
)
def geo_ipv6_lookup(spark, sf_dir):
    asn = {4: views.geo_asn(spark, sf_dir), 6: views.geo_v6(spark, sf_dir)}
    return _enriched(spark, sf_dir, "asn", asn=asn)


_NESTED = f"""SELECT event_id, SAddr, COALESCE(ASN, '0') AS ASN, COALESCE(ASNOrg, '') AS ASNOrg FROM (SELECT e.event_id, e.SAddr, n.ASN, n.ASNOrg,
    ROW_NUMBER() OVER (PARTITION BY e.event_id ORDER BY n.hi - n.lo) AS rn FROM (SELECT *, {_v4_key('SAddr')} AS k FROM tcp_events) AS e
    LEFT JOIN geo_nested AS n ON e.k BETWEEN n.lo AND n.hi) AS r WHERE rn = 1"""


@query("geo_nested_ranges", _NESTED)
def geo_nested_ranges(spark, sf_dir):
    """Networks in networks, and across their ends: the narrowest one holds an address."""
    return _enriched(spark, sf_dir, "asn", asn=views.geo_nested(spark, sf_dir), geo_field="SAddr", crossing="narrowest")


@query("geo_nested_ranges_swept", _NESTED)
def geo_nested_ranges_swept(spark, sf_dir):
    """The same as a sweep of addresses and ranges, without broadcasting the table."""
    return _enriched(spark, sf_dir, "asn", asn=views.geo_nested(spark, sf_dir), geo_field="SAddr", max_broadcast_bytes=0, crossing="narrowest")


_BROKEN = "CASE WHEN event_id % 3 = 0 THEN 'not an address' WHEN event_id % 3 = 1 THEN NULL ELSE DAddr END"


@query(
    "geo_merge",
    f"""SELECT e.event_id, e.DAddr, CASE WHEN e.event_id % 3 = 2 THEN COALESCE(c.City, '') ELSE 'own' END AS City,
    CASE WHEN e.event_id % 3 = 2 THEN COALESCE(c.CCode, '') END AS CCode,
    CASE WHEN e.event_id % 3 = 2 THEN COALESCE(c.Country, '') END AS Country, c.CSCode, c.Region
    FROM (SELECT event_id, {_BROKEN} AS DAddr, CASE WHEN event_id % 3 = 2 THEN {_v4_key('DAddr')} END AS k FROM tcp_events) AS e
    LEFT JOIN geo_city AS c ON e.k BETWEEN c.lo AND c.hi""",
)
def geo_merge(spark, sf_dir):
    """Looked-up values win; rows without a valid address keep their own."""
    rows = tcp_events(spark, sf_dir).selectExpr("event_id", f"{_BROKEN} AS DAddr", "'own' AS City")
    return enrich_geo(rows, "city", city=views.geo_city(spark, sf_dir), geo_field="DAddr")


@query(
    "spec_with_geo",
    f"""SELECT s.*, {_CITY_SQL}, {_LOC_SQL}, {_ASN_SQL} FROM (SELECT {_SPEC_COLUMNS}, {_v4_key('DAddr')} AS k FROM tcp_events
    WHERE {_CLOSED} AND NOT ({_RTT_MS} < 1)) AS s
    LEFT JOIN geo_city AS c ON s.k BETWEEN c.lo AND c.hi LEFT JOIN geo_asn AS a ON s.k BETWEEN a.lo AND a.hi""".replace(
        "s.*", "s.RTT, s.TotalRetrans, s.SAddr, s.DAddr, s.DPort, s.LPort, s.BytesReceived, s.BytesSent, s.Timestamp, s.event_id"
    ),
)
def spec_with_geo(spark, sf_dir):
    """The flagship: an agent spec, then country, city, location and AS number."""
    rows = run_spec(tcp_events(spark, sf_dir), Spec(**SPEC, keep=["event_id"]))
    geo = GeoLookup("city-loc-asn", views.geo_city(spark, sf_dir), views.geo_asn(spark, sf_dir))
    return geo.enrich(rows, "DAddr")


# -- row shaping -----------------------------------------------------------


def _json_pairs(names, hostname=False, string=("Task", "SAddr", "DAddr", "Hostname")) -> list[str]:
    names = [*names, *(["Hostname"] if hostname else [])]
    return [f"'\"{n}\":\"', {n}, '\"'" if n in string else f"'\"{n}\":', CAST({n} AS VARCHAR)" for n in names]


def _json_sql(pairs, braces=True) -> str:
    body = ", ',', ".join(pairs)
    return f"CONCAT('{{', {body}, '}}')" if braces else f"CONCAT({body})"


_LINE = _json_pairs([*LINE_FIELDS, "Timestamp"])
_VALUES = ", ',', ".join(
    f"'\"', {n}, '\"'" if n in ("Task", "SAddr", "DAddr") else f"CAST({n} AS VARCHAR)" for n in [*LINE_FIELDS, "Timestamp"]
)


@query("event_json", f"SELECT event_id, {_json_sql(_LINE)} AS value FROM tcp_events")
def event_json(spark, sf_dir):
    return to_event_json(tcp_events(spark, sf_dir), LINE_FIELDS, keep=["event_id"])


@query("event_json_host", f"SELECT event_id, {_json_sql(_json_pairs([*LINE_FIELDS, 'Timestamp'], True))} AS value FROM tcp_events")
def event_json_host(spark, sf_dir):
    return to_event_json(tcp_events(spark, sf_dir), LINE_FIELDS, F.col("Hostname"), keep=["event_id"])


@query("csv_lines", f"SELECT event_id, CONCAT({_VALUES}) AS value FROM tcp_events")
def csv_lines(spark, sf_dir):
    return to_csv_lines(tcp_events(spark, sf_dir), LINE_FIELDS, keep=["event_id"])


@query("array_lines", f"SELECT event_id, CONCAT('[', {_VALUES}, ']') AS value FROM tcp_events")
def array_lines(spark, sf_dir):
    return to_array_lines(tcp_events(spark, sf_dir), LINE_FIELDS, keep=["event_id"])


@query("console_lines", f"SELECT event_id, {_json_sql(_LINE, braces=False)} AS value FROM tcp_events")
def console_lines(spark, sf_dir):
    return to_console_lines(tcp_events(spark, sf_dir), LINE_FIELDS, keep=["event_id"])


# some rows lack a number, some a text
_GAPS = """SELECT event_id AS RTT, CASE WHEN event_id % 10 <> 0 THEN SRTT END AS SRTT,
  CASE WHEN event_id % 7 <> 0 THEN Task END AS Task, AdvMSS, BytesSent, Timestamp FROM {tcp_events}"""
_MAPPING = {"RTT": "id", "SRTT": "srtt", "AdvMSS": "mss", "BytesSent": "sent", "Timestamp": "seen", "Task": "task", "City": "city"}
_TABLE_SQL = """SELECT RTT AS id, {srtt} AS srtt, AdvMSS AS mss, BytesSent AS sent, Timestamp AS seen, {task} AS task,
  {city} AS city FROM ({gaps}) AS g"""


def _gaps(spark, sf_dir) -> DataFrame:
    return spark.sql(_GAPS, tcp_events=tcp_events(spark, sf_dir))


def _table_sql(srtt="SRTT", task="Task", city="CAST(NULL AS VARCHAR)") -> str:
    return _TABLE_SQL.format(srtt=srtt, task=task, city=city, gaps=_GAPS.format(tcp_events="tcp_events"))


@query("table_rows_strict", _table_sql() + " WHERE SRTT IS NOT NULL")
def table_rows_strict(spark, sf_dir):
    return to_table_rows(_gaps(spark, sf_dir), _MAPPING, "strict")


@query("table_rows_rejected", "SELECT RTT, Task FROM (" + _GAPS.format(tcp_events="tcp_events") + ") AS g WHERE SRTT IS NULL")
def table_rows_rejected(spark, sf_dir):
    return split_strict(_gaps(spark, sf_dir), _MAPPING)[1].select("RTT", "Task")


@query("table_rows_zero", _table_sql("COALESCE(SRTT, 0)", "COALESCE(Task, '')", "''"))
def table_rows_zero(spark, sf_dir):
    return to_table_rows(_gaps(spark, sf_dir), _MAPPING, "zero")


@query("table_rows_null", _table_sql())
def table_rows_null(spark, sf_dir):
    return to_table_rows(_gaps(spark, sf_dir), _MAPPING, "null")


_DOC_COLUMNS = sorted([*LINE_FIELDS, "Timestamp", "Hostname"])
_DOC_SQL = _json_sql(_json_pairs(_DOC_COLUMNS))


@query("json_documents", f"SELECT event_id, {_DOC_SQL} AS value FROM tcp_events")
def json_documents(spark, sf_dir):
    rows = tcp_events(spark, sf_dir).select("event_id", *_DOC_COLUMNS)
    return to_documents(rows, "json", keep=["event_id"])


_PB_COLUMNS = [n for n in TYPED_COLUMNS if n in _DOC_COLUMNS]
_PB_SQL = _json_sql(_json_pairs(_PB_COLUMNS, string=("Task", "SAddr", "DAddr", "Hostname", "BytesSent", "Timestamp")))


@query("typed_documents", f"SELECT event_id, {_PB_SQL} AS value FROM tcp_events")
def typed_documents(spark, sf_dir):
    rows = tcp_events(spark, sf_dir).select("event_id", "NewState", *_DOC_COLUMNS)
    return to_documents(rows, "pb", keep=["event_id"])


@query("bulk_lines", f"SELECT event_id, CONCAT('{{\"index\":{{}}}}', CHR(10), {_DOC_SQL}) AS value FROM tcp_events")
def bulk_lines(spark, sf_dir):
    rows = tcp_events(spark, sf_dir).select("event_id", *_DOC_COLUMNS)
    return to_bulk_lines(to_documents(rows, "spb", keep=["event_id"]), keep=["event_id"])


_TAGS = ["DAddr", "Hostname", "SAddr", "Task"]
_NUMBERS = ["BytesSent", "DPort", "SRTT", "TotalRetrans"]


@query(
    "time_series_points",
    f"""SELECT event_id, 'sockets' AS measurement, {_json_sql(_json_pairs(_TAGS))} AS tags,
    {_json_sql([f"{p}, '.0'" for p in _json_pairs(_NUMBERS)])} AS fields, Timestamp AS time FROM tcp_events""",
)
def time_series_points(spark, sf_dir):
    rows = tcp_events(spark, sf_dir).select("event_id", "Timestamp", *_TAGS, *_NUMBERS)
    points = to_points(rows, "sockets", keep=["event_id"])
    return points.select(
        "event_id", "measurement", F.to_json("tags").alias("tags"), F.to_json("fields").alias("fields"),
        F.unix_seconds("time").alias("time"),
    )


def _pairs(names, text) -> str:
    return ", ',', ".join(f"'{n}=', {text(n)}" for n in names)


_LINE_PROTOCOL = (
    "CONCAT('sockets,', {tags}, ' ', " + _pairs(_NUMBERS, lambda n: f"CAST({n} AS VARCHAR)") + ", ' ', CAST(Timestamp AS VARCHAR), '000000000')"
)


@query(
    "line_protocol",
    f"""SELECT event_id, {_LINE_PROTOCOL.format(tags=_pairs(_TAGS, str))} AS value FROM
    (SELECT event_id, DAddr, Hostname, SAddr, CONCAT(Task, '\\ a\\,b\\=', DPort) AS Task, BytesSent, DPort, SRTT,
    TotalRetrans, Timestamp FROM tcp_events) AS e""",
)
def line_protocol(spark, sf_dir):
    rows = tcp_events(spark, sf_dir).select("event_id", "Timestamp", *_TAGS, *_NUMBERS)
    rows = rows.withColumn("Task", F.concat("Task", F.lit(" a,b="), "DPort"))
    return to_lines(rows, "sockets", keep=["event_id"])


@query(
    "line_protocol_of_points",
    f"SELECT event_id, {_LINE_PROTOCOL.format(tags=_pairs(_TAGS, str))} AS value FROM tcp_events",
)
def line_protocol_of_points(spark, sf_dir):
    rows = tcp_events(spark, sf_dir).select("event_id", "Timestamp", *_TAGS, *_NUMBERS)
    return to_line_protocol(to_points(rows, "sockets", keep=["event_id"]), keep=["event_id"])


@query(
    "points_u64",
    """SELECT event_id, CONCAT('sockets,Hostname=', Hostname, '\\nx BytesReceived=', CAST(9223372036854775808 + event_id AS VARCHAR),
    'u ', CAST(Timestamp AS VARCHAR), '000000000') AS value FROM tcp_events""",
)
def points_u64(spark, sf_dir):
    """Counters above 2^63 keep every digit; a line end in a tag does not break the line."""
    rows = tcp_events(spark, sf_dir).select(
        "event_id", "Timestamp", F.concat("Hostname", F.lit("\nx")).alias("Hostname"),
        (F.lit("9223372036854775808").cast("decimal(20,0)") + F.col("event_id")).cast("decimal(20,0)").alias("BytesReceived"),
    )
    return to_lines(rows, "sockets", mode="pb", keep=["event_id"])


@query(
    "line_protocol_geo",
    f"""SELECT e.event_id, {_LINE_PROTOCOL.format(tags="'ASN=', COALESCE(ASN, '0'), CASE WHEN ASN IS NULL THEN '' ELSE CONCAT(',ASNOrg=', ASNOrg) END, ',', " + _pairs(_TAGS[1:], str))} AS value
    FROM (SELECT *, {_v4_key('DAddr')} AS k FROM tcp_events) AS e LEFT JOIN geo_asn AS a ON e.k BETWEEN a.lo AND a.hi""",
)
def line_protocol_geo(spark, sf_dir):
    """The looked-up address gives way to its geo tags; empty tags are left out."""
    rows = tcp_events(spark, sf_dir).select("event_id", "Timestamp", *_TAGS, *_NUMBERS)
    rows = enrich_geo(rows, "asn", asn=views.geo_asn(spark, sf_dir), geo_field="DAddr")
    return to_lines(rows, "sockets", geo_field="DAddr", keep=["event_id"])


# -- sinks: write, then read back ------------------------------------------


def _written(spark, sf_dir, sink, kind="text", **conf) -> DataFrame:
    path = scratch(spark, sink)
    where = {"filename": path} if sink in ("csv", "jsonl") else {"path": path}
    write(tcp_events(spark, sf_dir), sink, LINE_FIELDS, **where, **conf)
    return spark.read.format(kind).load(path)


@query("csv_sink", f"SELECT CONCAT({_VALUES}) AS value FROM tcp_events")
def csv_sink(spark, sf_dir):
    return _written(spark, sf_dir, "csv")


@query("jsonl_sink", f"SELECT CONCAT('[', {_VALUES}, ']') AS value FROM tcp_events")
def jsonl_sink(spark, sf_dir):
    return _written(spark, sf_dir, "jsonl")


@query("topic_sink_json", f"SELECT {_json_sql(_json_pairs([*LINE_FIELDS, 'Timestamp'], True))} AS value FROM tcp_events")
def topic_sink_json(spark, sf_dir):
    return _written(spark, sf_dir, "kafka", "parquet", serialization="json", compression="snappy")


_TYPED_PRESENT = [n for n in TYPED_COLUMNS if n in _EVENT_COLUMNS]


@query("topic_sink_typed", f"SELECT {_json_sql(_json_pairs(_TYPED_PRESENT))} AS value FROM tcp_events")
def topic_sink_typed(spark, sf_dir):
    return _written(spark, sf_dir, "kafka", "parquet", serialization="pb", compression="gzip")


@query("console_sink", f"SELECT {_json_sql([*_json_pairs(LINE_FIELDS), *_json_pairs(['Timestamp'])], braces=False)} AS value FROM tcp_events")
def console_sink(spark, sf_dir):
    """Every line, not the first twenty; sent to files instead of a screen."""
    path = scratch(spark, "console")
    write(tcp_events(spark, sf_dir), "console", LINE_FIELDS, filename=path)
    return spark.read.text(path)


@query("table_sink", "SELECT SRTT AS srtt, Task AS task, Hostname AS host, Timestamp AS seen FROM tcp_events")
def table_sink(spark, sf_dir):
    path = scratch(spark, "table")
    conf = {"fields": ["SRTT", "Task", "Hostname", "Timestamp"], "columns": ["srtt", "task", "host", "seen"]}
    write(tcp_events(spark, sf_dir), "table", path=path, serialization="json", **conf)
    return spark.read.parquet(path)


@query("documents_sink", f"SELECT '{{\"index\":{{}}}}' AS value FROM tcp_events UNION ALL SELECT {_DOC_SQL} FROM tcp_events")
def documents_sink(spark, sf_dir):
    path = scratch(spark, "documents")
    write(tcp_events(spark, sf_dir).select(_DOC_COLUMNS), "documents", path=path)
    return spark.read.text(path)


@query("points_sink", f"SELECT {_LINE_PROTOCOL.format(tags=_pairs(_TAGS, str))} AS value FROM tcp_events")
def points_sink(spark, sf_dir):
    path = scratch(spark, "points")
    write(tcp_events(spark, sf_dir).select("Timestamp", *_TAGS, *_NUMBERS), "points", path=path)
    return spark.read.text(path)


@query(
    "agent_config",
    f"""SELECT CONCAT(CAST({_RTT} AS VARCHAR), ',"', SAddr, '",', CAST(Timestamp AS VARCHAR)) AS value FROM tcp_events WHERE {_CLOSED}
    UNION ALL SELECT CONCAT(CAST({_RTT} AS VARCHAR), ',"', SAddr, '",', CAST(Timestamp AS VARCHAR)) FROM tcp_events
    WHERE Tracepoint = 'tcp:tcp_probe' AND Inet = 4
    UNION ALL SELECT CONCAT('{{"DPort":', CAST(DPort AS VARCHAR), ',"Timestamp":', CAST(Timestamp AS VARCHAR), ',"Hostname":"', Hostname, '"}}')
    FROM tcp_events WHERE Tracepoint = 'tcp:tcp_retransmit_skb' AND Inet = 4""",
)
def agent_config(spark, sf_dir):
    """Three tracepoints, two destinations."""
    files, messages = scratch(spark, "agent"), scratch(spark, "agent")
    config = {
        "tracepoints": [
            {"name": STATE_TRACEPOINT, "fields": "a", "tcp_state": "TCP_CLOSE", "inet": [4, 6], "egress": "files"},
            {"name": "tcp:tcp_probe", "fields": "a", "tcp_state": "TCP_ALL", "egress": "files"},
            {"name": "tcp:tcp_retransmit_skb", "fields": "b", "tcp_state": "TCP_ALL", "egress": "messages"},
        ],
        "fields": {"a": [{"name": "rtt"}, {"name": "saddr"}], "b": [{"name": "dport"}]},
        "egress": {
            "files": {"type": "csv", "config": {"filename": files}},
            "messages": {"type": "kafka", "config": {"path": messages}},
        },
    }
    run_agent(tcp_events(spark, sf_dir), config)
    return spark.read.text(files).unionByName(spark.read.parquet(messages))


@query(
    "agent_sampled",
    f"""SELECT CONCAT(CAST({_RTT} AS VARCHAR), ',', CAST(Timestamp AS VARCHAR)) AS value FROM (SELECT *, ROW_NUMBER() OVER
    (PARTITION BY Hostname ORDER BY Timestamp, event_id) AS rn FROM tcp_events WHERE {_CLOSED} AND Inet = 4) AS t WHERE rn % 4 = 0""",
)
def agent_sampled(spark, sf_dir):
    files = scratch(spark, "agent")
    point = {"name": STATE_TRACEPOINT, "fields": "a", "tcp_state": "TCP_CLOSE", "sample": 3, "order": ARRIVAL, "key": ["Hostname"], "egress": "files"}
    config = {"tracepoints": [point], "fields": {"a": [{"name": "rtt"}]}, "egress": {"files": {"type": "csv", "config": {"filename": files}}}}
    run_agent(tcp_events(spark, sf_dir), config)
    return spark.read.text(files)


# -- continuous flows ------------------------------------------------------


def _flow(spark, sf_dir, kind, serialization, conf, geo=None, ingress=None) -> str:
    """Run one flow over the whole topic; the folder it wrote."""
    out = scratch(spark, "flow")
    config = {
        "ingress": {"in": {"type": "kafka", "config": {"path": _topic_files(spark, sf_dir), "fields": _TOPIC_FIELDS, **(ingress or {})}}},
        "ingestion": {"out": {"type": kind, "config": {"path": out, "trigger": {"availableNow": True}, **conf}}},
        "flow": [{"ingress": "in", "ingestion": "out", "serialization": serialization}],
        "geo": geo,
    }
    for started in run_flows(spark, config, f"{out}-progress"):
        started.awaitTermination()
    return out


_GOOD = "event_id % 101 <> 0"


@query(
    "flow_to_table",
    f"""SELECT e.event_id AS id, SRTT AS srtt, Task AS task, Timestamp AS seen, COALESCE(City, '') AS city
    FROM (SELECT *, {_v4_key('DAddr')} AS k FROM tcp_events WHERE {_GOOD}) AS e LEFT JOIN geo_city AS c ON e.k BETWEEN c.lo AND c.hi""",
)
def flow_to_table(spark, sf_dir):
    conf = {
        "geo_field": "DAddr",
        "fields": ["RTT", "SRTT", "Task", "Timestamp", "City"],
        "columns": ["id", "srtt", "task", "seen", "city"],
    }
    out = _flow(spark, sf_dir, "table", "spb", conf, {"level": "city", "city": views.geo_city(spark, sf_dir)})
    return spark.read.parquet(out).drop("batch_id")


_FLOW_DOC = sorted(["RTT", "Task", "PID", "SRTT", "TotalRetrans", "SAddr", "DAddr", "DPort", "BytesSent", "Timestamp", "Hostname"])
_FLOW_SELECT = f"SELECT *, event_id AS RTT, {_v4_key('DAddr')} AS k FROM tcp_events WHERE {_GOOD}"


@query(
    "flow_to_documents",
    f"""SELECT '{{"index":{{}}}}' AS value FROM tcp_events WHERE {_GOOD}
    UNION ALL SELECT CONCAT('{{"ASN":"', COALESCE(ASN, '0'), '","ASNOrg":"', COALESCE(ASNOrg, ''), '",',
      {_json_sql(_json_pairs(_FLOW_DOC), braces=False)}, '}}')
    FROM ({_FLOW_SELECT}) AS e LEFT JOIN geo_asn AS a ON e.k BETWEEN a.lo AND a.hi""",
)
def flow_to_documents(spark, sf_dir):
    geo = {"level": "asn", "asn": views.geo_asn(spark, sf_dir)}
    out = _flow(spark, sf_dir, "documents", "json", {"geo_field": "DAddr"}, geo)
    return spark.read.text(out).select("value")


_FLOW_NUMBERS = ["BytesSent", "DPort", "PID", "RTT", "SRTT", "TotalRetrans"]


@query(
    "flow_to_points",
    f"""SELECT CONCAT('sockets,', {_pairs(_TAGS, str)}, ' ', {_pairs(_FLOW_NUMBERS, lambda n: f"CAST({n} AS VARCHAR), 'u'")},
    ' ', CAST(Timestamp AS VARCHAR), '000000000') AS value FROM ({_FLOW_SELECT}) AS e""",
)
def flow_to_points(spark, sf_dir):
    return spark.read.text(_flow(spark, sf_dir, "points", "pb", {})).select("value")


@query("flow_rejects", f"SELECT value AS payload FROM topic WHERE NOT ({_GOOD})")
def flow_rejects(spark, sf_dir):
    rejects = scratch(spark, "rejects")
    _flow(spark, sf_dir, "points", "json", {}, ingress={"rejects": rejects})
    return spark.read.parquet(rejects).select(F.col("_corrupt_record").alias("payload"))


@query(
    "flow_shared_topic",
    f"""SELECT 'table' AS flow, RTT AS id, Task AS task FROM ({_FLOW_SELECT}) AS e
    UNION ALL SELECT 'again', RTT, Task FROM ({_FLOW_SELECT}) AS e""",
)
def flow_shared_topic(spark, sf_dir):
    """Two flows on one topic; each sees all of it."""
    outs = {name: scratch(spark, name) for name in ("table", "again")}
    mapping = {"fields": ["RTT", "Task"], "columns": ["id", "task"], "trigger": {"availableNow": True}}
    config = {
        "ingress": {"in": {"config": {"path": _topic_files(spark, sf_dir), "fields": _TOPIC_FIELDS, "rejects": scratch(spark, "rejects")}}},
        "ingestion": {n: {"type": "table", "config": {"path": p, **mapping}} for n, p in outs.items()},
        "flow": [{"ingress": "in", "ingestion": n, "serialization": "json"} for n in outs],
    }
    for started in run_flows(spark, config, scratch(spark, "progress")):
        started.awaitTermination()
    parts = [spark.read.parquet(p).select(F.lit(n).alias("flow"), "id", "task") for n, p in outs.items()]
    return parts[0].unionByName(parts[1])


@query("flow_restart", f"SELECT RTT AS id, SRTT AS srtt FROM ({_FLOW_SELECT}) AS e")
def flow_restart(spark, sf_dir):
    """Stopped after half of the topic and started again: nothing lost, nothing twice."""
    topic_path, out, progress = (scratch(spark, n) for n in ("topic", "out", "progress"))
    halves = views.topic(spark, sf_dir).select("value", (F.col("event_id") % 2).alias("half"))
    config = {
        "ingress": {"in": {"config": {"path": topic_path, "fields": _TOPIC_FIELDS, "rejects": scratch(spark, "rejects")}}},
        "ingestion": {
            "out": {
                "type": "table",
                "config": {"path": out, "fields": ["RTT", "SRTT"], "columns": ["id", "srtt"], "trigger": {"availableNow": True}},
            }
        },
        "flow": [{"ingress": "in", "ingestion": "out", "serialization": "json"}],
    }
    for half in (0, 1):
        halves.where(F.col("half") == half).select("value").write.mode("append").parquet(topic_path)
        for started in run_flows(spark, config, progress):
            started.awaitTermination()
    return spark.read.parquet(out).drop("batch_id")


_WIDE = """CONCAT('{{"Task":"', Task, '","BytesReceived":', CASE WHEN event_id % 3 = 0 THEN '18446744073709551615'
  WHEN event_id % 3 = 1 THEN '5.5' ELSE '1.2e4' END, ',"RTT":', CASE WHEN event_id % 50 = 0 THEN '99999999999999999999' ELSE '7.0' END, '}}')"""


@query(
    "json_wide_numbers",
    """SELECT event_id, CASE WHEN event_id % 3 = 0 THEN '18446744073709551615' WHEN event_id % 3 = 1 THEN '5' ELSE '12000' END AS bytes, 7 AS rtt, TRUE AS good FROM tcp_events WHERE event_id % 50 <> 0
    UNION ALL SELECT event_id, NULL, NULL, FALSE FROM tcp_events WHERE event_id % 50 = 0""",
)
def json_wide_numbers(spark, sf_dir):
    """Any JSON number is read; one that no column holds is a reject. Good rows and rejects are all rows."""
    payloads = tcp_events(spark, sf_dir).select("event_id", F.expr(_WIDE.replace("{{", "{").replace("}}", "}")).alias("value"))
    good, bad = split_malformed(decode_json(payloads, event_schema(["Task", "BytesReceived", "RTT"]), keep=["event_id"], wide=True))
    good = good.select("event_id", F.col("BytesReceived").cast("string").alias("bytes"), F.col("RTT").cast("int").alias("rtt"), F.lit(True).alias("good"))
    return good.unionByName(bad.select("event_id", F.lit(False).alias("good")), allowMissingColumns=True)


@query(
    "flow_strict_rejects",
    """SELECT 'written' AS part, COUNT(*) AS n FROM tcp_events WHERE event_id % 10 <> 0 AND event_id % 33 <> 5
    UNION ALL SELECT 'malformed', COUNT(*) FROM tcp_events WHERE event_id % 33 = 5
    UNION ALL SELECT 'missing number', COUNT(*) FROM tcp_events WHERE event_id % 10 = 0 AND event_id % 33 <> 5""",
)
def flow_strict_rejects(spark, sf_dir):
    """A strict table takes rows with all numbers; every other payload is a reject, read and parsed once."""
    topic_path, rejects = scratch(spark, "topic"), scratch(spark, "rejects")
    payload = """CASE WHEN event_id % 33 = 5 THEN '{broken' ELSE to_json(named_struct('Task', Task, 'RTT', event_id,
      'SRTT', CASE WHEN event_id % 10 <> 0 THEN SRTT END)) END AS value"""
    tcp_events(spark, sf_dir).selectExpr(payload).write.parquet(topic_path)
    conf = {"fields": ["RTT", "SRTT", "Task"], "columns": ["id", "srtt", "task"]}
    out = _flow(spark, sf_dir, "table", "json", conf, ingress={"path": topic_path, "fields": ["RTT", "SRTT", "Task"], "rejects": rejects})
    written = spark.read.parquet(out).select(F.lit("written").alias("part"))
    every = written.unionByName(spark.read.parquet(rejects).select(F.col("reason").alias("part")))
    return every.groupBy("part").agg(F.count(F.lit(1)).alias("n"))


_EXTRA_PAYLOAD = """CONCAT('{{"Zone":"z', CAST(event_id % 3 AS VARCHAR(20)), '","Task":"', Task, '","Extra":', CAST(event_id AS VARCHAR(20)),
  ',"Share":1.5,"Nested":{{"a":[1,"x"]}},"Timestamp":', CAST(Timestamp AS VARCHAR(20)), CASE WHEN event_id % 2 = 0 THEN ',"City":"own"' ELSE '' END, '}}')"""


def _extra_topic(spark, sf_dir) -> str:
    path = scratch(spark, "topic")
    tcp_events(spark, sf_dir).select(F.expr(_EXTRA_PAYLOAD.replace("{{", "{").replace("}}", "}")).alias("value")).write.parquet(path)
    return path


@query(
    "flow_json_extra_keys",
    """SELECT '{{"index":{{}}}}' AS value FROM tcp_events UNION ALL
    SELECT CONCAT('{{', CASE WHEN event_id % 2 = 0 THEN '"City":"own",' ELSE '' END, '"Extra":', CAST(event_id AS VARCHAR(20)),
    ',"Nested":{{"a":[1,"x"]}},"Share":1.5,"Task":"', Task, '","Timestamp":', CAST(Timestamp AS VARCHAR(20)), ',"Zone":"z', CAST(event_id % 3 AS VARCHAR(20)), '"}}')
    FROM tcp_events""".replace("{{", "{").replace("}}", "}"),
)
def flow_json_extra_keys(spark, sf_dir):
    """Every key of a JSON payload is in its document, also those outside the catalog."""
    ingress = {"path": _extra_topic(spark, sf_dir), "fields": None}
    return spark.read.text(_flow(spark, sf_dir, "documents", "json", {}, ingress=ingress)).select("value")


@query(
    "flow_json_extra_points",
    """SELECT CONCAT('sockets,', CASE WHEN event_id % 2 = 0 THEN 'City=own,' ELSE '' END, 'Task=', Task, ',Zone=z', CAST(event_id % 3 AS VARCHAR(20)),
    ' Extra=', CAST(event_id AS VARCHAR(20)), ',Share=1.5 ', CAST(Timestamp AS VARCHAR(20)), '000000000') AS value FROM tcp_events""",
)
def flow_json_extra_points(spark, sf_dir):
    """Texts among the further keys are tags, numbers are fields."""
    ingress = {"path": _extra_topic(spark, sf_dir), "fields": None}
    return spark.read.text(_flow(spark, sf_dir, "points", "json", {"measurement": "sockets"}, ingress=ingress)).select("value")


def _payloads(spark, sf_dir, sql: str) -> DataFrame:
    return tcp_events(spark, sf_dir).select("event_id", F.expr(sql).alias("value"))


_TRAILING = """CONCAT('{"Task":"', Task, '","RTT":', CAST(event_id AS STRING), CASE event_id % 6 WHEN 0 THEN '}{"Task":"b"}' WHEN 1 THEN '} garbage'
  WHEN 2 THEN '},{"Task":"b"}' WHEN 3 THEN ',"RTT":7}' WHEN 4 THEN '}  ' ELSE '}' END)"""


@query(
    "json_trailing_text",
    """SELECT event_id, CASE WHEN event_id % 6 = 3 THEN 7 WHEN event_id % 6 > 3 THEN event_id END AS rtt, event_id % 6 > 2 AS good FROM tcp_events""",
)
def json_trailing_text(spark, sf_dir):
    """A payload is one object: a second one, or other text behind it, makes a reject. Of a repeated key the last value counts."""
    good, bad = split_malformed(decode_json(_payloads(spark, sf_dir, _TRAILING), event_schema(["Task", "RTT"]), keep=["event_id"]))
    good = good.select("event_id", F.col("RTT").alias("rtt"), F.lit(True).alias("good"))
    return good.unionByName(bad.select("event_id", F.lit(False).alias("good")), allowMissingColumns=True)


_HUGE = """CONCAT('{"Task":"', Task, '","RTT":', CAST(event_id AS STRING), ',"BytesReceived":', CASE WHEN event_id % 3 = 0 THEN '18446744073709551615'
  WHEN event_id % 3 = 1 THEN '9223372036854775808' ELSE '12' END, ',"Timestamp":', CAST(Timestamp AS STRING), '}')"""
_HUGE_SQL = "CASE WHEN event_id % 3 = 0 THEN '18446744073709551615' WHEN event_id % 3 = 1 THEN '9223372036854775808' ELSE '12' END"


def _huge_topic(spark, sf_dir) -> dict:
    path, rejects = scratch(spark, "topic"), scratch(spark, "rejects")
    _payloads(spark, sf_dir, _HUGE).select("value").write.parquet(path)
    return {"path": path, "rejects": rejects, "fields": ["Task", "RTT", "BytesReceived"]}


@query("flow_u64_table", f"SELECT event_id AS id, {_HUGE_SQL} AS bytes, Task AS task FROM tcp_events")
def flow_u64_table(spark, sf_dir):
    """64-bit counters reach a strict table whole."""
    conf = {"fields": ["RTT", "BytesReceived", "Task"], "columns": ["id", "bytes", "task"]}
    out = _flow(spark, sf_dir, "table", "json", conf, ingress=_huge_topic(spark, sf_dir))
    return spark.read.parquet(out).select("id", F.col("bytes").cast("string").alias("bytes"), "task")


@query(
    "flow_u64_typed",
    f"""SELECT '{{"index":{{}}}}' AS value FROM tcp_events UNION ALL SELECT CONCAT('{{"Task":"', Task, '","BytesReceived":"', {_HUGE_SQL},
    '","RTT":', CAST(event_id AS VARCHAR), ',"Timestamp":"', CAST(Timestamp AS VARCHAR), '"}}') FROM tcp_events""",
)
def flow_u64_typed(spark, sf_dir):
    """64-bit counters pass through the typed row."""
    return spark.read.text(_flow(spark, sf_dir, "documents", "pb", {}, ingress=_huge_topic(spark, sf_dir))).select("value")


_REPEATED = """CONCAT('{"Task":"', Task, '","Extra":1,"Extra":', CAST(event_id AS STRING), ',"Timestamp":', CAST(Timestamp AS STRING), ',"Zone":"a","Zone":"z"}')"""


def _repeated_topic(spark, sf_dir) -> dict:
    path = scratch(spark, "topic")
    # a file for every core, however few the events' files are
    rows = _payloads(spark, sf_dir, _REPEATED).select("value").repartition(spark.sparkContext.defaultParallelism)
    rows.write.parquet(path)
    return {"path": path, "fields": None}


@query(
    "flow_repeated_keys",
    """SELECT '{"index":{}}' AS value FROM tcp_events UNION ALL SELECT CONCAT('{"Extra":', CAST(event_id AS VARCHAR), ',"Task":"', Task,
    '","Timestamp":', CAST(Timestamp AS VARCHAR), ',"Zone":"z"}') FROM tcp_events""",
)
def flow_repeated_keys(spark, sf_dir):
    """Of a repeated key the last value is in the document."""
    return spark.read.text(_flow(spark, sf_dir, "documents", "json", {}, ingress=_repeated_topic(spark, sf_dir))).select("value")


@query(
    "flow_repeated_keys_points",
    """SELECT CONCAT('sockets,Task=', Task, ',Zone=z Extra=', CAST(event_id AS VARCHAR), ' ', CAST(Timestamp AS VARCHAR), '000000000') AS value FROM tcp_events""",
)
def flow_repeated_keys_points(spark, sf_dir):
    return spark.read.text(_flow(spark, sf_dir, "points", "json", {"measurement": "sockets"}, ingress=_repeated_topic(spark, sf_dir))).select("value")


@query(
    "flow_reject_counts",
    """SELECT 'strict' AS target, COUNT(*) AS read, SUM(CASE WHEN event_id % 10 <> 0 AND event_id % 33 <> 5 THEN 1 ELSE 0 END)::BIGINT AS written,
      SUM(CASE WHEN event_id % 33 = 5 THEN 1 ELSE 0 END)::BIGINT AS malformed, SUM(CASE WHEN event_id % 10 = 0 AND event_id % 33 <> 5 THEN 1 ELSE 0 END)::BIGINT AS missing FROM tcp_events
    UNION ALL SELECT 'lenient', COUNT(*), SUM(CASE WHEN event_id % 33 <> 5 THEN 1 ELSE 0 END)::BIGINT, SUM(CASE WHEN event_id % 33 = 5 THEN 1 ELSE 0 END)::BIGINT, 0 FROM tcp_events""",
)
def flow_reject_counts(spark, sf_dir):
    """The ledger counts what flows read, write, skip and reject, with a place for rejects and without."""
    topic_path, fields, parts = scratch(spark, "topic"), ["RTT", "SRTT", "Task"], []
    payload = """CASE WHEN event_id % 33 = 5 THEN '{broken' ELSE to_json(named_struct('Task', Task, 'RTT', event_id,
      'SRTT', CASE WHEN event_id % 10 <> 0 THEN SRTT END)) END AS value"""
    tcp_events(spark, sf_dir).selectExpr(payload).write.parquet(topic_path)
    conf = {"fields": fields, "columns": ["id", "srtt", "task"]}
    for target, serialization, more in (("strict", "json", {"rejects": scratch(spark, "rejects")}), ("lenient", "spb", {})):
        out = _flow(spark, sf_dir, "table", serialization, conf, ingress={"path": topic_path, "fields": fields, **more})
        parts.append(read_ledger(spark, out).withColumn("target", F.lit(target)))
    counts = [F.sum(c).alias(c) for c in ("read", "written", "malformed", "missing")]
    return parts[0].unionByName(parts[1]).groupBy("target").agg(*counts)


@query("flow_committed", f"SELECT RTT AS id, SRTT AS srtt FROM ({_FLOW_SELECT}) AS e")
def flow_committed(spark, sf_dir):
    """A micro-batch that was written but never finished is not read."""
    conf = {"fields": ["RTT", "SRTT"], "columns": ["id", "srtt"]}
    out = _flow(spark, sf_dir, "table", "spb", conf)
    spark.read.parquet(out).drop("batch_id").write.parquet(f"{out}/batch_id=7777")  # as a stop before the ledger leaves it
    return read_committed(spark, out)


@query(
    "flow_spb_documents",
    """SELECT '{"index":{}}' AS value FROM tcp_events UNION ALL SELECT CONCAT('{"Extra":', CAST(event_id AS VARCHAR), ',"Task":"', Task,
    '","Timestamp":', CAST(Timestamp AS VARCHAR), ',"Zone":"z"}') FROM tcp_events""",
)
def flow_spb_documents(spark, sf_dir):
    """Dynamic rows keep the keys that no catalog field has."""
    return spark.read.text(_flow(spark, sf_dir, "documents", "spb", {}, ingress=_repeated_topic(spark, sf_dir))).select("value")


@query("topic_sink_spb", f"SELECT {_json_sql(_json_pairs([*LINE_FIELDS, 'Timestamp'], True))} AS value FROM tcp_events")
def topic_sink_spb(spark, sf_dir):
    """Dynamic rows as topic messages: the selected fields and the stamps, a JSON object per event."""
    return _written(spark, sf_dir, "kafka", "parquet", serialization="spb")


def _unpacked(bodies: DataFrame, rows: int, size: int) -> DataFrame:
    """The lines of request bodies, and whether their body keeps to the limits."""
    fits = (F.col("rows") <= rows) & (F.octet_length("value") <= size) & (F.col("rows") * 2 == F.regexp_count("value", F.lit("\n")))
    lines = F.explode(F.split(F.rtrim(F.col("value"), F.lit("\n")), "\n"))
    return bodies.select("value", fits.alias("fits")).select(lines.alias("value"), "fits")  # a body is looked at once, not once a line


@query("bulk_bodies", f"SELECT '{{\"index\":{{}}}}' AS value, TRUE AS fits FROM tcp_events UNION ALL SELECT {_DOC_SQL}, TRUE FROM tcp_events")
def bulk_bodies(spark, sf_dir):
    """Request bodies of at most 100 rows and 8 KiB hold all documents, each with its action line."""
    lines = to_bulk_lines(to_documents(tcp_events(spark, sf_dir).select(*_DOC_COLUMNS)))
    return _unpacked(to_bulk_bodies(lines, 100, 8 << 10), 100, 8 << 10)


@query(
    "flow_flush_rows",
    """SELECT '{"index":{}}' AS value, TRUE AS fits FROM tcp_events UNION ALL SELECT CONCAT('{"Extra":', CAST(event_id AS VARCHAR), ',"Task":"', Task,
    '","Timestamp":', CAST(Timestamp AS VARCHAR), ',"Zone":"z"}'), TRUE FROM tcp_events""",
)
def flow_flush_rows(spark, sf_dir):
    """A flow hands its connector bodies of 50 rows at most."""
    out = scratch(spark, "bodies")
    conf = {"path": None, "format": "parquet", "options": {"path": out}, "bodies": True, "flush_rows": 50}
    _flow(spark, sf_dir, "documents", "json", conf, ingress=_repeated_topic(spark, sf_dir))
    return _unpacked(spark.read.parquet(out), 50, 5 << 20)


@query("flow_compaction", f"SELECT RTT AS id, SRTT AS srtt FROM ({_FLOW_SELECT}) AS e")
def flow_compaction(spark, sf_dir):
    """Micro-batches of a flow packed into clustered files while it goes on: rows are there once."""
    topic_path, out, progress = (scratch(spark, n) for n in ("topic", "out", "progress"))
    parts = views.topic(spark, sf_dir).select("value", (F.col("event_id") % 4).alias("part"))
    conf = {"path": out, "fields": ["RTT", "SRTT"], "columns": ["id", "srtt"], "trigger": {"availableNow": True}}
    config = {
        "ingress": {"in": {"config": {"path": topic_path, "fields": _TOPIC_FIELDS}}},
        "ingestion": {"out": {"type": "table", "config": conf}},
        "flow": [{"ingress": "in", "ingestion": "out", "serialization": "spb"}],
    }
    for part in range(4):
        parts.where(F.col("part") == part).select("value").write.mode("append").parquet(topic_path)
        for started in run_flows(spark, config, progress):
            started.awaitTermination()
        compact(spark, out, ["id"], keep=1)
    return read_compacted(spark, out)

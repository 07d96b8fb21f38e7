"""Writing shaped events: files, topics, tables, search indexes, time series.

Each sink shapes its rows and hands them to Spark's own writer, so the same
call serves a table (a batch write) and a stream (a started query). File sinks
of a stream are exactly-once through their checkpoint; connectors are
at-least-once.
"""

from __future__ import annotations

import sys
from collections.abc import Iterable

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StreamingQuery

from socklens.catalog import canonical
from socklens.operators import documents, lines, points, tables
from socklens.operators.conform import EXTRA, to_typed
from socklens.sources.topic import DEFAULT_TOPIC, kafka_options

COMPRESSIONS = ("none", "gzip", "lz4", "snappy")

# -- fixed values: sink types of agents and of flows -----------------------
AGENT_SINKS = ("console", "csv", "jsonl", "kafka")
FLOW_SINKS = {
    "table": "table",
    "clickhouse": "table",
    "documents": "documents",
    "elasticsearch": "documents",
    "points": "points",
    "influxdb": "points",
}
_NOT_BUILT = ("grpc-pb", "grpc-spb")


def write(df: DataFrame, sink: str, fields: Iterable[str] | None = None, **conf) -> StreamingQuery | None:
    """Write events to a sink chosen by type name.

    ``fields`` is the field list of the rows (default: all catalog columns of
    ``df``); for tables it pairs with ``columns``. An unknown type falls back to the console. Streams need
    ``checkpoint`` and take ``trigger``, e.g. ``{"processingTime": "2 seconds"}``.
    """
    if sink in _NOT_BUILT:
        raise ValueError(f"{sink} is a network server; write to a topic instead")
    if sink in FLOW_SINKS:
        if fields:
            conf["fields"] = list(fields)
        return _FLOW_WRITERS[FLOW_SINKS[sink]](df, conf)
    fields = list(fields) if fields else _fields_of(df)
    return _AGENT_WRITERS.get(sink, _console)(df, fields, conf)


def _fields_of(df: DataFrame) -> list[str]:
    names = []
    for column in df.columns:
        try:
            names.append(canonical(column))
        except ValueError:
            continue
    return names


def _need(conf, name: str, sink: str):
    if not conf.get(name):
        raise ValueError(f"sink {sink} needs the setting {name!r}")
    return conf[name]


def _save(df: DataFrame, conf, kind: str, path: str | None = None, options: dict | None = None):
    """Append through a batch or stream writer."""
    options = {k: str(v) for k, v in (options or {}).items()}
    if not df.isStreaming:
        writer = df.write.format(kind).mode(conf.get("mode", "append")).options(**options)
        return writer.save(path) if path else writer.save()
    writer = df.writeStream.format(kind).options(**options).outputMode("append")
    if path:
        writer = writer.option("path", path)
    return start_stream(writer, conf)


def start_stream(writer, conf) -> StreamingQuery:
    if conf.get("checkpoint"):
        writer = writer.option("checkpointLocation", conf["checkpoint"])
    if conf.get("trigger"):
        writer = writer.trigger(**conf["trigger"])
    if conf.get("name"):
        writer = writer.queryName(conf["name"])
    return writer.start()


def _print_lines(rows) -> None:
    for row in rows:
        print(row.value)
    sys.stdout.flush()


def _console(df: DataFrame, fields, conf):
    """Every event as a line, printed where its task runs, or written to text files under ``filename``.

    ``rows`` asks for a preview of so many rows (a batch: of the table, a
    stream: of each micro-batch) on the driver instead.
    """
    shaped = lines.to_console_lines(df, fields)
    if conf.get("filename"):
        return _save(shaped, conf, "text", conf["filename"])
    if df.isStreaming:
        if conf.get("rows"):
            return _save(shaped, conf, "console", options={"truncate": "false", "numRows": conf["rows"]})
        return start_stream(shaped.writeStream.foreachBatch(lambda batch, _id: batch.foreachPartition(_print_lines)), conf)
    return shaped.show(conf["rows"], truncate=False) if conf.get("rows") else shaped.foreachPartition(_print_lines)


def _line_file(shape, header):
    def save(df: DataFrame, fields, conf):
        path = _need(conf, "filename", "line file")
        if df.isStreaming:
            _write_header(df, path, header(fields))
            return _save(shape(df, fields), conf, "text", path)
        _save(shape(df, fields), conf, "text", path)  # may replace the folder
        return _write_header(df, path, header(fields))

    return save


def _write_header(df: DataFrame, path: str, header: str) -> None:
    """Put the header in its own file, once per folder.

    ``_header`` sorts before the part files, and Spark's readers skip it.
    """
    spark = df.sparkSession
    target = spark._jvm.org.apache.hadoop.fs.Path(path, "_header")
    files = target.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(target):
        out = files.create(target, False)
        out.write(bytearray(f"{header}\n".encode()))
        out.close()


def payload(df: DataFrame, fields, serialization: str = "json", conf=None) -> DataFrame:
    """Topic messages of events; no message key.

    ``json`` and ``spb`` carry the selected fields and the stamps, ``pb`` the
    typed row. Messages are JSON; with ``descriptor`` and ``message`` set, pb
    messages are protobuf bytes (needs Spark's protobuf module).
    """
    conf = conf or {}
    host = F.col("Hostname") if "Hostname" in df.columns else None
    if conf.get("hostname"):
        host = F.lit(conf["hostname"])
    if serialization in ("json", "spb"):
        return lines.to_event_json(df, fields, host)
    if serialization != "pb":
        raise ValueError(f"unknown serialization: {serialization}")
    typed = to_typed(df if host is None else df.withColumn("Hostname", host))
    row = F.struct(*typed.columns)
    if conf.get("descriptor"):
        from pyspark.sql.protobuf.functions import to_protobuf

        return typed.select(to_protobuf(row, conf["message"], descFilePath=conf["descriptor"]).alias("value"))
    return typed.select(F.to_json(row).alias("value"))


def _topic(df: DataFrame, fields, conf):
    messages = payload(df, fields, conf.get("serialization", "json"), conf)
    compression = conf.get("compression") or "none"
    if compression not in COMPRESSIONS:
        raise ValueError(f"unknown compression: {compression}")
    if conf.get("path"):
        return _save(messages, conf, "parquet", conf["path"], {"compression": compression})
    options = {
        **kafka_options(conf),
        "topic": conf.get("topic", DEFAULT_TOPIC),
        "kafka.compression.type": compression,
    }
    return _save(messages, conf, "kafka", options=options)


def mapping_of(conf) -> dict[str, str]:
    """Field -> column of a table sink (``fields`` and ``columns`` lists)."""
    fields, columns = _need(conf, "fields", "table"), _need(conf, "columns", "table")
    if len(fields) != len(columns):
        raise ValueError("table: fields and columns differ in length")
    return dict(zip(fields, columns))


def _table(df: DataFrame, conf):
    missing, mapping = tables.MISSING[conf.get("serialization", "pb")], mapping_of(conf)
    if missing == "strict" and df.isStreaming and conf.get("rejects"):
        raise ValueError("a stream of strict rows keeps its rejects in a flow; leave the setting out")
    if missing == "strict" and conf.get("rejects"):
        _, absent = tables.split_strict(df, mapping)
        rejected(absent).write.mode(conf.get("mode", "append")).parquet(conf["rejects"])
    elif missing == "strict":
        df, missing = tables.require_numbers(df, mapping), "null"
    rows = tables.to_table_rows(df, mapping, missing)
    if conf.get("path"):
        return _save(rows, conf, "parquet", conf["path"])
    options = {
        "url": _need(conf, "url", "table"),
        "dbtable": conf.get("table", DEFAULT_TOPIC),
        "batchsize": str(conf.get("batch_size", 100)),
        **(conf.get("options") or {}),
    }

    def insert(batch: DataFrame, _batch_id: int | None = None) -> None:
        batch.write.format("jdbc").mode("append").options(**options).save()

    if df.isStreaming:
        return start_stream(rows.writeStream.foreachBatch(insert), conf)
    return insert(rows)


def rejected(rows: DataFrame) -> DataFrame:
    """Rows that a strict table does not take, as reject payloads."""
    payload = F.to_json(F.struct(*rows.columns)) if rows.columns else F.lit("{}")
    return rows.select(payload.alias("_corrupt_record"), F.lit("missing number").alias("reason"))


def _connector_or_text(shaped: DataFrame, text, conf, sink: str):
    """Text files under ``path``, or the rows through connector ``format``."""
    if conf.get("format"):
        options = conf.get("options") or {}
        if not shaped.isStreaming:
            return _save(shaped, conf, conf["format"], options=options)

        def insert(batch: DataFrame, _batch_id: int) -> None:
            batch.write.format(conf["format"]).mode("append").options(**options).save()

        return start_stream(shaped.writeStream.foreachBatch(insert), conf)
    return _save(text(shaped), conf, "text", _need(conf, "path", sink))


def _documents(df: DataFrame, conf):
    """Documents through a connector, or as bulk lines.

    ``bodies`` hands a connector request bodies instead, one a row, of
    ``flush_rows`` rows and ``flush_bytes`` bytes at most.
    """
    shaped = documents.to_documents(df, conf.get("serialization", "json"))
    if conf.get("format") and conf.get("bodies"):
        limits = conf.get("flush_rows") or documents.BODY_ROWS, conf.get("flush_bytes") or documents.BODY_BYTES
        shaped = documents.to_bulk_bodies(documents.to_bulk_lines(shaped), *limits)
    return _connector_or_text(shaped, documents.to_bulk_lines, conf, "documents")


def _points(df: DataFrame, conf):
    mode, measurement = conf.get("serialization", "json"), conf.get("measurement", DEFAULT_TOPIC)
    if conf.get("format") or (mode != "pb" and EXTRA in df.columns):  # names of extra keys differ from row to row
        shaped = points.to_points(df, measurement, conf.get("geo_field"), mode)
        return _connector_or_text(shaped, lambda p: points.to_line_protocol(p, unsigned=mode == "pb"), conf, "points")
    shaped = points.to_lines(df, measurement, conf.get("geo_field"), mode)
    return _connector_or_text(shaped, lambda text: text, conf, "points")


_AGENT_WRITERS = {
    "console": _console,
    "csv": _line_file(lines.to_csv_lines, lines.csv_header),
    "jsonl": _line_file(lines.to_array_lines, lines.array_header),
    "kafka": _topic,
}
_FLOW_WRITERS = {"table": _table, "documents": _documents, "points": _points}

"""Continuous flows: topic -> decode -> enrich -> shape -> sink.

A flow binds one ingress, one ingestion and one serialization by name, and runs
as a Structured Streaming query of its own: flows that share a topic each read
all of it. Progress is checkpointed after a micro-batch is written, so nothing
is lost on restart.

A ledger holds a row per finished micro-batch: what was read, written and
rejected, counted while the rows were written. A folder target's ledger lies beside it;
:func:`read_committed` gives the rows of finished micro-batches alone, so a
stop between two files, or before a replay, shows nothing half or twice.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.sql import DataFrame, Observation, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from socklens.catalog import event_schema
from socklens.operators.conform import to_typed
from socklens.operators.decode import CORRUPT, decode_json, decode_protobuf, split_malformed
from socklens.operators.enrich import GeoLookup
from socklens.operators.tables import MISSING, split_strict
from socklens.sinks.writer import FLOW_SINKS, mapping_of, rejected, write
from socklens.sources.topic import read_topic

SERIALIZATIONS = ("json", "spb", "pb")

# -- fixed values: per-sink defaults ---------------------------------------
GEO_FIELD = {"table": "SAddr", "documents": "SAddr", "points": "DAddr"}
FLUSH_ROWS = {"table": 100, "points": 200}
FLUSH_SECONDS = {"table": 2, "documents": 1, "points": 1}


@dataclass(frozen=True)
class Flow:
    ingress: str
    ingestion: str
    serialization: str


def check_flows(config: Mapping) -> list[Flow]:
    """Flows of a configuration; raises on missing or undefined names."""
    flows = [f if isinstance(f, Flow) else Flow(**{k: f.get(k) or "" for k in Flow.__annotations__}) for f in config.get("flow") or []]
    if not flows:
        raise ValueError("the configuration names no flow")
    for flow in flows:
        for part in ("ingestion", "ingress", "serialization"):
            if not getattr(flow, part):
                raise ValueError(f"a flow lacks its {part}")
        for part in ("ingestion", "ingress"):
            if getattr(flow, part) not in (config.get(part) or {}):
                raise ValueError(f"no {part} is called {getattr(flow, part)!r}")
        if flow.serialization not in SERIALIZATIONS:
            raise ValueError(f"unknown serialization: {flow.serialization}")
        kind = config["ingestion"][flow.ingestion].get("type")
        if kind not in FLOW_SINKS:
            raise ValueError(f"unknown ingestion type: {kind}")
        source = config["ingress"][flow.ingress].get("config") or {}
        if FLOW_SINKS[kind] == "table" and MISSING[flow.serialization] == "strict" and not source.get("rejects"):
            raise ValueError(f"a strict table would stop at the first row that lacks a number: ingress {flow.ingress!r} needs a folder for rejects")
    repeated = [flow for n, flow in enumerate(flows) if flow in flows[:n]]
    if repeated:
        raise ValueError(f"a flow is named twice: {repeated[0]}")
    return flows


def open_geo(config: Mapping) -> GeoLookup | None:
    """Lookup of a configuration: ``geo = {level, city, asn}``, tables given
    as DataFrames (or ``{4: df, 6: df}``)."""
    geo = config.get("geo")
    return GeoLookup(geo.get("level", ""), geo.get("city"), geo.get("asn")) if geo else None


def decode_payload(payloads: DataFrame, conf: Mapping, serialization: str) -> DataFrame:
    """Event rows with the malformed marker.

    Payloads of events and of dynamic rows keep all of their keys, unless ``fields`` in the ingress
    configuration narrows what is parsed.
    """
    if conf.get("descriptor"):
        return decode_protobuf(payloads, conf["message"], conf["descriptor"])
    return decode_json(payloads, event_schema(conf.get("fields")), wide=True, extra=serialization != "pb" and not conf.get("fields"))


def prepare(events: DataFrame, kind: str, conf: Mapping, serialization: str, geo: GeoLookup | None) -> DataFrame:
    """Enriched rows for a sink kind.

    Looked-up values replace the row's own, except in tables fed by spb or pb,
    where the row's own value wins.
    """
    if serialization == "pb":
        events = to_typed(events)
    if geo is None:
        return events
    fill = kind == "table" and serialization != "json"
    return geo.enrich(events, conf.get("geo_field", GEO_FIELD[kind]), "fill" if fill else "overwrite")


def flush(conf: Mapping, kind: str) -> dict:
    """Trigger of a sink: ``flush_interval`` seconds, or its default."""
    if conf.get("trigger"):
        return conf["trigger"]
    return {"processingTime": f"{conf.get('flush_interval', FLUSH_SECONDS[kind])} seconds"}


def start_flow(
    spark: SparkSession, config: Mapping, flow: Flow, checkpoint: str, geo: GeoLookup | None = None
) -> list[StreamingQuery]:
    """Start one flow as one query.

    Every micro-batch is read and parsed once. Its good rows go to the sink, in
    a folder ``batch_id=N`` of their own where the target is a path, so that a
    replayed batch replaces itself whatever the size of the lookup tables;
    connectors and JDBC tables are at-least-once. ``rejects`` in the ingress
    configuration names a folder, laid out alike per flow, for what cannot be decoded
    and for rows that lack a number a strict table needs. Without it the former
    are skipped, and counted; a flow into a strict table does not start without it.
    When all of a micro-batch is written, its counts go to the ledger (:func:`read_ledger`).
    """
    ingress = config["ingress"][flow.ingress].get("config") or {}
    ingestion = config["ingestion"][flow.ingestion]
    conf, kind = dict(ingestion.get("config") or {}), FLOW_SINKS[ingestion["type"]]
    label = f"{flow.ingress}-{flow.ingestion}-{flow.serialization}"
    trigger = flush(conf, kind)
    conf.setdefault("batch_size", conf.get("flush_rows", FLUSH_ROWS.get(kind, 0)))
    conf["serialization"] = flow.serialization
    if kind == "points":
        conf["geo_field"] = conf.get("geo_field", GEO_FIELD[kind]) if geo else None
    geo_conf = {k: v for k, v in conf.items() if v is not None}
    target = {k: v for k, v in conf.items() if k not in ("trigger", "rejects")}

    ledger = ledger_of(conf["path"]) if conf.get("path") else f"{checkpoint}/ledger"

    def ingest(batch: DataFrame, batch_id: int) -> None:
        rejects = f"{ingress['rejects']}/flow={label}/batch_id={batch_id}" if ingress.get("rejects") else None
        here = dict(target)
        if here.get("path"):
            here |= {"path": f"{here['path']}/batch_id={batch_id}", "mode": "overwrite"}
        seen, kept = Observation(), Observation()
        batch = batch.observe(seen, F.count(F.lit(1)).alias("read"), F.count_if(F.col(CORRUPT).isNotNull()).alias("malformed"))
        batch = batch.persist(StorageLevel.MEMORY_AND_DISK) if rejects else batch
        try:
            good, bad = split_malformed(batch)
            rows = prepare(good, kind, geo_conf, flow.serialization, geo)
            if rejects:
                bad = bad.select("_corrupt_record", F.lit("malformed").alias("reason"))
                if kind == "table" and MISSING[flow.serialization] == "strict":
                    rows, absent = split_strict(rows, mapping_of(conf))
                    bad = bad.unionByName(rejected(absent))
                bad.write.mode("overwrite").parquet(rejects)
            write(rows.observe(kept, F.count(F.lit(1)).alias("written")), kind, **here)
        finally:
            if rejects:
                batch.unpersist()
        counts = {**seen.get, **kept.get}
        missing = counts["read"] - counts["malformed"] - counts["written"]
        row = [(counts["read"], counts["written"], counts["malformed"], missing)]
        spark.createDataFrame(row, _COUNTS).coalesce(1).write.mode("overwrite").parquet(f"{ledger}/flow={label}/batch_id={batch_id}")

    rows = decode_payload(read_topic(spark, ingress), ingress, flow.serialization)
    writer = rows.writeStream.foreachBatch(ingest).trigger(**trigger).queryName(label)
    return [writer.option("checkpointLocation", f"{checkpoint}/{label}").start()]


_COUNTS = "read long, written long, malformed long, missing long"


def ledger_of(path: str) -> str:
    """The ledger folder of a folder target."""
    return f"{path.rstrip('/')}-ledger"


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    """Finished micro-batches of a target: payloads ``read``, rows ``written``, ``malformed`` payloads and rows with a ``missing`` number.

    ``path`` is that of a folder target; of other targets, the ledger is in the
    folder ``ledger`` of the checkpoint folder and is read as it is.
    """
    return spark.read.parquet(ledger_of(path)).select("flow", F.col("batch_id").cast("long"), "read", "written", "malformed", "missing")


def read_committed(spark: SparkSession, path: str, kind: str = "parquet") -> DataFrame:
    """Rows of a folder target, of finished micro-batches alone; ``kind`` is the format of its files."""
    rows = spark.read.format(kind).load(path).withColumn("batch_id", F.col("batch_id").cast("long"))
    done = read_ledger(spark, path).select("batch_id").distinct()
    return rows.join(done, "batch_id", "left_semi").drop("batch_id")


def run_flows(spark: SparkSession, config: Mapping, checkpoint: str) -> list[StreamingQuery]:
    """Check a configuration and start all of its flows.

    Nothing is started if any flow is invalid. The geo tables are opened once.
    """
    flows = check_flows(config)
    geo = open_geo(config)
    return [query for flow in flows for query in start_flow(spark, config, flow, checkpoint, geo)]

"""Agent side: run every configured spec and write to its destination."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame

from socklens.operators.combine import check_one_list
from socklens.plans.spec import run_specs, specs_from_config, stream_specs
from socklens.sinks.writer import start_stream, write


def run_agent(df: DataFrame, config: Mapping, checkpoint: str | None = None, received: str | None = None) -> list:
    """Run the specs of an agent configuration over an event table or stream.

    Specs that name the same destination are written there together, from one
    scan. Returns the started queries of a stream, or one None per finished batch write.
    """
    grouped = specs_from_config(config)
    results = []
    for name, specs in grouped.items():
        destination = config["egress"][name]
        kind = destination.get("type", "")
        check_one_list(specs, kind)
        for spec in specs:
            spec.keep = ["Hostname"] if "Hostname" in df.columns else []
        conf = dict(destination.get("config") or {})
        if df.isStreaming:
            conf.setdefault("checkpoint", f"{checkpoint}/{name}")
        fields = list(dict.fromkeys(f for spec in specs for f in spec.field_names))
        if df.isStreaming and any(spec.sample for spec in specs):
            writer = stream_specs(df, specs, _each_batch(kind, fields, conf), f"{conf['checkpoint']}-sockets", received)
            results.append(start_stream(writer, conf))
            continue
        results.append(write(run_specs(df, specs, received), kind, fields, **conf))
    return results


def _each_batch(kind: str, fields: list[str], conf: Mapping):
    """Write the rows of a micro-batch; files go to a folder of its own, which a replay overwrites."""

    def sink(rows: DataFrame, batch_id: int) -> None:
        here = {k: v for k, v in conf.items() if k not in ("checkpoint", "trigger")}
        for place in ("filename", "path"):
            if here.get(place):
                here |= {place: f"{here[place]}/batch_id={batch_id}", "mode": "overwrite"}
        write(rows, kind, fields, **here)

    return sink

"""Socket telemetry on tables and streams, as Spark DataFrame plans."""

from socklens.catalog import catalog, event_schema, typed_schema
from socklens.functions.clock import event_time, stamp_host, stamp_time
from socklens.operators.combine import multiplex, union_families
from socklens.operators.conform import from_dynamic, to_dynamic, to_typed, to_variant
from socklens.operators.conformance import conformance
from socklens.operators.decode import decode_json, decode_records, encode_records, split_malformed
from socklens.operators.documents import to_bulk_bodies, to_bulk_lines, to_documents
from socklens.operators.enrich import GeoLookup, enrich_geo
from socklens.operators.lines import to_array_lines, to_console_lines, to_csv_lines, to_event_json
from socklens.operators.numbering import number_rows
from socklens.operators.points import to_line_protocol, to_lines, to_points
from socklens.operators.predicates import drop_where, filter_family, filter_protocol, filter_state, select_tracepoint
from socklens.operators.project import apply_math, derive_intrinsic, project
from socklens.operators.sampling import sample_per_socket, sample_stream
from socklens.operators.tables import split_strict, to_table_rows
from socklens.plans.spec import FieldSpec, Spec, run_spec, run_specs, specs_from_config
from socklens.sinks.writer import write
from socklens.sources.packed import read_packed, write_packed
from socklens.sources.records import read_records
from socklens.sources.topic import read_topic
from socklens.streaming.agent import run_agent
from socklens.streaming.compaction import compact, read_compacted
from socklens.streaming.flows import Flow, check_flows, read_committed, read_ledger, run_flows, start_flow

__all__ = [name for name in dir() if not name.startswith("_")]

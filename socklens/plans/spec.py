"""Specs: what to select from an event table, and the plan that does it."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping
from dataclasses import dataclass, field as default
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.streaming import DataStreamWriter

from socklens.catalog import STATE_TRACEPOINT, canonical, check_tracepoint, state_name
from socklens.functions.clock import stamp_time
from socklens.operators.numbering import number_rows
from socklens.operators.predicates import drop_where, dropped, filter_family, select_state_rows, select_tracepoint, selection
from socklens.operators.project import apply_math, derive_intrinsic, project
from socklens.operators.sampling import IDLE_MINUTES, ORDER, SocketCounters, check_order, check_sample, present_key, sample_per_socket
from socklens.settings import free_names

# -- fixed values: the spec used when nothing is configured ----------------
DEFAULT_FIELDS = ("RTT", "TotalRetrans", "SAddr", "DAddr", "DPort")


@dataclass(frozen=True)
class FieldSpec:
    """One selected field: C math suffix and C drop condition are optional."""

    name: str
    math: str = ""
    filter: str = ""


@dataclass
class Spec:
    """One tracepoint's selection. ``sample`` n keeps one row in n + 1.

    Sampling counts per ``key`` (default: the socket columns of the input) in
    ``order``; ``idle_minutes`` is when a stream forgets a socket that stopped.
    """

    tracepoint: str = STATE_TRACEPOINT
    fields: Iterable = DEFAULT_FIELDS
    tcp_state: str = "TCP_CLOSE"
    inet: Iterable[int] = (4,)
    sample: int = 0
    egress: str = "console"
    keep: Iterable[str] = default(default=())
    order: Iterable[str] = ORDER
    key: Iterable[str] | None = None
    idle_minutes: int | None = IDLE_MINUTES

    def __post_init__(self):
        self.fields = [self._field(f) for f in self.fields]
        names = self.field_names
        if not names:
            raise ValueError("a spec needs fields")
        if len(set(names)) != len(names):
            raise ValueError(f"field named twice: {names}")
        check_tracepoint(self.tracepoint)
        self.tcp_state = state_name(self.tcp_state)
        self.inet = list(self.inet) or [4]
        for family in self.inet:
            if family not in (4, 6):
                raise ValueError(f"wrong address family: {family}")
        check_sample(self.sample)
        self.order = [self.order] if isinstance(self.order, str) else list(self.order)
        self.key = list(self.key) if self.key else None
        if not self.order:
            raise ValueError("sampling needs an order")

    @staticmethod
    def _field(value) -> FieldSpec:
        if isinstance(value, str):
            value = FieldSpec(value)
        elif isinstance(value, Mapping):
            value = FieldSpec(**value)
        return FieldSpec(canonical(value.name), value.math, value.filter)

    @property
    def field_names(self) -> list[str]:
        return [f.name for f in self.fields]


def specs_from_config(config: Mapping) -> dict[str, list[Spec]]:
    """Specs of an agent configuration, grouped by destination.

    ``config`` has ``tracepoints`` (a list), ``fields`` (named field lists) and
    ``egress`` (named destinations), as they come out of a YAML file.
    """
    grouped: dict[str, list[Spec]] = {}
    for point in config.get("tracepoints", []):
        if point["fields"] not in config.get("fields", {}):
            raise ValueError(f"field list not found: {point['fields']}")
        if point.get("egress") not in config.get("egress", {}):
            raise ValueError(f"egress not found: {point.get('egress')}")
        spec = Spec(
            tracepoint=point["name"],
            fields=config["fields"][point["fields"]],
            tcp_state=point.get("tcp_state", ""),
            inet=point.get("inet") or (4,),
            sample=point.get("sample", 0),
            egress=point["egress"],
            order=point.get("order") or ORDER,
            key=point.get("key"),
            idle_minutes=point.get("idle_minutes", IDLE_MINUTES),
        )
        grouped.setdefault(spec.egress, []).append(spec)
    return grouped


def run_spec(
    df: DataFrame,
    spec: Spec,
    received: str | None = None,
    order: Iterable[str] | None = None,
    key: Iterable[str] | None = None,
    spread: bool = True,
    counters: SocketCounters | None = None,
) -> DataFrame:
    """Events of ``df`` selected by ``spec``: fields in spec order, Timestamp last.

    Selection comes first, then field math, then the drop filters over the
    computed values, then sampling. ``received`` names a receive-time column to
    stamp from; without it the input's own Timestamp is used, or the current
    time if it has none. ``order`` and ``key`` stand in for those of the spec.
    """
    if df.isStreaming and spec.sample:
        raise ValueError("a stream is sampled micro-batch by micro-batch: see stream_specs")
    rows = select_tracepoint(df, spec.tracepoint)
    rows = select_state_rows(rows, spec.tracepoint, spec.tcp_state)
    rows = filter_family(rows, spec.inet)
    if received or "Timestamp" not in df.columns:
        rows = stamp_time(rows, received)
    rows = derive_intrinsic(rows)
    if spec.sample:
        # sockets are told apart by their true addresses and ports, before math
        names = present_key(rows, key or spec.key)
        order = check_order(rows, list(order or spec.order))
        sockets = {f"_key_{n}": F.col(n) for n in names}
        rows = rows.withColumns(sockets)
    rows = apply_math(rows, {f.name: f.math for f in spec.fields})
    rows = drop_where(rows, {f.name: f.filter for f in spec.fields})
    keep = ["Timestamp", *spec.keep]
    if spec.sample:
        rows = project(rows, spec.field_names, [*dict.fromkeys([*keep, *order]), *sockets])
        rows = sample_per_socket(rows, spec.sample, list(sockets), order, spread, counters)
    return project(rows, spec.field_names, keep)


def stream_specs(
    df: DataFrame, specs: Iterable[Spec], sink: Callable[[DataFrame, int], None], state: str, received: str | None = None
) -> DataStreamWriter:
    """The rows of :func:`run_specs` for a stream, micro-batch by micro-batch; a writer to start.

    ``sink`` gets the rows of each micro-batch and its number. Counters of
    sampled sockets lie in the folder ``state``, so a replayed micro-batch gives the same rows.
    """
    specs = list(specs)
    return df.writeStream.foreachBatch(lambda batch, batch_id: sink(run_specs(batch, specs, received, (state, batch_id)), batch_id))


def run_specs(
    df: DataFrame, specs: Iterable[Spec], received: str | None = None, counted: tuple[str, int] | None = None
) -> DataFrame:
    """Events of all specs as one table; columns a spec does not select are NULL in its rows.

    The rows of :func:`run_spec` for each spec, from one scan of ``df``: what any
    spec selects is read once, and a row is repeated for each spec that selects
    it. Specs that sample are numbered together, per spec and socket, from a scan
    of their own (one per order and idle time they name). ``counted`` names the folder of socket
    counters and the number of the micro-batch that ``df`` is.
    """
    specs = list(specs)
    if not specs:
        raise ValueError("nothing to run")
    plain = [spec for spec in specs if not spec.sample]
    sampled = [spec for spec in specs if spec.sample]
    names = list(dict.fromkeys(n for spec in specs for n in spec.field_names))
    keep = list(dict.fromkeys(["Timestamp", *[k for spec in specs for k in spec.keep]]))
    parts = [_run_together(df, plain, received)] if plain else []
    orders: dict[tuple, list[Spec]] = {}
    for spec in sampled:
        orders.setdefault((*spec.order, spec.idle_minutes), []).append(spec)
    for i, together in enumerate(orders.values()):
        counters = SocketCounters(f"{counted[0]}/group={i}", counted[1], together[0].idle_minutes) if counted else None
        parts.append(_run_together(df, together, received, counters))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part, allowMissingColumns=True)
    return out.select(*names, *keep)


def _run_together(df: DataFrame, specs: list[Spec], received: str | None, counters: SocketCounters | None = None) -> DataFrame:
    """Specs that all sample in one order, or do not sample."""
    if len(specs) == 1:
        return run_spec(df, specs[0], received, counters=counters)
    if df.isStreaming and specs[0].sample:
        raise ValueError("a stream is sampled micro-batch by micro-batch: see stream_specs")
    (tag,) = free_names(df.columns, "_spec")
    selected = [selection(s.tracepoint, s.tcp_state, s.inet) for s in specs]
    rows = df.where(reduce(lambda a, b: a | b, selected))
    matching = F.array_compact(F.array(*[F.when(kept, i) for i, kept in enumerate(selected)]))
    rows = rows.withColumn(tag, F.explode(matching))
    if received or "Timestamp" not in df.columns:
        rows = stamp_time(rows, received)
    rows = derive_intrinsic(rows)
    order = specs[0].order
    sockets: list[str] = []
    if specs[0].sample:
        check_order(rows, order)
        keys = [present_key(rows, s.key) for s in specs]
        places = range(max(map(len, keys)))
        # sockets of a spec are told apart by its own key, before math
        named = {f"_key_{n}": _of_spec(tag, {i: F.col(k[n]).cast("string") for i, k in enumerate(keys) if n < len(k)}) for n in places}
        rows, sockets = rows.withColumns(named), list(named)
    for i, spec in enumerate(specs):
        rows = apply_math(rows, {f.name: f.math for f in spec.fields}, F.col(tag) == i)
    for i, spec in enumerate(specs):
        hit = dropped(rows, {f.name: f.filter for f in spec.fields})
        if hit is not None:
            rows = rows.where(~((F.col(tag) == i) & hit))
    names = list(dict.fromkeys(n for spec in specs for n in spec.field_names))
    keep = list(dict.fromkeys(["Timestamp", *[k for spec in specs for k in spec.keep]]))
    if sockets:
        rows = project(rows, names, [*dict.fromkeys([*keep, *order]), *sockets, tag])
        (position,) = free_names(rows.columns, "_position")
        sockets = [tag, *sockets]
        rows = counters.number(rows, sockets, order, position) if counters else number_rows(rows, sockets, order, position, "sampled")
        step = F.element_at(F.array(*[F.lit(s.sample + 1) for s in specs]), F.col(tag) + 1)
        rows = rows.where(F.col(position) % step == 0)
    else:
        rows = project(rows, names, [*keep, tag])
    values = [_of_spec(tag, {i: F.col(n) for i, s in enumerate(specs) if n in s.field_names}, len(specs)).alias(n) for n in names]
    return rows.select(*values, *keep)


def _of_spec(tag: str, values: Mapping[int, Column], count: int | None = None) -> Column:
    """The value of the row's own spec; NULL for specs without one."""
    if count == len(values):
        return values[0]  # the same column in all of them
    out = F.lit(None)
    for i, value in values.items():
        out = F.when(F.col(tag) == i, value).otherwise(out)
    return out

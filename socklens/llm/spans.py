"""Matches of a pattern with their places, in native expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

SPAN = "array<struct<start:int,end:int,text:string>>"


def no_spans() -> Column:
    return F.array().cast(SPAN)


def with_matches(df: DataFrame, text: str, patterns: dict[str, str], only: dict[str, Column] | None = None) -> DataFrame:
    """Add, per name, the leftmost non-overlapping matches of its pattern in column ``text``.

    Each is an array of (start, end, text), in code points, end exclusive. A row
    is searched for a name only where ``only[name]`` holds. The matches alone
    say how long they are; the pieces between them, which are cut only in rows
    that have a match, say where they lie.
    """
    only = only or {}

    def found(name: str) -> Column:
        matches = F.regexp_extract_all(F.col(text), F.lit(patterns[name]), F.lit(0))
        return F.when(only[name], matches).otherwise(F.array().cast("array<string>")) if name in only else matches

    df = df.withColumns({name: found(name) for name in patterns})

    def placed(name: str) -> Column:
        gaps = F.split(F.col(text), patterns[name], -1)
        pairs = F.zip_with(F.col(name), F.slice(gaps, F.lit(1), F.size(name)), lambda m, g: F.struct(m.alias("m"), g.alias("g")))
        start = F.struct(F.lit(0).alias("at"), no_spans().alias("spans"))

        def step(acc: Column, pair: Column) -> Column:
            begin = acc["at"] + F.length(pair["g"])
            end = begin + F.length(pair["m"])
            span = F.struct(begin.alias("start"), end.alias("end"), pair["m"].alias("text"))
            return F.struct(end.alias("at"), F.concat(acc["spans"], F.array(span)).alias("spans"))

        return F.when(F.size(name) > 0, F.aggregate(pairs, start, step, lambda acc: acc["spans"])).otherwise(no_spans())

    return df.withColumns({name: placed(name) for name in patterns})


def listed(kinds: list[str], by_start: bool) -> Column:
    """'kind:start:end' of the span columns ``kinds``, comma-joined: in the order of kinds, then start; or by start, then kind."""

    def rows(n: int, kind: str) -> Column:
        return F.transform(
            F.col(kind),
            lambda s: F.struct(
                (s["start"] if by_start else F.lit(n)).alias("first"),
                (F.lit(n) if by_start else s["start"]).alias("second"),
                F.concat_ws(":", F.lit(kind), s["start"], s["end"]).alias("text"),
            ),
        )

    every = F.concat(*[rows(n, kind) for n, kind in enumerate(kinds)])
    return F.array_join(F.transform(F.array_sort(every), lambda s: s["text"]), ",")


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions)


def all_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions)

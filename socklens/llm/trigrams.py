"""Boolean trigram queries of regular expressions, and the postings they are asked of."""

from __future__ import annotations

import re
from itertools import product

from pyspark.sql import Column, DataFrame, functions as F

from socklens.llm.spans import all_of, any_of

# A query is True (every text may match), a trigram, ("and", ...) or ("or", ...).
Query = bool | str | tuple
MOST_TEXTS = 64  # alternatives of a piece that are written out; beyond, the piece is cut there
MOST_CLASS = 8  # characters of a class that are written out


def _join(kind: str, parts: list) -> Query:
    neutral = kind == "and"
    if not neutral and any(p is True for p in parts):
        return True
    parts = list(dict.fromkeys(p for p in parts if p is not True))
    return parts[0] if len(parts) == 1 else (kind, *parts) if parts else True


def _of_texts(texts: set[str]) -> Query:
    """A text of the set stands in what matches, so all trigrams of one of them do."""
    sets = {frozenset(t[i : i + 3] for i in range(len(t) - 2)): t for t in sorted(texts)}
    least = [t for s, t in sets.items() if not any(other < s for other in sets)]
    return _join("or", [_join("and", [t[i : i + 3] for i in range(len(t) - 2)]) for t in least])


def _class(items) -> set[str] | None:
    chars: set[str] = set()
    for kind, value in items:
        if str(kind) == "LITERAL":
            chars.add(chr(value))
        elif str(kind) == "RANGE" and value[1] - value[0] < MOST_CLASS:
            chars.update(map(chr, range(value[0], value[1] + 1)))
        else:
            return None
    return chars if len(chars) <= MOST_CLASS else None


def _walk(items) -> tuple[set[str] | None, Query]:
    """(all texts the items can match, or None if too many; what any match must hold)."""
    whole, held, now = True, [], {""}

    def cut() -> None:
        nonlocal whole, now
        held.append(_of_texts(now))
        whole, now = False, {""}

    for kind, value in items:
        name, texts, query = str(kind), None, True
        if name == "LITERAL":
            texts = {chr(value)}
        elif name == "IN":
            texts = _class(value)
        elif name == "SUBPATTERN":
            texts, query = _walk(value[3])
        elif name == "BRANCH":
            found = [_walk(branch) for branch in value[1]]
            if all(t is not None for t, _ in found):
                texts = set().union(*[t for t, _ in found])
            query = _join("or", [_of_texts(t) if t is not None else q for t, q in found])
        elif name in ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT"):
            least, most, body = value
            inner, inner_query = _walk(body)
            if inner is not None and most == 1:
                texts = inner | {""}
            elif inner is not None and least == most and len(inner) ** least <= MOST_TEXTS:
                texts = {"".join(p) for p in product(inner, repeat=int(least))}
            elif least:
                query = inner_query if inner is None else _of_texts(inner)
        elif name == "AT":
            continue
        if texts is not None and len(now) * len(texts) <= MOST_TEXTS:
            now = {a + b for a in now for b in texts}
            continue
        cut()
        held.append(query if texts is None else _of_texts(texts))
    if whole:
        return now, _of_texts(now)
    held.append(_of_texts(now))
    return None, _join("and", held)


def trigram_query(pattern: str) -> Query:
    """What the lower-cased text must hold where ``pattern`` matches; True if nothing can be told."""
    return _walk(re._parser.parse(pattern.lower() if "\\" not in pattern else re.sub(r"(\\.)|[A-Z]", lambda m: m[1] or m[0].lower(), pattern)))[1]


def trigrams(query: Query) -> set[str]:
    if query is True:
        return set()
    return {query} if isinstance(query, str) else set().union(*map(trigrams, query[1:]))


def holds(query: Query, present: Column) -> Column:
    """The query as a condition on the array of trigrams that are present."""
    if query is True:
        return F.lit(True)
    if isinstance(query, str):
        return F.array_contains(present, query)
    return (all_of if query[0] == "and" else any_of)([holds(q, present) for q in query[1:]])


def postings(docs: DataFrame, key: str, text: str, wanted: set[str]) -> DataFrame:
    """(trigram, key): the inverted index of the wanted trigrams over the lower-cased texts, one row per posting."""
    low = F.lower(F.col(text))
    here = F.array_compact(F.array(*[F.when(low.contains(t), F.lit(t)) for t in sorted(wanted)]))
    return docs.select(key, F.explode(here).alias("trigram")).distinct()


def candidates(index: DataFrame, key: str, queries: dict[str, Query]) -> DataFrame:
    """(key, rules): the intersected postings of every rule, for keys where at least one rule can match.

    Postings of a key meet by key, one small array each, so no posting list of
    a frequent trigram is ever gathered.
    """
    present = index.groupBy(key).agg(F.collect_set("trigram").alias("present"))
    rules = F.array_compact(F.array(*[F.when(holds(q, F.col("present")), F.lit(r)) for r, q in queries.items()]))
    return present.select(key, rules.alias("rules")).where(F.size("rules") > 0)

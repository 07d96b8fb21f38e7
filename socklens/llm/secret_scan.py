"""Secret scans over a trigram index, in native expressions.

Rules are regular expressions. Each gives a Boolean query of trigrams that any
match must hold; an inverted index of the trigrams of all rules is asked for
the texts where a rule can match, and only those are searched for it. Rules
without such trigrams search every text.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, functions as F

from socklens.llm.shared import apart, stash, text_key, whole_text
from socklens.llm.spans import listed, no_spans, with_matches
from socklens.llm.trigrams import candidates, postings, trigram_query, trigrams

_KEYWORD = "password|passwd|secret|token|api_?key"
_VALUE = "[A-Za-z0-9+/_.=-]"
ASSIGN = rf"""(?i:{_KEYWORD})["']?\x20*[:=]\x20*["']?{_VALUE}+"""
# The value of an assignment is what follows this.
ASSIGN_HEAD = rf"""^(?i:{_KEYWORD})["']?\x20*[:=]\x20*["']?"""
LEAST_VALUE = 6

# The minimum lengths of the second and third rule are in their patterns: a
# run that is too short has no match inside, so the matches are those of the
# pattern without a minimum that are long enough.
RULES = {
    "assign": ASSIGN,
    "access": r"AKIA[A-Z0-9]{16,}",
    "hex": r"[0-9a-f]{24,}",
    "github": r"gh[opsu]_[A-Za-z0-9]{36,}",
    "google": r"AIza[A-Za-z0-9_-]{35}",
    "slack": r"xox[abprs]-[A-Za-z0-9-]{10,}",
    "stripe": r"[rs]k_live_[A-Za-z0-9]{16,}",
    "jwt": r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+",
    "pem": r"-----BEGIN [A-Z ]*PRIVATE KEY-----",
}
BASE = ["assign", "access", "hex"]


def confirmed(rule: str, text: Column) -> Column:
    if rule != "assign":
        return F.lit(True)
    return F.length(F.regexp_replace(text, ASSIGN_HEAD, "")) >= LEAST_VALUE


def find_secrets(docs: DataFrame, text: str = "text", rules: dict[str, str] | None = None) -> DataFrame:
    """Add one column per rule: array of (start, end, text), by start, in code points, end exclusive.

    Texts are indexed and joined by their digest, so ids may be null or repeat
    and equal texts share their postings; a text that many rows repeat is split
    by adaptive execution, as the candidates have one row per text. A null or
    empty text has no spans. Rows stay as they are; no rows give none. Columns
    of ``docs`` named like a rule are replaced; any other name is kept.
    """
    rules = rules or RULES
    docs, back = apart(docs, text)
    docs = docs.withColumn("__text", whole_text(text)).withColumn("__key", text_key(F.col("__text")))
    queries = {rule: trigram_query(pattern) for rule, pattern in rules.items()}
    indexed = {rule: q for rule, q in queries.items() if q is not True}
    if indexed:
        wanted = set().union(*map(trigrams, indexed.values()))
        index = stash(postings(docs, "__key", "__text", wanted), "postings")
        able = candidates(index, "__key", indexed).withColumnRenamed("__key", "__able")
        docs = docs.join(able, F.col("__key") == F.col("__able"), "left").drop("__able")
    else:
        docs = docs.withColumn("rules", F.lit(None).cast("array<string>"))
    only = {rule: F.coalesce(F.array_contains("rules", rule), F.lit(False)) for rule in indexed}
    found = with_matches(docs, "__text", rules, only)

    def kept(rule: str) -> Column:
        spans = F.filter(F.col(rule), lambda s: confirmed(rule, s["text"]))
        return F.when(F.size(rule) > 0, spans).otherwise(no_spans())

    return back(found.withColumns({rule: kept(rule) for rule in rules}), list(rules))


def digest_columns(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Counts per base rule, and digests of the spans."""
    return found.select(
        id_col,
        *[F.size(k).cast("long").alias(f"n_{k}") for k in BASE],
        F.sha2(listed(BASE, by_start=True), 256).alias("base_sha256"),
        listed(list(RULES), by_start=True).alias("spans"),
    )


def oracle() -> str:
    """The query in SQL: every rule searched in every text, the base ones without minimum lengths."""
    # letters of either case, ASCII alone: case folding would add others that look like them
    either = re.sub("[a-z]", lambda m: f"[{m[0]}{m[0].upper()}]", _KEYWORD)
    plain = RULES | {
        "assign": rf"""(?:{either})["'']?\x20*[:=]\x20*["'']?{_VALUE}+""",
        "access": "AKIA[A-Z0-9]+",
        "hex": "[0-9a-f]+",
    }
    head = "^" + plain["assign"][: -len(_VALUE) - 1]
    valid = {"assign": f"length(regexp_replace(s.t, '{head}', '')) >= {LEAST_VALUE}", "access": "length(s.t) >= 20", "hex": "length(s.t) >= 24"}
    matches = ", ".join(f"regexp_extract_all(t, '{p}', 0) AS m_{k}, string_split_regex(t, '{p}') AS g_{k}" for k, p in plain.items())
    # running sums by window: the shortest rule matches every few letters
    parts = " UNION ALL ".join(
        f"SELECT doc_id, n, '{k}' AS k, {i} AS o, unnest(m_{k}) AS t, unnest(g_{k}[1:len(m_{k})]) AS g, unnest(range(len(m_{k}))) AS i FROM m WHERE len(m_{k}) > 0"
        for i, k in enumerate(plain)
    )
    keep = " AND ".join(f"(k <> '{k}' OR {v})" for k, v in valid.items())
    base = ", ".join(f"'{k}'" for k in BASE)
    counts = ", ".join(f"CAST(count(k) FILTER (k = '{k}') AS BIGINT) AS n_{k}" for k in BASE)
    text = "string_agg(k || ':' || a || ':' || (a + length(z.t)), ',' ORDER BY a, o)"
    return f"""
WITH d AS (SELECT row_number() OVER () AS n, doc_id, coalesce(text, '') AS t FROM documents),
m AS (SELECT n, doc_id, {matches} FROM d),
x AS ({parts}),
y AS (SELECT n, k, o, t, CAST(sum(length(g) + length(t)) OVER (PARTITION BY n, k ORDER BY i) - length(t) AS BIGINT) AS a FROM x),
z AS (SELECT n, k, o, t, a FROM y AS s WHERE {keep})
SELECT d.doc_id, {counts}, sha256(coalesce({text} FILTER (k IN ({base})), '')) AS base_sha256, coalesce({text}, '') AS spans
FROM d LEFT JOIN z ON d.n = z.n GROUP BY d.n, d.doc_id"""

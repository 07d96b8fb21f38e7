"""Personal data: patterns propose spans, checksums confirm them, context words adjust the score. Native expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from socklens.llm.spans import listed, with_matches

# Possessive quantifiers and the look-behinds give the matches of the plain
# patterns (``PLAIN``) in one pass over the text: they only rule out retries
# that cannot succeed, and repetition of groups never recurses. ``\G`` is the
# end of the match before, where a match may begin inside a run.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9]++(?:[\x20-][0-9]++)*+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": r"\b[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?\b",
    "ssn": r"\b[0-9]{3}-[0-9]{2}-[0-9]{4}\b",
}
PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": PATTERNS["iban"],
    "ssn": PATTERNS["ssn"],
}
BASE = ["email", "ip", "card", "phone"]
KINDS = list(PATTERNS)
BYTE = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]?[0-9])"

# Score of a confirmed span of a kind in percent, what a context word within
# ``CONTEXT`` code points before it adds, and the words (lower case).
SCORES = {"email": 80, "ip": 60, "card": 70, "phone": 60, "iban": 85, "ssn": 40}
BONUS = 20
CONTEXT = 40
WORDS = {
    "email": r"mail|contact|correo|courriel",
    "ip": r"\bip\b|address|host|server|adresse",
    "card": r"card|visa|credit|carte|karte|tarjeta",
    "phone": r"phone|tel|call|mobile|fax|anruf",
    "iban": r"iban|account|bank|konto|compte|cuenta",
    "ssn": r"ssn|social|security",
}
REPORT = 50


def digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether a text of digits passes the Luhn check."""

    def step(total: Column, i: Column) -> Column:
        digit = F.substring(number, F.length(number) - i, F.lit(1)).cast("int")
        doubled = F.when(digit > 4, digit * 2 - 9).otherwise(digit * 2)
        return total + F.when(i % 2 == 1, doubled).otherwise(digit)

    places = F.sequence(F.lit(0), F.length(number) - 1)
    return F.aggregate(places, F.lit(0), step) % 10 == 0


def mod97(text: Column) -> Column:
    """Whether an account number (letters count 10 to 35, first four characters last) leaves 1 modulo 97."""
    plain = F.regexp_replace(text, r"\x20", "")
    turned = F.concat(F.substring(plain, F.lit(5), F.length(plain)), F.substring(plain, 1, 4))

    def step(rest: Column, i: Column) -> Column:
        code = F.ascii(F.substring(turned, i, F.lit(1)))
        return F.when(code < 58, rest * 10 + code - 48).otherwise(rest * 100 + code - 55) % 97

    return F.aggregate(F.sequence(F.lit(1), F.length(turned)), F.lit(0), step) == 1


def confirmed(kind: str, text: Column) -> Column:
    """Whether a proposed text of a kind holds."""
    n = F.length(digits(text))
    return {
        "email": F.lit(True),
        "ip": text.rlike(rf"^{BYTE}(?:\.{BYTE}){{3}}$"),
        "card": F.when(n.between(16, 19), luhn(digits(text))).otherwise(F.lit(False)),
        "phone": n.between(8, 15),
        "iban": mod97(text),
        "ssn": ~text.rlike(r"^(?:000|666|9..)-|-00-|-0000$"),
    }[kind]


def find_pii(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add one column per kind: array of (start, end, text, score), by start.

    Places are code points, end exclusive. ``score`` is in percent: what the
    pattern and checksum of the kind are worth, more if a context word stands
    close before. Kinds of ``BASE`` are always reported, the others from
    ``REPORT`` percent on. A null or empty text has no spans; rows stay as
    they are (repeated rows give repeated results, no rows give none), and
    columns of ``docs`` named like a kind are replaced. One narrow pass.
    """
    docs = docs.drop(*[c for c in docs.columns if c.lower() in KINDS or c == "__text"])
    found = with_matches(docs.withColumn("__text", F.coalesce(F.col(text), F.lit("")).cast("string")), "__text", PATTERNS)

    def scored(kind: str) -> Column:
        def score(s: Column) -> Column:
            first = F.greatest(s["start"] - CONTEXT, F.lit(0))
            before = F.lower(F.substring(F.col("__text"), first + 1, s["start"] - first))
            value = F.lit(SCORES[kind]) + F.when(before.rlike(WORDS[kind]), BONUS).otherwise(0)
            return F.struct(s["start"].alias("start"), s["end"].alias("end"), s["text"].alias("text"), value.alias("score"))

        spans = F.transform(F.filter(F.col(kind), lambda s: confirmed(kind, s["text"])), score)
        return spans if kind in BASE else F.filter(spans, lambda s: s["score"] >= REPORT)

    return found.withColumns({kind: scored(kind) for kind in KINDS}).drop("__text")


def digest_columns(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Counts per kind of ``BASE``, digests of the spans, and the spans with their scores."""

    def scores(kind: str) -> Column:
        return F.transform(F.col(kind), lambda s: F.concat_ws(":", F.lit(kind), s["start"], s["end"], s["score"]))

    return found.select(
        id_col,
        *[F.size(k).cast("long").alias(f"n_{k}") for k in BASE],
        F.sha2(listed(BASE, by_start=False), 256).alias("base_sha256"),
        listed(KINDS, by_start=False).alias("spans"),
        F.array_join(F.concat(*map(scores, KINDS)), ",").alias("scores"),
    )


def _sql_valid(kind: str) -> str:
    digits = "regexp_replace(w.tx, '[^0-9]', '', 'g')"
    luhn = (
        f"(list_sum([CASE WHEN i % 2 = 1 THEN d WHEN d > 4 THEN d * 2 - 9 ELSE d * 2 END FOR d, i IN "
        f"[CAST(c AS INT) FOR c IN string_split(reverse({digits}), '')]]) % 10 = 0)"
    )
    plain = r"regexp_replace(w.tx, ' ', '', 'g')"
    turned = f"(substring({plain}, 5) || substring({plain}, 1, 4))"
    number = f"list_reduce([CASE WHEN ascii(c) < 58 THEN ascii(c) - 48 ELSE ascii(c) - 55 END FOR c IN string_split({turned}, '')], LAMBDA a, b: (a * (CASE WHEN b < 10 THEN 10 ELSE 100 END) + b) % 97, 0)"
    return {
        "email": "TRUE",
        "ip": "len([p FOR p IN string_split(w.tx, '.') IF try_cast(p AS HUGEINT) <= 255]) = 4",
        "card": f"CASE WHEN length({digits}) BETWEEN 16 AND 19 THEN {luhn} ELSE FALSE END",
        "phone": f"length({digits}) BETWEEN 8 AND 15",
        "iban": f"({number}) = 1",
        "ssn": r"NOT regexp_matches(w.tx, '^(000|666|9..)-|-00-|-0000$')",
    }[kind]


def oracle() -> str:
    """The query in SQL, from the plain patterns."""
    matches = ", ".join(
        f"regexp_extract_all(t, '{PLAIN[k]}', 0) AS m_{k}, string_split_regex(t, '{PLAIN[k].replace('([', '(?:[').replace('(' + chr(92) + '.', '(?:' + chr(92) + '.')}') AS g_{k}"
        for k in KINDS
    )
    placed = ", ".join(
        f"""[{{'at': CAST(list_sum([length(x) FOR x IN g_{k}[1:i]]) + coalesce(list_sum([length(x) FOR x IN m_{k}[1:i - 1]]), 0) AS BIGINT), 'tx': w}} FOR w, i IN m_{k}] AS p_{k}"""
        for k in KINDS
    )
    kept = ", ".join(
        f"""[{{'at': w.at, 'e': w.at + length(w.tx), 'v': {SCORES[k]} + CASE WHEN regexp_matches(lower(substring(t, greatest(w.at - {CONTEXT}, 0) + 1, w.at - greatest(w.at - {CONTEXT}, 0))), '{WORDS[k]}') THEN {BONUS} ELSE 0 END}} FOR w IN p_{k} IF {_sql_valid(k)}] AS a_{k}"""
        for k in KINDS
    )
    reported = ", ".join(f"a_{k} AS k_{k}" if k in BASE else f"[x FOR x IN a_{k} IF x.v >= {REPORT}] AS k_{k}" for k in KINDS)

    def text(kinds: list[str], score: bool = False) -> str:
        each = [f"['{k}:' || x.at || ':' || x.e{' || chr(58) || x.v' if score else ''} FOR x IN k_{k}]" for k in kinds]
        every = each[0]
        for e in each[1:]:
            every = f"list_concat({every}, {e})"
        return f"array_to_string({every}, ',')"

    counts = ", ".join(f"CAST(len(k_{k}) AS BIGINT) AS n_{k}" for k in BASE)
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
m AS (SELECT doc_id, t, {matches} FROM d),
p AS (SELECT doc_id, t, {placed} FROM m),
k AS (SELECT doc_id, {kept} FROM p),
r AS (SELECT doc_id, {reported} FROM k)
SELECT doc_id, {counts}, sha256({text(BASE)}) AS base_sha256, {text(KINDS)} AS spans, {text(KINDS, True)} AS scores FROM r"""

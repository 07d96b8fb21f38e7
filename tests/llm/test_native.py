"""Exact dedup, secret scans and PII against plain Python, on awkward rows."""

import hashlib
import re

from pyspark.sql import functions as F

from socklens.llm import exact_dedup, pii, secret_scan, trigrams
from socklens.llm.shared import components
from tests.llm.conftest import SCHEMA, awkward, prose


def test_chunks_give_the_text_and_follow_its_content(spark, docs):
    rows = docs.select("text", exact_dedup.chunks(F.coalesce("text", F.lit(""))).alias("c")).collect()
    assert all("".join(r.c) == (r.text or "") for r in rows)
    shared = prose(3, 2000)
    two = spark.createDataFrame([("x" * 700 + ". " + shared,), (shared,)], "text string")
    cut = [set(r.c) for r in two.select(exact_dedup.chunks(F.col("text")).alias("c")).collect()]
    assert len(cut[0] & cut[1]) > len(cut[1]) * 0.7


def test_exact_dedup_matches_plain_groups(docs, no_docs):
    clash = docs.withColumn("kept", F.lit("mine")).withColumn("keep_id", F.lit(1.5))
    got = sorted((str(r.doc_id), str(r.keep_id), r.group_size, r.kept) for r in exact_dedup.exact_dedup(clash).collect())
    groups = {}
    for i, t, *_ in awkward():
        groups.setdefault(t or "", []).append(i)
    keep = {t: max((i for i in ids if i is not None), default=None) for t, ids in groups.items()}
    want = sorted((str(i), str(keep[t or ""]), len(groups[t or ""]), i == keep[t or ""]) for i, t, *_ in awkward())
    assert got == want
    assert exact_dedup.exact_dedup(no_docs).count() == 0


def test_colliding_identifiers_fall_back_to_contents(docs, monkeypatch):
    kept = exact_dedup.chunk_dictionary
    monkeypatch.setattr(exact_dedup, "chunk_dictionary", lambda *a: kept(*a).withColumn("same", F.lit(False)))
    got = {(r.doc_id, r.keep_id, r.group_size) for r in exact_dedup.exact_dedup(docs).collect()}
    monkeypatch.undo()
    assert got == {(r.doc_id, r.keep_id, r.group_size) for r in exact_dedup.exact_dedup(docs).collect()}


SECRETS = [
    'password = "hunter22x" and Token: abc', "secret: token:abcdefgh", "API_KEY='x/y+z=12' apikey=abcdef passwd=12345",
    "AKIA" + "B" * 16 + " AKIA" + "C" * 15, "AKIAB AKIA" + "Z" * 30, "0123456789abcdef01234567 0123456789abcdef0123456",
    "é🙂 token=ééé token==abcdefg", "ghp_" + "a1" * 18, "-----BEGIN RSA PRIVATE KEY----- x", "eyJ" + "a" * 9 + ".eyJ" + "b" * 9 + ".sig", "PASSWORD=password=password=x",
    "xoxb-1234567890ab AIza" + "k" * 35 + " sk_live_" + "9" * 16, None, "", "tok oke ken api key",
]


def plain_secrets(text):
    rules = secret_scan.RULES | {"access": "AKIA[A-Z0-9]+", "hex": "[0-9a-f]+"}
    rules["assign"] = r"""(?ai:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
    least = {"assign": lambda m: len(m[1]) >= 6, "access": lambda m: len(m[0]) >= 20, "hex": lambda m: len(m[0]) >= 24}
    return {k: [m.span() for m in re.finditer(p, text or "") if least.get(k, lambda m: True)(m)] for k, p in rules.items()}


def test_secrets_match_plain_search(spark, no_docs):
    rows = [(i, t) for i, t in enumerate([*SECRETS, *SECRETS[:2], SECRETS[0] * 400])]
    found = secret_scan.find_secrets(spark.createDataFrame(rows, "doc_id long, text string").withColumn("hex", F.lit("mine")))
    got = {r.doc_id: {k: [(s.start, s.end) for s in r[k]] for k in secret_scan.RULES} for r in found.collect()}
    assert got == {i: plain_secrets(t) for i, t in rows}
    digest = {r.doc_id: r for r in secret_scan.digest_columns(found).collect()}
    for i, t in rows:
        spans = sorted((s[0], n, f"{k}:{s[0]}:{s[1]}") for n, k in enumerate(secret_scan.BASE) for s in plain_secrets(t)[k])
        assert digest[i].base_sha256 == hashlib.sha256(",".join(s[2] for s in spans).encode()).hexdigest()
    assert secret_scan.find_secrets(no_docs).count() == 0


def test_trigram_queries_hold_for_every_match():
    def holds(query, text):
        if query is True:
            return True
        if isinstance(query, str):
            return query in text
        return (all if query[0] == "and" else any)(holds(q, text) for q in query[1:])

    queries = {k: trigrams.trigram_query(p) for k, p in secret_scan.RULES.items()}
    assert queries["hex"] is True and all(q is not True for k, q in queries.items() if k != "hex")
    for text in filter(None, SECRETS):
        for rule, spans in plain_secrets(text).items():
            assert not spans or holds(queries[rule], text.lower()), (rule, text)


PII = [
    "mail me: a.b+c@d-e.co.uk_x@y.z, call +49 (30) 1234-567.", "1.2.3.4.5.6.7.8 and 256.1.1.1 0255.00.1.2", "card 4111 1111 1111 1111 and 4111-1111-1111-1112",
    "é🙂 4111111111111111 " + "7" * 40, "IBAN DE89 3704 0044 0532 0130 00 DE89370400440532013001", "ssn 078-05-1120, 666-05-1120, 078-05-1120", "a@b a@b.c@d.e", "+1-2 +123456789012345 +1234567890123456",
    "x@" * 200 + "y.z", "1 2 3 " * 500, None, "", "a" * 2000 + "@b.c",
]


def plain_pii(text):
    def luhn(digits):
        total = 0
        for k, d in enumerate(map(int, reversed(digits))):
            total += d if k % 2 == 0 else d * 2 - 9 * (d > 4)
        return total % 10 == 0

    def good(kind, s):
        digits = re.sub("[^0-9]", "", s)
        if kind == "iban":
            s = s.replace(" ", "")
            return int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1
        return {
            "email": True, "ip": all(int(p) <= 255 for p in s.split(".") if p.isdigit()), "card": 16 <= len(digits) <= 19 and luhn(digits),
            "phone": 8 <= len(digits) <= 15, "ssn": not re.search("^(000|666|9..)-|-00-|-0000$", s),
        }[kind]

    out = {}
    for kind, pattern in pii.PLAIN.items():
        out[kind] = []
        for m in re.finditer(pattern, text or ""):
            if good(kind, m[0]):
                before = text[max(0, m.start() - pii.CONTEXT) : m.start()].lower()
                score = pii.SCORES[kind] + (pii.BONUS if re.search(pii.WORDS[kind], before) else 0)
                if kind in pii.BASE or score >= pii.REPORT:
                    out[kind].append((m.start(), m.end(), score))
    return out


def test_pii_matches_plain_search(spark, no_docs):
    rows = list(enumerate([*PII, PII[0] * 300, PII[2]]))
    found = pii.find_pii(spark.createDataFrame(rows, "doc_id long, text string").withColumn("card", F.lit("mine")))
    got = {r.doc_id: {k: [(s.start, s.end, s.score) for s in r[k]] for k in pii.KINDS} for r in found.collect()}
    for i, t in rows:
        assert got[i] == plain_pii(t), t
    assert got[0]["phone"] and got[2]["card"] and got[4]["iban"] and got[5]["ssn"]
    assert pii.find_pii(no_docs).count() == 0


def test_components_of_long_paths_stars_and_cycles(spark):
    path = [(i, i + 1) for i in range(100, 140)]
    star = [(500, i) for i in range(501, 560)]
    edges = [*path, *star, (900, 901), (901, 902), (902, 900), (7, 7), (901, 900)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {got[i] for i in range(101, 141)} == {100} and {got[i] for i in range(501, 560)} == {500} and got[901] == got[902] == 900
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
    assert SCHEMA.names[0] == "doc_id"

"""Periodic runs against all stretches of small texts."""

import hashlib
import random
import re
from fractions import Fraction
from zlib import crc32

import numpy as np
import pytest
from pyspark.sql import functions as F

from socklens.llm import queries, runs
from socklens.llm.shared import prepare
from tests.llm.conftest import SCHEMA, awkward, prose


def smallest_period(words):
    return next(q for q in range(1, len(words) + 1) if words[q:] == words[: len(words) - q])


def plain_runs(words):
    """(start, length, period) of every maximal stretch of one lag whose smallest period is that lag."""
    found = set()
    for q in range(1, len(words) // 4 + 1):
        i = 0
        while i + q < len(words):
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            length = j + q - i
            if length >= max(6, 4 * q) and smallest_period(words[i : i + length]) == q:
                found.add((i, length, q))
            i = j
    return sorted(found, key=lambda r: (r[0], r[2]))


def plain(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n = len(words)
    h = crc32(str(doc_id).encode()) if doc_id is not None else 1
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
    found = plain_runs(words)
    out = {i for s, length, q in found for i in range(s + q, s + length)}
    best = max(found, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=(None, None, None))
    lines = "".join(f"{s},{length},{q}\n" for s, length, q in found)
    kept = " ".join(w for i, w in enumerate(words) if i not in out)
    milli = 1000 * best[1] // best[2] if found else None
    return (doc_id, len(found), *best, milli, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(kept.encode()).hexdigest())


@pytest.mark.parametrize("seed", range(6))
def test_runs_of_random_words(seed):
    rng = random.Random(seed)
    texts = []
    for _ in range(300):
        words = [rng.randrange(1 + seed % 3 + 1) for _ in range(rng.randrange(60))]
        for _ in range(rng.randrange(4)):  # repeat a stretch
            a = rng.randrange(len(words) + 1)
            part = [rng.randrange(2 + seed) for _ in range(rng.randrange(1, 12))]
            words[a:a] = (part * 7)[: len(part) * rng.randrange(2, 7) + rng.randrange(len(part))]
        texts.append(words)
    first = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    got = runs.find_runs(np.array([w for t in texts for w in t], np.int64), first)
    want = [(i, *r) for i, t in enumerate(texts) for r in plain_runs(t)]
    assert [tuple(r) for r in got.tolist()] == want


def test_long_and_hostile_texts_stay_linear():
    one = runs.find_runs(np.zeros(200_000, np.int64), np.array([0, 200_000]))
    assert one.tolist() == [[0, 0, 200_000, 1]]
    period = np.random.default_rng(1).integers(0, 3, 20_011)
    got = runs.find_runs(np.tile(period, 9), np.array([0, 9 * 20_011]))
    assert [0, 0, 9 * 20_011, 20_011] in got.tolist()


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=str)


def damaged_ids(n):
    return [i for i in range(10_000) if crc32(str(i).encode()) % 10 == 0][:n]


def test_query_equals_plain_version(spark, no_docs):
    rows = [(i, t) for i, t, *_ in awkward() if t is None or len(t) < 50_000]
    rows += [(i, prose(i, 5 + i % 90)) for i in damaged_ids(40)]
    rows += [(20_000 + i, " ".join(("a b\tc " * (i % 9)).split() + ["x"] * (i % 13) + ["é", "é"] * (i % 5))) for i in range(60)]
    df = prepare(spark).createDataFrame(rows, "doc_id long, text string")
    got = runs.digests(runs.periodic_runs(df, damaged=True))
    assert rows_of(got) == sorted((plain(*r) for r in rows), key=str)
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert runs.digests(runs.periodic_runs(no_docs, damaged=True)).collect() == []


def test_real_outputs_and_clashing_columns(spark, docs):
    clash = docs.withColumns({"Runs": F.lit(1), "_whole": F.lit("w"), "_Number": F.lit("n"), "collapsed": F.lit(None).cast("int")})
    found = runs.periodic_runs(clash)
    assert found.columns == [*docs.columns, "_whole", "_Number", "runs", "collapsed"]
    assert found.count() == len(awkward())
    line = spark.createDataFrame([(1, "go on  on\non on on on now")], "doc_id long, text string")
    row = runs.periodic_runs(line).first()
    assert [tuple(r) for r in row.runs] == [(1, 6, 1)] and row.collapsed == "go on now"


def test_whole_table_of_given_documents(spark):
    sf_dir = "/root/testdata/sf0.001"
    docs = spark.read.schema(SCHEMA).parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    want = sorted((plain(r.doc_id, r.text) for r in docs), key=str)
    assert rows_of(queries.QUERIES["op12_periodic_runs"](spark, sf_dir)) == want
    assert sum(r[1] > 0 for r in want) > 5

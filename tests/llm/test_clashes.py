"""Operators keep columns whose names clash with their own, in whatever case."""

from pyspark.sql import functions as F

from socklens.llm import exact_dedup, near_dedup, pii, quality, secret_scan
from socklens.llm.shared import apart
from tests.llm.conftest import awkward


def clashing(docs, *names):
    return docs.withColumns({n: F.lit(f"own {n}") for n in names})


def kept(out, names):
    assert len(rows := out.collect()) == len(awkward())
    assert all(r[n] == f"own {n}" for r in rows for n in names)


def test_names_come_back_in_their_order(docs):
    inner, back = apart(clashing(docs, "x", "Y"), "doc_id", "text")
    assert inner.columns[:2] == ["doc_id", "text"] and not {"x", "Y", "lang"} & set(inner.columns)
    out = back(inner.withColumns({"y": F.lit(1), "lang": F.lit(2)}), ["y", "lang"])
    assert out.columns == ["doc_id", "text", "source", "n_chars", "x", "y", "lang"]


def test_exact_dedup(docs):
    names = ["__same", "__recipe", "Recipe", "chunk_id"]
    kept(exact_dedup.exact_dedup(clashing(docs, *names)), names)


def test_near_duplicates(docs):
    names = ["__same", "__first", "__id", "__NODE", "node", "part"]
    kept(near_dedup.near_duplicates(clashing(docs, *names)), names)


def test_secret_scan_and_pii(docs):
    names = ["Rules", "__KEY", "__able", "__text2"]
    kept(secret_scan.find_secrets(clashing(docs, *names)), names)
    kept(secret_scan.find_secrets(clashing(docs, "rules")), ["rules"])
    kept(pii.find_pii(clashing(docs, *names)), names)


def test_quality(docs):
    names = ["__text", "good", "h", "known"]
    kept(quality.classify(clashing(docs, *names), quality.QualityModel(0.5)), names)

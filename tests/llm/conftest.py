import pytest
from pyspark.sql import types as T

from socklens.llm.shared import prepare

SCHEMA = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
    ]
)
# clean prose of many different words
WORDS = [a + b + c for a in "bdfglmnprst" for b in ("a", "en", "ior", "u") for c in ("ka", "sel", "to", "m", "vi")]


def prose(seed: int, n: int) -> str:
    state, out = seed * 2654435761 % 2**32 + 1, []
    for i in range(n):
        state = (state * 1664525 + 1013904223) % 2**32
        out.append(WORDS[(state >> 8) % len(WORDS)] + ("." if i % 9 == 8 else ""))
    return " ".join(out)


def awkward() -> list[tuple]:
    """Nulls in every column, empty and long texts, ties, repeated rows."""
    long = prose(7, 30_000)
    a, b = prose(1, 120), prose(2, 90)
    return [
        (1, a, "en", "s0", 10), (2, b, "en", "s1", 10), (3, None, "en", "s0", 0), (4, "", None, None, 0), (5, a, "fr", "s0", 10),
        (None, b, "en", "s1", 10), (None, None, None, None, None), (8, long, "en", "s2", 1), (9, long, "en", "s2", 1),
        (10, a, "en", "s0", 10), (10, a, "en", "s0", 10), (11, " \n\t ", "de", "s3", 4), (12, "Żółć 日本語 🙂  x", "xx", "s3", 9),
        (13, "a" * 3000, "en", "s0", 3000), (14, "one two", "en", "s0", 7),
    ]


@pytest.fixture
def docs(spark):
    return prepare(spark).createDataFrame(awkward(), SCHEMA)


@pytest.fixture
def no_docs(spark):
    return prepare(spark).createDataFrame([], SCHEMA)

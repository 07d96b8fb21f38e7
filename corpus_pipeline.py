"""From raw documents to tokens: the stages of a training-data pipeline, one operator each.

Every stage takes (spark, docs, sf_dir), works on all rows that the stage before
it kept, and returns a DataFrame, which is written and read again before the
next one. All but the last return the columns of ``docs``; a column that an
operator adds under the same name is replaced. Null ids, texts, sources and
languages, empty and very long texts, repeated rows and empty tables are kept
or dropped as the operators' docstrings say.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from socklens.llm import byte_bpe, decontaminate, near_dedup, quality
from socklens.llm.exact_dedup import exact_dedup as with_copies
from socklens.llm.queries import bpe_digests
from socklens.llm.shared import prepare, stash

TOKENIZER = "byte_bpe_multi_50k.tiktoken"


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on the labelled ones, rejects go."""
    model = quality.train(docs, prepare(spark).read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.classify(docs, model).where("kept").select(docs.columns)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest id stays."""
    prepare(spark)
    return with_copies(docs).where("kept").select(docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates stays, the one with the smallest id."""
    prepare(spark)
    return near_dedup.near_duplicates(docs).where("kept").select(docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    benchmark = prepare(spark).read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontaminate.find_contamination(docs, benchmark).where(F.size("hits") == 0).select(docs.columns)


def byte_level_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every document and the bytes they decode to, as counts and digests by document id."""
    prepare(spark)
    path = public_tokenizers.path(TOKENIZER)
    return bpe_digests(byte_bpe.encode(docs.select("doc_id", "text"), path, decoded=True))


STAGES = [
    ("quality_classifier", quality_classifier),
    ("exact_dedup", exact_dedup),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("byte_level_bpe", byte_level_bpe),
]

# No SQL says what the classifier and the tokenizer give; tests hold the stages
# against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole table; each is written and read again."""
    docs = prepare(spark).read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stash(stage(spark, docs, sf_dir), name)
    return docs

"""One query per operator over its whole table, with production parameters, and SQL where it can say the same."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from socklens.llm import (
    byte_bpe,
    decontaminate,
    exact_dedup,
    language,
    mixing,
    near_dedup,
    pii,
    quality,
    repair,
    runs,
    secret_scan,
    token_count,
    token_files,
)
from socklens.llm.shared import new_folder, prepare, whole_text

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn

    return register


@query("op2_secret_scans", secret_scan.oracle())
def op2_secret_scans(spark, sf_dir):
    found = secret_scan.find_secrets(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return secret_scan.digest_columns(found)


@query(
    "op5_exact_dedup",
    """WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
    g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY t)
    SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AS kept, sha256(t) AS text_sha256 FROM d JOIN g USING (t)""",
)
def op5_exact_dedup(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.sha2(whole_text(), 256).alias("text_sha256"))
    decided = exact_dedup.exact_dedup(docs)
    return decided.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


@query("op10_pii", pii.oracle())
def op10_pii(spark, sf_dir):
    found = pii.find_pii(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return pii.digest_columns(found)


@query("op4_token_files")
def op4_token_files(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    folder = new_folder(spark, "token-files")
    token_files.write_token_files(docs, folder, public_tokenizers.path("byte_bpe_50k.json"), end_id=0)
    return token_files.with_crc32(token_files.read_token_files(spark, folder))


@query("op9_byte_bpe")
def op9_byte_bpe(spark, sf_dir):
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe_digests(byte_bpe.encode(docs, path, decoded=True))


def bpe_digests(decoded: DataFrame) -> DataFrame:
    return decoded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


@query("op3_token_counts")
def op3_token_counts(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return token_count.count_tokens(docs, public_tokenizers.path("piece_bpe_32k.model")).drop("text")


@query("op7_language_id")
def op7_language_id(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", held_out().alias("held_out"))
    model = language.train(docs.where(~F.col("held_out")))
    return language.predict(docs.select("doc_id", "held_out", "text"), model).drop("text")


def held_out():
    """One document in three, by the checksum of its id; a null id is not held out."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))


@query("op8_decontamination")
def op8_decontamination(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate.find_contamination(docs, table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        (F.size("hits") > 0).alias("contaminated"),
        F.array_sort(F.array_distinct("hits.item_id")).alias("item_ids"),
        F.array_max("hits.lcs").alias("best_lcs"),
    )


@query("op1_near_dedup")
def op1_near_dedup(spark, sf_dir):
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")


@query("op6_quality")
def op6_quality(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    return quality.classify(docs.select("doc_id", "text", "source", "lang"), model).drop("text", "source", "lang")


@query("op11_mixing", mixing.oracle())
def op11_mixing(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", mixing.word_count().alias("size"))
    return mixing.mix(docs).select("doc_id", "size", "source_size", "target", "taken")


@query("op12_periodic_runs")
def op12_periodic_runs(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return runs.digests(runs.periodic_runs(docs, damaged=True))


@query("op13_conversation_repair")
def op13_conversation_repair(spark, sf_dir):
    return repair.report(table(spark, sf_dir, "conversations"))

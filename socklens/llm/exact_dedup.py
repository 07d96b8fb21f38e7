"""Exact deduplication by content-defined chunk recipes, in native expressions.

A text is cut into chunks where its own content says so: at the first line end
or sentence end after ``MIN_CHUNK`` code points, or after ``MAX_CHUNK`` without
one. A cut depends on nothing before the chunk, so long shared passages give the
same chunks wherever they stand. Every chunk content gets an identifier (its
SHA-256); a dictionary with one row per identifier holds the content and proves
by comparing bytes that no identifier stands for two contents. A document then
is its recipe, the ordered list of its identifiers: recipes of some 30 bytes a
kilobyte are what is shuffled, grouped and joined, the texts themselves stay.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from socklens.llm.shared import apart, stash, whole_text

MIN_CHUNK = 512
MAX_CHUNK = 4096


def chunk_pattern(least: int = MIN_CHUNK, most: int = MAX_CHUNK) -> str:
    return rf"(?s).{{{least},{most - 1}}}?(?:\n|[.!?]\s)|.{{1,{most}}}"


def chunks(text: Column, least: int = MIN_CHUNK, most: int = MAX_CHUNK) -> Column:
    """The chunks of a text, in order; put together they give the text. An empty text has none."""
    return F.regexp_extract_all(text, F.lit(chunk_pattern(least, most)), F.lit(0))


def chunk_dictionary(docs: DataFrame, text: str = "text", least: int = MIN_CHUNK, most: int = MAX_CHUNK) -> DataFrame:
    """(chunk_id, uses, n_chars, same): one row per identifier over all documents.

    ``same`` tells whether all contents with this identifier are equal, byte by
    byte. Equal chunks of a task are combined before the shuffle, so a chunk
    that a third of all documents share arrives once per task.
    """
    chunk = docs.select(F.explode(chunks(whole_text(text), least, most)).alias("chunk"))
    return (
        chunk.groupBy(F.unhex(F.sha2("chunk", 256)).alias("chunk_id"))
        .agg(F.count(F.lit(1)).alias("uses"), F.min("chunk").alias("lo"), F.max("chunk").alias("hi"))
        .select("chunk_id", "uses", F.length("lo").alias("n_chars"), (F.col("lo") == F.col("hi")).alias("same"))
    )


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text: str = "text", least: int = MIN_CHUNK, most: int = MAX_CHUNK) -> DataFrame:
    """All rows of ``docs`` with ``keep_id``, ``group_size`` and ``kept``.

    Texts are equal when identical; of equal texts the row with the largest id
    stays. A null text counts as empty, and all empty texts are equal. A null id
    is smaller than any other; rows that share both the text and the largest id
    (repeated rows, or null ids alone) all stay, as nothing tells them apart.
    No rows give no rows.
    Columns of ``docs`` named like the added ones are replaced.

    Should two contents ever share an identifier, the chunk contents themselves
    serve as identifiers, so the result stays exact.
    """
    added = ("keep_id", "group_size", "kept")
    docs, back = apart(docs, id_col, text)
    verified = stash(chunk_dictionary(docs, text, least, most), "chunks")
    if verified.where(~F.col("same")).isEmpty():
        recipe = F.transform(chunks(whole_text(text), least, most), lambda c: F.unhex(F.sha2(c, 256)))
    else:
        recipe = F.transform(chunks(whole_text(text), least, most), lambda c: c.cast("binary"))
    named = docs.withColumn("__recipe", recipe)
    groups = named.groupBy("__recipe").agg(F.max(id_col).alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    groups = groups.withColumnRenamed("__recipe", "__same")
    out = named.join(groups, F.col("__recipe") == F.col("__same"), "left")
    return back(out.withColumn("kept", F.col(id_col).eqNullSafe(F.col("keep_id"))), added)

"""Mixing sources to target weights by systematic sampling.

Sources in the order of their code points, null last, weigh 5, 2, 1, 5, 2, 1, ...
and share ``SHARE`` times the words of all documents by weight. No source is to
give more than ``MOST`` times its own words; what it cannot give is shared by
weight among the others until no target is above that. The level of words per
weight at which that holds is found by Newton's steps on sums over all sources:
the sum of targets is concave and made of straight lines, so every step goes up
to the level or stops at it.

A document of a source with the target T and the size S is expected T / S times.
Documents of a source are put in order of their sizes and these expected copies
summed up; with one random offset per source, a document is taken once for each
whole number that the sum crosses. As neighbours in that order have like sizes,
the words taken from a source are off its target by less than its longest
document. Sums are whole numbers (copies in units of 2^-28), so reruns agree on any
cluster.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from socklens.llm.shared import stash, whole_text
from socklens.operators.numbering import number_rows
from socklens.settings import free_names

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST = 2
UNITS = 28  # bits behind the point of expected copies
SEED = "mix"
WORD = r"[^\x20\x09-\x0D]+"
ADDED = ("source_size", "target", "copies", "taken")


def word_count(text: str | Column = "text") -> Column:
    """Number of words of a text; a null text has none."""
    return F.regexp_count(whole_text(text), F.lit(WORD)).cast("long")


def _digest(seed: str, value: Column) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(value, F.lit(""))))


def offset(source: Column, seed: str = SEED) -> Column:
    """The random offset of a source, in units of expected copies."""
    digits = F.substring(_digest(seed, F.coalesce(source, F.lit("\0null"))), 1, UNITS // 4)
    return F.conv(digits, 16, 10).cast("long")


def source_targets(sized: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """(source, source_size, weight, target) of documents with ``source`` and ``size``: one row per source.

    Sources are ranked by ranges, and the level of the targets comes from one row
    of sums per step, so neither depends on how many sources there are.
    """
    if share > most:
        raise ValueError(f"sources that give {most} times their words at most cannot share {share} times all words")
    sums = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    ranked = number_rows(sums.withColumn("_null", F.col("source").isNull()), [], ["_null", "source"], "_rank", "sources", stash)
    weight = F.element_at(F.array(*[F.lit(int(w)) for w in weights]), ((F.col("_rank") - 1) % len(weights) + 1).cast("int"))
    ranked = ranked.select("source", "source_size", weight.alias("weight"), (F.lit(float(most)) * F.col("source_size")).alias("_most"))
    total = ranked.agg(F.sum("source_size")).first()[0] or 0
    level, held = 0.0, None
    while True:
        capped = F.col("_most") <= F.lit(level) * F.col("weight")
        row = ranked.agg(
            F.sum(F.when(capped, F.col("source_size"))).alias("full"), F.sum(F.when(~capped, F.col("weight"))).alias("weight"), F.count_if(capped).alias("n")
        ).first()
        if not row.weight or row.n == held:
            break
        level, held = (share * total - most * (row.full or 0)) / row.weight, row.n
    target = F.when(F.col("_most") <= F.lit(level) * F.col("weight"), F.col("_most")).otherwise(F.lit(level) * F.col("weight"))
    return ranked.select("source", "source_size", "weight", target.cast("double").alias("target"))


def mix(docs: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = SHARE, most: float = MOST, seed: str = SEED) -> DataFrame:
    """All rows of ``docs`` with ``source_size``, ``target``, ``copies`` and ``taken`` (copies times ``size``).

    ``docs`` has ``doc_id``, ``source`` and ``size`` (see :func:`word_count`; null
    counts as 0) and any other columns, which are moved along: leave out texts
    that are not wanted. Null sources are one source, the last. A source without
    words has the target 0 and is not taken. Documents of one source and size
    are ordered by a hash of their ids and then by those, so which of
    several equal rows is taken is of no consequence; of rows that share id, source
    and size but not the rest, any may be. Columns named like the added
    ones are replaced; no rows give none.
    """
    docs = docs.drop(*[c for c in docs.columns if c.lower() in ADDED])
    key, rank, by, rate, start = free_names([*docs.columns, *ADDED], "_key", "_rank", "_source", "_rate", "_offset")
    size = F.coalesce(F.col("size"), F.lit(0)).cast("long")
    sized = stash(docs.withColumns({"size": size, key: _digest(seed, F.col("doc_id").cast("string"))}), "sizes")
    targets = stash(source_targets(sized.select("source", "size"), weights, share, most), "targets")
    ordered = number_rows(sized, ["source"], ["size", key, "doc_id"], rank, "mixed", stash)
    unit = 1 << UNITS
    expected = F.when(F.col("source_size") > 0, F.round(F.col("target") / F.col("source_size") * unit)).otherwise(0).cast("long")
    rates = targets.select(F.col("source").alias(by), "source_size", "target", expected.alias(rate), offset(F.col("source"), seed).alias(start))

    def crossed(n: Column) -> Column:
        """Whole numbers crossed by the sum over the first ``n`` documents."""
        return F.shiftright(F.col(start) + n * F.col(rate), UNITS)

    copies = crossed(F.col(rank)) - crossed(F.col(rank) - 1)
    out = ordered.join(rates, F.col("source").eqNullSafe(F.col(by)))
    return out.withColumn("copies", copies).withColumn("taken", F.col("copies") * F.col("size")).select(*docs.columns, *ADDED)


def emit(mixed: DataFrame) -> DataFrame:
    """The mix itself: every row of :func:`mix` as often as it is taken, with ``copy`` from 1 on; ``copies`` is at most 2."""
    rows = mixed.drop(*[c for c in mixed.columns if c.lower() == "copy"])
    return rows.where("copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))


def oracle() -> str:
    """SQL for the query's rows, with the level of the targets in closed form."""
    digits = " + ".join(f"(instr('0123456789abcdef', substr(m, {i + 1}, 1)) - 1) * {16 ** (UNITS // 4 - 1 - i)}" for i in range(UNITS // 4))
    return f"""WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size FROM documents),
    s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
    w AS (SELECT source, source_size, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight FROM s),
    t AS (SELECT 1.5 * sum(source_size) AS total FROM w),
    c AS (SELECT a.source, a.source_size, a.weight,
        sum(least(2.0 * b.source_size, (2.0 * a.source_size / a.weight) * b.weight)) <= any_value(t.total) AS capped
        FROM w AS a CROSS JOIN w AS b CROSS JOIN t GROUP BY a.source, a.source_size, a.weight),
    l AS (SELECT (any_value(t.total) - 2 * coalesce(sum(source_size) FILTER (WHERE capped), 0)) / coalesce(sum(weight) FILTER (WHERE NOT capped), 1) AS level FROM c CROSS JOIN t),
    g AS (SELECT source, source_size, CASE WHEN capped THEN 2.0 * source_size ELSE CAST(level AS DOUBLE) * weight END AS target,
        md5(concat('{SEED}:', coalesce(source, chr(0) || 'null'))) AS m FROM c CROSS JOIN l),
    r AS (SELECT source, source_size, CAST(target AS DOUBLE) AS target, CAST({digits} AS BIGINT) AS off,
        CASE WHEN source_size > 0 THEN CAST(round(target / source_size * {1 << UNITS}) AS BIGINT) ELSE 0 END AS rate FROM g),
    n AS (SELECT doc_id, source, size, row_number() OVER (PARTITION BY source ORDER BY size, md5(concat('{SEED}:', CAST(doc_id AS VARCHAR))), doc_id) AS k FROM d)
    SELECT doc_id, size, source_size, target, CAST((((off + k * rate) >> {UNITS}) - ((off + (k - 1) * rate) >> {UNITS})) * size AS BIGINT) AS taken
    FROM n JOIN r ON n.source IS NOT DISTINCT FROM r.source"""

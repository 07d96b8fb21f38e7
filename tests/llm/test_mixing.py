"""Mixing against a plain version and the bounds it promises."""

import hashlib
import math
import re

import pytest
from pyspark.sql import functions as F

from socklens.llm import mixing
from socklens.llm.shared import prepare
from tests.llm.conftest import awkward, prose


def sized(df):
    return df.withColumn("size", mixing.word_count())


def md5(value):
    return hashlib.md5(f"{mixing.SEED}:{value}".encode()).hexdigest()


def plain(rows):
    """(doc_id, size, source_size, target, taken) of (doc_id, text, source) by the words of the contract."""
    rows = [(i, len(re.findall(r"[^\x20\x09-\x0D]+", t or "")), s) for i, t, s in rows]
    names = sorted({s for *_, s in rows}, key=lambda s: (s is None, (s or "").encode()))
    size = {n: sum(z for _, z, s in rows if s == n) for n in names}
    weight = {n: (5, 2, 1)[k % 3] for k, n in enumerate(names)}
    target, open_, left = {}, set(names), 1.5 * sum(size.values())
    while open_:
        level = left / sum(weight[n] for n in open_)
        over = {n for n in open_ if level * weight[n] >= 2 * size[n]}
        if not over:
            target |= {n: level * weight[n] for n in open_}
            break
        target |= {n: 2.0 * size[n] for n in over}
        open_, left = open_ - over, left - sum(2 * size[n] for n in over)
    out = []
    for n in names:
        mine = sorted(((z, md5("" if i is None else i), (i is not None, i or 0), i) for i, z, s in rows if s == n))
        start = int(md5("\0null" if n is None else n)[:7], 16)
        rate = math.floor(target[n] / size[n] * 2**28 + 0.5) if size[n] else 0
        for k, (z, _, _, i) in enumerate(mine, 1):
            out.append((i, z, size[n], target[n], (((start + k * rate) >> 28) - ((start + (k - 1) * rate) >> 28)) * z))
    return sorted(out, key=str)


def many(n=400):
    """Sources of very different sizes; one with a third of all rows, one with a huge text, one without words."""
    rows = []
    for i in range(n):
        source = "hot" if i % 3 == 0 else [f"s{i % 11}", "é", "zz", None, "tiny" if i < 8 else "s1"][i % 5]
        rows.append((i, prose(i, 4000 if i == 77 else 3 + i * 7 % 60), source))
    return rows + [(n, "", "void"), (n + 1, None, "void"), (n + 2, " \t ", "void")]


@pytest.mark.parametrize("rows", [[(i, t, s) for i, t, _, s, _ in awkward()], many()])
def test_equals_plain_version(spark, rows):
    df = prepare(spark).createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix(sized(df)).select("doc_id", "size", "source_size", "target", "taken").collect()
    got, want = sorted(map(tuple, got), key=str), plain(rows)
    assert [g[:3] + g[4:] for g in got] == [w[:3] + w[4:] for w in want]
    assert [g[3] for g in got] == pytest.approx([w[3] for w in want])


def test_sources_come_near_their_targets_and_nothing_is_taken_too_often(spark):
    df = sized(prepare(spark).createDataFrame(many(), "doc_id long, text string, source string"))
    rows = mixing.mix(df).collect()
    assert all(r.taken <= 2 * r.size and r.copies in (0, 1, 2) for r in rows)
    for source in {r.source for r in rows}:
        mine = [r for r in rows if r.source == source]
        assert abs(sum(r.taken for r in mine) - mine[0].target) <= max(r.size for r in mine)
        assert mine[0].target <= 2 * mine[0].source_size
    assert sum({r.source: r.target for r in rows}.values()) == pytest.approx(1.5 * sum(r.size for r in rows))
    again = mixing.mix(df.repartition(7, "text")).collect()
    assert sorted((r.doc_id, r.taken) for r in again) == sorted((r.doc_id, r.taken) for r in rows)


def test_rows_columns_and_copies(spark, docs, no_docs):
    clash = docs.withColumns({"Taken": F.lit("mine"), "_key": F.lit(1), "_Rank": F.lit("r"), "target": F.lit(None).cast("string"), "_rate": F.lit(2)})
    mixed = mixing.mix(sized(clash))
    assert mixed.columns == [*docs.columns, "_key", "_Rank", "_rate", "size", *mixing.ADDED]
    rows = mixed.collect()
    assert sorted(map(str, (r.doc_id for r in rows))) == sorted(str(r[0]) for r in awkward())
    assert {(r._key, r._Rank, r._rate) for r in rows} == {(1, "r", 2)}
    assert mixing.emit(mixed).count() == sum(r.copies for r in rows)
    assert mixing.mix(sized(no_docs)).collect() == []


def test_one_source_and_other_weights(spark):
    df = prepare(spark).createDataFrame([(i, prose(i, 10), s) for i, s in enumerate("aabb" * 20)], "doc_id long, text string, source string")
    one = mixing.mix(sized(df.where("source = 'a'"))).collect()
    assert one[0].target == 1.5 * 400 and sum(r.taken for r in one) == 600
    rows = mixing.mix(sized(df), weights=(3, 1), share=1.0).collect()
    assert {r.source: r.target for r in rows} == {"a": 600.0, "b": 200.0}
    with pytest.raises(ValueError, match="share"):
        mixing.mix(sized(df), share=3.0)


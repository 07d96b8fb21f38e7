"""Numbers of rows in groups against plain counting, with groups over many tasks."""

import random

import pytest
from pyspark.sql import functions as F

from socklens.operators.numbering import number_rows
from socklens.settings import free_names


@pytest.fixture
def pieces(spark, tmp_path):
    """Small batches, no merging of small partitions: groups reach over tasks and batches."""
    changed = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.execution.arrow.maxRecordsPerBatch": "7"}
    before = {k: spark.conf.get(k) for k in changed}
    for k, v in changed.items():
        spark.conf.set(k, v)
    made = []

    def cut(df, label):
        path = str(tmp_path / f"{label}{len(made)}")
        made.append(path)
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path)

    yield cut
    for k, v in before.items():
        spark.conf.set(k, v)


@pytest.mark.parametrize("order", [["o", "id"], ["id"], ["t", "id"]])
def test_numbers_equal_counting(spark, pieces, order):
    rng = random.Random(3)
    rows = [(None if i % 3 == 0 else f"g{rng.randrange(5)}", rng.choice([None, 1, 2, 3]), rng.choice([None, "x", "y"]), i) for i in range(600)]
    df = spark.createDataFrame(rows, "g string, o int, t string, id long").repartition(5)
    got = {r.id: r._position for r in number_rows(df, ["g"], order, cut=pieces).collect()}
    at = {"o": 1, "t": 2, "id": 3}
    seen, want = {}, {}
    for row in sorted(rows, key=lambda r: [(r[at[o]] is not None, r[at[o]] or type(r[at[o]] or 0)()) if r[at[o]] is not None else (False,) for o in order]):
        seen[row[0]] = seen.get(row[0], 0) + 1
        want[row[3]] = seen[row[0]]
    assert got == want


def test_equal_rows_of_one_group_are_spread(spark, pieces):
    df = spark.range(400).select(F.lit("h").alias("g"), F.lit(1).alias("o"))
    written = []
    got = number_rows(df, ["g"], ["o"], cut=lambda d, label: written.append(pieces(d, label)) or written[0])
    assert sorted(r._position for r in got.collect()) == list(range(1, 401))
    sizes = [r["count"] for r in written[0].groupBy("_piece").count().collect()]
    assert len(sizes) == 4 and max(sizes) < 250


def test_no_rows_no_group_and_clashing_names(spark, pieces):
    df = spark.range(20).selectExpr("id", "id AS _Piece", "id AS _position", "0 AS _nth")
    assert sorted(r._position for r in number_rows(df, [], ["id"], cut=pieces).collect()) == list(range(1, 21))
    assert number_rows(df.where("id < 0"), ["id"], ["id"], cut=pieces).count() == 0
    assert free_names(["A", "_b"], "a", "_B", "c") == ["_a", "__B", "c"]

"""Packed record files against records packed by the standard library."""

import struct

from pyspark.sql import functions as F

from socklens import decode_records, encode_records
from socklens.operators.decode import record_layout
from socklens.sources.packed import read_packed, write_packed

FIELDS = ["RTT", "DPort", "PID", "BytesSent"]


def _pack(i):
    """u32 RTT, u16 DPort in network order, u32 PID, u64 BytesSent: each at its own alignment."""
    return struct.pack("<I", i) + struct.pack(">H", 1000 + i % 7) + bytes(2) + struct.pack("<I", i * 3) + bytes(4) + struct.pack("<Q", 2**63 + i)


def _rows(df):
    return sorted((r.RTT, r.DPort, r.PID, int(r.BytesSent)) for r in decode_records(df, FIELDS, wide=True).collect())


def _want(ids):
    return [(i, 1000 + i % 7, i * 3, 2**63 + i) for i in ids]


def test_files_are_cut_at_record_borders(spark, tmp_path):
    assert record_layout(FIELDS, 4)[1] == len(_pack(0)) == 24
    (tmp_path / "in" / "more").mkdir(parents=True)
    (tmp_path / "in" / "a").write_bytes(b"".join(map(_pack, range(1000))))
    (tmp_path / "in" / "more" / "b").write_bytes(b"".join(map(_pack, range(1000, 1003))) + b"cut")
    (tmp_path / "in" / "_hidden").write_bytes(b"x" * 100)
    df = read_packed(spark, str(tmp_path / "in"), FIELDS, split_bytes=1000)
    assert df.rdd.getNumPartitions() > 20
    assert [r.position for r in df.where("file LIKE '%/a'").orderBy("position").collect()] == list(range(1000))
    short = df.where("length(record) < 24").collect()
    assert [(bytes(r.record), r.position) for r in short] == [(b"cut", 3)]
    assert _rows(df.where("length(record) = 24")) == _want(range(1003))
    (tmp_path / "none").mkdir()
    assert read_packed(spark, str(tmp_path / "none"), FIELDS).count() == 0


def test_stream_follows_growing_files(spark, tmp_path):
    folder, out = tmp_path / "in", str(tmp_path / "out")
    folder.mkdir()

    def drain():
        df = decode_records(read_packed(spark, str(folder), FIELDS, stream=True), FIELDS, wide=True)
        writer = df.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "c"))
        writer.trigger(availableNow=True).start().awaitTermination()

    whole = b"".join(map(_pack, range(50)))
    (folder / "a").write_bytes(whole[: 24 * 20 + 5])
    drain()
    assert spark.read.parquet(out).count() == 20
    (folder / "a").write_bytes(whole)
    (folder / "b").write_bytes(_pack(50))
    drain()
    got = sorted((r.RTT, r.DPort, r.PID, int(r.BytesSent)) for r in spark.read.parquet(out).collect())
    assert got == _want(range(51))


def test_written_records_are_read_back(spark, tmp_path):
    rows = spark.range(300).select(F.col("id").alias("RTT"), F.lit(80).alias("DPort"), (F.col("id") * 3).alias("PID"), F.col("id").alias("BytesSent"))
    packed = encode_records(rows, FIELDS).repartition(3)
    assert write_packed(packed.unionByName(spark.sql("SELECT CAST(NULL AS BINARY) AS record")), str(tmp_path / "out")) == 300
    got = decode_records(read_packed(spark, str(tmp_path / "out"), FIELDS), FIELDS)
    assert sorted(r.PID for r in got.collect()) == [i * 3 for i in range(300)]

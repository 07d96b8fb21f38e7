"""Captured socket records: one packed BINARY record per tracepoint hit."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, types as T

RECORD_SCHEMA = T.StructType(
    [
        T.StructField("record", T.BinaryType()),
        T.StructField("Tracepoint", T.StringType()),
        T.StructField("Inet", T.IntegerType()),
        T.StructField("received", T.TimestampType()),
    ]
)


def read_records(
    spark: SparkSession,
    path: str,
    streaming: bool = False,
    schema: T.StructType | None = None,
    max_files_per_trigger: int = 1000,
) -> DataFrame:
    """Read captured records from Parquet, as a table or as a stream.

    ``schema`` replaces the default record schema, e.g. to carry a host name or
    a sequence number along.
    """
    schema = schema or RECORD_SCHEMA
    if streaming:
        reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files_per_trigger)
        return reader.parquet(path)
    return spark.read.schema(schema).parquet(path)

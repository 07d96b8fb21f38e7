"""Message topics: payloads in a ``value`` column."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession, functions as F

# -- fixed values: topic defaults ------------------------------------------
DEFAULT_BROKERS = ("localhost:9092",)
DEFAULT_TOPIC = "sockets"

# trigger limits bound a micro-batch, and so what one stateful task holds
MAX_OFFSETS = 10_000_000
MAX_FILES = 1_000


def kafka_options(conf: Mapping) -> dict[str, str]:
    """Connector options of a topic configuration.

    Entries of ``options`` pass through (``kafka.*`` security settings etc.).
    """
    brokers = conf.get("brokers") or DEFAULT_BROKERS
    return {
        "kafka.bootstrap.servers": ",".join(brokers),
        **{k: str(v) for k, v in (conf.get("options") or {}).items()},
    }


def read_topic(spark: SparkSession, conf: Mapping, streaming: bool = True) -> DataFrame:
    """Payloads of one topic from its earliest offset, in ``value``.

    With ``path`` the topic is a folder of files (``format``: parquet with a
    ``value`` column, or text with one payload per line); otherwise it is read
    through the Kafka connector, which has to be on the class path.
    """
    source = spark.readStream if streaming else spark.read
    if conf.get("path"):
        if streaming:
            source = source.option("maxFilesPerTrigger", conf.get("max_files", MAX_FILES))
        if conf.get("format", "parquet") == "text":
            return source.text(conf["path"]).select("value")
        kind = "binary" if conf.get("binary") else "string"
        return source.schema(f"value {kind}").parquet(conf["path"])
    options = {
        "subscribe": conf.get("topic", DEFAULT_TOPIC),
        "startingOffsets": "earliest",
        **kafka_options(conf),
    }
    if conf.get("group"):
        options["kafka.group.id"] = conf["group"]
    if streaming:
        options["maxOffsetsPerTrigger"] = str(conf.get("max_offsets", MAX_OFFSETS))
    return source.format("kafka").options(**options).load().select(F.col("value"))

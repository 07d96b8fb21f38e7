"""Event and lookup views over the given tables, in SQL both engines read.

The Spark side builds its DataFrames from the same text, so a query and its
SQL counterpart start from the same rows.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession

from socklens import settings

_EPOCH = {"spark": "unix_timestamp(CAST(ts AS TIMESTAMP))", "duckdb": "CAST(FLOOR(epoch(ts)) AS BIGINT)"}

TCP_EVENTS = """
SELECT event_id,
  CASE WHEN event_id % 5 < 3 THEN 'sock:inet_sock_set_state'
       WHEN event_id % 5 = 3 THEN 'tcp:tcp_retransmit_skb' ELSE 'tcp:tcp_probe' END AS Tracepoint,
  CAST(CASE WHEN event_id % 17 = 0 THEN 17 ELSE 6 END AS INT) AS Protocol,
  CAST(CASE WHEN user_id % 4 = 0 THEN 6 ELSE 4 END AS INT) AS Inet,
  CAST((event_id + 3) % 11 + 1 AS INT) AS OldState,
  CAST(CASE WHEN event_type = 'error' THEN 7 ELSE event_id % 11 + 1 END AS INT) AS NewState,
  CONCAT('host', CAST(user_id % 10 AS VARCHAR(20))) AS Hostname,
  event_type AS Task,
  CAST(1000 + user_id AS BIGINT) AS PID,
  CASE WHEN user_id % 4 = 0 THEN CONCAT('fd00::', CAST(user_id % 9000 + 1 AS VARCHAR(20)))
       ELSE CONCAT('10.0.', CAST(CAST(FLOOR(user_id / 256) AS BIGINT) % 256 AS VARCHAR(20)), '.',
                   CAST(user_id % 256 AS VARCHAR(20))) END AS SAddr,
  CAST(1024 + user_id % 60000 AS INT) AS LPort,
  CASE WHEN user_id % 4 = 0 THEN CONCAT('fd01::', CAST(user_id % 9000 + 1 AS VARCHAR(20)))
       ELSE CONCAT('10.1.', CAST(user_id * 7 % 64 AS VARCHAR(20)), '.',
                   CAST(user_id % 251 AS VARCHAR(20))) END AS DAddr,
  CAST(CASE WHEN user_id % 2 = 0 THEN 443 ELSE 80 END AS INT) AS DPort,
  CAST(FLOOR(value * 1000) AS BIGINT) AS SRTT,
  CAST(event_id % 7 AS BIGINT) AS TotalRetrans,
  CAST(1460 - event_id % 3 * 20 AS INT) AS AdvMSS,
  CAST(event_id * 13 % 100000 AS BIGINT) AS BytesReceived,
  CAST(event_id * 7 % 5000 AS BIGINT) AS BytesSent,
  {epoch} AS Timestamp
FROM {events}
"""

# disjoint IPv4 ranges with gaps; no subdivision for every third
GEO_CITY = """
SELECT CAST(167837696 + n_nationkey * 512 AS BIGINT) AS lo, CAST(167837696 + n_nationkey * 512 + 255 AS BIGINT) AS hi,
  CONCAT('N', CAST(n_nationkey AS VARCHAR(20))) AS CCode, n_name AS Country, CONCAT(n_name, '_city') AS City,
  CASE WHEN n_nationkey % 3 = 0 THEN NULL ELSE CONCAT('S', CAST(n_nationkey AS VARCHAR(20))) END AS CSCode,
  CASE WHEN n_nationkey % 3 = 0 THEN NULL ELSE r_name END AS Region,
  CAST(n_nationkey - 12 AS DOUBLE) AS lat, CAST(n_nationkey * 2 AS DOUBLE) AS lon
FROM {nation} JOIN {region} ON n_regionkey = r_regionkey
"""

GEO_ASN = """
SELECT CAST(167837696 + s_suppkey * 1024 AS BIGINT) AS lo, CAST(167837696 + s_suppkey * 1024 + 1023 AS BIGINT) AS hi,
  CAST(64000 + s_suppkey AS VARCHAR(20)) AS ASN, s_name AS ASNOrg
FROM {supplier}
"""

# one unaligned range per customer around the source addresses
GEO_CUSTOMERS = """
SELECT CAST(167772160 + c_custkey * 48 + 7 AS BIGINT) AS lo, CAST(167772160 + c_custkey * 48 + 46 AS BIGINT) AS hi,
  c_mktsegment AS CCode, c_name AS Country, CONCAT('city ', CAST(c_custkey AS VARCHAR(20))) AS City,
  CAST(NULL AS VARCHAR(20)) AS CSCode, CAST(NULL AS VARCHAR(20)) AS Region,
  c_acctbal AS lat, CAST(c_nationkey AS DOUBLE) AS lon
FROM {customer}
"""

# networks in networks around the source addresses: one holds all, one per customer, some inside that, some inside those
GEO_NESTED = """
SELECT CAST(lo AS BIGINT) AS lo, CAST(hi AS BIGINT) AS hi, ASN, ASNOrg FROM (
  SELECT 167772160 AS lo, 184549375 AS hi, '1' AS ASN, r_name AS ASNOrg FROM {region} WHERE r_regionkey = 0
  UNION ALL SELECT 167772160 + c_custkey * 48, 167772160 + c_custkey * 48 + 47, CAST(70000 + c_custkey AS VARCHAR(20)), c_name FROM {customer}
  UNION ALL SELECT 167772160 + c_custkey * 48 + 10, 167772160 + c_custkey * 48 + 29, CAST(80000 + c_custkey AS VARCHAR(20)), 'half' FROM {customer} WHERE c_custkey % 2 = 0
  UNION ALL SELECT 167772160 + c_custkey * 48 + 10, 167772160 + c_custkey * 48 + 12, CAST(90000 + c_custkey AS VARCHAR(20)), 'quarter' FROM {customer} WHERE c_custkey % 4 = 0) AS n
"""

# one IPv6 range per customer, bounds as 32 hex digits
GEO_V6 = """
SELECT CONCAT('FD01', LPAD(CAST(c_custkey * 60 AS VARCHAR(20)), 28, '0')) AS lo_hex,
  CONCAT('FD01', LPAD(CAST(c_custkey * 60 + 39 AS VARCHAR(20)), 28, '0')) AS hi_hex,
  CAST(70000 + c_custkey AS VARCHAR(20)) AS ASN, c_name AS ASNOrg
FROM {customer}
"""

# JSON payloads; some are cut in half and do not parse
TOPIC = """
SELECT event_id,
  CASE WHEN event_id % 101 = 0 THEN SUBSTRING(payload, 1, CAST(FLOOR(LENGTH(payload) / 2) AS INT)) ELSE payload END AS value
FROM (SELECT event_id, CONCAT('{{"Task":"', Task, '","PID":', CAST(PID AS VARCHAR(20)),
    ',"SRTT":', CAST(SRTT AS VARCHAR(20)), ',"TotalRetrans":', CAST(TotalRetrans AS VARCHAR(20)),
    ',"SAddr":"', SAddr, '","DAddr":"', DAddr, '","DPort":', CAST(DPort AS VARCHAR(20)),
    ',"BytesSent":', CAST(BytesSent AS VARCHAR(20)), ',"RTT":', CAST(event_id AS VARCHAR(20)),
    ',"Timestamp":', CAST(Timestamp AS VARCHAR(20)), ',"Hostname":"', Hostname, '"}}') AS payload
  FROM ({tcp_events}) AS e) AS p
"""

TABLES = ("nation", "region", "supplier", "customer", "events")


def duckdb_events() -> str:
    return TCP_EVENTS.format(epoch=_EPOCH["duckdb"], events="events")


def duckdb_with(query: str) -> str:
    """``query`` with the views it names in front."""
    names = {t: t for t in TABLES}
    views = {
        "tcp_events": duckdb_events(),
        "topic": TOPIC.format(tcp_events=duckdb_events()),
        "geo_city": GEO_CITY.format(**names),
        "geo_asn": GEO_ASN.format(**names),
        "geo_customers": GEO_CUSTOMERS.format(**names),
        "geo_v6": GEO_V6.format(**names),
        "geo_nested": GEO_NESTED.format(**names),
    }
    used = [f"{name} AS ({text})" for name, text in views.items() if name in query]
    return f"WITH {', '.join(used)}\n{query}" if used else query


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _sql(spark: SparkSession, sf_dir: str, text: str, **more) -> DataFrame:
    used = {t: table(spark, sf_dir, t) for t in TABLES if "{" + t + "}" in text}
    return spark.sql(text, **used, **more)


def tcp_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    settings.apply(spark)
    shared(spark)
    return _sql(spark, sf_dir, TCP_EVENTS.replace("{epoch}", _EPOCH["spark"]))


def geo_city(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sql(spark, sf_dir, GEO_CITY)


def geo_asn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sql(spark, sf_dir, GEO_ASN)


def geo_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sql(spark, sf_dir, GEO_CUSTOMERS)


def geo_nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sql(spark, sf_dir, GEO_NESTED)


def geo_v6(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranges = _sql(spark, sf_dir, GEO_V6)
    return ranges.selectExpr("unhex(lo_hex) AS lo", "unhex(hi_hex) AS hi", "ASN", "ASNOrg")


def topic(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = TOPIC.replace("({tcp_events})", "{tcp_events}")
    return spark.sql(text, tcp_events=tcp_events(spark, sf_dir))


def shared(spark: SparkSession) -> str:
    """The folder every executor can reach.

    A temporary folder stands in only where none is set on one machine; it is
    removed when the driver ends.
    """
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if named is None and context.master.split("[")[0] == "local":
        context.setCheckpointDir(_local_folder())
    return settings.shared_folder(spark)


def scratch(spark: SparkSession, label: str) -> str:
    """A fresh folder that every executor can reach."""
    return f"{shared(spark)}/{label}-{uuid.uuid4().hex[:12]}"


@lru_cache(maxsize=1)
def _local_folder() -> str:
    folder = tempfile.mkdtemp(prefix="socklens-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    return folder

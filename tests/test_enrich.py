import ipaddress
import random
from datetime import datetime

import duckdb
import pytest

from socklens import GeoLookup, enrich_geo
from tests.conftest import plan_of
from workload import views
from workload.check import compare

CITY = "lo long, hi long, CCode string, Country string, City string, CSCode string, Region string, lat double, lon double"


def _key(text):
    return int(ipaddress.ip_address(text))


@pytest.fixture(scope="module")
def city(spark):
    lo = _key("2.125.160.216")
    return spark.createDataFrame([(lo, lo + 7, "GB", "United Kingdom", "Boxford", "ENG", "England", 51.75, -1.25)], CITY)


@pytest.fixture(scope="module")
def asn(spark):
    lo = _key("70.160.0.0")
    return spark.createDataFrame([(lo, lo + 2**13 - 1, 22773, "Cox Communications Inc.")], "lo long, hi long, ASN long, ASNOrg string")


def _lookup(spark, address, level, **tables):
    return enrich_geo(spark.createDataFrame([(address,)], "SAddr string"), level, **tables).first().asDict()


def test_city_and_location(spark, city):
    row = _lookup(spark, "2.125.160.217", "city", city=city)
    assert row == {
        "SAddr": "2.125.160.217", "CCode": "GB", "Country": "United Kingdom", "City": "Boxford", "CSCode": "ENG",
        "Region": "England",
    }
    assert _lookup(spark, "2.125.160.217", "city-loc", city=city)["GeoLocation"] == "51.750000,-1.250000"


def test_asn_levels(spark, city, asn):
    for level in ("asn", "city-asn", "City-Loc-ASN"):
        row = _lookup(spark, "70.160.0.1", level, city=city, asn=asn)
        assert (row["ASN"], row["ASNOrg"]) == ("22773", "Cox Communications Inc.")


def test_misses(spark, city, asn):
    unlisted = _lookup(spark, "9.9.9.9", "city-loc-asn", city=city, asn=asn)
    assert unlisted == {
        "SAddr": "9.9.9.9", "CCode": "", "Country": "", "City": "", "CSCode": None, "Region": None,
        "GeoLocation": "0.000000,0.000000", "ASN": "0", "ASNOrg": "",
    }
    for bad in ("nonsense", None):
        row = _lookup(spark, bad, "city-loc-asn", city=city, asn=asn)
        assert {v for k, v in row.items() if k != "SAddr"} == {None}


def test_merge_and_missing_address_column(spark, city):
    df = spark.createDataFrame([("2.125.160.217", "own"), ("9.9.9.9", None)], "SAddr string, City string")
    assert [r.City for r in enrich_geo(df, "city", city=city).collect()] == ["Boxford", ""]
    assert [r.City for r in enrich_geo(df, "city", city=city, merge="fill").collect()] == ["own", ""]
    kept = enrich_geo(df, "city", city=city, geo_field="DAddr")
    assert [r.City for r in kept.collect()] == ["own", None]
    assert "CCode" in kept.columns


def test_unknown_level_and_missing_table(spark, city):
    for level in ("country", "", "city-asn"):
        with pytest.raises(ValueError):
            GeoLookup(level, city=city)


def _random_ranges(rng, bits, count):
    """Disjoint ranges of all sizes, many of them unaligned."""
    points = sorted({rng.getrandbits(bits) >> rng.choice([0, 0, bits // 4]) for _ in range(2 * count)} | {5, 6})
    ranges = [(a, b - rng.randrange(2)) for a, b in zip(points[::2], points[1::2])]
    out = [(a, max(a, b)) for a, b in ranges]
    for start in (1 << bits - 2, 3 << bits - 2):  # dense small ones
        for i in range(300):
            a = start + i * 3
            if not any(lo <= a + 1 and a <= hi for lo, hi in out):
                out.append((a, a + 1))
    return out


@pytest.mark.parametrize("limit", [512 << 20, 2000, 0])
@pytest.mark.parametrize("family", [4, 6])
def test_equals_nested_loop(spark, family, limit):
    rng = random.Random(family)
    bits = 32 if family == 4 else 128
    ranges = _random_ranges(rng, bits, 150)
    kind = "long" if family == 4 else "binary"
    bound = (lambda v: v) if family == 4 else (lambda v: bytearray(v.to_bytes(16, "big")))
    table = spark.createDataFrame(
        [(bound(a), bound(b), str(i), f"org {i}") for i, (a, b) in enumerate(ranges)], f"lo {kind}, hi {kind}, ASN string, ASNOrg string"
    )
    values = [v for a, b in ranges for v in (a, b, a - 1, b + 1, (a + b) // 2)]
    values = [v for v in values if 0 <= v < 1 << bits and (family == 4 or v >> 32 != 0xFFFF)]
    make = ipaddress.IPv4Address if family == 4 else ipaddress.IPv6Address
    # a hot address, as a third of the rows
    rows = [(i, str(make(v))) for i, v in enumerate(values + [values[7]] * (len(values) // 2))]
    want = {}
    for i, text in rows:
        key = _key(text)
        want[i] = next((str(n) for n, (a, b) in enumerate(ranges) if a <= key <= b), "0")
    df = spark.createDataFrame(rows, "id long, SAddr string")
    got = enrich_geo(df, "asn", asn={family: table}, max_broadcast_bytes=limit)
    assert {r.id: r.ASN for r in got.collect()} == want
    assert got.count() == len(rows)


def test_small_tables_need_no_shuffle_and_no_nested_loop(spark, city, asn):
    df = spark.range(100).selectExpr("concat('10.0.0.', id) AS SAddr")
    plan = plan_of(enrich_geo(df, "city-loc-asn", city=city, asn=asn))
    assert "NestedLoop" not in plan and "Cartesian" not in plan and "EvalPython" not in plan
    assert "hashpartitioning" not in plan
    shuffled = plan_of(enrich_geo(df, "city-loc-asn", city=city, asn=asn, max_broadcast_bytes=0))
    assert "NestedLoop" not in shuffled and "Cartesian" not in shuffled


@pytest.mark.parametrize("ranges", [
    [(10, 20), (20, 30)], [(10, 20), (12, 14), (13, 15)], [(30, 20)], [(1, 2), (1, 2)],
    [(0, 1 << 20), (1 << 18, (1 << 20) + 5)], [(5, 1 << 26), ((1 << 25) + 3, (1 << 26) + 9), (7, 9)],
])
def test_ranges_that_cross_are_refused(spark, ranges):
    table = spark.createDataFrame([(lo, hi, "1", "o") for lo, hi in ranges], "lo long, hi long, ASN string, ASNOrg string")
    with pytest.raises(ValueError, match="overlap"):
        GeoLookup("asn", asn=table)
    rows = [(bytes(12) + lo.to_bytes(4), bytes(12) + hi.to_bytes(4), "1", "o") for lo, hi in ranges]
    with pytest.raises(ValueError, match="overlap"):
        GeoLookup("asn", asn=spark.createDataFrame(rows, "lo binary, hi binary, ASN string, ASNOrg string"))


def _nested(rng, lo, hi, depth):
    """Networks in networks, some that begin or end together, one that fills half of its parent."""
    out = []
    if depth and hi - lo > 8:
        cuts = sorted({rng.randrange(lo, hi + 1) for _ in range(6)} | ({lo, hi} if rng.random() < 0.5 else set()))
        for a, b in zip(cuts[::2], cuts[1::2]):
            if (a, b) != (lo, hi):
                out += [(a, b), *_nested(rng, a, b, depth - 1)]
    return out


@pytest.mark.parametrize("limit", [512 << 20, 0])
@pytest.mark.parametrize("family", [4, 6])
@pytest.mark.parametrize("partitions", [1, 7])
def test_the_innermost_of_nested_ranges_holds_an_address(spark, family, limit, partitions):
    rng = random.Random(family * 10 + partitions)
    bits = 32 if family == 4 else 128
    top = (1 << bits) - 1
    ranges = list(dict.fromkeys([(0, top), *_nested(rng, 1 << bits - 3, top >> 1, 5), (5, 5), (top, top)]))
    bound = (lambda v: v) if family == 4 else (lambda v: bytearray(v.to_bytes(16, "big")))
    kind = "long" if family == 4 else "binary"
    rng.shuffle(ranges)
    table = spark.createDataFrame([(bound(a), bound(b), str(i), f"org {i}") for i, (a, b) in enumerate(ranges)], f"lo {kind}, hi {kind}, ASN string, ASNOrg string")
    values = {v for a, b in ranges for v in (a, b, a - 1, b + 1, (a + b) // 2) if 0 <= v <= top}
    values = [v for v in values if family == 4 or v >> 32 != 0xFFFF]
    make = ipaddress.IPv4Address if family == 4 else ipaddress.IPv6Address
    want = {}
    for v in values:
        holds = [(b - a, i) for i, (a, b) in enumerate(ranges) if a <= v <= b]
        want[str(make(v))] = str(min(holds)[1])
    df = spark.createDataFrame([(t,) for t in want], "SAddr string")
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = {r.SAddr: r.ASN for r in enrich_geo(df, "asn", asn={family: table}, max_broadcast_bytes=limit).collect()}
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert got == want


def test_one_join_serves_large_tables(spark, city, asn):
    """Both tables and families in one sweep; the events are joined once, on their address."""
    df = spark.range(50).selectExpr("concat('70.160.0.', id) AS SAddr", "id")
    lookup = GeoLookup("city-loc-asn", city=city, asn=asn, max_broadcast_bytes=0)
    rows = lookup.enrich(df)
    assert {r.ASN for r in rows.collect()} == {"22773"} and rows.count() == 50
    plan = plan_of(rows)
    assert "NestedLoop" not in plan and "InMemoryTableScan" not in plan


def test_disjoint_ranges_are_accepted(spark):
    ranges = [(0, 1 << 17), ((1 << 17) + 1, 1 << 24), ((1 << 24) + 1, 1 << 27), (1 << 28, 1 << 28)]
    GeoLookup("asn", asn=spark.createDataFrame([(lo, hi, "1", "o") for lo, hi in ranges], "lo long, hi long, ASN string, ASNOrg string"))


def test_a_table_is_read_once(spark, tmp_path):
    path = str(tmp_path / "asn")
    ranges = [(i << 20, (i << 20) + 4**(i % 9), "1", "o") for i in range(1, 60)]
    spark.createDataFrame(ranges, "lo long, hi long, ASN string, ASNOrg string").write.parquet(path)
    lookup = GeoLookup("asn", asn=spark.read.parquet(path))
    assert len(lookup.tables[0].sizes) > 1
    rows = lookup.enrich(spark.createDataFrame([("0.16.0.1",), ("9.9.9.9",)], "SAddr string"))
    assert [r.ASN for r in rows.collect()] == ["1", "0"]
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert plan.count("InMemoryTableScan") >= len(lookup.tables[0].sizes)
    lookup.close()


@pytest.mark.parametrize("limit", [512 << 20, 0])
@pytest.mark.parametrize("family", [4, 6])
@pytest.mark.parametrize("partitions", [1, 7])
def test_the_narrowest_of_crossing_ranges_holds_an_address(spark, family, limit, partitions):
    rng = random.Random(family * 10 + partitions)
    bits = 32 if family == 4 else 128
    top = (1 << bits) - 1
    points = [(1 << bits - 2) + rng.randrange(4000) for _ in range(400)]
    ranges = {(min(a, b), max(a, b)) for a, b in zip(points[::2], points[1::2])}
    ranges |= {((1 << bits - 3) + 5 * i, (1 << bits - 3) + 5 * i + 40) for i in range(60)}  # equally narrow
    ranges = sorted(ranges | {(0, (1 << bits - 2) + 1500), (3, top), (top, top)})
    bound = (lambda v: v) if family == 4 else (lambda v: bytearray(v.to_bytes(16, "big")))
    kind = "long" if family == 4 else "binary"
    rng.shuffle(ranges)
    rows = [(bound(a), bound(b), str(i), f"org {i}") for i, (a, b) in enumerate(ranges)]
    table = spark.createDataFrame(rows, f"lo {kind}, hi {kind}, ASN string, ASNOrg string")
    values = {v for a, b in ranges for v in (a, b, a - 1, b + 1, (a + b) // 2) if 0 <= v <= top}
    values = [v for v in values if family == 4 or v >> 32 not in (0, 0xFFFF)]
    make = ipaddress.IPv4Address if family == 4 else ipaddress.IPv6Address
    want = {}
    for v in values:
        holds = [(b - a, -a, i) for i, (a, b) in enumerate(ranges) if a <= v <= b]
        want[str(make(v))] = str(min(holds)[2]) if holds else "0"
    df = spark.createDataFrame([(t,) for t in want], "SAddr string")
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = enrich_geo(df, "asn", asn={family: table}, max_broadcast_bytes=limit, crossing="narrowest")
        assert {r.SAddr: r.ASN for r in got.collect()} == want
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


@pytest.mark.parametrize("ranges", [[(30, 20)], [(1, 2), (1, 2)], [(1, 9), (4, 12), (4, 12)]])
def test_ranges_listed_twice_are_refused_beside_crossing_ones(spark, ranges):
    table = spark.createDataFrame([(lo, hi, "1", "o") for lo, hi in ranges], "lo long, hi long, ASN string, ASNOrg string")
    with pytest.raises(ValueError, match="overlap"):
        GeoLookup("asn", asn=table, crossing="narrowest")
    with pytest.raises(ValueError, match="crossing"):
        GeoLookup("asn", asn=table, crossing="widest")


@pytest.mark.parametrize("name", ["geo_nested_ranges", "geo_nested_ranges_swept"])
def test_networks_across_the_end_of_the_outermost(spark, tmp_path, name):
    """So many customers that their networks reach past the one that holds all."""
    keys = [*range(12), *range(349_518, 349_532)]
    customers = [(k, f"c{k}", 1, "1", 1.0, "seg") for k in keys]
    events = [(i, datetime(2026, 1, 1), i % 40, "error" if i % 9 == 0 else "view", 0.5) for i in range(400)]
    con = duckdb.connect()
    for table, rows, schema in (
        ("customer", customers, "c_custkey long, c_name string, c_nationkey long, c_phone string, c_acctbal double, c_mktsegment string"),
        ("events", events, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double"),
        ("region", [(0, "r0"), (1, "r1")], "r_regionkey long, r_name string"),
        ("nation", [(1, "n1", 1)], "n_nationkey long, n_name string, n_regionkey long"),
        ("supplier", [(1, "s1")], "s_suppkey long, s_name string"),
    ):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/{table}.parquet")
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{tmp_path}/{table}.parquet/*.parquet'")
    assert views.geo_nested(spark, str(tmp_path)).where("lo <= 184549375 AND hi > 184549375").count() == 1
    assert compare(spark, con, str(tmp_path), name) is None

import os
import random

import pytest

from socklens import Spec, run_spec, sample_per_socket, sample_stream
from socklens.operators import numbering
from socklens.operators.sampling import SocketCounters

COLUMNS = "event_id long, Hostname string, SAddr string, Timestamp long"
KEY = ["Hostname", "SAddr"]
ARRIVAL = ["Timestamp", "event_id"]


def _events(n, seed=5, hot=0.4):
    """Rows of a few sockets in arrival order; one socket has many."""
    rng = random.Random(seed)
    rows, second = [], 1_700_000_000
    for i in range(n):
        second += rng.choice([0, 0, 0, 1, 40_000])
        socket = ("hot", None) if rng.random() < hot else (f"h{rng.randrange(3)}", f"a{rng.randrange(4)}")
        rows.append((i * 3, *socket, second))
    return rows


def _counted(rows, n):
    """The counter loop: swallow n, pass one, start over."""
    seen, kept = {}, []
    for row in rows:
        key = row[1:3]
        if seen.get(key, 0) < n:
            seen[key] = seen.get(key, 0) + 1
        else:
            seen[key] = 0
            kept.append(row[0])
    return sorted(kept)


def _ids(df):
    return sorted(r.event_id for r in df.collect())


@pytest.mark.parametrize("n", [1, 3, 10])
@pytest.mark.parametrize("spread", [False, True])
def test_equals_counter_loop(spark, n, spread):
    rows = _events(1500)
    shuffled = rows[:]
    random.Random(1).shuffle(shuffled)
    df = spark.createDataFrame(shuffled, COLUMNS)
    assert _ids(sample_per_socket(df, n, KEY, ARRIVAL, spread)) == _counted(rows, n)


def test_one_second_holds_a_whole_socket(spark):
    rows = [(i, "h", "a", 1_700_000_000) for i in range(1000)]
    df = spark.createDataFrame(rows, COLUMNS)
    assert _ids(sample_per_socket(df, 4, KEY, ARRIVAL)) == _counted(rows, 4)


def test_one_second_of_a_socket_is_spread_over_tasks(spark, monkeypatch):
    before, dealt = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled"), []
    kept = numbering.deal
    monkeypatch.setattr(numbering, "deal", lambda *a: dealt.append(kept(*a)) or dealt[-1])
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        df = spark.createDataFrame([(i, "h", "a", 1_700_000_000) for i in range(1000)], COLUMNS)
        assert sample_per_socket(df, 4, KEY).count() == 200
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    assert dealt[0].rows.select("_piece").distinct().count() == 4


def test_zero_is_off_and_negative_is_an_error(spark):
    df = spark.createDataFrame(_events(10), COLUMNS)
    assert sample_per_socket(df, 0, KEY) is df
    with pytest.raises(ValueError):
        sample_per_socket(df, -1, KEY)


def test_plain_path_shuffles_once(spark):
    df = spark.createDataFrame(_events(100), COLUMNS)
    plan = sample_per_socket(df, 2, KEY, spread=False)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1


def test_the_final_plan_reads_dealt_rows_once_and_shuffles_nothing(spark, tmp_path):
    path = str(tmp_path / "rows")
    spark.createDataFrame(_events(100), COLUMNS).write.parquet(path)
    df = sample_per_socket(spark.read.parquet(path), 2, KEY, ARRIVAL)
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString()
    final = plan[: plan.index("Initial Plan")] if "Initial Plan" in plan else plan
    assert final.count("FileScan") == 1 and path not in final
    assert "hashpartitioning" not in final and "rangepartitioning" not in final


@pytest.mark.parametrize("order", [["Timestamp", "event_id"], ["event_id"], ["SAddr", "event_id"]])
def test_null_order_values_count_alike_in_pieces_and_whole(spark, order):
    rows = [(None if i % 11 == 3 else i, "h", None if i % 7 == 0 else f"a{i % 5}", None if i % 5 == 0 else 1_700_000_000 + i * 400) for i in range(200)]
    rows = [r for r in rows if r[0] is not None or r[3] is not None]
    df = spark.createDataFrame(rows, COLUMNS)
    whole = sample_per_socket(df, 3, ["Hostname"], order, False)
    assert sorted(map(str, whole.collect())) == sorted(map(str, sample_per_socket(df, 3, ["Hostname"], order).collect()))
    assert whole.count() == len(rows) // 4


def test_missing_key_and_order_columns_are_named(spark):
    df = spark.createDataFrame(_events(10), COLUMNS)
    with pytest.raises(ValueError, match="nothing"):
        sample_per_socket(df, 2, ["nothing"])
    with pytest.raises(ValueError, match="nothing"):
        sample_per_socket(df, 2, KEY, ["nothing"])
    with pytest.raises(ValueError, match="key columns"):
        sample_per_socket(df.select("event_id", "Timestamp"), 2)


def test_stream_equals_batch_over_micro_batches(spark, tmp_path):
    rows = _events(900, seed=9)
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    (tmp_path / "in").mkdir()
    batches = []

    def sink(rows, batch_id):
        batches.append(batch_id)
        rows.write.mode("overwrite").parquet(f"{out}/batch_id={batch_id}")

    def drain():
        stream = spark.readStream.schema(COLUMNS).option("maxFilesPerTrigger", 1).parquet(source)
        writer = sample_stream(stream, 3, sink, str(tmp_path / "state"), KEY, ARRIVAL, idle_minutes=None)
        writer.option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()

    for at in range(0, 900, 150):  # restarted from its checkpoint each time
        spark.createDataFrame(rows[at : at + 150], COLUMNS).coalesce(1).write.mode("append").parquet(source)
        drain()
    assert _ids(spark.read.parquet(out)) == _counted(rows, 3)
    assert len(batches) == 6 and sorted(os.listdir(tmp_path / "state")) == ["turn=0", "turn=1", "turn=2"]


def test_a_replayed_batch_gives_the_same_rows(spark, tmp_path):
    rows = _events(400, seed=2)
    parts = [spark.createDataFrame(rows[a : a + 100], COLUMNS) for a in range(0, 400, 100)]
    state = str(tmp_path / "state")
    give = lambda i: _ids(sample_per_socket(parts[i], 3, KEY, ARRIVAL, counters=SocketCounters(state, i, None)))
    got = [give(i) for i in (0, 1)]
    got.append(give(1))  # stopped before its rows were written
    got += [give(2), give(2), give(3)]
    assert got[1] == got[2] and got[3] == got[4]
    assert sorted(got[0] + got[1] + got[3] + got[5]) == _counted(rows, 3)


def test_idle_sockets_are_forgotten(spark, tmp_path):
    counters = lambda i: SocketCounters(str(tmp_path / "s"), i, idle_minutes=10)
    batch = lambda *rows: spark.createDataFrame([(i, "h", s, t) for i, s, t in rows], COLUMNS)
    give = lambda i, *rows: _ids(sample_per_socket(batch(*rows), 1, KEY, ARRIVAL, counters=counters(i)))
    assert give(0, (1, "a", 0), (2, "b", 0)) == []
    assert give(1, (3, "a", 500)) == [3]
    assert give(2, (4, "c", 700)) == []  # b has been idle for more than ten minutes
    assert give(3, (5, "b", 710), (6, "a", 720)) == []
    assert give(4, (7, "b", 730), (8, "a", 740)) == [7, 8]
    assert spark.read.parquet(str(tmp_path / "s" / "turn=1")).where("socket IS NOT NULL").count() == 3


def test_sampling_counts_true_sockets_after_filters(spark):
    """Math on a key column does not merge sockets; drops are not counted."""
    rows = []
    for i in range(60):
        port = 1000 + i % 2
        rows.append((i, "sock:inet_sock_set_state", 6, 4, 7, "h", "10.0.0.1", "10.0.0.2", port, 443, i * 100, 1_700_000_000 + i))
    df = spark.createDataFrame(
        rows,
        "event_id long, Tracepoint string, Protocol int, Inet int, NewState int, Hostname string, SAddr string, "
        "DAddr string, LPort int, DPort int, SRTT long, Timestamp long",
    )
    spec = Spec(fields=[{"name": "LPort", "math": "& 0"}, {"name": "SRTT", "filter": "SRTT < 1000"}], sample=4, keep=["event_id"], order=ARRIVAL)
    got = run_spec(df, spec)
    passed = [r for r in rows if r[10] >= 1000]
    want = [r[0] for port in (1000, 1001) for r in [x for x in passed if x[8] == port][4::5]]
    assert _ids(got) == sorted(want)
    assert {r.LPort for r in got.collect()} == {0}

"""Repair of conversations against a search through all edits."""

import hashlib
import heapq
import random
import re
from zlib import crc32

import pytest
from pyspark.sql import functions as F

from socklens.llm import queries, repair
from socklens.llm.shared import prepare, text_key

COLUMNS = "conv_id long, turn long, role string, text string"
WORDY = re.compile(r"[^\x20\x09-\x0D]")


def damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        kind = crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        out += [(conv, turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    return out


def in_order(rows):
    return sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2].encode(), hashlib.sha256(r[3].encode()).digest()))


def faults(rows):
    seen, out = set(), []
    for _, _, role, text in rows:
        last = WORDY.findall(text)[-1:]
        out.append("blank" if not last else "duplicate" if (role, text) in seen else "truncated" if last[0] not in ".!?" else "")
        seen.add((role, text))
    return out


def search(rows, found):
    """(cost, audit, lines) of the cheapest edits, by trying all of them in the order of cost and letters."""
    queue, limit = [(0, "", 0, "", ())], None
    best = None
    while queue:
        cost, audit, i, roles, lines = heapq.heappop(queue)
        if best and cost > best[0]:
            break
        if i == len(rows) and re.fullmatch("(s?(ua)+)?", roles):
            best = min(best or (cost, audit, lines), (cost, audit, lines))
        steps = []
        for role in ("user", "assistant"):
            steps.append((3, "I", i, role, f"{role}:"))
        if i < len(rows):
            _, _, role, text = rows[i]
            steps.append((4, "D", i + 1, None, None))
            if found[i] not in ("blank", "duplicate"):
                more = 3 * (found[i] == "truncated")
                steps.append((more, "K", i + 1, role, f"{role}:{text}"))
                steps += [(3 + more, "R", i + 1, r, f"{r}:{text}") for r in ("user", "assistant")]
        for price, letter, to, role, line in steps:
            told = roles if role is None else roles + (role[:1] or "o")
            # roles so far must be the beginning of a lawful order
            if re.fullmatch("s?(ua)*u?", told) and cost + price <= 4 * len(rows):
                heapq.heappush(queue, (cost + price, audit + letter, to, told, lines if line is None else (*lines, line)))
    return best


def plain(rows):
    out = []
    for conv in {r[0] for r in rows}:
        mine = in_order(damaged([r for r in rows if r[0] == conv]))
        found = faults(mine)
        turns = [r[1] for r in mine if r[1] is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        firsts = [r[2][:1] for r in mine]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(firsts, firsts[1:]))
        cost, audit, lines = search(mine, found)
        counts = [found.count(k) for k in ("blank", "duplicate", "truncated")]
        out.append((conv, gaps, *counts, illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return sorted(out, key=str)


def talks(seed, n=60):
    rng, rows = random.Random(seed), []
    for conv in range(n):
        for turn in range(rng.randrange(1, 7)):
            role = rng.choice(["user", "assistant"] * 5 + ["system", "system", "tool", "", None])
            text = rng.choice(["Yes.", "No!", "Go on", "Why?", "", " \t", None, f"Word {rng.randrange(9)}.", "Żółć 日本。"])
            rows.append((conv * 31 + seed if conv else None, None if rng.random() < 0.05 else turn + turn // 3, role, text))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_report_equals_a_search_through_all_edits(spark, seed):
    rows = talks(seed)
    df = prepare(spark).createDataFrame(rows, COLUMNS).repartition(3, "text")
    assert sorted(map(tuple, repair.report(df).collect()), key=str) == plain(rows)


def test_pieces_of_one_conversation_join(spark, monkeypatch):
    """Ranges that cut conversations, small batches: the same as whole."""
    rows = [(7, t, ["user", "assistant", "user", "tool", "system"][t * t % 5], ["Yes.", "so", "No?", f"{t}!"][t % 4]) for t in range(300)]
    rows += [(8, 1, "user", "Hi.")] * 40 + [(None, t, "user", f"{t}.") for t in range(9)]
    df = prepare(spark).createDataFrame(rows, COLUMNS)
    whole = sorted(map(str, repair.report(df.coalesce(1)).collect()))
    cut = []
    kept = repair.deal
    monkeypatch.setattr(repair, "deal", lambda *a: cut.append(kept(*a)) or cut[-1])
    options = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.shuffle.partitions": "13", "spark.sql.execution.arrow.maxRecordsPerBatch": "5"}
    before = {k: spark.conf.get(k) for k in options}
    for k, v in options.items():
        spark.conf.set(k, v)
    try:
        assert sorted(map(str, repair.report(df).collect())) == whole
        done = repair.repair(df)
        assert done.edits.where("edit <> 'D'").groupBy("conv_id").count().count() == 3
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert cut[0].rows.where("conv_id = 7").select(cut[0].piece).distinct().count() > 5


def test_powers_equal_steps():
    rng = random.Random(4)
    for _ in range(200):
        symbols = "".join(rng.choice("suaoSUAO1234") * rng.randrange(1, 9) for _ in range(rng.randrange(1, 5)))
        end = tuple(rng.randrange(0, 9) + d for d in repair.DONE)
        end = tuple(min([end[i], 3 + end[repair._TURN[i]], 6 + end[repair._TURN[repair._TURN[i]]]]) for i in repair.STATES)
        steps = end
        for s in reversed(symbols.translate(repair._SYMBOL)):
            steps = repair.apply(repair.power(s, 0), steps)
        assert repair.apply(repair.matrix(symbols), end) == steps


def test_no_rows_all_dropped_and_extra_columns(spark):
    none = prepare(spark).createDataFrame([], COLUMNS)
    assert repair.report(none).collect() == []
    gone = next(c for c in range(1000) if crc32(f"{c}:1".encode()) % 20 == 0)
    df = spark.createDataFrame([(gone, 1, "user", "Hi.")], COLUMNS).withColumns({"Key": F.lit(1), "_piece": F.lit(2), "edit": F.lit("x"), "symbols": F.lit(None).cast("int")})
    assert [tuple(r) for r in repair.report(df).collect()] == [(gone, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]
    long = spark.createDataFrame([(1, 1, "user", "word " * 200_000 + "."), (1, 2, "assistant", "Ok.")], COLUMNS)
    assert repair.repair(long).report.first().audit == "KK"


def test_digest_order_is_that_of_the_key(spark):
    row = spark.createDataFrame([("é",)], "t string").select(text_key(F.col("t")).alias("k")).first()
    assert bytes(row.k) == hashlib.sha256("é".encode()).digest()[:16]


def test_given_conversations(spark):
    sf_dir = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert sorted(map(tuple, queries.QUERIES["op13_conversation_repair"](spark, sf_dir).collect()), key=str) == plain(rows)

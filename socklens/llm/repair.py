"""Repair of the structure of conversations by dynamic programming over runs of symbols.

A row of a conversation is one symbol: the initial of its role (system, user,
assistant, other) and its fault (none, truncated, to be deleted). The cheapest edits that
leave roles in the order ``(s?(ua)+)?`` are a path through four states: nothing
yet, after system, after user, after assistant. What a symbol does to the
costs of the states is a 4 x 4 matrix under minimum and sum; a run of equal symbols is
a power of it, from cached binary powers, and pieces of a conversation are joined by
multiplying matrices. So a conversation of any length is cut into pieces, dealt out by
ranges of (conversation, turn):

1. every piece gives its matrix;
2. the matrices of a conversation, one per piece, give the cheapest costs behind each piece;
3. every piece unrolls its choices for each state it may be entered in, taking at each
   step the smallest letter among the cheapest edits (no two edits of one state share a
   letter, so that is the smallest of all cheapest audits);
4. the states between pieces, one per piece, pick the audit of each piece.

Texts take no part in this. They are shuffled once, with the audits, and edited
in order as a stream, so no task ever holds a conversation.
"""

from __future__ import annotations

import hashlib
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from socklens.llm.shared import stash, text_key
from socklens.operators.numbering import deal

# costs of edits
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
NEVER = 1 << 60
STATES = range(4)  # nothing yet, after system, after user, after assistant
_TURN = {0: 2, 1: 2, 2: 3, 3: 2}  # the state behind a user or an assistant, whichever may follow
_ROLE = {2: "user", 3: "assistant"}
_KEEP = {"s": {0: 1}, "u": {0: 2, 1: 2, 3: 2}, "a": {2: 3}, "o": {}}
# initials of rows: sound, truncated, to be deleted
SOUND, CUT, GONE = "suao", "SUAO", "1234"
_PLAIN = str.maketrans(CUT + GONE, SOUND * 2)  # to the initials alone
_SYMBOL = str.maketrans(GONE, "x" * 4)  # rows to be deleted are one symbol
LEGAL = {"su", "ua", "au"}
DONE = (0, 2 * INSERT, INSERT, 0)  # to end lawfully from each state


def multiply(a: tuple, b: tuple) -> tuple:
    return tuple(tuple(min(a[i][k] + b[k][j] for k in STATES) for j in STATES) for i in STATES)


def apply(a: tuple, costs: tuple) -> tuple:
    return tuple(min(a[i][k] + costs[k] for k in STATES) for i in STATES)


def _moves(symbol: str, state: int) -> list[tuple[str, int, int]]:
    """(letter, cost, next state) of the edits of one row, by letter; inserting comes before the row."""
    moves = [("D", DELETE, state)]
    if symbol != "x":
        more = TRUNCATED * symbol.isupper()
        kept = _KEEP[symbol.lower()].get(state)
        if kept is not None:
            moves.append(("K", more, kept))
        moves.append(("R", REROLE + more, _TURN[state]))
    return moves


@lru_cache(maxsize=None)
def power(symbol: str, k: int) -> tuple:
    """The matrix of 2^k rows of a symbol, with what may be inserted before each."""
    if k:
        return multiply(power(symbol, k - 1), power(symbol, k - 1))
    insert = [[0 if i == j else NEVER for j in STATES] for i in STATES]
    edit = [[NEVER] * 4 for _ in STATES]
    for i in STATES:
        at = i
        for n in (1, 2):
            at = _TURN[at]
            insert[i][at] = min(insert[i][at], n * INSERT)
        for _, cost, j in _moves(symbol, i):
            edit[i][j] = min(edit[i][j], cost)
    return multiply(tuple(map(tuple, insert)), tuple(map(tuple, edit)))


def runs(symbols: str) -> list[tuple[str, int]]:
    """Equal consecutive symbols collapsed: (symbol, times)."""
    return [(s, sum(1 for _ in same)) for s, same in groupby(symbols.translate(_SYMBOL))]


def behind(symbol: str, times: int, costs: tuple) -> tuple:
    """Cheapest costs before ``times`` rows of a symbol, from those behind them."""
    k = 0
    while times:
        if times & 1:
            costs = apply(power(symbol, k), costs)
        times, k = times >> 1, k + 1
    return costs


def matrix(symbols: str) -> tuple:
    """The matrix of a piece of a conversation."""
    columns = []
    for j in STATES:
        costs = tuple(0 if i == j else NEVER for i in STATES)
        for symbol, times in reversed(runs(symbols)):
            costs = tuple(min(c, NEVER) for c in behind(symbol, times, costs))
        columns.append(costs)
    return tuple(zip(*columns))


def unroll(symbols: str, costs: tuple, state: int, last: bool) -> tuple[str, int]:
    """(letters, state behind) of a piece entered in ``state``, with the cheapest costs behind it.

    Costs at the borders of runs come from matrix powers; inside a run they are
    stepped through when its choices are made.
    """
    collapsed, borders = runs(symbols), [costs]
    for symbol, times in reversed(collapsed):
        borders.append(behind(symbol, times, borders[-1]))
    letters = []
    for (symbol, times), after in zip(collapsed, borders[-2::-1]):
        inside = [after]
        for _ in range(times):
            inside.append(apply(power(symbol, 0), inside[-1]))
        for left in range(times, 0, -1):
            here, ahead = inside[left], inside[left - 1]
            while True:
                options = _moves(symbol, state)
                options.insert(1, ("I", INSERT, _TURN[state]))
                letter, to = next((x, to) for x, cost, to in options if cost + (here if x == "I" else ahead)[to] == here[state])
                letters.append(letter)
                state = to
                if letter != "I":
                    break
    while last and DONE[state]:
        letters.append("I")
        state = _TURN[state]
    return "".join(letters), state


def damage(rows: DataFrame) -> DataFrame:
    """Conversations spoilt by the checksum of their ids and turns, for trying out repairs.

    Of twenty values 0 drops a row, 1 empties its text, 2 takes the ends of its
    sentences away, 3 repeats it with the same turn, 4 makes its role user.
    """
    name = [F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")]
    kind = F.crc32(F.concat(name[0], F.lit(":"), name[1]).cast("binary")) % 20
    text = F.when(kind == 1, "").when(kind == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(kind == 4, "user").otherwise(F.col("role"))
    times = F.explode(F.sequence(F.lit(1), F.when(kind == 3, 2).otherwise(1)))
    return rows.where(kind != 0).select("conv_id", "turn", role.alias("role"), text.alias("text"), times.alias("_time")).drop("_time")


def plain_rows(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role and text alone; null roles and texts are one space."""
    words = [F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text")]
    return conversations.select("conv_id", F.col("turn").cast("long").alias("turn"), *words)


_BLANKS = " \t\n\x0b\f\r"


def _one_of(column: Column, codes: str) -> Column:
    """The letter of ``codes`` for a role's initial; the last for all others."""
    first = F.substring(column, 1, 1)
    return F.when(first == "s", codes[0]).when(first == "u", codes[1]).when(first == "a", codes[2]).otherwise(codes[3])


def _join(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """Join on equal values, null being one."""
    renamed = right.withColumnsRenamed({c: f"_other_{c}" for c in on})
    same = [F.col(c).eqNullSafe(F.col(f"_other_{c}")) for c in on]
    condition = same[0]
    for part in same[1:]:
        condition = condition & part
    return left.join(renamed, condition, how).drop(*[f"_other_{c}" for c in on])


def _sorted_list(*columns: str) -> Column:
    return F.array_sort(F.collect_list(F.struct(*columns)))


@dataclass
class Repaired:
    """``report``: a row per conversation; ``edits``: a row per edit, those of one conversation together and in order."""

    report: DataFrame
    edits: DataFrame


def repair(conversations: DataFrame) -> Repaired:
    """Faults of every conversation and the cheapest edits that repair it.

    ``conversations`` has conv_id, turn, role and text; other columns are left out. Rows
    stand in the order of their turns, null first; rows of one turn in that of
    their role and then of a digest of their text, so equal rows are
    neighbours. Null roles and texts are one space; null is a conversation id of its own.

    ``report``: ``conv_id``, ``gaps`` (turns missing between the first and the last;
    0 without turns), ``blank``, ``duplicate``, ``truncated`` (rows by their first fault: no
    word; role and text seen earlier; not ending in ``.``, ``!`` or ``?``), ``illegal`` (neighbours
    other than system-user, user-assistant, assistant-user, by initials), ``cost`` and ``audit`` (letters
    of the edits). ``edits``: ``conv_id``, ``edit`` (Keep, Rerole, Delete, Insert by letter), ``turn``
    (null for inserted rows), ``role``, ``text`` as repaired; deleted rows as they were. No rows give none.
    """
    rows = plain_rows(conversations)
    ending = F.substring(F.rtrim(F.col("text"), F.lit(_BLANKS)), -1, 1)
    narrow = rows.select(
        "conv_id", "turn", "role", text_key(F.col("text")).alias("key"), (ending == "").alias("blank"), (~ending.isin(".", "!", "?")).alias("cut")
    )
    dealt = deal(narrow, ["conv_id"], ["turn", "role", "key"], "turns", stash)
    at = (F.shiftleft(F.col(dealt.piece).cast("long"), 33) + F.col(dealt.nth)).alias("at")
    turns = dealt.rows.select("conv_id", "turn", "role", "key", "blank", "cut", F.col(dealt.piece).alias("piece"), F.col(dealt.nth).alias("nth"), at)

    # the first of equal rows is found by a partial minimum and known by its place, so no row is looked up by its text
    firsts = turns.groupBy("conv_id", "role", "key").agg(F.min("at").alias("at")).select("conv_id", "at", F.lit(True).alias("first"))
    marked = _join(turns, firsts, ["conv_id", "at"], "left").withColumn("again", F.col("first").isNull())
    code = (
        F.when(F.col("blank") | F.col("again"), _one_of(F.col("role"), GONE))
        .when(F.col("cut"), _one_of(F.col("role"), CUT))
        .otherwise(_one_of(F.col("role"), SOUND))
    )
    begins = F.min_by(F.struct("turn", "role", "key"), "nth")
    pieces = marked.withColumn("code", code).groupBy("conv_id", "piece").agg(
        F.array_join(F.transform(_sorted_list("nth", "code"), lambda x: x["code"]), "").alias("symbols"),
        begins.alias("begins"),
        F.count_if("blank").alias("blank"),
        F.count_if(F.expr("again AND NOT blank")).alias("duplicate"),
        F.count_if(F.expr("cut AND NOT again AND NOT blank")).alias("truncated"),
    )
    pieces = stash(_with_matrix(pieces), "pieces")
    known = _costs(pieces)
    unrolled = stash(_audits(_join(pieces.select("conv_id", "piece", "symbols", "begins"), known, ["conv_id", "piece"])), "audits")
    audits = _join(unrolled, _entries(unrolled), ["conv_id", "piece"])
    audits = audits.select("conv_id", "piece", "begins", F.get("audits", F.col("entry")).alias("audit"))

    faults = pieces.groupBy("conv_id").agg(*[F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated")])
    spans = turns.groupBy("conv_id").agg(F.min("turn").alias("lo"), F.max("turn").alias("hi"), F.count_distinct("turn").alias("n"))
    gaps = spans.select("conv_id", F.coalesce(F.col("hi") - F.col("lo") + 1 - F.col("n"), F.lit(0)).alias("gaps"))
    totals = known.where("opens").select("conv_id", "illegal", "cost")
    whole = audits.groupBy("conv_id").agg(F.array_join(F.transform(_sorted_list("piece", "audit"), lambda x: x["audit"]), "").alias("audit"))
    report = _join(_join(_join(gaps, faults, ["conv_id"]), totals, ["conv_id"]), whole, ["conv_id"])
    return Repaired(report, _edits(rows, audits))


def _fields(df: DataFrame, *names: str) -> list[T.StructField]:
    return [df.schema[n] for n in names]


def _with_matrix(pieces: DataFrame) -> DataFrame:
    """Pieces with ``matrix``, ``wrong`` (illegal neighbours inside) and the initials at both ends."""
    added = T.StructType().add("matrix", T.ArrayType(T.LongType())).add("wrong", "long").add("head", "string").add("tail", "string")
    schema, at = T.StructType([*pieces.schema.fields, *added.fields]), pieces.columns.index("symbols")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            symbols = batch.column(at).to_pylist()
            roles = [s.translate(_PLAIN) for s in symbols]
            columns = [
                pa.array([[c for row in matrix(s) for c in row] for s in symbols], pa.list_(pa.int64())),
                pa.array([sum(a + b not in LEGAL for a, b in zip(r, r[1:])) for r in roles], pa.int64()),
                pa.array([r[0] for r in roles], pa.string()),
                pa.array([r[-1] for r in roles], pa.string()),
            ]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], schema.names)

    return pieces.mapInArrow(run, schema)


def _costs(pieces: DataFrame) -> DataFrame:
    """Per piece: the cheapest costs ``behind`` it, whether it ``opens`` and ``closes`` its conversation, and that's cost and illegal neighbours."""
    grouped = pieces.groupBy("conv_id").agg(_sorted_list("piece", "matrix", "wrong", "head", "tail").alias("parts"))
    kind = T.StructType().add("piece", "integer").add("behind", T.ArrayType(T.LongType())).add("opens", "boolean").add("closes", "boolean").add("cost", "long").add("illegal", "long")
    schema = T.StructType([*_fields(grouped, "conv_id"), T.StructField("found", T.ArrayType(kind))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for parts in batch.column(1).to_pylist():
                costs, found = DONE, []
                for part in reversed(parts):
                    found.append({"piece": part["piece"], "behind": list(costs), "opens": part is parts[0], "closes": part is parts[-1]})
                    flat = part["matrix"]
                    costs = apply(tuple(tuple(flat[4 * i : 4 * i + 4]) for i in STATES), costs)
                wrong = sum(p["wrong"] for p in parts) + sum(a["tail"] + b["head"] not in LEGAL for a, b in zip(parts, parts[1:]))
                out.append([f | {"cost": costs[0], "illegal": wrong} for f in found])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.list_(_arrow_kind()))], schema.names)

    return grouped.mapInArrow(run, schema).select("conv_id", F.inline("found"))


def _arrow_kind() -> pa.DataType:
    return pa.struct(
        [("piece", pa.int32()), ("behind", pa.list_(pa.int64())), ("opens", pa.bool_()), ("closes", pa.bool_()), ("cost", pa.int64()), ("illegal", pa.int64())]
    )


def _audits(pieces: DataFrame) -> DataFrame:
    """Per piece its audits and the states behind it by the state it is entered in; the first of a conversation is entered in 0 alone."""
    names = ["conv_id", "piece", "begins"]
    schema = T.StructType([*_fields(pieces, *names), T.StructField("audits", T.ArrayType(T.StringType())), T.StructField("exits", T.ArrayType(T.IntegerType()))])
    columns = pieces.select(*names, "symbols", "behind", "opens", "closes")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            symbols, costs, opens, closes = (batch.column(k).to_pylist() for k in range(3, 7))
            found = [
                [unroll(s, tuple(c), state, last) for state in (STATES if not first else (0,))] for s, c, first, last in zip(symbols, costs, opens, closes)
            ]
            audits = pa.array([[a for a, _ in f] for f in found], pa.list_(pa.string()))
            exits = pa.array([[e for _, e in f] for f in found], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], audits, exits], schema.names)

    return columns.mapInArrow(run, schema)


def _entries(pieces: DataFrame) -> DataFrame:
    """(conv_id, piece, entry): the state each piece is entered in."""
    parts = pieces.groupBy("conv_id").agg(_sorted_list("piece", "exits").alias("parts"))
    start = F.array().cast("array<struct<piece:int,entry:int,exit:int>>")

    def follow(done: Column, part: Column) -> Column:
        entry = F.coalesce(F.try_element_at(done, F.lit(-1))["exit"], F.lit(0))
        return F.array_append(done, F.struct(part["piece"].alias("piece"), entry.alias("entry"), F.get(part["exits"], entry).alias("exit")))

    return parts.select("conv_id", F.inline(F.aggregate("parts", start, follow))).drop("exit")


def _edits(rows: DataFrame, audits: DataFrame) -> DataFrame:
    """Rows edited in order. Each piece's audit travels to its first row and is used up letter by letter."""
    texts = rows.select("conv_id", "turn", "role", text_key(F.col("text")).alias("key"), F.lit(None).cast("int").alias("piece"), F.lit(None).cast("string").alias("audit"), "text")
    heads = audits.select("conv_id", "begins.turn", "begins.role", "begins.key", "piece", "audit", F.lit(None).cast("string").alias("text"))
    order = ["conv_id", "turn", "role", "key"]
    both = texts.unionByName(heads).repartition("conv_id")
    # of equal rows the audits come first
    both = both.sortWithinPartitions(*[F.col(c).asc_nulls_first() for c in order], F.col("piece").asc_nulls_last())
    schema = T.StructType([*_fields(rows, "conv_id"), T.StructField("edit", T.StringType()), *_fields(rows, "turn", "role", "text")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        letters, state, now, kind = deque(), 0, None, None
        for batch in batches:
            out, kind = [], batch.column(0).type
            ids, turns, roles, pieces, audits, texts = (batch.column(k).to_pylist() for k in (0, 1, 2, 4, 5, 6))
            for conv, turn, role, piece, audit, text in zip(ids, turns, roles, pieces, audits, texts):
                if now != (conv,):
                    out += _rest(now, letters, state)
                    letters, state, now = deque(), 0, (conv,)
                if piece is not None:
                    letters.extend(audit)
                    continue
                while (letter := letters.popleft()) == "I":
                    state = _TURN[state]
                    out.append((conv, "I", None, _ROLE[state], ""))
                if letter == "R":
                    state = _TURN[state]
                    role = _ROLE[state]
                elif letter == "K":
                    state = _KEEP[role[0]][state]
                out.append((conv, letter, turn, role, text))
            yield _batch(out, schema, kind)
        if letters:
            yield _batch(_rest(now, letters, state), schema, kind)

    return both.mapInArrow(run, schema)


def _rest(now: tuple | None, letters: deque, state: int) -> list[tuple]:
    """What is inserted behind the last row of a conversation."""
    out = []
    while letters:
        letters.popleft()
        state = _TURN[state]
        out.append((*now, "I", None, _ROLE[state], ""))
    return out


def _batch(rows: list[tuple], schema: T.StructType, id_type: pa.DataType) -> pa.RecordBatch:
    kinds = [id_type, pa.string(), pa.int64(), pa.string(), pa.string()]
    columns = list(zip(*rows)) if rows else [[]] * 5
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], schema.names)


def digests(edits: DataFrame) -> DataFrame:
    """(conv_id, repaired_sha256) of repaired conversations, ``role:text`` lines, hashed as they stream by."""
    schema = T.StructType([*_fields(edits, "conv_id"), T.StructField("repaired_sha256", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, lines, digest, kind = None, 0, hashlib.sha256(), None
        for batch in batches:
            done, kind = [], batch.column(0).type
            for conv, edit, role, text in zip(*(batch.column(k).to_pylist() for k in (0, 1, 3, 4))):
                if now != (conv,):
                    done += [] if now is None else [(now[0], digest.hexdigest())]
                    now, lines, digest = (conv,), 0, hashlib.sha256()
                if edit != "D":
                    digest.update(f"{chr(10) if lines else ''}{role}:{text}".encode())
                    lines += 1
            yield _hashes(done, schema, kind)
        if now is not None:
            yield _hashes([(now[0], digest.hexdigest())], schema, kind)

    return edits.mapInArrow(run, schema)


def _hashes(rows: list[tuple], schema: T.StructType, id_type: pa.DataType) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], id_type), pa.array([r[1] for r in rows], pa.string())], schema.names)


def report(conversations: DataFrame) -> DataFrame:
    """A row per original conversation: the report of its repair after :func:`damage`, with the digest of what it became."""
    done = repair(damage(plain_rows(conversations)))
    every = conversations.select("conv_id").distinct()
    found = _join(_join(every, done.report, ["conv_id"], "left"), digests(done.edits), ["conv_id"], "left")
    counts = [F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    empty = hashlib.sha256(b"").hexdigest()
    return found.select("conv_id", *counts, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(empty)).alias("repaired_sha256"))

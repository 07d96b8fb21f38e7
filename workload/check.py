"""Compare every query with its SQL counterpart in DuckDB.

    python -m workload.check [sf_dir] [name ...]
"""

from __future__ import annotations

import sys
import time

import duckdb

from workload.registry import ORACLES, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES.split():
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def canonical_rows(names, rows) -> list[str]:
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted(repr(tuple(row[i] for i in order)) for row in rows)


def compare(spark, con, sf_dir: str, name: str) -> str | None:
    """None if the query and its SQL agree, else what differs."""
    df = QUERIES[name](spark, sf_dir)
    got = canonical_rows(df.columns, [tuple(r) for r in df.collect()])
    if name not in ORACLES:
        return None
    cursor = con.execute(ORACLES[name])
    columns = [d[0] for d in cursor.description]
    if sorted(columns) != sorted(df.columns):
        return f"columns {sorted(df.columns)} / {sorted(columns)}"
    kinds = {
        "int": "INTEGER", "bigint": "BIGINT", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN",
    }
    types = {d[0]: str(d[1]) for d in cursor.description}
    for field in df.schema:
        if kinds.get(field.dataType.simpleString()) != types[field.name]:
            return f"type of {field.name}: {field.dataType.simpleString()} / {types[field.name]}"
    want = canonical_rows(columns, cursor.fetchall())
    if got == want:
        return None
    only = [r for r in got if r not in set(want)][:2], [r for r in want if r not in set(got)][:2]
    return f"{len(got)} rows / {len(want)} rows\n   only here {only[0]}\n   only SQL  {only[1]}"


def main() -> int:
    from workload.session import local_session

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:] or list(QUERIES)
    spark, con, failed = local_session(), connect(sf_dir), 0
    for name in names:
        begun = time.time()
        try:
            problem = compare(spark, con, sf_dir, name)
        except Exception as error:  # report and go on
            problem = f"{type(error).__name__}: {str(error)[:600]}"
        failed += problem is not None
        print(f"{'ok  ' if problem is None else 'FAIL'} {name} {time.time() - begun:.1f}s {problem or ''}", flush=True)
    print(f"{len(names) - failed} of {len(names)} agree")
    return failed


if __name__ == "__main__":
    sys.exit(main())

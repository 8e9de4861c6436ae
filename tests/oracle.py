"""Side-by-side comparison of registered queries with their oracle SQL.

Usage: python -m tests.oracle [sf] [query ...]
"""

from __future__ import annotations

import math
import sys
import time

import duckdb
import pandas as pd

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()
KINDS = {
    "bigint": "BIGINT",
    "int": "INTEGER",
    "double": "DOUBLE",
    "string": "VARCHAR",
    "boolean": "BOOLEAN",
    "date": "DATE",
    "timestamp_ntz": "TIMESTAMP",
    "timestamp": "TIMESTAMP",
    "float": "FLOAT",
}


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(
            f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')"
        )
    return connection


def _plain(value):
    if value is None or value is pd.NaT or (isinstance(value, float) and math.isnan(value)):
        return "NULL"
    if isinstance(value, bool):
        return str(value)
    if isinstance(value, (int, float)):
        return repr(round(float(value), 9) + 0.0)
    return str(value)


def canonical(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_plain(row[i]) for i in order) for row in rows)


def compare(connection, frame, sql):
    """None if equal, else a short description of the first difference."""
    mine = [tuple(r) for r in frame.collect()]
    relation = connection.sql(sql)
    theirs = relation.fetchall()
    kinds = {c: t.simpleString() for c, t in ((f.name, f.dataType) for f in frame.schema)}
    oracle_kinds = dict(zip(relation.columns, map(str, relation.types), strict=True))
    if sorted(kinds) != sorted(oracle_kinds):
        return f"columns {sorted(kinds)} vs {sorted(oracle_kinds)}"
    wrong = {
        c: (k, oracle_kinds[c]) for c, k in kinds.items() if KINDS.get(k, k) != oracle_kinds[c]
    }
    if wrong:
        return f"types {wrong}"
    if len(mine) != len(theirs):
        return f"rows {len(mine)} vs {len(theirs)}"
    a, b = canonical(mine, frame.columns), canonical(theirs, relation.columns)
    for left, right in zip(a, b, strict=True):
        if left != right:
            n = sum(x != y for x, y in zip(a, b, strict=True))
            return f"{n} rows differ, first {left} vs {right}"
    return None


def main() -> None:
    from tests.session import make_session

    from __spark_entry__ import oracle_sql, queries

    sf = sys.argv[1] if len(sys.argv) > 1 else "0.001"
    sf_dir = f"/root/testdata/sf{sf}"
    wanted = sys.argv[2:]
    spark = make_session()
    connection = connect(sf_dir)
    oracles = oracle_sql()
    bad = 0
    for name, function in queries().items():
        if wanted and not any(name.startswith(w) for w in wanted):
            continue
        start = time.time()
        try:
            if name in oracles:
                problem = compare(connection, function(spark, sf_dir), oracles[name])
                n = len(connection.sql(oracles[name]).fetchall()) if not problem else -1
            else:
                n = len(function(spark, sf_dir).collect())
                problem = None if n else "no rows"
        except Exception as error:  # noqa: BLE001
            problem, n = f"{type(error).__name__}: {str(error)[:600]}", -1
        bad += problem is not None
        tag = "ok " if problem is None else "BAD"
        oracle = "" if name in oracles else " (rows only)"
        print(f"{tag} {name}{oracle} n={n} {time.time() - start:.1f}s {problem or ''}", flush=True)
    print(f"{bad} bad")


if __name__ == "__main__":
    main()

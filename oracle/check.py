"""Run registered queries and their SQL side by side; used by the tests and from the shell.

    python -m oracle.check /root/testdata/sf0.01 [query ...]
"""

from __future__ import annotations

import glob
import math
import os
import sys
import time

import duckdb

from oracle.sql import ORACLES


def connect(directory: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in sorted(glob.glob(f"{directory}/*.parquet")):
        name = os.path.basename(path).removesuffix(".parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def _canonical(columns: list[str], rows: list[tuple]) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def cell(v):
        if isinstance(v, float):
            return None if math.isnan(v) else repr(round(v, 9))
        return v if v is None else f"{type(v).__name__}:{v}"

    return sorted((tuple(cell(r[i]) for i in order) for r in rows), key=repr)


def differences(df, con: duckdb.DuckDBPyConnection, sql: str) -> str | None:
    """What differs between a DataFrame and a SQL result, or None."""
    mine = [tuple(r) for r in df.collect()]
    relation = con.sql(sql)
    theirs, names = relation.fetchall(), relation.columns
    if sorted(df.columns) != sorted(names):
        return f"columns {sorted(df.columns)} / {sorted(names)}"
    if len(mine) != len(theirs):
        return f"rows {len(mine)} / {len(theirs)}"
    a, b = _canonical(df.columns, mine), _canonical(names, theirs)
    wrong = [(x, y) for x, y in zip(a, b) if x != y]
    return f"{len(wrong)} rows differ, first {str(wrong[0])[:600]}" if wrong else None


def main(directory: str, names: list[str]) -> int:
    from ledgerlens.plans.catalog import QUERIES
    from ledgerlens.session import local_session

    spark, con, bad = local_session(), connect(directory), 0
    for name in names or QUERIES:
        started = time.time()
        try:
            df = QUERIES[name](spark, directory)
            if name in ORACLES:
                found = differences(df, con, ORACLES[name])
                rows = df.count() if found is None else "?"
            else:
                found, rows = None, f"{df.count()} (no SQL)"
        except Exception as error:  # report and go on with the next query
            found, rows = f"{type(error).__name__}: {str(error)[:900]}", "?"
        bad += found is not None
        print(f"{'FAIL' if found else 'ok  '} {name:28} {rows!s:>8} {time.time() - started:6.2f}s {found or ''}", flush=True)
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1], sys.argv[2:]) else 0)

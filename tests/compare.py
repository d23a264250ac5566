"""Runs a query and its SQL and compares rows, as the driver does."""

from __future__ import annotations

from pathlib import Path

import duckdb


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    db = duckdb.connect()
    db.sql("SET TimeZone = 'UTC'")
    for path in sorted(Path(folder).glob("*.parquet")):
        files = f"{path}/*.parquet" if path.is_dir() else path
        db.sql(f"CREATE VIEW {path.stem} AS SELECT * FROM '{files}'")
    return db


def plain(value: object) -> str:
    return f"{value:.6g}" if isinstance(value, float) else str(value)


def differences(spark_df, db: duckdb.DuckDBPyConnection, sql: str) -> list[str]:
    """What differs between a frame and its SQL; empty if nothing does."""
    columns = sorted(spark_df.columns)
    mine = sorted(tuple(plain(r[c]) for c in columns) for r in spark_df.collect())
    result = db.sql(sql)
    if sorted(result.columns) != columns:
        return [f"columns {columns} against {sorted(result.columns)}"]
    order = [result.columns.index(c) for c in columns]
    theirs = sorted(tuple(plain(r[k]) for k in order) for r in result.fetchall())
    if mine == theirs:
        return []
    a, b = {}, {}
    for rows, count in ((mine, a), (theirs, b)):
        for row in rows:
            count[row] = count.get(row, 0) + 1
    only = lambda x, y: [r for r, n in x.items() if n > y.get(r, 0)]
    return [f"{len(mine)} rows against {len(theirs)}", *(f"+ {r}" for r in only(a, b)[:6]), *(f"- {r}" for r in only(b, a)[:6])]

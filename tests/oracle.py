"""Order-insensitive comparison of a Spark result with DuckDB's on the same files."""

from __future__ import annotations

from pathlib import Path

import duckdb

DATA = "/root/testdata"


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in Path(sf_dir).glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM read_parquet('{path}')")
    return con


def canonical(columns: list[str], rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return [tuple(sorted(columns)), *sorted((tuple(row[i] for i in order) for row in rows), key=repr)]


def of_spark(df) -> list[tuple]:
    return canonical(df.columns, df.collect())


def of_duck(sf_dir: str, sql: str) -> list[tuple]:
    found = duck(sf_dir).execute(sql)
    return canonical([x[0] for x in found.description], found.fetchall())

"""Scans: every predicate is a plain comparison on a stored column, so Parquet statistics can prune with it."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from tidemark.functions import price_matches
from tidemark.operators.order import by_time
from tidemark.schema import COLUMNS, SEQ

# Rows that the driver holds at once.
LOCAL_ROWS = 100_000


def range_scan(ticks: DataFrame, symbol: str | None, start: int, end: int) -> DataFrame:
    """Ticks of ``symbol`` (all symbols when None) with ``start <= timestamp <= end``; reversed bounds match nothing."""
    found = ticks.filter(F.col("timestamp").between(F.lit(start).cast("long"), F.lit(end).cast("long")))
    return found if symbol is None else found.filter(F.col("symbol") == symbol)


def price_filter(ticks: DataFrame, op: str, value: float) -> DataFrame:
    """Ticks whose close compares as asked; NaN closes never match."""
    return ticks.filter(price_matches(op, value))


def project(ticks: DataFrame, columns: Sequence[str] | None) -> DataFrame:
    """The named columns in the order given, or all seven in schema order."""
    return ticks.select(*(columns or COLUMNS))


def point_lookup(ticks: DataFrame, symbol: str, timestamp: int) -> DataFrame:
    """The ticks with that key: of resolved ones at most one."""
    return ticks.filter((F.col("symbol") == symbol) & (F.col("timestamp") == F.lit(timestamp).cast("long")))


def count_range(ticks: DataFrame, symbol: str | None, start: int, end: int) -> DataFrame:
    """One row, ``n``: the number of ticks in the range."""
    return range_scan(ticks, symbol, start, end).agg(F.count(F.lit(1)).alias("n"))


def first_rows(df: DataFrame, n: int, *order: str) -> DataFrame:
    """First ``n`` rows in time order, planned as a per-partition top-n."""
    return df.orderBy(*(order or by_time(df))).limit(n)


def iterate(ticks: DataFrame) -> Iterator[dict]:
    """Ticks in (symbol, timestamp) order, those of one key by their sequence where it is known."""
    return (row.asDict() for row in local_rows(ticks, "symbol", *by_time(ticks)))


def local_rows(df: DataFrame, *order: str) -> Iterator[Row]:
    """Rows without their sequence in the order given, one partition of some LOCAL_ROWS at a time on the driver."""
    parts = max(1, -(-df.count() // LOCAL_ROWS))
    return df.repartitionByRange(parts, *order).sortWithinPartitions(*order).drop(SEQ).toLocalIterator()

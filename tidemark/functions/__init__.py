"""Column-level building blocks; everything here stays inside whole-stage codegen."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SECOND = 1_000_000_000
MINUTE = 60 * SECOND
HOUR = 60 * MINUTE
INTERVALS = {"s": SECOND, "m": MINUTE, "h": HOUR}


def epoch_ns(ts: Column) -> Column:
    """Nanoseconds since the epoch of a microsecond timestamp column."""
    return F.unix_micros(ts.cast("timestamp")) * F.lit(1000).cast("long")


def bucket(ts: Column, width: int) -> Column:
    """Start of the bucket of ``ts``; the division truncates toward zero, so bucket 0 spans (-width, width)."""
    width_col = F.lit(width).cast("long")
    return F.call_function("div", ts, width_col) * width_col


def price_matches(op: str, value: float, price: Column | None = None) -> Column:
    """Ordered comparison of the close: NaN never matches, although Spark sorts it above every number."""
    price = F.col("close") if price is None else price
    value = F.lit(float(value))
    return {
        ">": (price > value) & ~F.isnan(price),
        ">=": (price >= value) & ~F.isnan(price),
        "<": price < value,
        "<=": price <= value,
        "=": price == value,
    }[op]


def max_ignoring_nan(col: Column) -> Column:
    """Largest value that is a number; NaN only when every value is NaN."""
    return F.coalesce(F.max(F.when(~F.isnan(col), col)), F.max(col))

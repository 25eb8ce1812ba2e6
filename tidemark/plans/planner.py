"""Query to DataFrame: filters first, then the aggregate or the projection, then the limit."""

from __future__ import annotations

from pyspark.sql import DataFrame

from tidemark.operators import bars, scan
from tidemark.operators.order import by_time
from tidemark.plans.text import Query, parse


def _aggregated(ticks: DataFrame, query: Query, compat: bool) -> DataFrame:
    if query.aggregate == "VWAP":
        return bars.range_vwap(ticks, query.symbol) if compat else bars.vwap_bars(ticks, query.width)
    if query.aggregate == "COUNT":
        return bars.count_bars(ticks, query.width, compat)
    return {"OHLCV": bars.ohlcv, "SUM": bars.sum_bars}[query.aggregate](ticks, query.width)


def plan(ticks: DataFrame, query: Query | str, compat: bool = False) -> DataFrame:
    """Lazy result of ``query`` over ticks, in time order; those of one time by their sequence, where ``ticks`` have it.

    By default COUNT counts, VWAP is per bucket and the column list projects; ``compat`` gives one per bucket,
    one VWAP for the range and all seven columns.
    """
    query = parse(query) if isinstance(query, str) else query
    found = scan.range_scan(ticks, query.symbol, query.start, query.end)
    if query.price is not None:
        found = scan.price_filter(found, *query.price)
    if query.aggregate is not None:
        found = _aggregated(found, query, compat)
    found = found.orderBy(*by_time(found))
    if query.limit is not None:
        found = found.limit(query.limit)
    return found if query.aggregate is not None else scan.project(found, None if compat else query.columns)

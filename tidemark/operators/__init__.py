"""Relational operators over tick DataFrames. All are lazy and pure."""

from tidemark.operators.bars import Aggregate, count_bars, ohlcv, range_vwap, sum_bars, vwap_bars
from tidemark.operators.dedup import last_write_wins, merge_runs
from tidemark.operators.encodings import delta, double_delta, symbol_ids, volume_runs, xor_previous
from tidemark.operators.order import by_time, moment
from tidemark.operators.scan import count_range, first_rows, iterate, local_rows, point_lookup, price_filter, project, range_scan

__all__ = [
    "Aggregate", "by_time", "count_bars", "count_range", "delta", "double_delta", "first_rows", "iterate", "last_write_wins",
    "local_rows", "merge_runs", "moment", "ohlcv", "point_lookup", "price_filter", "project", "range_scan", "range_vwap", "sum_bars",
    "symbol_ids", "volume_runs", "vwap_bars", "xor_previous",
]

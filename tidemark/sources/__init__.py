"""Sources and sinks: the segment store, file adapters and columnar ingest."""

from tidemark.sources.adapters import bars_from_lineitem, from_columns, from_rows, ticks_from_events, ticks_from_orders
from tidemark.sources.store import SegmentStore

__all__ = [
    "SegmentStore", "bars_from_lineitem", "from_columns", "from_rows", "ticks_from_events", "ticks_from_orders",
]

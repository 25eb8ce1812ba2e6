"""The plan tree with row estimates, from integer arithmetic on the number of stored rows."""

from __future__ import annotations

from tidemark.plans.text import Query

# Names that the tree prints.
UNIT_NAMES = {"s": "Sec1", "m": "Min1", "h": "Hour1"}
MEMORY_ROWS = 10_000


def explain_tree(query: Query, total_rows: int) -> str:
    """Text tree, outermost operator first; no data is read."""
    scanned = total_rows // 10
    rows = scanned
    chain = [
        ("MemTableScan", min(total_rows, MEMORY_ROWS)),
        (f"BloomFilterPushdown(t1={query.start}, t2={query.end})", scanned),
        (f"SSTableScan(symbol={query.symbol})", scanned),
    ]
    if query.price is not None:
        rows = scanned // 2
        chain.append(("SimdPriceFilter(AVX2)", rows))
    if query.aggregate is not None:
        rows = scanned // 100
        name = f"StreamAggregate(interval={UNIT_NAMES[query.unit]}, fn={query.aggregate.capitalize()})"
        chain.append((name, rows))
    if query.limit is not None:
        rows = query.limit
        chain.append((f"Limit({query.limit})", rows))
    chain.append(("QueryRoot", rows))
    return "".join(f"{'  ' * depth}{name} (est. {n} rows)\n" for depth, (name, n) in enumerate(reversed(chain)))

import pytest

from tidemark.errors import QueryParseError, UnexpectedEnd, UnexpectedToken
from tidemark.functions import HOUR, MINUTE
from tidemark.plans import explain_tree, parse

BASE = "SELECT * FROM AAPL WHERE timestamp BETWEEN 0 AND 1000"


def test_simple():
    q = parse(BASE)
    assert (q.symbol, q.start, q.end, q.columns, q.explain) == ("AAPL", 0, 1000, None, False)


@pytest.mark.parametrize("tail", ["LIMIT 5 GROUP BY :1m AGGREGATE OHLCV", "group by : 1 M aggregate ohlcv limit 5"])
def test_limit_and_group_in_either_order(tail):
    q = parse(f"{BASE} AND price >= -1.5 {tail}")
    assert (q.limit, q.width, q.aggregate, q.price) == (5, MINUTE, "OHLCV", (">=", -1.5))


@pytest.mark.parametrize("symbol, want", [("'BRK.B'", "BRK.B"), ("sum", "sum"), ("Price", "Price"), ("'it''s'", "it's")])
def test_symbols(symbol, want):
    assert parse(BASE.replace("AAPL", symbol)).symbol == want


def test_columns_with_and_without_commas():
    assert parse(BASE.replace("*", "timestamp, CLOSE volume")).columns == ("timestamp", "close", "volume")


def test_exact_nanoseconds():
    t = 1_700_000_000_000_000_001
    assert parse(f"SELECT * FROM A WHERE timestamp BETWEEN {t} AND {t + 1}").end == t + 1


@pytest.mark.parametrize(
    "text, error, at",
    [
        (BASE + " nonsense", UnexpectedToken, len(BASE) + 1),
        (BASE + " LIMIT -1", QueryParseError, len(BASE) + 7),
        (BASE + " GROUP BY :2m AGGREGATE SUM", QueryParseError, len(BASE) + 11),
        (BASE[:-9], UnexpectedEnd, len(BASE) - 9),
        (BASE.replace("*", "wrong"), QueryParseError, 7),
        (BASE.replace("*", ""), QueryParseError, 8),
        (BASE + " ;", UnexpectedToken, len(BASE) + 1),
        (BASE.replace("1000", "9" * 20), QueryParseError, BASE.index("1000")),
        (BASE.replace("1000", "1.5"), UnexpectedToken, BASE.index("1000")),
    ],
)
def test_rejects(text, error, at):
    with pytest.raises(error) as caught:
        parse(text)
    assert caught.value.position == at


def test_explain_tree():
    q = parse(f"EXPLAIN {BASE} AND price > 1 GROUP BY :1h AGGREGATE VWAP")
    assert q.width == HOUR
    assert explain_tree(q, 100_000) == (
        "QueryRoot (est. 100 rows)\n"
        "  StreamAggregate(interval=Hour1, fn=Vwap) (est. 100 rows)\n"
        "    SimdPriceFilter(AVX2) (est. 5000 rows)\n"
        "      SSTableScan(symbol=AAPL) (est. 10000 rows)\n"
        "        BloomFilterPushdown(t1=0, t2=1000) (est. 10000 rows)\n"
        "          MemTableScan (est. 10000 rows)\n"
    )

"""Events of one symbol at one time: queries match their SQL on them, in whatever order tasks run."""

import pytest

import duckdb
from oracle import of_duck, of_spark
from tidemark import engine as engines
from tidemark import open_engine
from tidemark.queries import ORACLES, QUERIES
from tidemark.sources import adapters

TIED = [
    "insert_multi",
    "background_compaction",
    "compaction_due",
    "health_and_accessors",
    "ingest_late",
    "ingest_replayed_batch",
    "insert_batch",
    "insert_batch_columns",
    "insert_numpy",
    "live_bars",
    "ohlcv_1s_whole",
    "ohlcv_1m_all_symbols",
    "ohlcv_1h_all_symbols",
    "ohlcv_1h",
    "limit_first_n",
    "implicit_order",
    "point_lookup",
    "bloom_lookup",
    "delta_ts",
    "double_delta_price",
    "xor_repeat",
    "rle_volume_runs",
    "scan_iter",
    "query_range",
    "scan_stream",
]


@pytest.fixture(scope="module")
def tied(tmp_path_factory):
    """Two weeks and more of events, three of each symbol at every time, in ranges of a query and out of them."""
    folder = tmp_path_factory.mktemp("tied")
    duckdb.sql(f"""COPY (SELECT i AS event_id, TIMESTAMP '2024-01-05' + to_hours(CAST(i // 6 * 5 AS BIGINT)) AS ts, CAST(i * 7 % 23 AS BIGINT) AS user_id,
     CASE WHEN i % 2 = 0 THEN 'click' ELSE 'view' END AS event_type, CAST((i * 37) % 200 + 0.5 AS DOUBLE) AS value, '' AS props
     FROM range(600) t(i) ORDER BY i) TO '{folder}/events.parquet' (FORMAT parquet)""")
    return str(folder)


@pytest.mark.parametrize("name", TIED)
def test_ticks_of_one_time_match_sql(spark, tied, name):
    assert of_spark(QUERIES[name](spark, tied)) == of_duck(tied, ORACLES[name])


def test_inserts_hold_one_part_at_a_time(spark, tmp_path, monkeypatch):
    """Rows from an iterator and columns are sent in parts, and added as one segment in which later rows win."""
    sizes = []

    def seen(make):
        return lambda *args: sizes.append(len(args[-1]["volume"] if isinstance(args[-1], dict) else args[-1])) or make(*args)

    monkeypatch.setattr(adapters, "PART_ROWS", 10)
    for name in ("from_rows", "from_columns"):
        monkeypatch.setattr(engines, name, seen(getattr(engines, name)))
    engine = open_engine(spark, str(tmp_path))
    assert engine.insert_multi({"symbol": "A", "timestamp": i % 30, "close": i} for i in range(45)) == 45
    columns = {c: list(range(25)) for c in ("timestamp", "open", "high", "low", "close", "volume")}
    assert engine.insert_batch_columns("B", columns) == 25 and engine.insert_batch_columns("C", [columns, columns]) == 50
    assert max(sizes) == 10 and sum(sizes) == 120 and engine.stats()["total_sstables"] == 3
    assert [t["close"] for t in engine.scan_iter("A", 0, 99)] == [*range(30, 45), *range(15, 30)]
    assert engine.insert_multi([]) == 0 and engine.count_range("C", 0, 99) == 25


def test_text_sink_shows_every_tick(spark, tied):
    """Its SQL leaves the order of lines of one time open."""
    got, want = (sorted(r, key=lambda x: x[0]) for r in (of_spark(QUERIES["cli_text_sink"](spark, tied))[1:], of_duck(tied, ORACLES["cli_text_sink"])[1:]))
    assert got[0] == want[0] and sorted(x[1] for x in got) == sorted(x[1] for x in want) and len(got) == 301


def test_a_large_segment_with_nothing_newer_is_not_due(spark, tied, monkeypatch):
    """A level beyond its limit waits for something to merge it with, and then goes on before it is merged into."""
    from tidemark.sources import store

    monkeypatch.setattr(store, "LEVEL_ONE_BYTES", 1)
    for name in ("compaction_due", "health_and_accessors"):
        assert of_spark(QUERIES[name](spark, tied)) == of_duck(tied, ORACLES[name])


def test_newer_segments_make_a_large_level_due(spark, tmp_path, monkeypatch):
    from tidemark.sources import store

    monkeypatch.setattr(store, "LEVEL_ONE_BYTES", 1)
    engine = open_engine(spark, str(tmp_path), auto_compact=False)
    for i in range(4):
        assert not engine.needs_compaction()
        engine.insert("A", i, 1, 1, 1, i, 1)
    assert engine.needs_compaction() and engine.compact_due() == 1 and not engine.needs_compaction()
    engine.insert("A", 9, 1, 1, 1, 9, 1)
    assert engine.needs_compaction() and engine.compact_due() >= 1
    assert [t["close"] for t in engine.scan_iter("A", 0, 99)] == [0, 1, 2, 3, 9]


def test_footers_tell_codecs(spark, tmp_path):
    """Codecs come from the footers, without a file's content on the driver."""
    engine = open_engine(spark, str(tmp_path), auto_compact=False)
    engine.insert("A", 1, 1, 1, 1, 1, 1)
    (segment,) = engine.store.manifest()["segments"]
    found = {column: codec for column, codec, _ in engine.store.files.column_chunks(segment["uri"])}
    assert found["timestamp"] == "LZ4" and set(found) >= {"symbol", "close", "volume"}

import json

import numpy as np
import pytest

from tidemark import cli, open_engine
from tidemark.errors import ReplicationError, SymbolNotFound
from tidemark.functions import MINUTE, SECOND
from tidemark.streaming import ingest_json, maintain_bars


def filled(spark, path, n=100, **config):
    engine = open_engine(spark, str(path), **config)
    one = np.ones(n)
    engine.insert_numpy("AAPL", np.arange(n) * SECOND, 150 * one, 151 * one, 149 * one, 150.5 * one, (1000 * one).astype("int64"))
    return engine


def test_insert_query_get_count(spark, tmp_path):
    engine = filled(spark, tmp_path)
    assert engine.query(f"SELECT * FROM AAPL WHERE timestamp BETWEEN 0 AND {99 * SECOND}").count() == 100
    assert engine.get("AAPL", 5 * SECOND)["close"] == 150.5 and engine.get("AAPL", 5) is None
    assert engine.count_range("AAPL", 0, 9 * SECOND) == 10
    assert [t["timestamp"] for t in engine.scan_iter("AAPL", 0, 2 * SECOND)] == [0, SECOND, 2 * SECOND]
    assert engine.to_dict(f"SELECT close FROM AAPL WHERE timestamp BETWEEN 0 AND 0") == {"close": [150.5], "row_count": 1}
    assert "BloomFilterPushdown" in engine.query("EXPLAIN SELECT * FROM X WHERE timestamp BETWEEN 0 AND 1").first()[0]
    with pytest.raises(SymbolNotFound):
        engine.query("SELECT * FROM GOOG WHERE timestamp BETWEEN 0 AND 1")
    with pytest.raises(ValueError, match="same length"):
        engine.insert_numpy("A", [1, 2], [1], [1], [1], [1], [1])


def test_upsert_compact_reopen(spark, tmp_path):
    engine = filled(spark, tmp_path, auto_compact=False)
    engine.insert("AAPL", 0, 1, 1, 1, 55, 1)
    engine.insert_multi([{"symbol": "GOOG", "timestamp": -7, "close": 2}])
    before = sorted(map(tuple, engine.ticks().collect()))
    assert len(before) == 101 and engine.get("AAPL", 0)["close"] == 55
    assert engine.stats()["total_sstables"] == 3 and not engine.needs_compaction()
    assert engine.compact() == 101 and engine.compact() == 0
    again = open_engine(spark, str(tmp_path))
    assert sorted(map(tuple, again.ticks().collect())) == before
    assert again.stats()["total_rows"] == 101 and again.stats()["total_sstables"] == 1
    assert {r["symbol"]: r["symbol_id"] for r in again.symbol_dict().collect()} == {"AAPL": 0, "GOOG": 1}


def test_auto_compaction_after_four_appends(spark, tmp_path):
    engine = open_engine(spark, str(tmp_path))
    for i in range(4):
        engine.insert("A", i, 1, 1, 1, i, 1)
    assert engine.stats()["total_sstables"] == 1 and engine.count_range("A", 0, 9) == 4


def test_archive_restores(spark, tmp_path):
    engine = filled(spark, tmp_path / "db", cold_tier_uri=str(tmp_path / "cold"), cold_tier_min_level=1)
    assert engine.sync_cold_tier() == 0
    engine.compact()
    assert engine.sync_cold_tier() == 1 == engine.cold_tier_synced_count()
    engine.store.files.delete(engine.store.manifest()["segments"][0]["uri"])
    assert engine.count_range("AAPL", 0, 99 * SECOND) == 100


def test_replication(spark, tmp_path):
    primary = filled(spark, tmp_path / "p", 2, auto_compact=False)
    replica = open_engine(spark, str(tmp_path / "r"), role="replica")
    with pytest.raises(ReplicationError):
        replica.insert("AAPL", 1, 1, 1, 1, 1, 1)
    with pytest.raises(ReplicationError):
        primary.apply_replication_batch(primary.read_wal_for_replication(None, 10))
    assert replica.replication_status(primary)["lag"] == 2
    assert replica._replica.pull(primary.store, batch=1) == 2
    assert replica.replication_status(primary)["lag"] == 0
    assert replica.get("AAPL", SECOND)["close"] == 150.5
    assert replica.apply_replication_batch(primary.read_wal_for_replication(replica.replication_last_applied(), 9)) == 0


def test_sequences_are_dense_over_partitions(spark, tmp_path):
    engine = open_engine(spark, str(tmp_path))
    rows = [(i, "A" if i % 3 else "B", float(i)) for i in range(90)]
    for part in (rows[:40], rows[40:]):
        engine.append(spark.createDataFrame(part, "timestamp long, symbol string, close double").repartition(5))
    assert sorted(r["_seq"] for r in engine.store.log().collect()) == list(range(90))
    assert sorted(r["_seq"] for r in engine.store.log_between(37, 52).collect()) == list(range(38, 53))
    assert engine.store.manifest()["segments"][0]["symbols"] == ["A", "B"] and not engine.store.has_symbol("C")


def test_a_manifest_is_created_once(spark, tmp_path):
    files, uri = open_engine(spark, str(tmp_path)).store.files, f"{tmp_path}/m/1.json"
    assert files.create_json(uri, {"a": 1}) and not files.create_json(uri, {"a": 2})
    assert files.read_json(uri) == {"a": 1} and files.names(f"{tmp_path}/m") == ["1.json"]


def test_levels_merge_one_at_a_time(spark, tmp_path):
    engine = open_engine(spark, str(tmp_path))
    for i in range(10):
        engine.insert_batch("A", [{"timestamp": t, "close": float(i)} for t in range(i, i + 3)])
    segments = engine.store.manifest()["segments"]
    assert sorted(s["level"] for s in segments) == [0, 0, 1]
    # The merge of the second four left the level above it alone but for what overlaps it.
    assert {t["timestamp"]: t["close"] for t in engine.scan_iter("A", 0, 99)} == {t: float(min(t, 9)) for t in range(12)}


def test_background_compaction_stops(spark, tmp_path):
    engine = filled(spark, tmp_path, 3)
    stop = engine.compact_every(0.1)
    stop()
    assert engine.count_range("AAPL", 0, 2 * SECOND) == 3


def test_streaming_ingest_and_live_bars(spark, tmp_path):
    engine = filled(spark, tmp_path / "db", 3)
    source = tmp_path / "in"
    source.mkdir()
    (source / "a.json").write_text(json.dumps({"symbol": "AAPL", "timestamp": -5, "high": 999.0}) + "\n")
    ingest_json(spark, str(source), engine.store, str(tmp_path / "cp")).awaitTermination()
    late = engine.ticks(-5, -5)
    assert [(r["timestamp"], r["high"]) for r in maintain_bars(engine.ticks(), late, MINUTE).collect()] == [(0, 999.0)]


def test_cli(spark, tmp_path):
    engine = open_engine(spark, str(tmp_path))
    call = lambda *args: cli.run(engine, cli._parser().parse_args(args))
    assert call("insert", "A", "5", "--close", "2") == "1"
    assert call("count", "A", "0", "9") == "1"
    assert json.loads(call("range", "A", "0", "9", "--json"))[0]["close"] == 2
    assert call("query", "SELECT close FROM A WHERE timestamp BETWEEN 0 AND 9").startswith("1 rows")
    assert json.loads(call("stats"))["total_rows"] == 1

"""The engine: one store of ticks with queries, ingest, maintenance and replication."""

from __future__ import annotations

import contextlib
import threading
import uuid
from collections.abc import Callable, Iterable, Iterator, Mapping, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.errors import ReplicationError, StoreError, SymbolNotFound
from tidemark.operators import scan
from tidemark.operators.encodings import symbol_ids
from tidemark.plans import Query, explain_tree, parse, plan
from tidemark.schema import SEQ
from tidemark.sources import SegmentStore, from_columns, from_rows
from tidemark.sources.adapters import PLACE, column_parts, in_parts, spooled
from tidemark.streaming.replication import Replica, read_since

PRIMARY, REPLICA = "primary", "replica"


@dataclass(frozen=True)
class Config:
    """``auto_compact`` merges the levels that an append makes due. ``keep_all``, of a new store, keeps every tick, also those
    that share symbol and time, as different events may; otherwise the last written replaces the others. A replica is
    opened like its primary."""

    auto_compact: bool = True
    cold_tier_uri: str | None = None
    cold_tier_min_level: int = 2
    role: str = PRIMARY
    keep_all: bool = False


class Engine:
    def __init__(self, spark: SparkSession, path: str, config: Config | None = None):
        self.spark, self.config = spark, config or Config()
        self.store = SegmentStore(spark, path, self.config.keep_all)
        self._replica = Replica(self.store, self.config.role)

    # ingest

    def _writable(self) -> None:
        if self.config.role == REPLICA:
            raise ReplicationError("replica cannot accept writes")

    def append(self, ticks: DataFrame, order_by: str | None = None) -> int:
        """Upsert a DataFrame of ticks, the bulk path. Replicas refuse every write but replication."""
        self._writable()
        rows = self.store.append(ticks, order_by)
        if self.config.auto_compact:
            self.store.compact_due()
        return rows

    def insert(self, symbol: str, timestamp: int, open: float, high: float, low: float, close: float, volume: int) -> int:
        """Upsert one tick. Every call writes a segment; use a batch for more than a few."""
        row = {"symbol": symbol, "timestamp": timestamp, "open": open, "high": high, "low": low, "close": close, "volume": volume}
        return self.insert_multi([row])

    def insert_batch(self, symbol: str, rows: Iterable[Mapping]) -> int:
        return self.insert_multi(dict(row) | {"symbol": symbol} for row in rows)

    def insert_multi(self, rows: Iterable[Mapping]) -> int:
        """Upsert ticks of any symbols; the rows are read as they are needed, so they may come from an iterator."""
        return self._append_parts(from_rows(self.spark, part) for part in in_parts(rows))

    def insert_batch_columns(self, symbol: str, columns: Mapping[str, Sequence] | Iterable[Mapping[str, Sequence]]) -> int:
        """Upsert ticks from six arrays, or from some such mappings that are read one at a time."""
        mappings = [columns] if isinstance(columns, Mapping) else columns
        return self._append_parts(from_columns(self.spark, symbol, part) for whole in mappings for part in column_parts(whole))

    def _append_parts(self, parts: Iterable[DataFrame]) -> int:
        """Append parts as one segment, so that all or none of them are seen; the driver holds one at a time."""
        self._writable()
        folder = f"{self.store.path}/parts/{uuid.uuid4().hex}"
        try:
            ticks = spooled(parts, folder)
            if ticks is None:
                return 0
            return self.append(ticks, order_by=PLACE) if PLACE in ticks.columns else self.append(ticks.coalesce(1))
        finally:
            self.store.files.delete(folder)

    def insert_numpy(self, symbol, timestamps, open, high, low, close, volume) -> int:
        arrays = {"timestamp": timestamps, "open": open, "high": high, "low": low, "close": close, "volume": volume}
        return self.insert_batch_columns(symbol, arrays)

    # queries

    def ticks(self, start: int | None = None, end: int | None = None) -> DataFrame:
        return self.store.ticks(start, end)

    def _known(self, symbol: str) -> None:
        if not self.store.has_symbol(symbol):
            raise SymbolNotFound(symbol)

    def query(self, text: str | Query, compat: bool = False) -> DataFrame:
        """Result of a query; EXPLAIN gives one row with the plan tree."""
        query = parse(text) if isinstance(text, str) else text
        if query.explain:
            tree = explain_tree(query, self.store.stats()["total_rows"])
            return self.spark.createDataFrame([(tree,)], "explain_plan string")
        self._known(query.symbol)
        return plan(self.store.ticks(query.start, query.end, in_order=True), query, compat)

    def spark_explain(self, text: str) -> str:
        """The physical plan that Spark chose for a query."""
        return self.query(text)._jdf.queryExecution().toString()

    def query_range(self, symbol: str, start: int, end: int) -> DataFrame:
        return self.query(Query(symbol=symbol, start=start, end=end))

    def scan_stream(self, symbol: str, start: int, end: int) -> Iterator[dict]:
        self._known(symbol)
        return scan.iterate(scan.range_scan(self.store.ticks(start, end, in_order=True), symbol, start, end))

    scan_iter = scan_stream

    def count_range(self, symbol: str, start: int, end: int) -> int:
        self._known(symbol)
        return scan.count_range(self.ticks(start, end), symbol, start, end).first()["n"]

    def lookup(self, symbol: str, timestamp: int) -> DataFrame:
        """The ticks of that symbol and time: one at most, unless the store keeps all."""
        self._known(symbol)
        return scan.point_lookup(self.store.ticks(timestamp, timestamp, in_order=True), symbol, timestamp)

    def get(self, symbol: str, timestamp: int) -> dict | None:
        """The tick of that symbol and time that was written last."""
        found = self.lookup(symbol, timestamp)
        last = found.orderBy(F.col(SEQ).desc()).drop(SEQ) if SEQ in found.columns else found
        row = last.first()
        return row.asDict() if row else None

    def to_dict(self, text: str, compat: bool = False) -> dict:
        """Columns of a result as lists, with ``row_count``."""
        frame = self.query(text, compat).toPandas()
        return frame.to_dict("list") | {"row_count": len(frame)}

    def to_arrow(self, text: str, compat: bool = False) -> pa.Table:
        """A result as an Arrow table."""
        return self.query(text, compat).toArrow()

    def to_polars(self, text: str, compat: bool = False):
        """A result as a Polars frame, where Polars is installed."""
        import polars

        return polars.from_arrow(self.to_arrow(text, compat))

    # maintenance and introspection

    def compact(self) -> int:
        return self.store.compact()

    def compact_due(self) -> int:
        """Merge the levels that are due; returns how many were."""
        return self.store.compact_due()

    def compact_every(self, seconds: float) -> Callable[[], None]:
        """Merge due levels in the background, every so often (0.1 s at least); returns what stops that. A round that
        fails, as when another writer was faster, is made up for by the next."""
        stop = threading.Event()

        def work() -> None:
            while not stop.wait(max(seconds, 0.1)):
                with contextlib.suppress(StoreError):
                    self.store.compact_due()

        worker = threading.Thread(target=work, daemon=True)
        worker.start()
        return lambda: (stop.set(), worker.join()) and None

    def needs_compaction(self) -> bool:
        return bool(self.store.due_levels())

    def stats(self) -> dict:
        return self.store.stats()

    @property
    def path(self) -> str:
        return self.store.path

    def symbol_dict(self) -> DataFrame:
        return symbol_ids(self.store.log())

    def health(self) -> dict:
        return {"status": "ok", "role": self.config.role, "total_rows": self.stats()["total_rows"]}

    def sync_cold_tier(self) -> int:
        return self.store.archive(self.config.cold_tier_uri, self.config.cold_tier_min_level) if self.config.cold_tier_uri else 0

    def cold_tier_synced_count(self) -> int:
        return sum(s["archive"] is not None for s in self.store.manifest()["segments"])

    # replication

    @property
    def node_role(self) -> str:
        return self.config.role

    def read_wal_for_replication(self, after: int | None, limit: int) -> DataFrame:
        return read_since(self.store.log(), after, limit)

    def replication_last_applied(self) -> int:
        return self._replica.last_applied if self.config.role == REPLICA else 0

    def apply_replication_batch(self, entries: DataFrame) -> int:
        return self._replica.apply(entries)

    def replication_status(self, primary: Engine | None = None) -> dict:
        """The lag is a number of entries, as sequences are dense."""
        own = self.store.manifest()["next_seq"] - 1
        ahead = primary.store.manifest()["next_seq"] - 1 if primary else own
        return {"role": self.config.role, "wal_sequence": ahead, "last_primary_sequence": own, "lag": max(0, ahead - own)}


def open_engine(spark: SparkSession, path: str, **config) -> Engine:
    """Open or create the store at ``path``; keyword arguments are fields of :class:`Config`."""
    return Engine(spark, path, Config(**config))


__all__ = ["PRIMARY", "REPLICA", "SEQ", "Config", "Engine", "open_engine"]

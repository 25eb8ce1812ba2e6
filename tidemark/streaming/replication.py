"""Replication by reading the primary's log past a cursor."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.errors import ReplicationError
from tidemark.schema import SEQ
from tidemark.sources.store import SegmentStore


def read_since(log: DataFrame, after: int | None, limit: int) -> DataFrame:
    """The first ``limit`` rows with a sequence above ``after`` (from the start when None), ascending."""
    newer = log if after is None else log.filter(F.col(SEQ) > F.lit(after).cast("long"))
    return newer.orderBy(SEQ).limit(limit)


class Replica:
    """Cursor of a replica over its own store: the largest sequence applied, which survives in the manifest."""

    def __init__(self, store: SegmentStore, role: str = "replica"):
        self.store, self.role = store, role

    @property
    def last_applied(self) -> int:
        return self.store.manifest()["next_seq"] - 1

    def apply(self, entries: DataFrame) -> int:
        """Append a batch that carries its sequences; returns the number of entries, 0 for an empty batch."""
        if entries.isEmpty():
            return 0
        if self.role != "replica":
            raise ReplicationError("only replicas accept replication batches")
        return self.store.append_log(entries)

    def pull(self, primary: SegmentStore, batch: int = 500) -> int:
        """Apply what the primary has past the cursor, ``batch`` numbers at a time; returns the entries applied.

        Sequences are dense, so a batch is a range of them: the manifest tells which segments have some, and nothing
        is sorted. Numbers whose rows compaction has resolved away are passed over."""
        done, at = 0, self.last_applied
        while at < (newest := primary.manifest()["next_seq"] - 1):
            high = min(at + batch, newest)
            done += self.apply(primary.log_between(at, high))
            at = high
        return done

    def catch_up(self, primary: SegmentStore) -> int:
        """Apply all that the primary's newest manifest lists past the cursor, as one segment."""
        return self.apply(primary.log_between(self.last_applied, primary.manifest()["next_seq"] - 1))

    def follow(self, primary: SegmentStore, checkpoint: str, once: bool = True):
        """Stream the primary's manifests; each batch of new ones applies the rows they list past the cursor.

        Files that no manifest names are never read, a compaction brings no row twice, and a batch that is replayed
        finds its rows applied."""
        trigger = {"availableNow": True} if once else {"processingTime": "1 second"}
        stream = self.store.spark.readStream.schema("version long").option("pathGlobFilter", "*.json").json(f"{primary.path}/_manifest")
        return (
            stream.writeStream.foreachBatch(lambda _, __: self.catch_up(primary) and None)
            .option("checkpointLocation", checkpoint)
            .trigger(**trigger)
            .start()
        )

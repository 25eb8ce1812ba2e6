"""Append-only segment store.

A segment is a Parquet directory, written whole and never changed. What is visible is what the newest manifest
lists; manifests are numbered, written through a rename that does not overwrite, and never changed, so readers see all
of an append or none of it, and a lost executor leaves at most files that no manifest names. Rows keep their ingest
sequence, which is dense: the n-th row ever appended has n - 1. Reads resolve keys by it, compaction for good.

A segment of several partitions is written with the place of each row in its partition; the manifest holds where each
partition's numbers begin, so numbering costs no sort and no second write.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from tidemark.errors import StoreError
from tidemark.operators.dedup import last_write_wins
from tidemark.schema import COLUMNS, LOG_SCHEMA, SEQ, conform
from tidemark.sources.files import Files

# When a level counts as due for compaction.
LEVEL_ZERO_SEGMENTS = 4
LEVEL_ONE_BYTES = 4 * 1024 * 1024
LEVEL_GROWTH = 10
# Codecs: fast ones for what is soon merged, dense ones for what stays, with delta encoding of integers.
YOUNG = {"compression": "lz4_raw"}
SETTLED = {"compression": "zstd", "parquet.writer.version": "v2", "parquet.enable.dictionary#timestamp": "false"}
# Symbols of a segment are listed in its manifest entry up to so many.
LISTED_SYMBOLS = 10_000
# Of so few, symbols are listed and rows counted by partition in one go.
FEW_SYMBOLS = 100
# Places in a partition are the low bits of monotonically_increasing_id.
_PLACE_BITS = 33

_EMPTY = {"version": 0, "next_seq": 0, "inserted": 0, "segments": [], "read_bytes": 0, "written_bytes": 0, "batches": {}, "keep_all": False}


def level_limit(level: int) -> int:
    return LEVEL_GROWTH**level * LEVEL_ONE_BYTES


class SegmentStore:
    def __init__(self, spark: SparkSession, path: str, keep_all: bool = False):
        """With ``keep_all`` a new store keeps every tick, also those that share symbol and time. Its manifests say so."""
        self.spark, self.path, self.files = spark, path.rstrip("/"), Files(spark)
        self._empty = _EMPTY | {"keep_all": keep_all}

    # manifest

    def manifest(self) -> dict:
        names = [x for x in self.files.names(f"{self.path}/_manifest") if x.endswith(".json")]
        return _EMPTY | self.files.read_json(f"{self.path}/_manifest/{names[-1]}") if names else dict(self._empty)

    def _publish(self, manifest: dict) -> None:
        version = manifest["version"] + 1
        if not self.files.create_json(f"{self.path}/_manifest/{version:012d}.json", manifest | {"version": version}):
            raise StoreError(f"another writer published version {version}")

    def _segment(self, df: DataFrame, level: int, first_seq: int | None = None, symbols: set[str] | None = None) -> dict:
        """Write ``df``; with ``first_seq`` its sequence column holds places, to be numbered densely from there.
        ``symbols``, if known, are those of its rows."""
        name = uuid.uuid4().hex
        uri = f"{self.path}/segments/{name}"
        seen = Observation(f"segment_{name}")
        seq = F.col(SEQ)
        writer = df.observe(
            seen, F.count(F.lit(1)).alias("rows"), F.min(seq).alias("low"), F.max(seq).alias("high"),
            F.min("timestamp").alias("first"), F.max("timestamp").alias("last"), F.approx_count_distinct("symbol").alias("symbols"),
        ).write.option("parquet.bloom.filter.enabled#timestamp", "true")
        writer.options(**(SETTLED if level else YOUNG)).parquet(uri)
        found = seen.get
        segment = {
            "name": name, "level": level, "uri": uri, "rows": found["rows"], "bytes": self.files.size(uri), "min_seq": found["low"],
            "max_seq": found["high"], "first": found["first"], "last": found["last"], "archive": None, "begins": None,
        }
        if found["rows"]:
            counts: dict[int, int] = {}
            written = self.spark.read.schema(LOG_SCHEMA).parquet(uri)
            partition = F.shiftright(SEQ, _PLACE_BITS)
            several = first_seq is not None and found["high"] >> _PLACE_BITS > 0
            if several and symbols is None and found["symbols"] <= FEW_SYMBOLS:
                symbols = set()
                for at, symbol, n in written.groupBy(partition, "symbol").count().toLocalIterator():
                    counts[at] = counts.get(at, 0) + n
                    symbols.add(symbol)
            elif several:
                counts = dict(written.groupBy(partition).count().collect())
            if symbols is None:
                symbols = {r[0] for r in written.select("symbol").distinct().limit(LISTED_SYMBOLS + 1).collect()}
            segment["symbols"] = sorted(symbols) if len(symbols) <= LISTED_SYMBOLS else None
            if first_seq is not None:
                # The first number of each partition, by partition.
                begins = [first_seq]
                for at in range(found["high"] >> _PLACE_BITS):
                    begins.append(begins[-1] + counts.get(at, 0))
                segment |= {"min_seq": first_seq, "max_seq": first_seq + found["rows"] - 1, "begins": begins}
        return segment

    # writes

    def append(self, df: DataFrame, order_by: str | None = None, batch: tuple[str, int] | None = None) -> int:
        """Add ticks as one segment; returns the rows written.

        Later rows win over earlier ones of the same key. Within ``df`` the order is that of ``order_by``, else
        that of its partitions. ``batch`` names a stream and its batch: one that is in the manifest already, as after
        a failure, is not added again.
        """
        manifest = self.manifest()
        if batch is not None and manifest["batches"].get(batch[0], -1) >= batch[1]:
            return 0
        if order_by is not None:
            df = df.orderBy(order_by)
        placed = conform(df).withColumn(SEQ, F.monotonically_increasing_id())
        return self._add(manifest, self._segment(placed, 0, manifest["next_seq"]), batch)

    def append_log(self, log: DataFrame) -> int:
        """Add rows that already carry their sequence, as a replica does."""
        return self._add(self.manifest(), self._segment(log.select(*COLUMNS, SEQ), 0))

    def _add(self, manifest: dict, segment: dict, batch: tuple[str, int] | None = None) -> int:
        if not segment["rows"]:
            self.files.delete(segment["uri"])
            return 0
        self._publish(manifest | {
            "segments": [*manifest["segments"], segment],
            "next_seq": max(manifest["next_seq"], segment["max_seq"] + 1),
            "inserted": manifest["inserted"] + segment["rows"],
            "batches": manifest["batches"] | ({batch[0]: batch[1]} if batch else {}),
        })
        return segment["rows"]

    # reads

    def _numbered(self, segment: dict) -> Column:
        if segment["begins"] is None:
            return F.col(SEQ)
        place = F.col(SEQ).bitwiseAND(F.lit((1 << _PLACE_BITS) - 1))
        begins = F.array(*[F.lit(b).cast("long") for b in segment["begins"]])
        return place + F.element_at(begins, F.shiftright(SEQ, _PLACE_BITS).cast("int") + 1)

    def _read(self, segments: list[dict]) -> DataFrame:
        if not segments:
            return self.spark.createDataFrame([], LOG_SCHEMA)

        def rows(chosen: list[dict]) -> DataFrame:
            # Only what has a copy in the archive can be missing here.
            paths = [s["uri"] if s["archive"] is None or self.files.exists(s["uri"]) else s["archive"] for s in chosen]
            return self.spark.read.schema(LOG_SCHEMA).parquet(*paths)

        plain = [s for s in segments if s["begins"] is None]
        parts = [rows(plain)] if plain else []
        parts += [rows([s]).withColumn(SEQ, self._numbered(s)) for s in segments if s["begins"] is not None]
        return reduce(DataFrame.unionByName, parts)

    def log(self, start: int | None = None, end: int | None = None) -> DataFrame:
        """Every stored row with its sequence. Segments outside the time range are not opened."""
        segments = self.manifest()["segments"]
        if start is not None:
            segments = [s for s in segments if s["last"] >= start]
        if end is not None:
            segments = [s for s in segments if s["first"] <= end]
        return self._read(segments)

    def log_between(self, after: int, last: int) -> DataFrame:
        """Rows with a sequence above ``after`` and up to ``last``; segments without any are not opened, nothing is sorted."""
        segments = [s for s in self.manifest()["segments"] if s["max_seq"] > after and s["min_seq"] <= last]
        return self._read(segments).filter(F.col(SEQ).between(after + 1, last))

    def ticks(self, start: int | None = None, end: int | None = None, in_order: bool = False) -> DataFrame:
        """Resolved ticks, or all where the store keeps all; then ``in_order`` leaves them the sequence, which orders
        those of one time. One segment that compaction has resolved needs no shuffle."""
        manifest = self.manifest()
        if manifest["keep_all"]:
            return self.log(start, end) if in_order else self.log(start, end).drop(SEQ)
        if len(manifest["segments"]) == 1 and manifest["segments"][0]["level"] > 0:
            return self.log(start, end).drop(SEQ)
        return last_write_wins(self.log(start, end))

    def has_symbol(self, symbol: str) -> bool:
        """Whether any tick of it was ever stored: from the manifest, but for segments of very many symbols."""
        segments = self.manifest()["segments"]
        if any(symbol in (s["symbols"] or ()) for s in segments):
            return True
        unlisted = [s for s in segments if s["symbols"] is None]
        return bool(unlisted) and not self._read(unlisted).filter(F.col("symbol") == symbol).limit(1).isEmpty()

    # maintenance

    def due_levels(self) -> list[int]:
        """Level 0 by its number of segments, others by size. A level of one segment with nothing newer above it waits:
        to merge it would only write the same rows again, however large they are."""
        sizes: dict[int, list[int]] = {}
        for s in self.manifest()["segments"]:
            sizes.setdefault(s["level"], []).append(s["bytes"])
        newest = min(sizes, default=0)

        def due(level: int, held: list[int]) -> bool:
            if level == 0:
                return len(held) >= LEVEL_ZERO_SEGMENTS
            return sum(held) > level_limit(level) and (len(held) > 1 or level > newest)

        return sorted(k for k, v in sizes.items() if due(k, v))

    def _merge(self, manifest: dict, old: list[dict], level: int) -> dict:
        """Replace some segments by one, resolved (unless all is kept) and range-sorted; it is published before they are deleted."""
        rows = self._read(old)
        merged = rows if manifest["keep_all"] else last_write_wins(rows, keep_seq=True)
        ordered = merged.repartitionByRange("symbol", "timestamp").sortWithinPartitions("symbol", "timestamp")
        listed = [s["symbols"] for s in old]
        segment = self._segment(ordered, level, symbols=None if None in listed else set().union(*listed))
        gone = {s["name"] for s in old}
        self._publish(manifest | {
            "segments": [*(s for s in manifest["segments"] if s["name"] not in gone), segment],
            "read_bytes": manifest["read_bytes"] + sum(s["bytes"] for s in old),
            "written_bytes": manifest["written_bytes"] + segment["bytes"],
        })
        for s in old:
            self.files.delete(s["uri"])
        return segment

    def compact_level(self, level: int) -> int:
        """Merge a level, with what overlaps it in time on the next, into the next; returns the rows written there.

        Segments that are not touched keep their rows, so an append never rewrites the whole table. Rows of a key in
        different segments stay resolved by their sequence."""
        manifest = self.manifest()
        own = [s for s in manifest["segments"] if s["level"] == level]
        if not own:
            return 0
        first, last = min(s["first"] for s in own), max(s["last"] for s in own)
        below = [s for s in manifest["segments"] if s["level"] == level + 1 and s["first"] <= last and s["last"] >= first]
        return self._merge(manifest, own + below, level + 1)["rows"]

    def compact_due(self) -> int:
        """Merge levels that are due, deepest first, as what is merged into a level meets less there, until none is;
        returns how many were."""
        done = 0
        while due := self.due_levels():
            self.compact_level(due[-1])
            done += 1
        return done

    def compact(self) -> int:
        """Merge everything into one segment; returns its rows, 0 if there is nothing to merge."""
        manifest = self.manifest()
        old = manifest["segments"]
        if not old or len(old) == 1 and old[0]["level"] > 0:
            return 0
        return self._merge(manifest, old, max(s["level"] for s in old) + 1)["rows"]

    def archive(self, uri: str, min_level: int = 2) -> int:
        """Copy segments of ``min_level`` and above that have no copy yet; returns how many."""
        manifest = self.manifest()
        done, segments = 0, []
        for s in manifest["segments"]:
            if s["level"] >= min_level and s["archive"] is None:
                target = f"{uri.rstrip('/')}/{s['name']}"
                self.files.copy(s["uri"], target)
                s = s | {"archive": target}
                done += 1
            segments.append(s)
        if done:
            self._publish(manifest | {"segments": segments})
        return done

    def stats(self) -> dict:
        manifest = self.manifest()
        levels: dict[int, int] = {}
        for s in manifest["segments"]:
            levels[s["level"]] = levels.get(s["level"], 0) + s["bytes"]
        read = manifest["read_bytes"]
        return {
            "level_sizes": levels,
            "total_rows": sum(s["rows"] for s in manifest["segments"]),
            "inserted_rows": manifest["inserted"],
            "total_sstables": len(manifest["segments"]),
            "write_amplification_factor": manifest["written_bytes"] / read if read else 1.0,
            "bloom_filter_hit_rate": 0.0,
            "cache_hit_rate": 0.0,
        }

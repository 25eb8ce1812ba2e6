"""Where windows of a fixed size repeat: the distributed part that substring deduplication by words and by bytes share.

A *run* is a maximal sequence of windows of one document that chose one seed. Equal windows choose equal seeds, so
only runs whose seed is met more than once matter. They are found by counting seeds; a bitmap of fixed size, built
from the counts, keeps most other runs out of the shuffles that follow (what passes it wrongly is dropped by an exact
join, so it decides nothing).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import Texts, chunks, release, staged, text_key

# Bits of each filter: 16 MB whatever the input.
FILTER_BITS = 27


@dataclass
class Runs:
    """Runs of one chunk: document, seed, first window, number of windows, fingerprint of all content."""

    document: np.ndarray
    seed: np.ndarray
    start: np.ndarray
    windows: np.ndarray
    content: np.ndarray
    # Whether two windows of the run are equal.
    inner: np.ndarray


def runs_of(seeds: np.ndarray, bounds: np.ndarray, fingerprint: Callable, window: int, inner_of: Callable) -> Runs:
    """Runs by seed; 0 means that no window starts there. ``fingerprint`` is of the content from starts to ends;
    ``inner_of`` tells of first and last windows whether the run between them can hold two equal windows."""
    n = len(seeds)
    document = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    breaks = np.ones(n, dtype=bool)
    breaks[1:] = (seeds[1:] != seeds[:-1]) | (document[1:] != document[:-1])
    first = np.flatnonzero(breaks)
    count = np.diff(np.append(first, n))
    real = seeds[first] != 0
    first, count = first[real], count[real]
    content = fingerprint(first, first + count - 1 + window)
    own = document[first]
    return Runs(own, seeds[first], first - bounds[own], count, content, inner_of(first, first + count - 1))


Find = Callable[[Texts], tuple[Runs, Callable[[int], object]]]


def _signed(values: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(values).view(np.int64))


def seed_counts(documents: DataFrame, find: Find) -> DataFrame:
    """Seeds met more than once: seed, and ``same``, whether all their runs have equal content."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, texts in chunks(batch.column("text")):
                runs, _ = find(texts)
                # A run that repeats within itself counts as two of different content.
                seeds = np.concatenate([runs.seed, runs.seed[runs.inner]])
                content = np.concatenate([runs.content, ~runs.content[runs.inner]])
                yield pa.RecordBatch.from_arrays([_signed(seeds), _signed(content)], ["seed", "content"])

    found = documents.select("text").mapInArrow(run, "seed long, content long")
    counted = found.groupBy("seed").agg(F.count(F.lit(1)).alias("n"), F.min("content").alias("low"), F.max("content").alias("high"))
    return staged(counted.filter("n > 1").select("seed", (F.col("low") == F.col("high")).alias("same")))


def bitmap(values: DataFrame) -> np.ndarray:
    """The top bits of one column of 64-bit values as a bitmap of fixed size."""
    value = F.col(values.columns[0])
    place = F.shiftrightunsigned(value, 64 - FILTER_BITS)
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(place, F.lit(64)).cast("int"))
    got = values.groupBy(F.shiftrightunsigned(place, 6).alias("word")).agg(F.bit_or(bit).alias("bits")).toArrow()
    bits = np.zeros(1 << (FILTER_BITS - 6), np.uint64)
    bits[got.column("word").to_numpy()] = got.column("bits").to_numpy().view(np.uint64)
    return bits


def passes(bits: np.ndarray, seeds: np.ndarray) -> np.ndarray:
    place = seeds >> np.uint64(64 - FILTER_BITS)
    return (bits[place >> np.uint64(6)] >> (place & np.uint64(63))) & np.uint64(1) == 1


def keyed(documents: DataFrame) -> DataFrame:
    """doc_id, text_key and text: the key tells rows of one id with different texts apart."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), text_key().alias("text_key"), text.alias("text"))


def repeated_runs(documents: DataFrame, find: Find, payload: pa.DataType, payload_sql: str) -> DataFrame:
    """All runs of repeated seeds: doc_id, text_key, seed, same, start, windows, content and, for runs of seeds whose
    runs differ, ``payload``: what ``find`` gives for the run."""
    spark = documents.sparkSession
    counts = seed_counts(documents, find)
    release(spark)
    every, mixed = bitmap(counts.select("seed")), bitmap(counts.filter("NOT same").select("seed"))
    every_b, mixed_b = spark.sparkContext.broadcast(every), spark.sparkContext.broadcast(mixed)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc_ids, keys = batch.column("doc_id"), batch.column("text_key")
            for row, texts in chunks(batch.column("text")):
                runs, content_of = find(texts)
                keep = np.flatnonzero(passes(every_b.value, runs.seed))
                full = passes(mixed_b.value, runs.seed[keep])
                index = pa.array(row + runs.document[keep])
                extra = [content_of(runs, k) if f else None for k, f in zip(keep.tolist(), full.tolist(), strict=True)]
                columns = [
                    doc_ids.take(index), keys.take(index), _signed(runs.seed[keep]), pa.array(runs.start[keep]),
                    pa.array(runs.windows[keep]), _signed(runs.content[keep]), pa.array(extra, payload),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "text_key", "seed", "start", "windows", "content", "payload"])

    schema = f"doc_id long, text_key long, seed long, start long, windows long, content long, payload {payload_sql}"
    found = keyed(documents).mapInArrow(run, schema).join(counts, "seed")
    out = staged(found)
    release(spark)
    return out


def attach(documents: DataFrame, covered: DataFrame) -> DataFrame:
    """Every document with its covered ranges (doc_id, text_key, low, high) gathered in ``ranges``; rows that repeat share them."""
    ranges = covered.groupBy("doc_id", "text_key").agg(F.collect_set(F.struct("low", "high")).alias("ranges"))
    rows, ranges = keyed(documents).alias("d"), ranges.alias("r")
    same = F.col("d.doc_id").eqNullSafe(F.col("r.doc_id")) & (F.col("d.text_key") == F.col("r.text_key"))
    return rows.join(ranges, same, "left").select("d.doc_id", "d.text", "r.ranges")


def mask_of(ranges: list[dict] | None, n: int) -> np.ndarray:
    """Flags of the positions inside any range."""
    edges = np.zeros(n + 1, np.int64)
    if ranges:
        np.add.at(edges, [r["low"] for r in ranges], 1)
        np.add.at(edges, [r["high"] for r in ranges], -1)
    return np.cumsum(edges[:-1]) > 0

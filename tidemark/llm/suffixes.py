"""Substring deduplication by bytes: an enhanced suffix array with its common-prefix interval tree.

Suffixes that share 100 bytes or more also share the least 32-byte gram of their first 100 bytes, so the deep part of
the whole corpus's suffix array falls into buckets by that gram, its *seed*, and no interval of that depth lies in two buckets. Buckets
with one suffix per text hold no repeat and are dropped before any text moves; a bucket whose runs of suffixes are all
alike is one interval. For the others each task sorts the suffixes of its buckets, computes the common prefixes of
neighbours and scans them with a stack, which gives every interval of the tree; an interval whose suffixes are not
all preceded by the same byte is a maximal repeat, output with all its occurrences. Bytes are removed from every
occurrence of a maximal repeat but the first.

Copies of a run are counted before they are sorted: equal runs meet by partial aggregation as their first
occurrence, so copies by the thousand cost a bucket one run. A bucket of very many different runs is dealt again by
its windows, so that no task holds it whole. :func:`maximal_repeats` returns the groups themselves.

Defined cases: a null text is empty; documents shorter than a window lose nothing; the first occurrence is by doc_id
(nulls first), then start; rows of the same doc_id and text do not remove one another's bytes, as neither is
earlier; ties in order are broken by text; very long texts are one document each, and their runs are sorted in parts;
other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import Hasher, Texts, byte_names, cover_names, mix, release, staged
from tidemark.llm.repeats import Runs, attach, mask_of, repeated_runs, runs_of

WINDOW = 100
GRAM = 32
# Bytes of runs that a task sorts at once, suffixes in one sort, and different runs in a bucket that one task may hold.
SORTED_BYTES = 2 << 20
SORTED_SUFFIXES = 200_000
BUCKET_RUNS = 100_000
# Periodic text makes runs of any length; they are sorted in parts of so many windows, which bounds a suffix.
LONGEST_RUN = 80
_MASKS = np.array([0, *(2**64 - (1 << (64 - 8 * n)) for n in range(1, 9))], dtype=np.uint64)


def sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` consecutive values, by doubling."""
    least, size = values, 1
    while 2 * size <= width:
        least = np.minimum(least[:-size], least[size:])
        size *= 2
    rest = width - size
    return np.minimum(least[: len(least) - rest], least[rest:]) if rest else least


def seeds(texts: Texts, window: int, names: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each byte the least gram (of those named) of the window that starts there, or 0 if none does, and where that
    gram first stands."""
    n = len(texts.data)
    chosen, place = np.zeros(n, np.uint64), np.zeros(n, np.int64)
    if n < window:
        return chosen, place
    at, gram = np.arange(len(names)), n + 1 - len(names)
    grams = names | np.uint64(1)
    bits = np.uint64(int(n).bit_length())
    least = sliding_least((grams >> bits << bits) | at.astype(np.uint64), window - gram + 1)
    where = (least & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    place[: len(where)] = where
    chosen[: len(where)] = grams[where]
    last = np.repeat(texts.offsets[1:], np.diff(texts.offsets)) - window
    chosen[np.arange(n) > last] = 0
    return chosen, place


def find(texts: Texts, window: int = WINDOW, gram: int = GRAM) -> tuple[Runs, object]:
    """Runs of a chunk, and the bytes of any of them."""
    names = byte_names(texts.data, gram)
    chosen, place = seeds(texts, window, names)
    # Two equal windows have their least gram at the same offset, so it stands at two places of the run.
    content_of = lambda starts, ends: cover_names(names, gram, starts, ends)
    runs = runs_of(chosen, texts.offsets, content_of, window, lambda first, last: place[first] != place[last])

    def content(runs: Runs, k: int) -> bytes:
        first = texts.offsets[runs.document[k]] + runs.start[k]
        return texts.data[first : first + runs.windows[k] - 1 + window].tobytes()

    return runs, content


class Forest:
    """The deep intervals of the suffix array of some runs.

    Suffixes are given by run and offset, start at the windows of a run and end with it. ``order`` is the sorted array
    of those that share ``window`` bytes with another of their bucket; ``groups`` are intervals of it.
    """

    def __init__(self, runs: list[bytes], buckets: np.ndarray, window: int):
        self.window = window
        sizes = np.array([len(r) for r in runs], np.int64)
        self.begin = np.cumsum(sizes) - sizes
        self.data = np.frombuffer(b"".join(runs), np.uint8)
        count = sizes - window + 1
        self.run = np.repeat(np.arange(len(runs)), count)
        self.offset = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        self.at = self.begin[self.run] + self.offset
        self.end = (self.begin + sizes)[self.run]
        # Suffixes that share the first window: candidates by fingerprint, settled by their bytes below.
        prints = mix(byte_names(self.data, window)[self.at] ^ buckets[self.run])
        by_print = np.argsort(prints, kind="stable")
        same = prints[by_print][1:] == prints[by_print][:-1]
        shared = np.zeros(len(prints), dtype=bool)
        shared[1:] |= same
        shared[:-1] |= same
        self.candidates = by_print[shared]
        fresh = np.ones(len(self.candidates), dtype=bool)
        fresh[1:] = prints[self.candidates][1:] != prints[self.candidates][:-1]
        self.block = np.flatnonzero(fresh)
        self.depth = window + LONGEST_RUN
        self.word: np.ndarray | None = None

    def slices(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Candidates in runs of whole blocks, some SORTED_SUFFIXES at a time, and the block of each."""
        stops = np.append(self.block[1:], len(self.candidates))
        k = 0
        while k < len(self.block):
            stop = max(k + 1, int(np.searchsorted(stops, self.block[k] + SORTED_SUFFIXES, side="right")))
            yield self.candidates[self.block[k] : stops[stop - 1]], np.repeat(np.arange(stop - k), stops[k:stop] - self.block[k:stop])
            k = stop

    def keys(self, suffixes: np.ndarray) -> np.ndarray:
        """The first ``depth`` bytes of each suffix as big-endian words, zero past its end: (words, suffixes)."""
        words = -(-self.depth // 8)
        if self.word is None:
            padded = np.concatenate([self.data, np.zeros(8 * words + 8, np.uint8)]).astype(np.uint64)
            self.word = np.zeros(len(self.data) + 8 * words, np.uint64)
            for b in range(8):
                self.word |= padded[b : b + len(self.word)] << np.uint64(56 - 8 * b)
        at, size = self.at[suffixes], self.end[suffixes] - self.at[suffixes]
        return np.stack([self.word[at + 8 * w] & _MASKS[np.clip(size - 8 * w, 0, 8)] for w in range(words)])

    def common(self, suffixes: np.ndarray, keys: np.ndarray) -> np.ndarray:
        """The common prefix of each suffix with the one before it, from the second on."""
        differ = keys[:, 1:] ^ keys[:, :-1]
        first = np.argmax(differ != 0, axis=0)
        value = differ[first, np.arange(differ.shape[1])]
        leading = sum((value < np.uint64(1 << bits)).astype(np.int64) for bits in range(8, 64, 8))
        equal = np.where(value != 0, 8 * first + leading, 8 * len(keys))
        size = self.end[suffixes] - self.at[suffixes]
        return np.minimum(equal, np.minimum(size[1:], size[:-1]))

    def before(self, suffixes: np.ndarray) -> np.ndarray:
        """The byte before each suffix; at the start of a run, where none is known, a value of its own."""
        return np.where(self.offset[suffixes] > 0, self.data[np.maximum(self.at[suffixes] - 1, 0)].astype(np.int64), -1 - np.arange(len(suffixes)))

    def groups(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Maximal repeats, many at a time or one: occurrences as suffixes (a row per repeat), and lengths."""
        for suffixes, blocks in self.slices():
            size = np.bincount(blocks)[blocks]
            # Two suffixes are one interval, whichever stands first.
            two = suffixes[size == 2]
            if len(two):
                common, before = self.common(two, self.keys(two))[::2], self.before(two)
                repeat = (common >= self.window) & (before[::2] != before[1::2])
                yield two.reshape(-1, 2)[repeat], common[repeat]
            if (size > 2).any():
                yield from self._larger(suffixes[size > 2], blocks[size > 2])

    def _larger(self, suffixes: np.ndarray, blocks: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        keys = self.keys(suffixes)
        # Suffixes of a block have their first window in common, so it need not be compared to sort them.
        order = np.lexsort([*keys[: self.window // 8 - 1 : -1], blocks])
        ranked, keys, blocks = suffixes[order], keys[:, order], blocks[order]
        common = np.concatenate([[0], np.where(blocks[1:] == blocks[:-1], self.common(ranked, keys), 0)])
        before = self.before(ranked)
        first = np.flatnonzero(common < self.window)
        last = np.append(first[1:], len(ranked)) - 1
        for low, high in zip(first.tolist(), last.tolist(), strict=True):
            if high > low:
                for left, right, length in intervals(common[low : high + 1].tolist()):
                    inside = before[low + left : low + right + 1]
                    if (inside != inside[0]).any():
                        yield ranked[None, low + left : low + right + 1], np.array([length])


def intervals(common: list[int]) -> Iterator[tuple[int, int, int]]:
    """All intervals of a common-prefix array (its first entry is not used) by one scan with a stack: first and last
    rank, and length."""
    stack = [(0, 0)]  # length, first rank
    for rank in range(1, len(common) + 1):
        here = common[rank] if rank < len(common) else 0
        low = rank - 1
        while stack[-1][0] > here:
            length, low = stack.pop()
            yield low, rank - 1, length
        if stack[-1][0] < here:
            stack.append((here, low))


RANGES = "doc_id long, text_key long, low long, high long"


def _forest(rows: list[tuple], window: int) -> tuple[Forest, list, list, list]:
    """The intervals of some runs, and the document, start and text key of each part that a run is sorted in."""
    parts = [
        (seed, doc_id, start + cut, text_key, payload[cut : cut + LONGEST_RUN - 1 + window])
        for seed, doc_id, start, text_key, payload in rows
        for cut in range(0, len(payload) - window + 1, LONGEST_RUN)
    ]
    seed, doc_id, start, text_key, payload = (list(x) for x in zip(*parts, strict=True))
    return Forest(payload, np.array(seed, np.int64).view(np.uint64), window), doc_id, start, text_key


def _buckets(made_of) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Runs dealt and sorted by seed, some whole buckets at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("seed", "doc_id", "start", "text_key", "payload")), strict=True):
                if size > SORTED_BYTES and row[0] != held[-1][0]:
                    yield made_of(held)
                    held, size = [], 0
                held.append(row)
                size += len(row[4])
        if held:
            yield made_of(held)

    return run


def _covered(window: int):
    """Ranges that maximal repeats cover in all occurrences but their first, for runs dealt and sorted by seed."""

    def ranges(rows: list[tuple]) -> pa.RecordBatch:
        forest, doc_id, start, text_key = _forest(rows, window)
        # Occurrences in order of document and start.
        rank_of = {d: i for i, d in enumerate(sorted({(d is not None, d or 0, k) for d, k in zip(doc_id, text_key, strict=True)}))}
        place = np.array([rank_of[d is not None, d or 0, k] for d, k in zip(doc_id, text_key, strict=True)], np.int64)
        begin = np.array(start, np.int64)
        when = place[forest.run] * (1 << 40) + begin[forest.run] + forest.offset
        longest = np.zeros(len(forest.run), np.int64)
        for members, lengths in forest.groups():
            at = when[members]
            later = at > at.min(axis=1, keepdims=True)
            np.maximum.at(longest, members[later], np.repeat(lengths, later.sum(axis=1)))
        hit = np.flatnonzero(longest)
        run, low = forest.run[hit], begin[forest.run[hit]] + forest.offset[hit]
        high = low + longest[hit]
        # Ranges of one run that touch are one.
        new = np.ones(len(hit), dtype=bool)
        reach = np.maximum.accumulate(high + run * (1 << 40)) if len(hit) else high
        new[1:] = low[1:] + run[1:] * (1 << 40) > reach[:-1]
        head = np.flatnonzero(new)
        tail = np.append(head[1:], len(hit)) - 1 if len(hit) else head
        own = run[head]
        return pa.RecordBatch.from_arrays(
            [pa.array([doc_id[r] for r in own], pa.int64()), pa.array([text_key[r] for r in own], pa.int64()),
             pa.array(low[head]), pa.array(reach[tail] - own * (1 << 40))], [c.split()[0] for c in RANGES.split(", ")],
        )

    return _buckets(ranges)


GROUPS = "repeat long, length long, doc_id long, start long, text_key long"


def _groups(window: int):
    """Maximal repeats of runs dealt and sorted by seed, a row for each occurrence."""

    def repeats(rows: list[tuple]) -> pa.RecordBatch:
        forest, doc_id, start, text_key = _forest(rows, window)
        bytes_ = Hasher(forest.data)
        columns: list[list] = [[], [], []]
        for members, lengths in forest.groups():
            at = forest.at[members[:, 0]]
            columns[0].append(np.repeat(bytes_.of(at, at + lengths), members.shape[1]).view(np.int64))
            columns[1].append(np.repeat(lengths, members.shape[1]))
            columns[2].append(members.ravel())
        repeat, length, member = (np.concatenate([np.zeros(0, np.int64), *c]) for c in columns)
        run = forest.run[member]
        low = np.array(start, np.int64)[run] + forest.offset[member]
        return pa.RecordBatch.from_arrays(
            [pa.array(repeat), pa.array(length), pa.array([doc_id[r] for r in run], pa.int64()), pa.array(low), pa.array([text_key[r] for r in run], pa.int64())],
            [c.split()[0] for c in GROUPS.split(", ")],
        )

    return _buckets(repeats)


def _windows(window: int):
    """The windows of runs, one row each: print, doc_id, text_key, at."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "start", "text_key", "payload")), strict=True):
                raw = np.frombuffer(row[3], np.uint8)
                prints = byte_names(raw, window).view(np.int64)
                n = len(prints)
                at = np.arange(n)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(prints), pa.array([row[0]] * n, pa.int64()), pa.array(np.full(n, row[2])), pa.array(at + row[1])],
                    ["print", "doc_id", "text_key", "at"],
                )

    return run


def repeated_bytes(documents: DataFrame, window: int = WINDOW, gram: int = GRAM, bucket_runs: int = BUCKET_RUNS) -> DataFrame:
    """Ranges of bytes that occurred earlier: doc_id, text_key, low, high (exclusive)."""
    found = repeated_runs(documents, partial(find, window=window, gram=gram), pa.binary(), "binary")
    spot = F.struct("doc_id", "start", "text_key")
    # Copies of a run: all of it is covered but in the first.
    firsts = staged(found.groupBy("seed", "content", "windows").agg(
        F.min(spot).alias("first"), F.first("payload", ignorenulls=True).alias("payload"), F.count(F.lit(1)).alias("n"),
        F.first("same").alias("same"),
    ))
    release(documents.sparkSession)
    copied = firsts.filter("n > 1").select("seed", "content", "windows", "first")
    earlier = F.struct("first.doc_id", "first.start")
    copies = found.drop("payload").join(copied, ["seed", "content", "windows"]).filter(~F.struct("doc_id", "start").eqNullSafe(earlier))
    whole = copies.select("doc_id", "text_key", F.col("start").alias("low"), (F.col("start") + F.col("windows") - 1 + window).alias("high"))
    mixed = firsts.filter("NOT same").select("seed", "first.*", "payload")
    sizes = mixed.groupBy("seed").agg(F.count(F.lit(1)).alias("n"))
    large = sizes.filter(F.col("n") > bucket_runs).select("seed")
    dealt = mixed.join(large, "seed", "left_anti").repartition("seed").sortWithinPartitions("seed", "doc_id", "start", "text_key")
    trees = dealt.mapInArrow(_covered(window), RANGES)
    split = mixed.join(large, "seed", "left_semi").mapInArrow(_windows(window), "print long, doc_id long, text_key long, at long")
    first = split.groupBy("print").agg(F.min(F.struct("doc_id", "at")).alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    later = split.join(first, "print").filter(~F.struct("doc_id", "at").eqNullSafe(F.col("first")))
    parts = later.select("doc_id", "text_key", F.col("at").alias("low"), (F.col("at") + window).alias("high"))
    return whole.unionByName(trees).unionByName(parts)


def maximal_repeats(documents: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """All occurrences of maximal repeats of ``window`` bytes or more: repeat (equal for equal bytes), length, doc_id,
    text_key, start.

    A repeat is looked for inside runs, where it is followed as far as the run goes: one that goes on beyond is
    reported as several that overlap, at most ``window`` + LONGEST_RUN - 1 bytes each. Of a run's first suffixes the
    byte before is not known; they count as preceded by bytes of their own. Runs that are alike everywhere are one
    repeat each, with a number of their own.
    """
    found = repeated_runs(documents, partial(find, window=window, gram=gram), pa.binary(), "binary")
    alike = found.filter("same").select(
        F.xxhash64("seed", "content", "windows").alias("repeat"), (F.col("windows") - 1 + window).alias("length"), "doc_id", "start", "text_key"
    )
    dealt = found.filter("NOT same").select("seed", "doc_id", "start", "text_key", "payload").repartition("seed")
    return alike.unionByName(dealt.sortWithinPartitions("seed", "doc_id", "start", "text_key").mapInArrow(_groups(window), GROUPS))


def deduplicate(documents: DataFrame, window: int = WINDOW) -> DataFrame:
    """Every document without the bytes that occurred earlier: doc_id, kept (bytes), n_bytes, n_removed, n_spans."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text, ranges in zip(batch.column("text").to_pylist(), batch.column("ranges").to_pylist(), strict=True):
                raw = text.encode()
                gone = mask_of(ranges, len(raw)) if ranges else np.zeros(len(raw), dtype=bool)
                spans = int((gone[1:] & ~gone[:-1]).sum() + gone[:1].sum())
                kept = np.frombuffer(raw, np.uint8)[~gone].tobytes() if spans else raw
                rows.append((kept, len(raw), int(gone.sum()), spans))
            columns = zip(*rows, strict=True) if rows else [()] * 4
            kinds = (pa.binary(), pa.int64(), pa.int64(), pa.int64())
            names = ["doc_id", "kept", "n_bytes", "n_removed", "n_spans"]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names)

    covered = staged(repeated_bytes(documents, window))
    release(documents.sparkSession)
    return attach(documents, covered).mapInArrow(run, "doc_id long, kept binary, n_bytes long, n_removed long, n_spans long")


__all__ = ["Forest", "deduplicate", "intervals", "maximal_repeats", "repeated_bytes"]

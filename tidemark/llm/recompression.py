"""Substring deduplication by recompression: long word sequences that repeat, found through shared high-level symbols.

A document is a sequence of word codes. In rounds, runs of one symbol and then pairs of symbols get a new name, a
64-bit fingerprint of their parts: the same name everywhere for the same content, so no dictionary is exchanged. Which pairs
join is decided by a hash of each symbol alone (one class may begin a pair, the other may end one), so equal
substrings are parsed alike but for their edges. With each symbol goes the range of words that its forming depended
on; a symbol is *interior* to a window if that range lies in it, and then every equal window has it too.

Each window takes as its seed the longest interior symbol (ties by name). Equal windows have equal seeds, so:

1. runs of windows with one seed are counted by seed; seeds met once are done with, which is most of the text;
2. runs of repeated seeds are compared by the fingerprint of all their words: seeds whose runs are all alike
   prove every window of theirs a repeat at once;
3. for the other seeds, window fingerprints are counted, and windows met more than once are repeats.

Counting is by partial aggregation, so a passage in a third of all documents sends one row per task. The fingerprints
that decide are 64-bit ones of all words of a window or run.

Defined cases: a null text has no words; documents shorter than a window lose nothing; every row is a document, so
rows that repeat lose all their windows; a null doc_id is an id; other columns are ignored; an empty table gives no
rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import NON_SPACE, Texts, cover_names, discard, mix, release, staged, window_names
from tidemark.llm.repeats import Runs, attach, mask_of, repeated_runs, runs_of

WINDOW = 35
ROUNDS = 6
_RUN, _PAIR = np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA0761D6478BD642F)
_ONE = np.uint64(1)


class Symbols:
    """A parse of all documents of a chunk: names, first and last word, and the words that each depends on."""

    def __init__(self, codes: np.ndarray, bounds: np.ndarray):
        n = len(codes)
        self.codes = codes
        self.name = codes
        self.lo = self.hi = self.left = self.right = np.arange(n)
        self.doc = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
        self.fresh = np.ones(n, dtype=bool)

    def _joined_before(self) -> np.ndarray:
        """Whether a symbol of the same document stands before each."""
        out = np.zeros(len(self.name), dtype=bool)
        out[1:] = self.doc[1:] == self.doc[:-1]
        return out

    def _take(self, first: np.ndarray, last: np.ndarray, name: np.ndarray, left: np.ndarray, right: np.ndarray, fresh: np.ndarray) -> None:
        self.lo, self.hi, self.doc = self.lo[first], self.hi[last], self.doc[first]
        self.name, self.left, self.right, self.fresh = name, left, right, fresh

    def runs(self) -> None:
        """Name maximal runs. That a symbol's run ends shows in the next word if it differs, else in the next symbol."""
        n = len(self.name)
        inner = self._joined_before()
        same = np.zeros(n, dtype=bool)
        same[1:] = (self.name[1:] == self.name[:-1]) & inner[1:]
        first = np.flatnonzero(~same)
        last = np.append(first[1:], n) - 1
        count = last - first + 1
        # What lies before and after a run; at a document's edge its end is not in any window.
        has_before = inner[first]
        before = np.maximum(first - 1, 0)
        plain = self.codes[self.hi[before]] != self.codes[self.hi[first]]
        left = np.where(has_before, np.minimum(self.left[first], np.where(plain, self.lo[first] - 1, self.left[before])), -1)
        has_after = np.append(inner[1:], False)[last]
        after = np.minimum(last + 1, n - 1)
        plain = self.codes[self.lo[after]] != self.codes[self.lo[last]]
        right = np.where(has_after, np.maximum(self.right[last], np.where(plain, self.hi[last] + 1, self.right[after])), np.iinfo(np.int64).max)
        name = self.name[first]
        long = count > 1
        name = np.where(long, mix(name * _RUN + count.astype(np.uint64)), name)
        # Inside a run all members depend on one another only; the ends carry the range.
        self._take(first, last, name, left, right, long)

    def pairs(self, round_: int) -> None:
        """Join each symbol of the first class with a following one of the second."""
        n = len(self.name)
        inner = self._joined_before()
        ends = (mix(self.name + np.uint64(round_)) & _ONE).astype(bool)
        joins = np.zeros(n, dtype=bool)
        joins[1:] = ends[1:] & ~ends[:-1] & inner[1:]
        first = np.flatnonzero(~joins)
        last = first.copy()
        begins = np.append(joins[1:], False)[first]
        last[begins] += 1
        left, right = self.left[first], self.right[last]
        name = self.name[first]
        a, b = first[begins], last[begins]
        name = name.copy()
        name[begins] = mix(self.name[a] * _PAIR ^ mix(self.name[b] + _PAIR))
        left[begins] = np.minimum(self.left[a], self.left[b])
        right[begins] = np.maximum(self.right[a], self.right[b])
        # One that stayed single did so because of its neighbour: an ender because no beginner is before it.
        single = ~begins
        enders, beginners = single & ends[first], single & ~ends[first]
        before, after = np.maximum(first - 1, 0), np.minimum(first + 1, n - 1)
        left = np.where(enders, np.where(inner[first], np.minimum(left, self.left[before]), -1), left)
        follows = np.append(inner[1:], False)[first]
        right = np.where(beginners, np.where(follows, np.maximum(right, self.right[after]), np.iinfo(np.int64).max), right)
        self._take(first, last, name, left, right, begins)


def _spread_max(n: int, low: np.ndarray, high: np.ndarray, keys: np.ndarray, widest: int) -> np.ndarray:
    """For each of n places the largest key whose range [low, high] holds it, by doubling."""
    size = high - low + 1
    level = np.frexp(size)[1] - 1
    top = int(widest).bit_length()
    tables = [np.zeros(n, np.uint64) for _ in range(top)]
    for j in range(top):
        own = np.flatnonzero(level == j)
        np.maximum.at(tables[j], low[own], keys[own])
        np.maximum.at(tables[j], high[own] + 1 - (1 << j), keys[own])
    for j in range(top - 1, 0, -1):
        half, below = 1 << (j - 1), tables[j - 1]
        np.maximum(below, tables[j], out=below)
        if half < n:
            np.maximum(below[half:], tables[j][: n - half], out=below[half:])
    return tables[0]


def seeds(codes: np.ndarray, bounds: np.ndarray, window: int = WINDOW, rounds: int = ROUNDS) -> np.ndarray:
    """The seed of the window that starts at each word; 0 where none fits into the document."""
    n = len(codes)
    if not n:
        return np.zeros(0, np.uint64)
    symbols = Symbols(codes, bounds)
    lows, highs, keys = [], [], []
    final = np.repeat(bounds[1:], np.diff(bounds)) - window  # last start of a window in the word's document
    begin = np.repeat(bounds[:-1], np.diff(bounds))

    def offer(lo: np.ndarray, left: np.ndarray, right: np.ndarray, size: np.ndarray, name: np.ndarray) -> None:
        at = lo
        low = np.maximum(np.where(right < n, right, n + window) - window + 1, begin[at])
        high = np.minimum(np.where(left >= 0, left, -1), final[at])
        fits = (low <= high) & (left >= begin[at]) & (right < n)
        lows.append(low[fits])
        highs.append(high[fits])
        keys.append((size[fits].astype(np.uint64) << np.uint64(57)) | (name[fits] >> np.uint64(7)))

    for round_ in range(rounds):
        for step in (symbols.runs, lambda r=round_: symbols.pairs(r)):
            step()
            new = np.flatnonzero(symbols.fresh)
            offer(symbols.lo[new], symbols.left[new], symbols.right[new], np.minimum(symbols.hi[new] - symbols.lo[new] + 1, 127), symbols.name[new])
    best = _spread_max(n, np.concatenate(lows), np.concatenate(highs), np.concatenate(keys), window)
    starts_window = np.arange(n) <= final
    if (bare := np.flatnonzero((best == 0) & starts_window)).size:
        # No symbol is interior to these: words are, always.
        inside = bare[:, None] + np.arange(window)
        best[bare] = (codes[inside] >> np.uint64(7)).max(axis=1) | (_ONE << np.uint64(57))
    best[~starts_window] = 0
    return best


def words_of(texts: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends, codes of the words and bounds by document."""
    starts, ends, bounds = texts.words(NON_SPACE)
    return starts, ends, texts.word_hashes(starts, ends), bounds


def find(texts: Texts, window: int = WINDOW) -> tuple[Runs, object]:
    """Runs of a chunk, and the window fingerprints of any of them."""
    _, _, codes, bounds = words_of(texts)
    chosen, names = seeds(codes, bounds, window), window_names(codes, window)
    windows = np.zeros(len(codes), np.uint64)
    windows[: len(names)] = names
    at = np.flatnonzero(chosen != 0)
    order = at[np.argsort(windows[at], kind="stable")]
    # Equal windows of one run are neighbours in this order, for a run is contiguous.
    pairs = np.sort(order[1:][windows[order[1:]] == windows[order[:-1]]])

    def inner(first: np.ndarray, last: np.ndarray) -> np.ndarray:
        before = np.zeros(len(codes), np.int64)
        before[order[1:]] = order[:-1]
        own = pairs[np.searchsorted(first, pairs, side="right") - 1 == np.searchsorted(first, before[pairs], side="right") - 1]
        out = np.zeros(len(first), dtype=bool)
        out[np.searchsorted(first, own, side="right") - 1] = True
        return out

    runs = runs_of(chosen, bounds, lambda starts, ends: cover_names(names, window, starts, ends), window, inner)
    signed = windows.view(np.int64)

    def fingerprints(runs: Runs, k: int) -> np.ndarray:
        first = bounds[runs.document[k]] + runs.start[k]
        return signed[first : first + runs.windows[k]]

    return runs, fingerprints


def repeated_words(documents: DataFrame, window: int = WINDOW) -> DataFrame:
    """Ranges of words covered by repeated windows: doc_id, text_key, low, high (exclusive)."""
    found = repeated_runs(documents, partial(find, window=window), pa.list_(pa.int64()), "array<long>")
    at = ("doc_id", "text_key")
    whole = found.filter("same").select(*at, F.col("start").alias("low"), (F.col("start") + F.col("windows") - 1 + window).alias("high"))
    single = found.filter("NOT same").select(*at, "start", "seed", F.posexplode("payload").alias("nth", "print"))
    # Written first, so that both sides of the join are plain shuffles and a hot window's partition can be split.
    again = staged(single.groupBy("seed", "print").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("seed", "print"))
    release(documents.sparkSession)
    low = F.col("start") + F.col("nth")
    parts = single.join(again, ["seed", "print"]).select(*at, low.alias("low"), (low + window).alias("high"))
    return whole.unionByName(parts)


def deduplicate(documents: DataFrame, window: int = WINDOW) -> DataFrame:
    """Every document without the words that repeated windows cover: doc_id, kept (words joined by one space), n_words,
    n_removed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text, ranges in zip(batch.column("text").to_pylist(), batch.column("ranges").to_pylist(), strict=True):
                words = text.encode().split()
                gone = mask_of(ranges, len(words))
                removed = int(gone.sum())
                kept = [w for w, g in zip(words, gone.tolist(), strict=True) if not g] if removed else words
                rows.append((b" ".join(kept).decode(), len(words), removed))
            columns = zip(*rows, strict=True) if rows else [()] * 3
            kinds = (pa.string(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], ["doc_id", "kept", "n_words", "n_removed"])

    covered = staged(repeated_words(documents, window))
    release(documents.sparkSession)
    return attach(documents, covered).mapInArrow(run, "doc_id long, kept string, n_words long, n_removed long")

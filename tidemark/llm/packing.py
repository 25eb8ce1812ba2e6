"""Tokenised documents packed into sequences of a fixed length by best fit, with certified lower bounds.

A document's token ids, an end id appended, are cut into pieces of at most the sequence length only if they exceed it.
Pieces are packed by best-fit decreasing inside partitions of bounded size. Dual-feasible functions give each
partition a lower bound on its number of sequences: a partition that meets its bound is certified, and its sequences
stay. The others keep the sequences that are all but full and put the rest of their pieces in a pool; pools of several
partitions are dealt anew, fewer pieces to fewer partitions, and packed again, until all are certified, one partition is left
or a round saves no sequence.

The pieces table holds numbers only, so exchanging documents moves some 20 bytes a piece and no text. A partition's
size is a parameter and does not grow with the input.

Defined cases: a null text is empty and gives the end id alone; repeated rows are packed each; pieces of one length
are placed by key; a very long text is tokenized whole and gives as many pieces as it needs; a null doc_id is kept
as it is; other columns are ignored; an empty table gives no pieces.
"""

from __future__ import annotations

from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import staged

CAPACITY = 2048
END_ID = 0
PARTITION_PIECES = 100_000
# A sequence with no more than this part of its length free is not opened again.
KEPT_GAP = 1 / 256
# What each generation of the cache of parts holds at most, before a batch: entries and characters.
CACHED_WORDS = 300_000
CACHED_CHARS = 32 << 20

# Texts of these characters only are normalised by lower() alone and split by split(), as the tokenizer does it.
_PLAIN = regex.compile(r"[\t\n\r\x20-\x7eÀ-įı-ňŊ-ž‐-‧€]*+")
# Marks that the tokenizer splits off the end of a part that ends in a letter or digit before them.
_MARKS = ".,;:!?"
_MARK = "©"  # not among them, and one token


class PartCache(dict):
    """Ids by part in two generations: one that is full becomes the older, and what is asked for again moves up."""

    def __init__(self):
        super().__init__()
        self.older: dict[str, bytes] = {}
        self.chars = 0

    def __missing__(self, part: str) -> bytes:
        ids = self.older[part]
        self[part] = ids
        self.chars += len(part)
        return ids

    def turn(self) -> None:
        if len(self) >= CACHED_WORDS or self.chars >= CACHED_CHARS:
            self.older = dict(self)
            self.clear()
            self.chars = 0


class WordTokenizer:
    """Ids of texts as little-endian unsigned 32-bit bytes, with a cache of white-space-free parts.

    The tokenizer's words never cross white space, so the ids of a text are those of its parts in order. Texts with
    characters outside a plain set, or with a special token's string, go to the tokenizer whole.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer, normalizers

        self._whole = Tokenizer.from_file(path)
        # For parts of plain texts, which are normalised once they are lowered.
        self._bare = Tokenizer.from_file(path)
        self._bare.normalizer = normalizers.Sequence([])
        self._special = [x.content for x in self._whole.get_added_tokens_decoder().values()]
        self._cache = PartCache()
        self._mark = self._whole.encode(_MARK, add_special_tokens=False).ids
        if len(self._mark) != 1:
            raise ValueError("the separator is not one token of this vocabulary")

    def _encode(self, text: str, normalised: bool = False) -> np.ndarray:
        coder = self._bare if normalised else self._whole
        return np.array(coder.encode_batch_fast([text], add_special_tokens=False)[0].ids, dtype="<u4")

    def _encode_parts(self, parts: list[str]) -> list[bytes]:
        """All parts, lowered ones of plain texts, in one call, told apart by a separator that no part contains."""
        ids = self._encode(f" {_MARK} ".join(parts), normalised=True)
        raw, cuts = ids.tobytes(), (4 * np.flatnonzero(ids == self._mark[0])).tolist()
        return [raw[a:b] for a, b in zip([0, *(c + 4 for c in cuts)], [*cuts, len(raw)], strict=True)]

    def _learn(self, missing: set[str]) -> None:
        """Add parts to the cache."""
        cache = self._cache
        known = lambda part: part in cache or part in cache.older
        # Most parts are a word with a mark or two; the word alone has often been met.
        marked, new = [], set()
        for part in missing:
            core = part.rstrip(_MARKS)
            if core != part and core[-1:].isalnum():
                tail = part[len(core) :]
                marked.append((part, core, tail))
                new.update(x for x in (core, tail) if not known(x))
            else:
                new.add(part)
        words = list(new)
        cache.chars += sum(map(len, missing)) + sum(map(len, words))
        if words:
            cache.update(zip(words, self._encode_parts(words), strict=True))
        for part, core, tail in marked:
            cache[part] = cache[core] + cache[tail]

    def _ids(self, parts: list[str]) -> list[bytes]:
        """The ids of different parts."""
        ids = list(map(self._cache.get, parts))
        holes = [i for i, x in enumerate(ids) if x is None]
        if new := {parts[i] for i in holes} - self._cache.older.keys():
            self._learn(new)
        for i in holes:
            ids[i] = self._cache[parts[i]]
        return ids

    def encode(self, texts: list[str | None]) -> list[bytes]:
        self._cache.turn()
        out, plain = [b""] * len(texts), []
        for i, text in enumerate(texts):
            if text and _PLAIN.fullmatch(text) and not any(x in text for x in self._special):
                plain.append(i)
            elif text:
                out[i] = self._encode(text).tobytes()
        if plain:
            # Each different part of all these texts is looked up once; Arrow deals its ids to its places.
            cut = pc.ascii_split_whitespace(pa.array([texts[i].lower() for i in plain], pa.large_string()))
            coded = cut.values.dictionary_encode()
            flat = pa.array(self._ids(coded.dictionary.to_pylist()), pa.large_binary()).take(coded.indices)
            _, ends, raw = flat.buffers()
            at = np.frombuffer(ends, np.int64)[cut.offsets.to_numpy()].tolist()
            for k, i in enumerate(plain):
                out[i] = raw[at[k] : at[k + 1]].to_pybytes() if at[k + 1] > at[k] else b""
        return out


_tokenizers: dict[str, WordTokenizer] = {}


def tokenizer(path: str) -> WordTokenizer:
    """One tokenizer per worker process, with its cache."""
    if path not in _tokenizers:
        _tokenizers[path] = WordTokenizer(path)
    return _tokenizers[path]


def pieces(documents: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, and piece_key, unique over the table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, end = tokenizer(path), np.array([end_id], "<u4").tobytes()
        for batch in batches:
            doc_ids = batch.column("doc_id").to_pylist()
            texts = batch.column("text")
            rows: list[tuple] = []
            # Some documents at a time, so that ids of one batch stay small.
            for at in range(0, len(doc_ids), 1000):
                for doc_id, ids in zip(doc_ids[at : at + 1000], coder.encode(texts.slice(at, 1000).to_pylist()), strict=True):
                    ids += end
                    step = 4 * capacity
                    for piece, cut in enumerate(range(0, len(ids), step)):
                        part = ids[cut : cut + step]
                        rows.append((doc_id, piece, cut // 4, len(part) // 4, crc32(part)))
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            columns = zip(*rows, strict=True) if rows else [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long"
    cut = documents.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, schema)
    return cut.withColumn("piece_key", F.monotonically_increasing_id())


# Packing of one partition, on numbers alone.


def best_fit(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Best-fit decreasing: bin and offset of each item, and the number of bins.

    Bins are kept by what they have free; a bit mask of the free sizes in use finds the tightest that fits.
    """
    order = np.argsort(-lengths, kind="stable")
    bins, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    by_free: list[list[int]] = [[] for _ in range(capacity + 1)]
    mask = used = 0
    for i, size in zip(order.tolist(), lengths[order].tolist(), strict=True):
        fits = mask >> size
        if fits:
            free = size + (fits & -fits).bit_length() - 1
            place = by_free[free].pop()
            if not by_free[free]:
                mask &= ~(1 << free)
        else:
            free, place = capacity, used
            used += 1
        bins[i], offsets[i] = place, capacity - free
        left = free - size
        if left:
            by_free[left].append(place)
            mask |= 1 << left
    return bins, offsets, used


def lower_bound(lengths: np.ndarray, capacity: int) -> int:
    """The best of the total size and two families of dual-feasible functions.

    The first drops items of at most t and rounds those above capacity - t up to the whole (t up to half the
    capacity); the second rounds k + 1 times an item's share down and divides by k, keeping exact multiples.
    """
    if not len(lengths):
        return 0
    sizes, counts = np.unique(lengths, return_counts=True)
    best = -(-int(sizes @ counts) // capacity)
    for t in np.unique(np.concatenate([sizes[sizes * 2 <= capacity], capacity - sizes[sizes * 2 > capacity]])):
        big = int(counts[sizes > capacity - t].sum())
        middle = (sizes >= t) & (sizes <= capacity - t)
        best = max(best, big + -(-int(sizes[middle] @ counts[middle]) // capacity))
    for k in range(1, 21):
        whole = (k + 1) * sizes % capacity == 0
        scaled = np.where(whole, sizes * k, (k + 1) * sizes // capacity * capacity)
        best = max(best, -(-int(scaled @ counts) // (capacity * k)))
    return best


PLACED = "piece_key long, length long, sequence_id long, offset long, settled boolean, sequences long, bound long"


def _pack_partition(capacity: int, round_: int, last: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        frame = pa.Table.from_batches(held)
        group = frame.column("pool")[0].as_py()
        keys, lengths = (frame.column(n).to_numpy() for n in ("piece_key", "length"))
        order = np.lexsort((keys, -lengths))
        keys, lengths = keys[order], lengths[order]
        bins, offsets, used = best_fit(lengths, capacity)
        bound = lower_bound(lengths, capacity)
        load = np.bincount(bins, lengths, used)
        settled = np.full(len(keys), True) if last or used == bound else (load >= capacity * (1 - KEPT_GAP))[bins]
        ids = (np.int64(round_) << 58) + (np.int64(group) << 28) + bins
        n = len(keys)
        columns = [keys, lengths, ids, offsets, settled, np.full(n, used), np.full(n, bound)]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], [c.split()[0] for c in PLACED.split(", ")])

    return run


def pack(items: DataFrame, capacity: int = CAPACITY, partition_pieces: int = PARTITION_PIECES) -> DataFrame:
    """Sequence and offset of every item (piece_key, length): piece_key, sequence_id, offset, and of the partition that
    settled it: its sequences and their lower bound (equal where it is certified)."""
    columns = ("piece_key", "sequence_id", "offset", "sequences", "bound")
    whole = items.filter(F.col("length") == capacity).select(
        "piece_key", (F.lit(1 << 62).cast("long") + F.col("piece_key") % F.lit(1 << 61)).alias("sequence_id"), F.lit(0).cast("long").alias("offset"),
        F.lit(1).cast("long").alias("sequences"), F.lit(1).cast("long").alias("bound"),
    )
    done, pool = whole, items.filter(F.col("length") < capacity).select("piece_key", "length")
    n, round_, before = pool.count(), 0, None
    while n:
        parts = -(-n // partition_pieces)
        dealt = pool.withColumn("pool", F.pmod(F.xxhash64("piece_key", F.lit(round_)), F.lit(parts)).cast("int"))
        placed = staged(dealt.repartitionById(parts, F.col("pool")).mapInArrow(_pack_partition(capacity, round_, parts == 1), PLACED))
        if before is not None:
            # Dealing anew must save sequences, or the last packing of these pieces stays and rounds end.
            old, used = before.select("sequence_id").distinct().count(), placed.select("sequence_id").distinct().count()
            if used >= old:
                return done.unionByName(before.select(*columns))
        done = done.unionByName(placed.filter("settled").select(*columns))
        before = placed.filter("NOT settled")
        pool = before.select("piece_key", "length")
        n, round_ = pool.count(), round_ + 1
    return done


def packed(documents: DataFrame, path: str) -> DataFrame:
    """The pieces of all documents with their sequence and offset, and their partition's sequences and lower bound."""
    cut = staged(pieces(documents, path))
    return cut.join(pack(cut), "piece_key").drop("piece_key")

"""Shared plumbing: staging in the folder that the cluster shares, Arrow batches, and word hashing on raw bytes."""

from __future__ import annotations

import atexit
import contextlib
import gc
import hashlib
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Text that is handled at once: bounds what vectorised code allocates, whatever the size of an Arrow batch, and keeps its
# arrays in the processor's cache (at eight times the size the same steps take three to four times as long).
CHUNK_BYTES = 1 << 17
# Rows and bytes of an Arrow batch: bound what one batch of long texts takes.
BATCH_ROWS = 1000
BATCH_BYTES = 32 << 20


def prepare(spark: SparkSession) -> None:
    """Bound Arrow batches by rows and, where Spark can, by bytes. The setting stays: plans read it when they run."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def shared_folder(spark: SparkSession) -> str:
    """A new folder under spark.checkpoint.dir. Where that is unset, a local session uses its warehouse; a cluster is
    refused, as nothing else is known to be shared."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = spark.conf.get("spark.sql.warehouse.dir")
    return f"{root}/llm-{uuid.uuid4().hex}"


_FOLDERS: list[tuple[SparkSession, str]] = []


def staged(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read back: a lost executor costs no recomputation of what led to it.

    :func:`discard` deletes it; what is never discarded, as the result still reads it, goes when Python ends.
    """
    spark = df.sparkSession
    folder = shared_folder(spark)
    df.write.parquet(folder)
    back = spark.read.schema(df.schema).parquet(folder)
    back._staged = folder
    _FOLDERS.append((spark, folder))
    return back


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def discard(*frames: DataFrame) -> None:
    """Delete what :func:`staged` wrote, once nothing reads it any more."""
    for df in frames:
        if folder := getattr(df, "_staged", None):
            _delete(df.sparkSession, folder)
            _FOLDERS.remove((df.sparkSession, folder))
            df._staged = None


@atexit.register
def _sweep() -> None:
    for spark, folder in _FOLDERS:
        # A session that has ended, or whose JVM is gone, deletes nothing.
        with contextlib.suppress(Exception):
            if spark.sparkContext._jsc is not None:
                _delete(spark, folder)
    _FOLDERS.clear()


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of plans that are done with: its cleaner acts when the driver's heap is collected."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def fresh(df: DataFrame, stem: str) -> str:
    """A column name that ``df`` does not have in any case."""
    name, taken = f"_{stem}", {c.lower() for c in df.columns}
    while name in taken:
        name = f"_{name}"
    return name


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def map_rows(df: DataFrame, fn: Callable[[list[list]], Iterable[tuple]], schema: str, *columns: str) -> DataFrame:
    """Rows that ``fn`` makes of each batch of the given columns, as Python lists."""
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = None
        for batch in batches:
            rows = list(fn([batch.column(i).to_pylist() for i in range(batch.num_columns)]))
            kinds = kinds or target
            yield pa.RecordBatch.from_arrays([pa.array(c, kinds[i]) for i, c in enumerate(zip(*rows, strict=True))] if rows else [pa.array([], k) for k in kinds], names)

    target = arrow_types(df.sparkSession, schema)
    return df.select(*columns).mapInArrow(run, schema)


def edit_batches(df: DataFrame, edit: Callable[[pa.RecordBatch], pa.RecordBatch]) -> DataFrame:
    """``df`` with each batch, all columns of it, passed through ``edit``, which keeps the columns."""
    return df.mapInArrow(lambda batches: map(edit, batches), df.schema)


# Rows that may be broadcast: some MB of keys.
BROADCAST_ROWS = 200_000


def without(df: DataFrame, rejected: DataFrame) -> DataFrame:
    """Rows of documents whose (doc_id, text_key) is not among ``rejected``. Those are broadcast if they are counted
    to be few, so that texts stay where they are, and shuffled otherwise."""
    id_, key = fresh(df, "id"), fresh(df, "key")
    gone = staged(rejected.select(F.col("doc_id").alias(id_), F.col("text_key").alias(key)).distinct())
    if gone.count() <= BROADCAST_ROWS:
        gone = F.broadcast(gone)
    same = F.col("doc_id").cast("long").eqNullSafe(F.col(id_)) & (text_key() == F.col(key))
    return df.join(gone, same, "left_anti")


def text_key() -> Column:
    """Tells rows of one doc_id with different texts apart."""
    return F.xxhash64(F.coalesce(F.col("text"), F.lit("")))


def arrow_types(spark: SparkSession, schema: str) -> list[pa.DataType]:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(schema)).types


# Words on bytes.


def word_table(extra: Iterable[int] = (), *, separators: Iterable[int] | None = None) -> np.ndarray:
    """256 flags: which bytes belong to words. By default ASCII letters and digits and all of 0x80 to 0xFF."""
    flags = np.zeros(256, dtype=bool)
    if separators is not None:
        flags[:] = True
        flags[list(separators)] = False
        return flags
    flags[0x80:] = True
    for low, high in ((0x30, 0x3A), (0x41, 0x5B), (0x61, 0x7B)):
        flags[low:high] = True
    flags[list(extra)] = True
    return flags


ALNUM = word_table()
NON_SPACE = word_table(separators=(0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D))
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32

# Hashing. No polynomials: those have structure (two strings of the Thue-Morse form collide modulo 2**64 under every base).
# Bytes are taken eight at a time through a bijective scrambling, and windows of codes are named by halves, so that what is
# equal has equal fingerprints and all else collides by chance only. Where equality is decided, both lanes are compared.
_LANES = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))
_ODD = np.uint64(0xD6E8FEB86659FD93)
_FIRST_BYTES = np.array([(1 << 8 * n) - 1 for n in range(9)], dtype=np.uint64)
# Longer ranges are hashed one at a time.
LONG_RANGE = 2048


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = x ^ (x >> np.uint64(31))
    x *= np.uint64(0x7FB5D329728EA185)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x81DADEF4BC2DD44D)
    x ^= x >> np.uint64(33)
    return x


def pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The name of two names in order."""
    return mix(a * _ODD + b)


class Hasher:
    """Fingerprints of any ranges of some bytes."""

    def __init__(self, data: np.ndarray):
        self.data = data
        padded = np.concatenate([data, np.zeros(8, np.uint8)])
        # The eight bytes from every place on.
        self.word = np.ndarray(len(data) + 1, "<u8", padded, strides=(1,))

    def of(self, starts: np.ndarray, ends: np.ndarray, lane: int = 0) -> np.ndarray:
        """64-bit fingerprint of the bytes from each start to before each end; it also holds the length."""
        size = ends - starts
        state = mix(size.astype(np.uint64) + _LANES[lane])
        if not len(size):
            return state
        state = mix(state ^ (self.word[starts] & _FIRST_BYTES[np.minimum(size, 8)]))
        rows = np.flatnonzero(size > 8)
        if len(rows) and int(size.max()) > LONG_RANGE:
            far = size[rows] > LONG_RANGE
            for i in rows[far].tolist():
                raw = hashlib.blake2b(self.data[starts[i] : ends[i]].tobytes(), digest_size=16).digest()
                state[i] = np.frombuffer(raw, np.uint64)[lane]
            rows = rows[~far]
        at = 8
        while len(rows):
            left = size[rows] - at
            state[rows] = mix(state[rows] ^ (self.word[starts[rows] + at] & _FIRST_BYTES[np.minimum(left, 8)]))
            rows = rows[left > 8]
            at += 8
        return state


def code_hasher(codes: np.ndarray) -> Callable[[np.ndarray, np.ndarray, int], np.ndarray]:
    """Fingerprints of ranges of a sequence of 64-bit codes, by first and last place (exclusive) and lane."""
    hasher = Hasher(np.ascontiguousarray(codes).view(np.uint8))
    return lambda starts, ends, lane=0: hasher.of(8 * starts, 8 * ends, lane)


def byte_names(data: np.ndarray, width: int) -> np.ndarray:
    """A name of the ``width`` bytes (8 or more) from each place on that has so many, by doubling."""
    if len(data) < width:
        return np.zeros(0, np.uint64)
    names, size = mix(Hasher(data).word[: len(data) - 7] + _LANES[0]), 8
    while 2 * size <= width:
        names = pair(names[:-size], names[size:])
        size *= 2
    rest = width - size
    return pair(names[:-rest], names[rest:]) if rest else names


def cover_names(names: np.ndarray, width: int, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Fingerprints of ranges of ``width`` places or more, from the names of the windows that cover them."""
    state = mix((ends - starts).astype(np.uint64) + _LANES[1])
    state = pair(state, names[ends - width])
    rows, at = np.arange(len(starts)), 0
    while len(rows):
        state[rows] = pair(state[rows], names[starts[rows] + at])
        at += width
        rows = rows[starts[rows] + at < ends[rows] - width]
    return state


def window_names(codes: np.ndarray, width: int, lane: int = 0) -> np.ndarray:
    """A name of the ``width`` codes from each place on that has so many, by doubling."""
    if len(codes) < width:
        return np.zeros(0, np.uint64)
    names, size = mix(codes + _LANES[lane]), 1
    while 2 * size <= width:
        names = pair(names[:-size], names[size:])
        size *= 2
    rest = width - size
    return pair(names[:-rest], names[rest:]) if rest else names


class Texts:
    """Some documents as one array of bytes; document i is ``data[offsets[i]:offsets[i + 1]]``."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.data, self.offsets = data, offsets

    def __len__(self) -> int:
        return len(self.offsets) - 1

    def words(self, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start and end of each word, and ``bounds``: the words of document i are bounds[i] to bounds[i + 1]."""
        inside = table[self.data]
        edge = self.offsets[:-1][np.diff(self.offsets) > 0]
        before = np.zeros_like(inside)
        before[1:] = inside[:-1]
        before[edge] = False
        starts = np.flatnonzero(inside & ~before)
        after = np.zeros_like(inside)
        after[:-1] = inside[1:]
        after[edge[1:] - 1] = False
        ends = np.flatnonzero(inside & ~after) + 1
        return starts, ends, np.searchsorted(starts, self.offsets)

    def hasher(self, fold_case: bool = False) -> Hasher:
        """Fingerprints of any byte ranges, with ASCII case folded or not."""
        return Hasher(LOWER[self.data] if fold_case else self.data)

    def word_hashes(self, starts: np.ndarray, ends: np.ndarray, fold_case: bool = False, lane: int = 0) -> np.ndarray:
        return self.hasher(fold_case).of(starts, ends, lane)


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column without copying; nulls are empty."""
    column = column.cast(pa.large_string()) if not pa.types.is_large_string(column.type) else column
    if column.null_count:
        column = column.fill_null("")
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8), ends


def chunks(column: pa.Array) -> Iterator[tuple[int, Texts]]:
    """The column in runs of documents of about CHUNK_BYTES, at least one document each, with the first one's row."""
    if not len(column):
        return
    data, ends = utf8(column)
    row = 0
    while row < len(column):
        stop = max(row + 1, int(np.searchsorted(ends, ends[row] + CHUNK_BYTES, side="right")) - 1)
        yield row, Texts(data[ends[row] : ends[stop]], ends[row : stop + 1] - ends[row])
        row = stop


def in_common(sets: list[np.ndarray]) -> np.ndarray:
    """How many values each two of some arrays, of different values each, have in common.

    Values that one set alone has cannot be shared; the others are columns of an incidence matrix, a slab at a time.
    """
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, column, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = count[column] > 1
    owner, column = owner[shared], (np.cumsum(count > 1) - 1)[column[shared]]
    common = np.zeros((len(sets), len(sets)), np.float32)
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    slab = 4096
    last = int(column[-1]) + 1 if len(column) else 0
    for low in range(0, last, slab):
        part = slice(*np.searchsorted(column, [low, low + slab]))
        held = np.zeros((len(sets), min(slab, last - low)), np.float32)
        held[owner[part], column[part] - low] = 1
        common += held @ held.T
    return common

"""Jaccard self-join of documents on word n-grams by the chosen-path method.

A document is its set of 5-word shingles (all its words as one, if fewer). Documents with one set are one *node*; sets are
equal if 128 bits of fingerprint are. A node's sketch holds least hashes of its shingles: 32 of them, in full, choose
paths (two sets share one with probability equal to their similarity), and 4 bits each of 512 others, its *filter*,
estimate similarities. Chosen paths split nodes recursively: each run starts from its own coordinates; nodes that
share the token at a path's coordinate are a bucket; a bucket of no more than BUCKET nodes is compared by brute force,
on filters, block against block, and a larger one is split again on BRANCHES more coordinates that its path has not
used. (A comparison of filters costs a tenth of a microsecond, so splitting pays only where buckets are large.) Runs are
repeated until a pair at the threshold is met with the target recall. A bucket of several blocks most of whose nodes have
filters like its representative's holds near copies, which no split parts: it becomes a candidate group, and is
neither compared nor split. Documents that share a template but are less alike are compared or split.

Candidate groups (components of the pairs whose filters agree) are then verified on whole shingle sets: within a
group all pairs are compared, block against block, each once, so no task holds more than two blocks; a task returns its
nodes' numbers of links and a spanning forest, never the pairs. The components of the verified links are the classes. Similarities are
exact; what a run can miss is a pair that shares no bucket and no group, or whose filters agree by four standard
deviations less than a pair's at the threshold.

Defined cases: null texts and texts without a word have no shingles, no links and a class of their own; rows that
repeat are documents that link to one another; class_id is the smallest doc_id of the class, null if it has none, and of
several texts of that doc_id the one with the least hash is the class's first;
ties in size or similarity need no order; very long texts are sets like others, and blocks are bounded by tokens; other
columns are ignored, whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import ALNUM, Texts, chunks, code_hasher, discard, fresh, in_common, mix, pair, release, staged, text_key, window_names, without
from tidemark.llm.graph import components
from tidemark.llm.repeats import bitmap, passes

SHINGLE = 5
THRESHOLD = 0.8
TARGET_RECALL = 0.9999
COORDINATES = 32
BRANCHES = 2
BUCKET = 20_000
# Path coordinates are used up by then; what is still large becomes a group.
DEPTH = 24
# A bucket of several blocks is a group if half of its nodes are at least this similar to its representative.
ALIKE = 0.65
# Blocks of a bucket by nodes, of a group by nodes and by tokens.
BLOCK = 1024
BLOCK_TOKENS = 400_000
FILTER = 512
# Filters agree where tokens do, and in one of 16 other cases; four standard deviations less than at the threshold.
_CHANCE = THRESHOLD + (1 - THRESHOLD) / 16
_NEAR = math.floor(FILTER * (ALIKE + (1 - ALIKE) / 16))
_AGREE = math.floor(FILTER * (_CHANCE - 4 * math.sqrt(_CHANCE * (1 - _CHANCE) / FILTER)))

_rng = np.random.Generator(np.random.PCG64(977))
_FACTORS = _rng.integers(0, 2**31, COORDINATES + FILTER, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_MASKS = _rng.integers(0, 2**32, COORDINATES + FILTER, dtype=np.uint32)


def recall(runs: int, threshold: float = THRESHOLD) -> float:
    """Least probability that a pair at the threshold shares a path in some run, however deep."""
    alive = 1.0
    for _ in range(DEPTH):
        alive = 1 - (1 - threshold * alive) ** BRANCHES
    return 1 - (1 - alive) ** runs


RUNS = next(n for n in range(1, COORDINATES // BRANCHES + 1) if recall(n) >= TARGET_RECALL)


def shingle_sets(texts: Texts, n: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of all documents, by document and ascending, and their bounds."""
    starts, ends, bounds = texts.words(ALNUM)
    codes = texts.word_hashes(starts, ends, fold_case=True)
    size = np.diff(bounds)
    count = np.where(size >= n, size - n + 1, np.minimum(size, 1))
    document = np.repeat(np.arange(len(texts)), count)
    first = bounds[:-1][document] + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    short = size[document] < n
    hashes = np.empty(len(first), np.uint64)
    hashes[~short] = window_names(codes, n)[first[~short]]
    hashes[short] = code_hasher(codes)(first[short], bounds[1:][document[short]])
    order = np.lexsort((hashes, document))
    hashes, document = hashes[order], document[order]
    new = np.ones(len(hashes), dtype=bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (document[1:] != document[:-1])
    return hashes[new], np.searchsorted(document[new], np.arange(len(texts) + 1))


def sketches(tokens: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For every set a row of COORDINATES least hashes, and its filter as bytes; none may be empty."""
    n = len(bounds) - 1
    least = np.empty((n, COORDINATES), np.uint32)
    low = np.empty((n, FILTER), np.uint8)
    if n:
        small = (tokens >> np.uint64(32)).astype(np.uint32)
        for k in range(COORDINATES + FILTER):
            value = np.minimum.reduceat((small ^ _MASKS[k]) * _FACTORS[k], bounds[:-1])
            if k < COORDINATES:
                least[:, k] = value
            else:
                # The least values are small numbers: their bits are scrambled before some are kept.
                low[:, k - COORDINATES] = (value * np.uint32(0x9E3779B1)) >> np.uint32(28)
    return least, low[:, ::2] | low[:, 1::2] << np.uint8(4)


def agreement(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """In how many places the filters in the rows of ``a`` and ``b`` (64-bit words) agree."""
    apart = a ^ b
    apart |= apart >> np.uint64(2)
    apart |= apart >> np.uint64(1)
    apart &= np.uint64(0x1111111111111111)
    return FILTER - np.bitwise_count(apart).sum(axis=-1, dtype=np.int64)


def roots(least: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first path of every run's branches, and the coordinate that each has used; runs start from their own."""
    at = np.arange(RUNS * BRANCHES, dtype=np.uint64)
    paths = mix(least[:, : len(at)].astype(np.uint64) | (at << np.uint64(32)) | np.uint64(1 << 60))
    return paths, np.broadcast_to(np.uint64(1) << at, paths.shape)


def children(paths: np.ndarray, used: np.ndarray, least: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The paths that each path of a set goes on to, a row of BRANCHES per path, and what those have used."""
    out, marks = (np.empty((len(paths), BRANCHES), np.uint64) for _ in range(2))
    taken = used.copy()
    for k in range(BRANCHES):
        at = mix(paths + np.uint64(k + 1)) % np.uint64(COORDINATES)
        for _ in range(COORDINATES):
            busy = (taken >> at) & np.uint64(1) == 1
            if not busy.any():
                break
            at = np.where(busy, (at + np.uint64(1)) % np.uint64(COORDINATES), at)
        taken |= np.uint64(1) << at
        value = least[np.arange(len(paths)), at.astype(np.int64)].astype(np.uint64)
        out[:, k] = pair(paths, mix(value | (at << np.uint64(32))))
        marks[:, k] = used | (np.uint64(1) << at)
    return out, marks


def _identity(tokens: np.ndarray, bounds: np.ndarray, lane: int) -> np.ndarray:
    """One 64-bit value per set and lane, the same for equal sets."""
    if len(bounds) < 2:
        return np.zeros(0, np.uint64)
    total = np.add.reduceat(mix(tokens + np.uint64(lane + 1)), bounds[:-1])
    return mix(total + np.diff(bounds).astype(np.uint64))


ROWS = "doc_id long, text_key long, h1 long, h2 long, size long, paths binary, filter binary"


def _signed(values: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(values).view(np.int64)


def _fixed(rows: np.ndarray) -> pa.Array:
    """Rows of a matrix as binary values."""
    raw = np.ascontiguousarray(rows)
    width = raw.shape[1] * raw.itemsize
    return pa.Array.from_buffers(pa.binary(width), len(raw), [None, pa.py_buffer(raw)]).cast(pa.binary())


def _matrix(column: pa.Array, dtype: type, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype).reshape(-1, width)


def rows(documents: DataFrame) -> DataFrame:
    """Every document with its set's identity, size and sketch; null where it has no shingle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, texts in chunks(batch.column("text")):
                tokens, bounds = shingle_sets(texts)
                some = np.flatnonzero(np.diff(bounds))
                own = np.append(bounds[some], bounds[-1])
                least, low = sketches(tokens, own)
                # Places of the documents that have a set; the others take null.
                at = np.full(len(texts), -1)
                at[some] = np.arange(len(some))
                index = pa.array(at, mask=at < 0)
                made = (_signed(_identity(tokens, own, 0)), _signed(_identity(tokens, own, 1)), np.diff(own))
                columns = [*(pa.array(c) for c in made), _fixed(least), _fixed(low)]
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(c).slice(row, len(texts)) for c in ("doc_id", "text_key")), *(c.take(index) for c in columns)],
                    [c.split()[0] for c in ROWS.split(", ")],
                )

    return documents.select(F.col("doc_id").cast("long"), text_key().alias("text_key"), "text").mapInArrow(run, ROWS)


PATHS = "path long, node long, used long"


def _roots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        paths, used = roots(_matrix(batch.column("paths"), np.uint32, COORDINATES))
        node = np.repeat(batch.column("node").to_numpy(), paths.shape[1])
        yield pa.RecordBatch.from_arrays([pa.array(_signed(paths.ravel())), pa.array(node), pa.array(_signed(used.ravel()))], ["path", "node", "used"])


SPLIT = "path long, node long, alike boolean, children array<struct<path: long, used: long>>"


def _split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For nodes of large buckets: whether their filter agrees with the representative's, and the paths they go on to."""
    kind = pa.struct([("path", pa.int64()), ("used", pa.int64())])
    for batch in batches:
        path, used = (batch.column(c).to_numpy() for c in ("path", "used"))
        own, first = (_matrix(batch.column(c), np.uint64, FILTER // 16) for c in ("filter", "first"))
        made, marks = children(path.view(np.uint64), used.view(np.uint64), _matrix(batch.column("paths"), np.uint32, COORDINATES))
        pairs = pa.StructArray.from_arrays([pa.array(_signed(made.ravel())), pa.array(_signed(marks.ravel()))], fields=list(kind))
        offsets = pa.array(np.arange(len(path) + 1, dtype=np.int32) * BRANCHES)
        yield pa.RecordBatch.from_arrays(
            [batch.column("path"), batch.column("node"), pa.array(agreement(own, first) >= _NEAR), pa.ListArray.from_arrays(offsets, pairs)],
            ["path", "node", "alike", "children"],
        )


class Forest:
    """Union-find over the nodes of one task."""

    def __init__(self, n: int):
        self.parent = list(range(n))

    def root(self, x: int) -> int:
        while self.parent[x] != x:
            self.parent[x] = self.parent[self.parent[x]]
            x = self.parent[x]
        return x

    def join(self, a: int, b: int) -> bool:
        a, b = self.root(a), self.root(b)
        if a != b:
            self.parent[max(a, b)] = min(a, b)
        return a != b


class Labels:
    """Union-find by relabelling, for one unit of comparison."""

    def __init__(self, n: int):
        self.label = np.arange(n)

    def join(self, x: int, others: np.ndarray) -> list[int]:
        """Put ``x`` and ``others`` into one set; returns those of the others that stand for sets joined by this."""
        own = self.label[x]
        foreign = others[self.label[others] != own]
        if not len(foreign):
            return []
        names, first = np.unique(self.label[foreign], return_index=True)
        self.label[np.isin(self.label, names)] = own
        return foreign[first].tolist()


# Units of so few nodes are compared many at once.
FEW = 16


def _bucket_edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A spanning forest of the pairs in units whose filters agree enough.

    A unit is a block of a bucket, or two of them, whose pairs across are compared. Rows come sorted by (path, first,
    second, block)."""

    def edges(table: pa.Table, unit: np.ndarray) -> pa.RecordBatch:
        node, size, block = (table.column(c).to_numpy() for c in ("node", "size", "block"))
        low = _matrix(table.column("filter").combine_chunks(), np.uint64, FILTER // 16)
        left, right = [], []
        begin = np.flatnonzero(np.diff(unit, prepend=-1))
        stop = np.append(begin[1:], len(unit))
        forest = Forest(len(unit))
        few = (stop - begin <= FEW)[unit]
        for lag in range(1, FEW):
            a = np.flatnonzero((unit[lag:] == unit[:-lag]) & few[lag:])
            b = a + lag
            fits = (5 * size[a] >= 4 * size[b]) & (5 * size[b] >= 4 * size[a])
            a, b = a[fits], b[fits]
            near = agreement(low[a], low[b]) >= _AGREE
            for x, y in zip(a[near].tolist(), b[near].tolist(), strict=True):
                if forest.join(x, y):
                    left.append(x)
                    right.append(y)
        for u in np.flatnonzero(stop - begin > FEW).tolist():
            rows = slice(begin[u], stop[u])
            own, sizes = low[rows], size[rows]
            n = len(own)
            # Of two blocks each row of the first is compared with the second's, of one with those after it.
            cut = int(np.searchsorted(block[rows], block[begin[u]], side="right"))
            labels = Labels(n)
            for x in range(cut if cut < n else n):
                to = cut if cut < n else x + 1
                near = agreement(own[x], own[to:]) >= _AGREE
                near &= (5 * sizes[x] >= 4 * sizes[to:]) & (5 * sizes[to:] >= 4 * sizes[x])
                for y in labels.join(x, to + np.flatnonzero(near)):
                    left.append(begin[u] + x)
                    right.append(begin[u] + y)
        return pa.RecordBatch.from_arrays([pa.array(node[left], pa.int64()), pa.array(node[right], pa.int64())], ["a", "b"])

    def units(table: pa.Table) -> np.ndarray:
        key = [table.column(c).to_numpy() for c in ("path", "first", "second")]
        new = np.zeros(table.num_rows, np.int64)
        for c in key:
            new[1:] |= c[1:] != c[:-1]
        return np.cumsum(new)

    held: list[pa.RecordBatch] = []
    n = 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= 2 * BLOCK + 4000:
            table = pa.Table.from_batches(held)
            unit = units(table)
            cut = int(np.searchsorted(unit, unit[-1]))
            yield edges(table.slice(0, cut), unit[:cut])
            held, n = table.slice(cut).combine_chunks().to_batches(), len(unit) - cut
    if n:
        table = pa.Table.from_batches(held)
        yield edges(table, units(table))


def compared(members: DataFrame, nodes: DataFrame) -> DataFrame:
    """a, b: a forest of the like nodes of buckets; ``members`` are (path, node, n: the bucket's size)."""
    blocks = F.ceil(F.col("n") / F.lit(BLOCK)).cast("int")
    dealt = members.withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    paired = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        "path", F.least("block", "other").alias("first"), F.greatest("block", "other").alias("second"), "block", "node"
    )
    key = ("path", "first", "second")
    rows = paired.join(nodes.select("node", "size", "filter"), "node").repartition(*key).sortWithinPartitions(*key, "block", "node")
    return rows.mapInArrow(_bucket_edges, "a long, b long")


def candidate_groups(nodes: DataFrame) -> DataFrame:
    """node, component: nodes that some run's recursion brought together, by component."""
    spark = nodes.sparkSession
    edges: list[DataFrame] = []
    members = staged(nodes.select("node", "paths").mapInArrow(_roots, PATHS))
    # Nodes of large buckets, with their sketches; deeper ones are among those of the first split.
    held = nodes
    for depth in range(1, DEPTH + 1):
        sizes = staged(members.groupBy("path").agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("least")).filter("n > 1"))
        small = members.select("path", "node").join(sizes.filter(F.col("n") <= BLOCK).select("path", "n"), "path")
        edges.append(staged(compared(small, held)))
        large = sizes.filter(F.col("n") > BLOCK)
        if large.isEmpty():
            discard(members, sizes)
            break
        inside = staged(members.join(large.select("path", "n"), "path"))
        if depth == 1:
            held = staged(nodes.join(inside.select("node").distinct(), "node", "left_semi").select("node", "size", "paths", "filter"))
        first = large.select("path", F.col("least").alias("node")).join(held.select("node", F.col("filter").alias("first")), "node").select("path", "first")
        met = inside.join(first, "path").join(held.select("node", "paths", "filter"), "node")
        split = staged(met.mapInArrow(_split, SPLIT))
        near = split.groupBy("path").agg(F.avg(F.col("alike").cast("int")).alias("part"))
        whole = large.join(near, "path").filter((F.col("part") >= 0.5) | (F.lit(depth == DEPTH) & (F.col("n") > BUCKET)))
        whole = staged(whole.select("path", "least"))
        edges.append(staged(split.select("path", "node").join(whole, "path").select(F.col("node").alias("a"), F.col("least").alias("b"))))
        other = inside.join(whole, "path", "left_anti")
        edges.append(staged(compared(other.filter(F.col("n") <= BUCKET).select("path", "node", "n"), held)))
        deep = split.join(large.filter(F.col("n") > BUCKET).select("path"), "path", "left_semi").join(whole, "path", "left_anti")
        on = staged(deep.select("node", F.explode("children").alias("c")).select("c.path", "node", "c.used"))
        discard(members, sizes, inside, split, whole)
        members = on
        release(spark)
        if members.isEmpty():
            discard(members)
            break
    if held is not nodes:
        discard(held)
    groups = components(reduce(DataFrame.unionByName, edges))
    discard(*edges)
    return groups


def _source() -> F.Column:
    """Tells rows apart, but for those that repeat."""
    return F.xxhash64(F.col("doc_id").cast("long"), text_key())


def token_sets(documents: DataFrame, nodes: DataFrame) -> DataFrame:
    """node, tokens (ascending): the sets of the given nodes (node, h1, h2, source), read again from one text each."""
    wanted = documents.sparkSession.sparkContext.broadcast(bitmap(nodes.select("source")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = np.flatnonzero(passes(wanted.value, batch.column("source").to_numpy().view(np.uint64)))
            chosen = batch.take(pa.array(keep))
            for row, texts in chunks(chosen.column("text")):
                tokens, bounds = shingle_sets(texts)
                some = np.flatnonzero(np.diff(bounds))
                own = np.append(bounds[some], bounds[-1])
                made = [_signed(_identity(tokens, own, lane)) for lane in (0, 1)]
                sets = pa.ListArray.from_arrays(pa.array(own - own[0], pa.int32()), pa.array(_signed(tokens)))
                source = chosen.column("source").slice(row, len(texts)).take(pa.array(some))
                yield pa.RecordBatch.from_arrays([source, pa.array(made[0]), pa.array(made[1]), sets], ["source", "h1", "h2", "tokens"])

    found = documents.select(_source().alias("source"), "text").mapInArrow(run, "source long, h1 long, h2 long, tokens array<long>")
    key = ["source", "h1", "h2"]
    return found.dropDuplicates(key).join(nodes.select("node", *key), key).select("node", "tokens")


def similar_pairs(sets: list[np.ndarray], cut: int | None) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the pairs of sets at or above the threshold: all of them, or with ``cut`` one before and one from it on."""
    size, common = np.array([len(s) for s in sets]), in_common(sets)
    joined = size[:, None] + size[None, :] - common
    # In integers: 0.8 of a union is met exactly at 4 to 5.
    near = np.triu(5 * common >= 4 * joined, 1)
    if cut is not None:
        near[:cut, :cut] = False
        near[cut:, cut:] = False
    return np.nonzero(near)


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each pair of blocks: its nodes' links by number of documents, and a spanning forest of the links.

    Rows come sorted by (component, first, second, block).
    """
    out: list[list[np.ndarray]] = [[], [], []]

    def add(held: list[tuple]) -> None:
        _, first, second, block, node, copies, tokens = zip(*held, strict=True)
        cut = None if first[0] == second[0] else sum(b == first[0] for b in block)
        a, b = similar_pairs(list(tokens), cut)
        weight = np.array(copies, np.int64)
        linked = np.bincount(a, weight[b], len(node)) + np.bincount(b, weight[a], len(node))
        forest = Forest(len(node))
        edges = [(x, y) for x, y in zip(a.tolist(), b.tolist(), strict=True) if forest.join(x, y)]
        ids = np.array(node, np.int64)
        hit = np.flatnonzero(linked)
        left, right = (np.array([e[k] for e in edges], np.int64) for k in (0, 1))
        out[0] += [ids[hit], ids[left]]
        out[1] += [linked[hit].astype(np.int64), np.zeros(len(left), np.int64)]
        out[2] += [ids[hit], ids[right]]

    def flush() -> pa.RecordBatch:
        made = [pa.array(np.concatenate([np.zeros(0, np.int64), *c])) for c in out]
        for c in out:
            c.clear()
        return pa.RecordBatch.from_arrays(made, ["a", "links", "b"])

    held: list[tuple] = []
    for batch in batches:
        columns = [batch.column(c) for c in ("component", "first", "second", "block", "node", "copies")]
        values, ends = batch.column("tokens").values.to_numpy(), batch.column("tokens").offsets.to_numpy()
        for i, row in enumerate(zip(*(c.to_pylist() for c in columns), strict=True)):
            if held and held[0][:3] != row[:3]:
                if len(held) > 1:
                    add(held)
                held = []
            held.append((*row, values[ends[i] : ends[i + 1]]))
        if len(out[0]) > 2000:
            yield flush()
    if len(held) > 1:
        add(held)
    yield flush()


def join(documents: DataFrame) -> DataFrame:
    """Per document: doc_id, text_key, class_id, n_links (other documents at or above the threshold), node (its set,
    null without shingles) and first, whether it is its class's first (class_id and, of several texts of that id, one)."""
    spark = documents.sparkSession
    every = staged(rows(documents))
    sets = every.filter("h1 IS NOT NULL").withColumn("source", F.xxhash64("doc_id", "text_key")).groupBy("h1", "h2").agg(
        F.first("size").alias("size"), F.first("paths").alias("paths"), F.first("filter").alias("filter"),
        F.count(F.lit(1)).alias("copies"), F.min(F.struct(F.isnull("doc_id").alias("none"), "doc_id", "text_key")).alias("lead"),
        F.min("source").alias("source"),
    )
    # Numbers of nodes: unique, and in no order.
    nodes = staged(sets.withColumn("node", F.xxhash64(F.monotonically_increasing_id())))
    release(spark)
    groups = candidate_groups(nodes)
    known = staged(groups.join(nodes.select("node", "h1", "h2", "source", "size", "copies"), "node"))
    by_tokens, by_nodes = F.sum("size") / F.lit(BLOCK_TOKENS), F.count(F.lit(1)) / F.lit(BLOCK)
    parts = known.groupBy("component").agg(F.ceil(F.greatest(by_tokens, by_nodes)).cast("int").alias("blocks"))
    member = known.select("component", "node", "copies").join(parts, "component")
    member = member.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")).join(token_sets(documents, known), "node")
    paired = member.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        "component", F.least("block", "other").alias("first"), F.greatest("block", "other").alias("second"), "block", "node", "copies", "tokens"
    )
    key = ("component", "first", "second")
    verified = staged(paired.repartition(*key).sortWithinPartitions(*key, "block", "node").mapInArrow(_verify, "a long, links long, b long"))
    discard(groups, known)
    release(spark)
    links = verified.filter("links > 0").groupBy(F.col("a").alias("node")).agg(F.sum("links").alias("links"))
    labels = components(verified.filter("links = 0").select("a", "b"))
    named = nodes.select("node", "h1", "h2", "copies", "lead").join(labels, "node", "left").join(links, "node", "left")
    named = staged(named.select("node", "h1", "h2", "copies", "lead", F.coalesce("component", "node").alias("component"), F.coalesce("links", F.lit(0)).alias("links")))
    discard(nodes, labels, verified)
    # The class's first document: the least id, nulls last; of several texts of that id, one.
    classes = named.groupBy("component").agg(F.min("lead").alias("first"))
    classed = named.join(classes, "component").select(
        "h1", "h2", "node", (F.col("links") + F.col("copies") - 1).alias("n_links"), F.col("first.doc_id").alias("class_id"), F.col("first.text_key").alias("class_key"),
    )
    joined = every.select("doc_id", "text_key", "h1", "h2").join(classed, ["h1", "h2"], "left")
    none = F.col("node").isNull()
    return joined.select(
        "doc_id", "text_key", F.when(none, F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
        F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), "node",
        (none | F.col("doc_id").eqNullSafe(F.col("class_id")) & (F.col("text_key") == F.col("class_key"))).alias("first"),
    )


def deduplicate(documents: DataFrame) -> DataFrame:
    """The documents without those that are not the first of their class; of rows that repeat exactly one stays."""
    joined = staged(join(documents))
    kept = without(documents, joined.filter("NOT first"))
    again = joined.filter("first AND node IS NOT NULL").groupBy("doc_id", "text_key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    if again.isEmpty():
        return kept
    key = fresh(kept, "key")
    return kept.withColumn(key, text_key()).dropDuplicates(["doc_id", key]).drop(key)

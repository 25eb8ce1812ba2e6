"""Copy detection for image columns with local descriptors.

Images are binary PGM or PPM files (P5, P6; 8 bits). Each is described by corners at several scales: the strongest
responses of the structure tensor, oriented by their intensity centroid, with DESCRIPTOR_BITS comparisons of smoothed
pixels turned by that orientation. Descriptors are looked up in Hamming tables: each run of KEY_BANDS of the BANDS equal
parts of the bits, taken as a ring, is a key, so descriptors that differ in few bits share one. Images that meet in several tables are compared in full: matched corners
vote for a common turn, scale and shift, and enough of them that agree make a link. The components of the links are
the classes.

Images of equal bytes are one before all this. A table's bucket of up to BUCKET images gives all its pairs; in a larger one,
many copies of an image or some texture that many images share, each image is paired at first with the bucket's representative
and with the images next to it in two orders. Those are the same in all buckets, so the same pairs come up again; each of
them is compared, whatever its votes. That joins many copies by pairs that grow with the images and not with their square.
What a large bucket then still holds in different components is compared block against block: every pair that meets in
LEAST_VOTES entries of any tables, once. So a pair that shares enough entries is either compared or linked through others.

Defined cases: null, undecodable or textureless images have no descriptors and are classes of their own, but for
copies of equal bytes; rows that repeat are copies; class_id is the least media_id of the class; other columns are ignored; an empty table gives
no rows.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.common import discard, in_common, mix, release, staged
from tidemark.llm.graph import components
from tidemark.llm.jaccard import Forest

SCALES = (1.0, 0.75, 0.5)
CORNERS = 48
PATCH = 9
DESCRIPTOR_BITS = 128
BANDS = 8
KEY_BANDS = 4
BUCKET = 24
# Images of a large bucket that one task orders.
BLOCK = 1000
LEAST_VOTES = 2
MOST_BITS = 20
LEAST_INLIERS = 8
# Images of a large bucket that are compared with as many others in one unit.
UNIT = 250
# Pairs that are joined with their descriptors, some KB each, before those shuffles are dropped.
SLICE_PAIRS = 100_000
TOLERANCE = 3.0

_rng = np.random.Generator(np.random.PCG64(4242))
_TESTS = np.clip(_rng.normal(0, PATCH / 2.2, (DESCRIPTOR_BITS, 2, 2)), -PATCH + 1, PATCH - 1)
_HEADER = re.compile(rb"P([56])\s+(?:#[^\n]*\n\s*)*(\d+)\s+(\d+)\s+(\d+)\s")


def decode(raw: bytes | None) -> np.ndarray | None:
    """Grey values of a binary PGM or PPM, or None."""
    match = _HEADER.match(raw or b"")
    if not match or int(match[4]) > 255:
        return None
    channels, width, height = 1 if match[1] == b"5" else 3, int(match[2]), int(match[3])
    body = np.frombuffer(raw, np.uint8, offset=match.end())
    if not width * height or len(body) < width * height * channels:
        return None
    pixels = body[: width * height * channels].reshape(height, width, channels).astype(np.float32)
    return pixels[:, :, 0] if channels == 1 else pixels @ np.array([0.299, 0.587, 0.114], np.float32)


def encode(pixels: np.ndarray) -> bytes:
    """A binary PGM of grey values."""
    height, width = pixels.shape
    return b"P5\n%d %d\n255\n" % (width, height) + np.clip(np.rint(pixels), 0, 255).astype(np.uint8).tobytes()


def sample(image: np.ndarray, y: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Bilinear values at fractional places, edges repeated."""
    y, x = np.clip(y, 0, image.shape[0] - 1), np.clip(x, 0, image.shape[1] - 1)
    top, left = np.minimum(y.astype(int), image.shape[0] - 2), np.minimum(x.astype(int), image.shape[1] - 2)
    dy, dx = y - top, x - left
    # In one row or column of pixels the places before the first have no weight.
    flat, width = image.ravel(), image.shape[1]
    at = top * width + left
    upper = flat.take(at, mode="wrap") * (1 - dx) + flat.take(at + 1, mode="wrap") * dx
    at += width
    return upper * (1 - dy) + (flat.take(at, mode="wrap") * (1 - dx) + flat.take(at + 1, mode="wrap") * dx) * dy


def resize(image: np.ndarray, height: int, width: int) -> np.ndarray:
    y = (np.arange(height) + 0.5) * image.shape[0] / height - 0.5
    x = (np.arange(width) + 0.5) * image.shape[1] / width - 0.5
    return sample(image, *np.meshgrid(y, x, indexing="ij"))


def smooth(image: np.ndarray) -> np.ndarray:
    """A binomial 5 by 5 blur."""
    for axis in (0, 1):
        n = image.shape[axis]
        padded = image.take(np.clip(np.arange(-2, n + 2), 0, n - 1), axis=axis)
        parts = (padded[k : k + n] if axis == 0 else padded[:, k : k + n] for k in range(5))
        image = sum(w * part for w, part in zip((1 / 16, 4 / 16, 6 / 16, 4 / 16, 1 / 16), parts, strict=True))
    return image


def describe(image: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Corners as (x, y, scale, angle) in the image's own pixels, and their bits packed into two 64-bit values."""
    places, codes = [], []
    for scale in SCALES:
        height, width = round(image.shape[0] * scale), round(image.shape[1] * scale)
        if min(height, width) < 2 * PATCH:
            continue
        level = smooth(image if scale == 1 else resize(smooth(image), height, width))
        dy, dx = np.gradient(level)
        xx, yy, xy = smooth(dx * dx), smooth(dy * dy), smooth(dx * dy)
        response = xx * yy - xy * xy - 0.05 * (xx + yy) ** 2
        inner = response[4:-4, 4:-4]
        peak = inner > 1.0
        for sy in (-1, 0, 1):
            for sx in (-1, 0, 1):
                if sy or sx:
                    near = response[4 + sy : response.shape[0] - 4 + sy, 4 + sx : response.shape[1] - 4 + sx]
                    peak &= inner > near if (sy, sx) < (0, 0) else inner >= near
        y, x = np.nonzero(peak)
        strongest = np.argsort(-inner[y, x], kind="stable")[:CORNERS]
        y, x = y[strongest] + 4.0, x[strongest] + 4.0
        if not len(x):
            continue
        span = np.arange(-PATCH + 2, PATCH - 1)
        oy, ox = (g.ravel() for g in np.meshgrid(span, span, indexing="ij"))
        disc = oy**2 + ox**2 <= (PATCH - 2) ** 2
        values = sample(level, y[:, None] + oy[disc], x[:, None] + ox[disc])
        values = values - values.mean(axis=1, keepdims=True)
        angle = np.arctan2(values @ oy[disc], values @ ox[disc])
        cos, sin = np.cos(angle)[:, None, None], np.sin(angle)[:, None, None]
        tx = x[:, None, None] + cos * _TESTS[None, :, :, 0] - sin * _TESTS[None, :, :, 1]
        ty = y[:, None, None] + sin * _TESTS[None, :, :, 0] + cos * _TESTS[None, :, :, 1]
        tested = sample(level, ty, tx)
        bits = np.packbits(tested[:, :, 0] < tested[:, :, 1], axis=1)
        codes.append(bits.view(np.uint64))
        places.append(np.stack([(x + 0.5) / scale, (y + 0.5) / scale, np.full(len(x), 1 / scale), angle], axis=1))
    if not places:
        return np.zeros((0, 4), np.float32), np.zeros((0, 2), np.uint64)
    return np.concatenate(places).astype(np.float32), np.concatenate(codes)


def agreement(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> int:
    """The most matched corners that one turn, scale and shift explains."""
    (pa_, ca), (pb, cb) = a, b
    apart = np.bitwise_count(ca[:, None, 0] ^ cb[None, :, 0])
    apart += np.bitwise_count(ca[:, None, 1] ^ cb[None, :, 1])
    i = np.arange(len(ca))
    j = apart.argmin(axis=1)
    # Only corners that are each other's best match.
    good = (apart[i, j] <= MOST_BITS) & (apart.argmin(axis=0)[j] == i)
    i, j = i[good], j[good]
    if len(i) < LEAST_INLIERS:
        return len(i)
    turn, zoom = pb[j, 3] - pa_[i, 3], pb[j, 2] / pa_[i, 2]
    cos, sin = np.cos(turn) * zoom, np.sin(turn) * zoom
    # Each match proposes a transform; every match is tried on it.
    dx, dy = pa_[i, 0][None, :] - pa_[i, 0][:, None], pa_[i, 1][None, :] - pa_[i, 1][:, None]
    ex = pb[j, 0][:, None] + cos[:, None] * dx - sin[:, None] * dy - pb[j, 0][None, :]
    ey = pb[j, 1][:, None] + sin[:, None] * dx + cos[:, None] * dy - pb[j, 1][None, :]
    inlier = ex**2 + ey**2 <= (TOLERANCE * np.maximum(1, zoom))[:, None] ** 2
    # Corners found at several scales at one place count once.
    explained = np.count_nonzero(inlier, axis=1)
    best = inlier[int(explained.argmax())]
    if explained.max() < LEAST_INLIERS:
        return int(explained.max())
    cells = np.unique(np.stack([pa_[i, 0][best] // 4, pa_[i, 1][best] // 4]), axis=1)
    return cells.shape[1]


FEATURES = "media_id long, image long, places binary, codes binary"


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for raw in batch.column("content").to_pylist():
            pixels = decode(raw)
            places, codes = describe(pixels) if pixels is not None else (np.zeros((0, 4), np.float32), np.zeros((0, 2), np.uint64))
            out.append((places.tobytes(), codes.tobytes()))
        columns = list(zip(*out, strict=True)) or [(), ()]
        yield pa.RecordBatch.from_arrays(
            [batch.column("media_id"), batch.column("image"), *(pa.array(c, pa.binary()) for c in columns)], [c.split()[0] for c in FEATURES.split(", ")]
        )


def _keys(codes: np.ndarray, places: range) -> np.ndarray:
    """The table key of each descriptor at each of some places of the ring."""
    step = DESCRIPTOR_BITS // BANDS // 8
    parts = codes.view(np.uint8).reshape(len(codes), BANDS, step)
    value = sum(parts[:, :, k].astype(np.uint64) << np.uint64(8 * k) for k in range(step))
    at = np.array(places)
    joined = np.broadcast_to(at.astype(np.uint64), (len(codes), len(at)))
    for k in range(KEY_BANDS):
        joined = mix(joined ^ value[:, (at + k) % BANDS] * np.uint64(0x9E3779B97F4A7C15))
    return joined


def table_keys(codes: np.ndarray, places: range = range(BANDS)) -> np.ndarray:
    """Distinct table keys of some descriptors: KEY_BANDS neighbouring bands from each of some places of the ring."""
    return np.unique(_keys(codes, places).ravel())


def _entries(batches: Iterator[pa.RecordBatch], places: range) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        each = [np.frombuffer(raw, np.uint64).reshape(-1, 2) for raw in batch.column("codes").to_pylist()]
        # The keys of a whole batch at once, each with its image's row; those of one image are distinct.
        row = np.repeat(np.arange(len(each)), [len(c) * len(places) for c in each])
        key = _keys(np.concatenate([np.zeros((0, 2), np.uint64), *each]), places).ravel()
        order = np.lexsort((key, row))
        row, key = row[order], key[order]
        new = np.ones(len(key), dtype=bool)
        new[1:] = (key[1:] != key[:-1]) | (row[1:] != row[:-1])
        image = batch.column("image").to_numpy()[row[new]]
        yield pa.RecordBatch.from_arrays([pa.array(image), pa.array(key[new].view(np.int64))], ["image", "key"])


def _unpacked(places: bytes, codes: bytes) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(places, np.float32).reshape(-1, 4), np.frombuffer(codes, np.uint64).reshape(-1, 2)


def _consensus(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ("a", "b", "places_a", "codes_a", "places_b", "codes_b")
    for batch in batches:
        rows = zip(*(batch.column(n).to_pylist() for n in names), strict=True)
        linked = [(a, b) for a, b, *f in rows if agreement(_unpacked(*f[:2]), _unpacked(*f[2:])) >= LEAST_INLIERS]
        columns = list(zip(*linked, strict=True)) or [(), ()]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["a", "b"])


def _meetings(entries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pairs of images (a < b) and their votes, one for each table entry (image, key) that they meet in; and the entries
    of large buckets, of whose pairs only some are made here. For those one entry is enough."""
    # A bucket's representative is the first of its images in an order that all buckets share: that of the hash of their bytes.
    sizes = staged(entries.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("image").alias("first")).filter("n > 1"))
    held = staged(entries.join(sizes, "key"))
    release(entries.sparkSession)
    few = Window.partitionBy("key").orderBy("image").rowsBetween(1, BUCKET)
    after = held.filter(F.col("n") <= BUCKET).withColumn("after", F.collect_list("image").over(few))
    pairs = after.select(F.col("image").alias("a"), F.explode("after").alias("b"), F.lit(1).alias("vote"))
    # Large buckets: each image with the representative, and with the next in two shared orders, dealt in blocks.
    large = held.filter(F.col("n") > BUCKET)
    chained = [large.select(F.col("image").alias("x"), F.col("first").alias("y"))]
    for salt in (1, 2):
        block = F.pmod(F.xxhash64("image", F.lit(salt)), F.ceil(F.col("n") / BLOCK))
        order = Window.partitionBy("key", block).orderBy(F.xxhash64("image", F.lit(-salt)), "image")
        chained.append(large.select(F.col("image").alias("x"), F.lead("image").over(order).alias("y")))
    linked = reduce(DataFrame.unionByName, chained).filter("x <> y")
    pairs = pairs.unionByName(linked.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), F.lit(LEAST_VOTES).alias("vote")))
    votes = staged(pairs.groupBy("a", "b").agg(F.sum("vote").alias("votes")))
    kept = staged(large.select("key", "image"))
    discard(sizes, held)
    return votes, kept


def meetings(features: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pairs of images (a < b) that meet in LEAST_VOTES table entries or more, or are paired in a large bucket; and the
    entries (key, image) of all large buckets.

    The places of the ring are dealt one at a time, so that the shuffles of one pass are gone before the next; a pass
    leaves its pairs with their partial counts.
    """
    counted, large = [], []
    for at in range(BANDS):
        keyed = lambda batches, at=at: _entries(batches, range(at, at + 1))
        made = _meetings(features.select("image", "codes").mapInArrow(keyed, "image long, key long"))
        counted.append(made[0])
        large.append(made[1])
        release(features.sparkSession)
    votes = reduce(DataFrame.unionByName, counted)
    pairs = staged(votes.groupBy("a", "b").agg(F.sum("votes").alias("votes")).filter(F.col("votes") >= LEAST_VOTES))
    discard(*counted)
    return pairs, reduce(DataFrame.unionByName, large)


def candidates(features: DataFrame) -> DataFrame:
    """The pairs of :func:`meetings`."""
    return meetings(features)[0]


def _across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links between images of different components, unit by unit. Rows come sorted by (unit, image)."""

    def links(held: list[tuple]) -> list[tuple[int, int]]:
        _, key, image, component, second, keys, places, codes = zip(*held, strict=True)
        features = [_unpacked(*f) for f in zip(places, codes, strict=True)]
        names, second = np.unique(component, return_inverse=True)[1], np.array(second)
        meet = in_common([table_keys(f[1]) for f in features]) >= LEAST_VOTES
        meet &= names[:, None] != names[None, :]
        # Of the buckets that hold both images the first has the pair.
        own = [np.array(k, np.int64) for k in keys]
        meet &= in_common([k[k < key[0]] for k in own]) == 0
        if second.any():
            meet &= second[:, None] != second[None, :]
        forest, made = Forest(len(names) + int(names.max()) + 1), []
        for i, name in enumerate(names.tolist()):
            forest.join(i, len(names) + name)
        for i, j in np.argwhere(np.triu(meet, 1)).tolist():
            if forest.root(i) != forest.root(j) and agreement(features[i], features[j]) >= LEAST_INLIERS:
                forest.join(i, j)
                made.append((image[i], image[j]))
        return made

    def written(made: list[tuple[int, int]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([m[k] for m in made], pa.int64()) for k in (0, 1)], ["a", "b"])

    held: list[tuple] = []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if held and held[0][0] != row[0]:
                yield written(links(held))
                held = []
            held.append(row)
    if held:
        yield written(links(held))


def _let_go(spark: SparkSession) -> None:
    """:func:`release`, of the last query's shuffles too: Spark's event queues hold the end of a query, and with it its plan,
    until that of another comes."""
    spark.range(1).collect()
    release(spark)


def _written(links: DataFrame) -> DataFrame:
    """The links of a slice, at most a few for each of its images, as one file: many small ones cost each reader more than they hold."""
    return staged(links.repartition(1))


def consensus(pairs: DataFrame, features: DataFrame) -> list[DataFrame]:
    """The links (a, b) among ``pairs`` (a, b).

    Images are dealt into groups, and a slice is what pairs have ``a`` in one group and ``b`` in another: so a slice
    shuffles the descriptors of those two groups only, and those of ``a`` once more for each of its pairs.
    """
    spark = features.sparkSession
    groups = max(1, math.ceil(math.sqrt(pairs.count() / SLICE_PAIRS)))
    of = lambda n: F.pmod(F.xxhash64(n), F.lit(groups))

    def side(n: str, at: int) -> DataFrame:
        rows = features.select(F.col("image").alias(n), F.col("places").alias(f"places_{n}"), F.col("codes").alias(f"codes_{n}"))
        return rows.filter(of(n) == at)

    links = []
    for first in range(groups):
        for second in range(groups):
            _let_go(spark)
            part = pairs.select("a", "b").filter((of("a") == first) & (of("b") == second))
            dealt = part.join(side("a", first), "a").join(side("b", second), "b")
            links.append(_written(dealt.mapInArrow(_consensus, "a long, b long")))
    discard(pairs)
    _let_go(spark)
    return links


def across(large: DataFrame, known: DataFrame, features: DataFrame) -> list[DataFrame]:
    """The links (a, b) that large buckets hold between images of different components of ``known`` (node, component).

    Buckets of the same images are one. The images of a component that are many in a bucket have blocks of their own,
    those of the others share blocks; a unit is two blocks, or a shared one with itself, and no two of one component.
    """
    spark = large.sparkSession
    named = large.join(known, F.col("image") == F.col("node"), "left").select("key", "image", F.coalesce("component", "image").alias("component"))
    counts = staged(named.groupBy("key", "component").agg(F.count(F.lit(1)).alias("n"), *(F.bit_xor(F.xxhash64("image", F.lit(s))).alias(f"x{s}") for s in (3, 4))))
    few = F.sum(F.when(F.col("n") < UNIT, F.col("n")).otherwise(0))
    buckets = counts.groupBy("key").agg(F.count(F.lit(1)).alias("parts"), F.sum("n").alias("n"), few.alias("few"), *(F.bit_xor(x).alias(x) for x in ("x3", "x4")))
    mixed = buckets.filter("parts > 1").groupBy("n", "x3", "x4").agg(F.min(F.struct("key", "few")).alias("one")).select("one.*")
    sizes = staged(counts.select("key", "component", "n").join(mixed, "key"))
    own = F.col("n") >= UNIT
    turn = F.when(own, F.pmod(F.xxhash64("image"), F.ceil(F.col("n") / UNIT))).otherwise(F.pmod(F.xxhash64("component"), F.greatest(F.ceil(F.col("few") / UNIT), F.lit(1))))
    block = F.struct(F.when(own, F.col("component")).otherwise(F.lit(0)).alias("of"), own.alias("own"), turn.alias("turn"))
    members = staged(named.join(sizes, ["key", "component"]).select("key", "image", "component", block.alias("block")))
    blocks = members.select("key", "block").distinct()
    facing = blocks.withColumnRenamed("block", "first").join(blocks.withColumnRenamed("block", "second"), "key").filter("first <= second")
    units = staged(facing.filter("NOT (first.own AND second.own AND first.of = second.of)").withColumn("unit", F.monotonically_increasing_id()))
    one = units.select("unit", "key", F.col("first").alias("block"), F.lit(False).alias("second"))
    two = units.filter("first <> second").select("unit", "key", F.col("second").alias("block"), F.lit(True).alias("second"))
    rows = staged(members.join(one.unionByName(two), ["key", "block"]).select("unit", "key", "image", "component", "second"))
    keys = staged(members.groupBy("image").agg(F.sort_array(F.collect_set("key")).alias("keys")))
    links, slices = [], -(-rows.count() // SLICE_PAIRS)
    for at in range(slices):
        _let_go(spark)
        part = rows.filter(F.pmod(F.xxhash64("unit"), F.lit(slices)) == at).join(keys, "image").join(features, "image")
        dealt = part.select("unit", "key", "image", "component", "second", "keys", "places", "codes").repartition("unit").sortWithinPartitions("unit", "image")
        links.append(_written(dealt.mapInArrow(_across, "a long, b long")))
    discard(counts, sizes, members, units, rows, keys)
    _let_go(spark)
    return links


def copies(media: DataFrame) -> DataFrame:
    """Per row of (media_id, content): media_id, class_id, n_same (rows of equal bytes, itself not counted), n_class (rows of the class)."""
    spark = media.sparkSession
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 200)
    content = F.coalesce(F.col("content"), F.lit(b""))
    rows = media.select(F.col("media_id").cast("long").alias("media_id"), F.xxhash64(content).alias("image"), "content")
    # Described where they are, so that no image is shuffled.
    described = staged(rows.mapInArrow(_features, FEATURES))
    features = staged(described.drop("media_id").dropDuplicates(["image"]))
    ids = staged(described.select("media_id", "image"))
    discard(described)
    release(spark)
    pairs, large = meetings(features)
    links = consensus(pairs, features)
    joined = components(reduce(DataFrame.unionByName, links))
    if rest := across(large, joined, features):
        joined = components(reduce(DataFrame.unionByName, links + rest))
    label = F.coalesce("component", "image").alias("component")
    named = staged(ids.join(joined, F.col("image") == F.col("node"), "left").select("media_id", "image", label))
    same = named.groupBy("image").agg((F.count(F.lit(1)) - 1).alias("n_same"))
    classes = named.groupBy("component").agg(F.min("media_id").alias("class_id"), F.count(F.lit(1)).alias("n_class"))
    return named.join(same, "image").join(classes, "component").select("media_id", "class_id", "n_same", "n_class")

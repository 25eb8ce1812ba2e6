"""The pipeline and the queries that SQL cannot express, as registered, against brute force."""

from zlib import crc32

import corpus_pipeline
import numpy as np
import public_tokenizers
from oracle import DATA
from tokenizers import Tokenizer

from test_duplicates import brute_links
from test_text import brute_hits, brute_marginals
from tidemark.llm import images, packing, toxicity
from tidemark.llm.common import chunks, prepare
from tidemark.llm.queries import QUERIES, held_out

PATH = public_tokenizers.path("word_bpe_49k.json")


def check_packing(texts, rows):
    """Pieces by the tokenizer itself, sequences gapless, and no more of them than best fit over all pieces makes."""
    coder, want = Tokenizer.from_file(PATH), []
    for doc_id, text in texts:
        ids = [*coder.encode(text or "", add_special_tokens=False).ids, 0]
        for piece, start in enumerate(range(0, len(ids), packing.CAPACITY)):
            part = np.array(ids[start : start + packing.CAPACITY], "<u4")
            want.append((doc_id, piece, start, len(part), crc32(part.tobytes())))
    assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == sorted(want)
    places: dict = {}
    for r in rows:
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
        assert r.bound <= r.sequences
    for parts in places.values():
        ends = np.cumsum([0, *(n for _, n in sorted(parts))])
        assert [o for o, _ in sorted(parts)] == ends[:-1].tolist() and ends[-1] <= packing.CAPACITY
    lengths = np.array([w[3] for w in want])
    assert packing.lower_bound(lengths, packing.CAPACITY) <= len(places) <= packing.best_fit(lengths, packing.CAPACITY)[2]


def test_packing_query(spark):
    sf_dir = f"{DATA}/sf0.001"
    texts = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    check_packing(texts, QUERIES["op1_best_fit_packing"](spark, sf_dir).collect())


def brute_score(field, text):
    """Forward-backward over all words, one by one."""
    import pyarrow as pa

    ((_, made),) = chunks(pa.array([text], pa.large_string()))
    starts, _, _, features = toxicity.word_features(made)
    words, gains = field.evidence(features)
    found = brute_marginals(field, dict(zip(words.tolist(), gains.tolist())), len(starts))[words] if len(words) else np.zeros(0)
    return field.score(found)


def fixture():
    rng = np.random.default_rng(8)
    calm = [f"calm{i}" for i in range(400)]
    prose = lambda n: " ".join(rng.choice(calm, n))
    rows, labels = [], []
    for i in range(60):
        toxic = i % 3 == 0
        words = prose(60).split()
        if toxic:
            for at in (5, 20, 40):
                words[at] = "vileword"
        rows.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    base = prose(80).split()
    rows += [(100, " ".join(base)), (101, " ".join([*base, "end"])), (102, " ".join(base)), (102, " ".join(base))]
    leak = prose(14)
    rows += [(110, f"{prose(20)} {leak} {prose(5)}"), (111, prose(20)), (112, f"password = abcdefghij0123 {prose(9)}")]
    rows += [(None, "nobody knows this id"), (120, None), (121, ""), (122, "long " + prose(9000))]
    return rows, labels, [(1, leak), (2, None), (3, "Short item")]


def test_pipeline_by_brute_force(spark, tmp_path):
    rows, labels, items = fixture()
    folder = f"file://{tmp_path}"
    docs = spark.createDataFrame([(*r, None, "s", len(r[1] or ""), 7, "k") for r in rows], "doc_id long, text string, lang string, source string, n_chars long, _id long, _key string")
    docs.repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    prepare(spark)
    read = spark.read.parquet(f"{folder}/documents.parquet")
    field = toxicity.fit(read.filter(~held_out()), spark.read.parquet(f"{folder}/labels.parquet"))
    kept = [(i, t) for i, t in rows if brute_score(field, t) < 0.5]
    gone = {i for i, _ in rows} - {i for i, _ in kept}
    assert gone == {i for i, toxic in labels if toxic}
    assert corpus_pipeline.without_toxic(spark, read, folder).columns == read.columns
    links = brute_links([t for _, t in kept])
    order = sorted(range(len(kept)), key=lambda k: (kept[k][0] is None, kept[k][0] or 0))
    left, seen = [], set()
    for k in order:
        if k not in seen:
            left.append(kept[k])
            reach = [k]
            while reach:
                seen.add(x := reach.pop())
                reach += [y for y in links[x] if y not in seen]
    assert {i for i, _ in kept} - {i for i, _ in left} == {101, 102}
    hits = brute_hits([(n, t) for n, (_, t) in enumerate(left)], items)
    clean = [row for n, row in enumerate(left) if not hits[n][1]]
    assert {i for i, _ in left} - {i for i, _ in clean} == {110}
    masked = [(i, "[REDACTED] " + t.split(" ", 3)[3] if i == 112 else t) for i, t in clean]
    assert [i for i, t in masked if t and "[REDACTED]" in t] == [112]
    as_keys = [(-1 if i is None else i, t) for i, t in masked]
    result = corpus_pipeline.run(spark, folder)
    check_packing(as_keys, result.fillna({"doc_id": -1}).collect())


def test_pipeline_of_nothing(spark, tmp_path):
    folder = f"file://{tmp_path}"
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([], "doc_id long, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    assert corpus_pipeline.run(spark, folder).collect() == []


def test_image_copies_by_brute_force(spark):
    """All pairs by geometric consensus, and their classes."""
    rng = np.random.default_rng(2)
    media = []
    for k in range(12):
        texture = images.resize(rng.uniform(0, 255, (20, 20)), 80, 80)
        media += [(4 * k, texture), (4 * k + 1, texture[8:72, 6:74] * 0.85 + 20), (4 * k + 2, texture + rng.normal(0, 4, texture.shape))]
    rows = [(i, images.encode(p)) for i, p in media]
    described = [images.describe(images.decode(raw)) for _, raw in rows]
    label = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a + 1, len(rows)):
            if images.agreement(described[a], described[b]) >= images.LEAST_INLIERS:
                label = [label[a] if x == label[b] else x for x in label]
    want = {rows[k][0]: min(rows[j][0] for j in range(len(rows)) if label[j] == label[k]) for k in range(len(rows))}
    got = images.copies(spark.createDataFrame(rows, "media_id long, content binary"))
    assert {r.media_id: r.class_id for r in got.collect()} == want and len(set(want.values())) == 12

from zlib import crc32

import numpy as np
import public_tokenizers
from hypothesis import given
from hypothesis import strategies as st

from tidemark.llm import packing

PATH = public_tokenizers.path("word_bpe_49k.json")


def reference(text):
    from tokenizers import Tokenizer

    return [*Tokenizer.from_file(PATH).encode(text or "", add_special_tokens=False).ids, 0]


def test_tokens_are_the_tokenizers():
    texts = ["Hello, World!! it's a.b. (x).", "<|endoftext|> a", "İstanbul ﬁ ½ é", "don't 'S x's 12 3", "", "a\x1cb\x85c d", "ab). !'s ..", "É×÷ß"]
    for _ in range(2):
        got = packing.tokenizer(PATH).encode(texts)
        assert [np.frombuffer(g, "<u4").tolist() for g in got] == [reference(t)[:-1] for t in texts]


def test_each_part_is_looked_up_once_a_batch():
    asked = []

    class Counted(packing.PartCache):
        def get(self, part, default=None):
            asked.append(part)
            return super().get(part, default)

        def __getitem__(self, part):
            asked.append(part)
            return super().__getitem__(part)

    coder = packing.WordTokenizer(PATH)
    coder._cache = Counted()
    texts = ["  Some words, some MORE\t", "words. " * 1000, None, "\n", "more some × " * 500]
    got = coder.encode(texts)
    assert [np.frombuffer(g, "<u4").tolist() for g in got] == [reference(t)[:-1] for t in texts]
    assert len(asked) < 50


def test_pieces_and_sequences(edges, empty):
    rows = packing.packed(edges, PATH).collect()
    assert packing.packed(empty, PATH).collect() == []
    by_sequence = {}
    for r in rows:
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by_sequence.values():
        ends = [0, *(o + n for o, n in sorted(parts))]
        assert [o for o, _ in sorted(parts)] == ends[:-1] and ends[-1] <= packing.CAPACITY
    total = sum(r.length for r in rows)
    assert len(by_sequence) <= -(-total // packing.CAPACITY) + 1
    assert sum(r.doc_id == 6 and r.piece == 0 for r in rows) == 2
    for doc_id, text in ((1, None), (7, "café ñandú ÉCLAIR 💥 " * 40)):
        (r,) = [r for r in rows if r.doc_id == doc_id]
        ids = reference(text)
        assert (r.start, r.length, r.ids_crc32) == (0, len(ids), crc32(np.array(ids, "<u4").tobytes()))


def test_many_partitions_exchange(spark):
    rng = np.random.default_rng(5)
    items = spark.createDataFrame([(i, int(n)) for i, n in enumerate(rng.integers(1, 100, 3000))], "piece_key long, length long")
    placed = packing.pack(items, capacity=100, partition_pieces=500).join(items, "piece_key").toPandas()
    assert len(placed) == 3000
    load = placed.groupby("sequence_id").length.sum()
    assert load.max() <= 100
    whole = packing.best_fit(placed.length.to_numpy(), 100)[2]
    assert len(load) <= 1.02 * whole and len(load) >= packing.lower_bound(placed.length.to_numpy(), 100)


@given(st.lists(st.integers(1, 20), max_size=40))
def test_bounds_hold(lengths):
    lengths = np.array(lengths, np.int64)
    bins, offsets, used = packing.best_fit(lengths, 20)
    assert packing.lower_bound(lengths, 20) <= used
    for b in range(used):
        own = np.flatnonzero(bins == b)
        order = own[np.argsort(offsets[own])]
        assert (offsets[order] == np.cumsum(lengths[order]) - lengths[order]).all() and lengths[own].sum() <= 20


def test_cache_is_bounded(monkeypatch):
    monkeypatch.setattr(packing, "CACHED_WORDS", 5)
    coder = packing.WordTokenizer(PATH)
    for k in range(6):
        texts = [f"alpha{k} beta{k}, gamma", "x" * 50 + str(k), f"alpha{k}"]
        assert [np.frombuffer(g, "<u4").tolist() for g in coder.encode(texts)] == [reference(t)[:-1] for t in texts]
        assert len(coder._cache) < 16 and len(coder._cache.older) < 16

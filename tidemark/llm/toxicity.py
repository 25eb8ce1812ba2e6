"""Toxic spans by a linear-chain conditional random field, aggregated to document scores.

Each word is tagged clean or toxic. Its evidence is the word itself and its first 3 to 6 bytes, so that forms never
seen follow their stem; transitions join neighbours. Training words are labelled from document labels: a word of a toxic document is toxic when
one of its features is far more frequent in toxic than in clean documents; all others, and all words of clean
documents, are clean. The field is fitted to these sequences by gradient ascent on their conditional likelihood.

Most words have no feature of the field. Their steps are one constant matrix, so forward-backward visits the words
with evidence and takes a power of that matrix for each gap between them: exact, in time proportional to the evidence.
A document's score is a logistic function of its marginals' sum and maximum, fitted on the same sample.

Defined cases: empty and null texts get the score of no evidence; rows that repeat are scored each; labels that
repeat count as toxic if any is; null labels are not used; of texts with one doc_id the least is learned from; of features
that tie in odds all are used; very long texts take memory in proportion to their words with evidence and their bytes;
without both labels in the sample every score is 0; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import ALNUM, Texts, chunks, edit_batches, utf8

# The bounded sample that the field is fitted on: documents of each label, and clean ones for counts alone.
SAMPLE_DOCUMENTS = 500
MORE_CLEAN = 1500
STEMS = (3, 4, 5, 6)
# Evidence: contexts in which a feature stands, and by how much its log odds must favour toxic documents.
LEAST_CONTEXTS = 5
LEAST_ODDS = 3.0
LEAST_LABEL_ODDS = 4.0
# Training sequences: the sample's documents in parts of so many words; those without evidence are thinned to as many
# as have some.
SEQUENCE = 64
STEPS = 80
# Powers of the step without evidence that are kept; longer gaps are products of these.
KEPT_POWERS = 512


def word_features(texts: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]]:
    """Starts, ends and bounds of the words, and an array of hashes for the words and for each stem length."""
    starts, ends, bounds = texts.words(ALNUM)
    hashes = texts.hasher(fold_case=True)
    features = [hashes.of(starts, ends)]
    for n in STEMS:
        # A stem is its own feature, apart from the word of the same bytes; shorter words have none.
        stem = hashes.of(starts, np.minimum(starts + n, ends)) ^ np.uint64(n)
        features.append(np.where(ends - starts > n, stem, np.uint64(0)))
    return starts, ends, bounds, features


class Field:
    """Weights of features, bias and transitions: ``trans[a, b]`` from tag a to tag b; a clean word scores 0."""

    def __init__(self, hashes: np.ndarray, weights: np.ndarray, bias: float, trans: np.ndarray, head: tuple[float, float, float]):
        self.hashes, self.weights, self.bias, self.trans, self.head = hashes, weights, bias, trans, head
        self._table = np.zeros(1 << 18, dtype=bool)
        self._table[hashes >> np.uint64(46)] = True
        step = np.exp(trans + np.array([0.0, bias]))
        self._gaps = [np.eye(2)]
        for _ in range(KEPT_POWERS):
            power = self._gaps[-1] @ step
            self._gaps.append(power / power.sum())

    def gap(self, n: int) -> np.ndarray:
        """The step without evidence to the power ``n``, up to a factor."""
        if n <= KEPT_POWERS:
            return self._gaps[n]
        half = self.gap(n // 2)
        power = half @ half @ self._gaps[n % 2]
        return power / power.sum()

    def evidence(self, features: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """The words with any feature of the field, and what their features add up to."""
        n = len(features[0])
        total, some = np.zeros(n), np.zeros(n, dtype=bool)
        for hashes in features:
            maybe = np.flatnonzero(self._table[hashes >> np.uint64(46)])
            if len(self.hashes) and len(maybe):
                at = np.minimum(np.searchsorted(self.hashes, hashes[maybe]), len(self.hashes) - 1)
                hit = self.hashes[at] == hashes[maybe]
                total[maybe[hit]] += self.weights[at[hit]]
                some[maybe[hit]] = True
        words = np.flatnonzero(some)
        return words, total[words]

    def marginals(self, positions: np.ndarray, scores: np.ndarray, n_words: int) -> np.ndarray:
        """Probability of the toxic tag at each position with evidence of a document of ``n_words`` words."""
        k = len(positions)
        ahead, behind = np.empty((k, 2)), np.empty((k, 2))
        gain = np.exp(np.minimum(scores + self.bias, 50.0))
        entry, first = np.exp(self.trans), np.ones(2)
        gap = np.diff(positions, prepend=-1).tolist()
        state = None
        for i in range(k):
            # The first word of a document has no transition into it.
            if state is None:
                before = positions[i]
                if before == 0:
                    state = first.copy()
                else:
                    start = np.array([1.0, np.exp(self.bias)])
                    state = start @ self.gap(int(before) - 1) @ entry
            else:
                state = state @ self.gap(gap[i] - 1) @ entry
            state = state * (1.0, gain[i])
            state /= state.sum()
            ahead[i] = state
        rest = self.gap(n_words - 1 - int(positions[-1])) @ np.ones(2) if k else None
        for i in range(k - 1, -1, -1):
            behind[i] = rest
            if i:
                rest = self.gap(gap[i] - 1) @ (entry @ (rest * (1.0, gain[i])))
                rest /= rest.sum()
        both = ahead * behind
        return both[:, 1] / both.sum(axis=1)

    def tag(self, texts: Texts) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, int]]:
        """For each document: starts and ends in bytes of the words with evidence, their marginals, number of words."""
        starts, ends, bounds, features = word_features(texts)
        words, scores = self.evidence(features)
        cuts = np.searchsorted(words, bounds)
        for i in range(len(texts)):
            own = slice(cuts[i], cuts[i + 1])
            n = int(bounds[i + 1] - bounds[i])
            found = self.marginals(words[own] - bounds[i], scores[own], n) if cuts[i] < cuts[i + 1] else np.zeros(0)
            yield starts[words[own]] - texts.offsets[i], ends[words[own]] - texts.offsets[i], found, n

    def score(self, marginals: np.ndarray) -> float:
        a, b, c = self.head
        z = a + b * np.log1p(marginals.sum()) + c * marginals.max(initial=0.0)
        return float(1 / (1 + np.exp(-np.clip(z, -40, 40))))


def _sequence_gradient(emit: np.ndarray, live: np.ndarray, trans: np.ndarray, gold: np.ndarray):
    """Padded sequences: expected minus observed tags, and the same for transitions, by forward-backward."""
    n, width = emit.shape
    step = np.exp(trans)
    gain = np.stack([np.ones_like(emit), np.exp(np.clip(emit, -30, 30))], axis=2)
    gain[~live] = 1.0
    ahead, behind = np.empty((width, n, 2)), np.ones((width, n, 2))
    ahead[0] = gain[:, 0] / gain[:, 0].sum(axis=1, keepdims=True)
    for i in range(1, width):
        state = (ahead[i - 1] @ step) * gain[:, i]
        state = np.where(live[:, i, None], state, ahead[i - 1])
        ahead[i] = state / state.sum(axis=1, keepdims=True)
    for i in range(width - 2, -1, -1):
        state = (behind[i + 1] * gain[:, i + 1]) @ step.T
        state = np.where(live[:, i + 1, None], state, behind[i + 1])
        behind[i] = state / state.sum(axis=1, keepdims=True)
    both = ahead * behind
    tags = (both[:, :, 1] / both.sum(axis=2)).T - gold
    tags[~live] = 0
    moves = np.zeros((2, 2))
    for i in range(1, width):
        pair = ahead[i - 1][:, :, None] * step * (gain[:, i] * behind[i])[:, None, :]
        pair = pair[live[:, i]]
        moves += (pair / pair.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
        a, b = gold[live[:, i], i - 1].astype(int), gold[live[:, i], i].astype(int)
        np.subtract.at(moves, (a, b), 1)
    return tags, moves


def _train(features: list[np.ndarray], bounds: np.ndarray, hashes: np.ndarray, gold: np.ndarray):
    """Weights, bias and transitions that fit the labelled words, by Adam with a small quadratic penalty."""
    n = len(gold)
    columns = []
    for own in features:
        at = np.minimum(np.searchsorted(hashes, own), len(hashes) - 1)
        columns.append(np.where(hashes[at] == own, at, len(hashes)))
    document = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    within = np.arange(n) - bounds[document]
    # Sequences of the training sample are cut; only those with any evidence, and as many others, take part.
    _, sequence = np.unique(document * (1 << 32) + within // SEQUENCE, return_inverse=True)
    some = np.zeros(n, bool)
    for c in columns:
        some |= c < len(hashes)
    useful = np.zeros(sequence.max() + 1, bool)
    useful[sequence[some]] = True
    others = np.flatnonzero(~useful)
    useful[others[:: max(1, len(others) // max(1, useful.sum()))]] = True
    rank = np.cumsum(useful) - 1
    keep = useful[sequence]
    row, place = rank[sequence[keep]], within[keep] % SEQUENCE
    shape = (int(useful.sum()), SEQUENCE)
    live, tags = np.zeros(shape, bool), np.zeros(shape)
    live[row, place], tags[row, place] = True, gold[keep]
    columns = [c[keep] for c in columns]
    size = len(hashes)
    theta = np.zeros(size + 5)
    theta[size] = -3.0
    first, second = np.zeros_like(theta), np.zeros_like(theta)
    emit = np.zeros(shape)
    for t in range(1, STEPS + 1):
        weight = np.append(theta[:size], 0.0)
        emit[row, place] = sum(weight[c] for c in columns) + theta[size]
        error, moves = _sequence_gradient(emit, live, theta[size + 1 :].reshape(2, 2), tags)
        each = error[row, place]
        grad = np.zeros_like(theta)
        grad[: size + 1] = sum(np.bincount(c, each, size + 1) for c in columns)
        grad[size] = each.sum()
        grad[size + 1 :] = moves.ravel()
        grad += 0.02 * theta
        first = 0.9 * first + 0.1 * grad
        second = 0.99 * second + 0.01 * grad**2
        theta -= 0.15 * (first / (1 - 0.9**t)) / (np.sqrt(second / (1 - 0.99**t)) + 1e-8)
    return theta[:size], float(theta[size]), theta[size + 1 :].reshape(2, 2)


def _logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Penalised logistic regression by Newton steps."""
    w = np.zeros(x.shape[1])
    ridge = np.diag([1e-3] + [1e-2] * (x.shape[1] - 1))
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        hessian = (x * (p * (1 - p))[:, None]).T @ x + ridge
        w -= np.linalg.solve(hessian, x.T @ (p - y) + ridge @ w)
    return w


def _distinct(keys: np.ndarray, context: np.ndarray, rows: np.ndarray) -> dict[int, int]:
    """In how many contexts each key stands in the given rows."""
    keys, context = keys[rows], context[rows]
    order = np.lexsort((context, keys))
    keys, context = keys[order], context[order]
    new = np.ones(len(keys), dtype=bool)
    new[1:] = (keys[1:] != keys[:-1]) | (context[1:] != context[:-1])
    found, counts = np.unique(keys[new], return_counts=True)
    return dict(zip(found.tolist(), counts.tolist(), strict=True))


def _clean_counts(texts: list[str], often: np.ndarray) -> Counter:
    """The same for some more texts and the given features, a few texts at a time."""
    out: Counter = Counter()
    for _, part in chunks(pa.array(texts, pa.large_string())):
        features = word_features(part)[3]
        for own in features:
            out.update(_distinct(own, np.roll(features[0], 1), np.isin(own, often)))
    return out


def fit_texts(texts: list[str], toxic: np.ndarray, clean: list[str] | tuple[str, ...] = ()) -> Field:
    """A field from labelled texts; ``clean`` ones only tell which features clean texts have too."""
    if not len(toxic) or toxic.min() == toxic.max():
        return Field(np.zeros(0, np.uint64), np.zeros(0), -9.0, np.zeros((2, 2)), (-40.0, 0.0, 0.0))
    sample = Texts(*utf8(pa.array(texts, pa.large_string())))
    _, _, bounds, features = word_features(sample)
    document = np.repeat(np.arange(len(texts)), np.diff(bounds))
    seen = [Counter(), Counter()]
    # Evidence is counted by the word before, not by document: copies of a text repeat its words in their places.
    context = np.where(np.arange(len(document)) == bounds[:-1][document], np.uint64(0), np.roll(features[0], 1))
    for own in features:
        often = _distinct(own, context, toxic[document] == 1)
        seen[1].update({k: c for k, c in often.items() if c >= LEAST_CONTEXTS})
        asked = np.isin(own, np.array(sorted(often), np.uint64))
        seen[0].update(_distinct(own, context, asked & (toxic[document] == 0)))
    if clean and seen[1]:
        seen[0] += _clean_counts(list(clean), np.array(sorted(seen[1]), np.uint64))
    n = [int((toxic == 0).sum()) + len(clean), int((toxic == 1).sum())]
    odds = {
        k: np.log((c + 0.5) / (n[1] + 1)) - np.log((seen[0][k] + 0.5) / (n[0] + 1))
        for k, c in seen[1].items() if k
    }
    chosen = sorted((k for k, v in odds.items() if v >= LEAST_ODDS), key=lambda k: (-odds[k], k))
    hashes = np.array(sorted(chosen), dtype=np.uint64)
    if not len(hashes):
        return Field(hashes, np.zeros(0), -9.0, np.zeros((2, 2)), (-40.0, 0.0, 0.0))
    sure = np.array(sorted(k for k in chosen if odds[k] >= LEAST_LABEL_ODDS), dtype=np.uint64)
    gold = np.zeros(len(document))
    for own in features:
        gold[np.isin(own, sure)] = 1
    gold[toxic[document] == 0] = 0
    weights, bias, trans = _train(features, bounds, hashes, gold)
    field = Field(hashes, weights, bias, trans, (0.0, 0.0, 0.0))
    x = np.array([[1.0, np.log1p(m.sum()), m.max(initial=0.0)] for _, _, m, _ in field.tag(sample)])
    head = _logistic(x, toxic)
    return Field(hashes, weights, bias, trans, tuple(head.tolist()))


def fit(documents: DataFrame, labels: DataFrame, sample: int = SAMPLE_DOCUMENTS, more: int = MORE_CLEAN) -> Field:
    """A field from documents (doc_id, text) and labels (doc_id, toxic): ``sample`` documents of each label and ``more``
    clean ones, by a hash."""
    by_doc = labels.filter("toxic IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").alias("_toxic"))
    pick = F.xxhash64("doc_id", F.lit("toxicity"))
    ids = None
    for label in (0, 1):
        own = by_doc.filter(F.col("_toxic") == label).orderBy(pick, "doc_id").limit(sample if label else sample + more)
        ids = own if ids is None else ids.unionByName(own)
    # One text per id, so that an id that many rows have does not outgrow the sample.
    chosen = documents.select("doc_id", "text").filter("text IS NOT NULL").join(F.broadcast(ids), "doc_id")
    rows = sorted(chosen.groupBy("doc_id").agg(F.min("text").alias("text"), F.max("_toxic").alias("_toxic")).toLocalIterator())
    toxic, clean = ([r[1] for r in rows if bool(r[2]) is label] for label in (True, False))
    own, rest = clean[:sample], clean[sample:]
    return fit_texts([*toxic, *own], np.array([1] * len(toxic) + [0] * len(own)), rest)


def score(documents: DataFrame, field: Field, threshold: float = 0.5) -> DataFrame:
    """doc_id, score and spans: byte offsets and marginals of the words tagged toxic."""
    span = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("marginal", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores, spans = [], []
            for _, texts in chunks(batch.column("text")):
                for starts, ends, found, _ in field.tag(texts):
                    scores.append(field.score(found))
                    hot = found >= threshold
                    rows = zip(starts[hot].tolist(), ends[hot].tolist(), found[hot].tolist(), strict=True)
                    spans.append([{"start": s, "end": e, "marginal": m} for s, e, m in rows])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(scores, pa.float64()), pa.array(spans, pa.list_(span))], ["doc_id", "score", "spans"])

    schema = "doc_id long, score double, spans array<struct<start: long, end: long, marginal: double>>"
    return documents.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, schema)


def reject(documents: DataFrame, field: Field, threshold: float = 0.5) -> DataFrame:
    """The documents whose score is under the threshold, all columns."""

    def keep(batch: pa.RecordBatch) -> pa.RecordBatch:
        below = [field.score(found) < threshold for _, texts in chunks(batch.column("text")) for _, _, found, _ in field.tag(texts)]
        return batch.filter(pa.array(below, pa.bool_()))

    return edit_batches(documents, keep)

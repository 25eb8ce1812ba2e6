"""Language identification by segmentation-marginalised unigrams.

Each language has a probability for every piece of a fixed public vocabulary. The probability of a word is the sum over
all its segmentations into pieces, by the forward algorithm on its UTF-8 bytes; single bytes are pieces too, so every
word has one. A text's score is the product over its words. Piece probabilities are fitted by expectation-maximisation
(forward-backward expected counts) on all words of a bounded sample of labelled rows.

Words are runs of ASCII letters and digits and of bytes above 0x7F, with a leading space and in ASCII lower case. Short
ones share lattices; longer ones, as scripts without spaces have, are summed whole, a byte at a time, in memory that
does not grow with them.

Defined cases: null texts and texts without a letter (Unicode category L) are ``und`` with score 0; ties go to the first
language in order; without any labelled row every text is ``und``; rows that repeat are predicted each, and learned
from once: of texts with one doc_id and language the least; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import ALNUM, LOWER, Hasher, Texts, chunks

# The bounded sample that the model is fitted on: documents of each language.
SAMPLE_DOCUMENTS = 300
ROUNDS = 4
SMOOTHING = 0.05
# Words of up to so many bytes share lattices, so many words each.
SHORT = 40
LATTICE_WORDS = 512
# Places of a long word whose pieces are looked up at once.
BLOCK = 4096
CACHED_WORDS = 1_000_000

_LETTER = regex.compile(r"\p{L}")


class Lattice:
    """For words as ranges of some bytes: the piece that starts at each byte and has each length, or -1."""

    def __init__(self, vocabulary: Vocabulary, data: np.ndarray, starts: np.ndarray, ends: np.ndarray):
        self.sizes = ends - starts
        hasher = Hasher(data)
        width = int(self.sizes.max(initial=0))
        self.longest = min(width, vocabulary.longest)
        self.pieces = np.full((width, self.longest, len(starts)), -1, dtype=np.int32)
        for at in range(width):
            for length in range(1, self.longest + 1):
                rows = np.flatnonzero(at + length <= self.sizes)
                if not len(rows):
                    break
                begin = starts[rows] + at
                self.pieces[at, length - 1, rows] = vocabulary.find(hasher.of(begin, begin + length))

    def forward(self, logp: np.ndarray) -> np.ndarray:
        """Forward sums: log probability of each prefix of each word, by language: (width + 1, words, languages)."""
        width, _, n = self.pieces.shape
        out = np.full((width + 1, n, logp.shape[1]), -np.inf)
        out[0] = 0
        for end in range(1, width + 1):
            terms = []
            for length in range(1, min(self.longest, end) + 1):
                ids = self.pieces[end - length, length - 1]
                terms.append(out[end - length] + np.where(ids[:, None] >= 0, logp[ids], -np.inf))
            out[end] = np.logaddexp.reduce(terms)
        return out

    def total(self, forward: np.ndarray) -> np.ndarray:
        return forward[self.sizes, np.arange(len(self.sizes))]

    def expected(self, logp: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Expected number of uses of each piece over all segmentations of all words, weighted by ``counts``."""
        width, _, n = self.pieces.shape
        forward = self.forward(logp)
        whole = self.total(forward)
        backward = np.full((width + 1, n, logp.shape[1]), -np.inf)
        backward[self.sizes, np.arange(n)] = 0
        used = np.zeros_like(logp)
        for at in range(width - 1, -1, -1):
            terms = [backward[at]]
            for length in range(1, min(self.longest, width - at) + 1):
                ids = self.pieces[at, length - 1]
                rows = np.flatnonzero(ids >= 0)
                if len(rows):
                    step = np.full(backward[at].shape, -np.inf)
                    step[rows] = logp[ids[rows]] + backward[at + length][rows]
                    terms.append(step)
                    share = np.exp(forward[at][rows] + step[rows] - whole[rows]) * counts[rows]
                    np.add.at(used, ids[rows], share)
            backward[at] = np.logaddexp.reduce(terms)
        return used


def _sum(terms: np.ndarray) -> np.ndarray:
    """Logarithm of the sum over rows of what ``terms`` are logarithms of."""
    top = terms.max(axis=0)
    return top + np.log(np.exp(terms - top).sum(axis=0))


class LongWord:
    """The same for one word of any length."""

    def __init__(self, vocabulary: Vocabulary, data: np.ndarray):
        self.vocabulary, self.hasher, self.size = vocabulary, Hasher(data), len(data)

    def _ending(self, low: int, high: int) -> np.ndarray:
        """Pieces that end at each of the places from ``low`` to before ``high``, by length: (places, lengths)."""
        end = np.arange(low, high)
        out = np.full((high - low, self.vocabulary.longest), -1, np.int32)
        for length in range(1, self.vocabulary.longest + 1):
            rows = np.flatnonzero(end >= length)
            out[rows, length - 1] = self.vocabulary.find(self.hasher.of(end[rows] - length, end[rows]))
        return out

    def total(self, logp: np.ndarray) -> np.ndarray:
        """Log probability by language; only as many sums as the longest piece has bytes are held."""
        padded = np.vstack([logp, np.full((1, logp.shape[1]), -np.inf)])
        before = np.full((self.vocabulary.longest, logp.shape[1]), -np.inf)  # nearest first
        before[0] = 0
        for low in range(1, self.size + 1, BLOCK):
            for ids in self._ending(low, min(low + BLOCK, self.size + 1)):
                here = _sum(padded[ids] + before)
                before[1:] = before[:-1]
                before[0] = here
        return before[0]

    def expected(self, logp: np.ndarray, count: float) -> np.ndarray:
        """Expected uses of each piece, for one language."""
        longest, n = self.vocabulary.longest, self.size
        ending = self._ending(1, n + 1)
        cost = np.where(ending >= 0, logp[ending, 0], -np.inf)
        ahead, behind = np.full(n + 1, -np.inf), np.full(n + 1, -np.inf)
        ahead[0] = behind[n] = 0
        for end in range(1, n + 1):
            k = min(longest, end)
            ahead[end] = _sum(ahead[end - k : end][::-1] + cost[end - 1, :k])
        for end in range(n, 0, -1):
            k = min(longest, end)
            into = slice(end - k, end)
            behind[into] = np.logaddexp(behind[into], behind[end] + cost[end - 1, :k][::-1])
        used = np.zeros_like(logp)
        for length in range(1, min(longest, n) + 1):
            ids = ending[length - 1 :, length - 1]
            rows = np.flatnonzero(ids >= 0)
            share = np.exp(ahead[rows] + cost[length - 1 + rows, length - 1] + behind[rows + length] - ahead[n]) * count
            np.add.at(used[:, 0], ids[rows], share)
        return used


class Vocabulary:
    """Pieces of a fixed public vocabulary as byte strings, and every single byte."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = {bytes([b]) for b in range(256)}
        for i in range(model.get_piece_size()):
            if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i)):
                pieces.add(model.id_to_piece(i).replace("▁", " ").encode())
        pieces.discard(b"")
        self.longest = max(map(len, pieces))
        data, starts, ends = _joined(list(pieces))
        self.hashes = np.sort(Hasher(data).of(starts, ends))
        # A table of the top bits tells most strings that are no piece at once.
        self._seen = np.zeros(1 << 22, dtype=bool)
        self._seen[self.hashes >> np.uint64(42)] = True

    def __len__(self) -> int:
        return len(self.hashes)

    def find(self, hashes: np.ndarray) -> np.ndarray:
        out = np.full(len(hashes), -1, dtype=np.int32)
        maybe = np.flatnonzero(self._seen[hashes >> np.uint64(42)])
        at = np.minimum(np.searchsorted(self.hashes, hashes[maybe]), len(self.hashes) - 1)
        hit = self.hashes[at] == hashes[maybe]
        out[maybe[hit]] = at[hit]
        return out


def _joined(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words as one array with starts and ends."""
    ends = np.cumsum([len(w) for w in words], dtype=np.int64)
    return np.frombuffer(b"".join(words), np.uint8), ends - [len(w) for w in words], ends


def lattices(vocabulary: Vocabulary, words: list[bytes]) -> Iterator[tuple[list[int], Lattice | LongWord]]:
    """Words, by place in the list, with what sums their segmentations: words of like size together, long ones alone."""
    order = sorted(range(len(words)), key=lambda i: len(words[i]))
    short = sum(len(w) <= SHORT for w in words)
    for cut in range(0, short, LATTICE_WORDS):
        rows = order[cut : min(cut + LATTICE_WORDS, short)]
        yield rows, Lattice(vocabulary, *_joined([words[i] for i in rows]))
    for i in order[short:]:
        yield [i], LongWord(vocabulary, np.frombuffer(words[i], np.uint8))


class Model:
    def __init__(self, path: str, languages: list[str], logp: np.ndarray):
        self.path, self.languages, self.logp = path, languages, logp
        self._ready = False

    def __getstate__(self) -> dict:
        return {"path": self.path, "languages": self.languages, "logp": self.logp, "_ready": False}

    def _prepare(self) -> None:
        if not self._ready:
            self.vocabulary = Vocabulary(self.path)
            self._known = np.zeros(0, np.uint64)
            self._scores = np.zeros((0, len(self.languages)), np.float32)
            self._ready = True

    def word_scores(self, texts: Texts, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Log probability of each word by language; distinct words are computed once and kept."""
        self._prepare()
        distinct, first, inverse = np.unique(texts.word_hashes(starts, ends, fold_case=True), return_index=True, return_inverse=True)
        scores = np.empty((len(distinct), len(self.languages)), np.float32)
        at = np.minimum(np.searchsorted(self._known, distinct), max(0, len(self._known) - 1))
        have = self._known[at] == distinct if len(self._known) else np.zeros(len(distinct), bool)
        scores[have] = self._scores[at[have]]
        new = np.flatnonzero(~have)
        low = LOWER[texts.data]
        words = [b" " + low[a:b].tobytes() for a, b in zip(starts[first[new]].tolist(), ends[first[new]].tolist(), strict=True)]
        for rows, lattice in lattices(self.vocabulary, words):
            if isinstance(lattice, Lattice):
                scores[new[rows]] = lattice.total(lattice.forward(self.logp))
            else:
                scores[new[rows]] = lattice.total(self.logp)
        if len(new) and len(self._known) < CACHED_WORDS:
            merged = np.concatenate([self._known, distinct[new]])
            sort = np.argsort(merged, kind="stable")
            self._known, self._scores = merged[sort], np.concatenate([self._scores, scores[new]])[sort]
        return scores[inverse]

    def score(self, texts: Texts) -> np.ndarray:
        """Log probability of each document by language."""
        starts, ends, bounds = texts.words(ALNUM)
        out = np.zeros((len(texts), len(self.languages)))
        if len(starts):
            owner = np.repeat(np.arange(len(texts)), np.diff(bounds))
            scores = self.word_scores(texts, starts, ends)
            for k in range(len(self.languages)):
                out[:, k] = np.bincount(owner, scores[:, k], len(texts))
        return out


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        langs = batch.column("lang")
        for row, texts in chunks(batch.column("text")):
            starts, ends, bounds = texts.words(ALNUM)
            low = LOWER[texts.data].tobytes()
            words = pa.array([low[a:b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)], pa.binary())
            own = pa.array(row + np.repeat(np.arange(len(texts)), np.diff(bounds)))
            yield pa.RecordBatch.from_arrays([langs.take(own), words], ["lang", "word"])


def sample_ids(usable: DataFrame, documents: int) -> DataFrame:
    """doc_id, lang: of each language the ``documents`` ids with the least hashes.

    A language's ids are counted first, and only those whose hash is low enough to be among some four times as many
    are ranked, so what one task ranks does not grow with the table.
    """
    counts = usable.groupBy("lang").agg(F.countDistinct("doc_id").alias("n"))
    pick = F.xxhash64("doc_id", F.lit("langid"))
    low = F.pmod(pick, F.lit(1 << 30)) * F.col("n") < F.lit((4.0 * documents + 100) * (1 << 30))
    near = usable.join(F.broadcast(counts), "lang").filter(low).select("doc_id", "lang").distinct()
    order = Window.partitionBy("lang").orderBy(F.pmod(pick, F.lit(1 << 30)), "doc_id")
    return near.withColumn("nth", F.row_number().over(order)).filter(F.col("nth") <= documents).select("doc_id", "lang")


def fit(labelled: DataFrame, path: str, documents: int = SAMPLE_DOCUMENTS) -> Model:
    """A model from labelled rows (doc_id, text, lang): of each language ``documents`` ids, picked by a hash.

    Words are counted where the texts are; the driver receives the sample's distinct words."""
    usable = labelled.filter("lang IS NOT NULL AND text IS NOT NULL").select("doc_id", "lang", "text")
    # One text per id and language, so that an id that many rows have neither fills the sample nor outgrows it.
    ids = sample_ids(usable.select("doc_id", "lang"), documents).select(F.col("doc_id").alias("id"), F.col("lang").alias("of"))
    same = F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("lang") == F.col("of"))
    chosen = usable.join(F.broadcast(ids), same).groupBy("doc_id", "lang").agg(F.min("text").alias("text"))
    counted = chosen.select("lang", "text").mapInArrow(_word_counts, "lang string, word binary").groupBy("lang", "word").agg(F.count(F.lit(1)).alias("n"))
    counts: dict[str, dict[bytes, int]] = {}
    for lang, word, n in counted.toLocalIterator():
        counts.setdefault(lang, {})[bytes(word)] = n
    # A language whose sample has no word at all is learned too: every word is as likely in it.
    languages = sorted({r[0] for r in ids.select("of").distinct().toLocalIterator()})
    vocabulary = Vocabulary(path)
    logp = np.full((len(vocabulary), max(1, len(languages))), -np.log(len(vocabulary)))
    for k, lang in enumerate(languages):
        words = sorted(counts.get(lang, {}))
        weight = np.array([counts[lang][w] for w in words], dtype=float)
        parts = list(lattices(vocabulary, [b" " + w for w in words]))
        mine = logp[:, k : k + 1]
        for _ in range(ROUNDS if words else 0):
            used = np.full_like(mine, SMOOTHING)
            for rows, lattice in parts:
                used += lattice.expected(mine, weight[rows][:, None] if isinstance(lattice, Lattice) else weight[rows[0]])
            mine = np.log(used / used.sum())
        logp[:, k : k + 1] = mine
    return Model(path, languages, logp)


def predict(documents: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score: the most probable language and its posterior under equal priors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = batch.column("text")
            langs, scores = [], []
            for row, texts in chunks(text):
                total = model.score(texts) if model.languages else np.zeros((len(texts), 1))
                best = total.argmax(axis=1)
                share = 1 / np.exp(total - total.max(axis=1, keepdims=True)).sum(axis=1)
                for i, value in enumerate(text.slice(row, len(texts)).to_pylist()):
                    known = bool(model.languages) and value is not None and _LETTER.search(value) is not None
                    langs.append(model.languages[best[i]] if known else "und")
                    scores.append(float(share[i]) if known else 0.0)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "lang_pred", "score"])

    return documents.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, lang_pred string, score double")


__all__ = ["Lattice", "Model", "Vocabulary", "fit", "predict"]

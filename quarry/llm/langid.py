"""Language identification: a linear-chain conditional random field over the words of a text.

Each word's labels are scored by hashed features of its bytes: prefixes and suffixes of 1 to 3, n-grams of 2 and 3, and the
word itself (the lexicon). Transition and start weights are learned with them, by maximising the likelihood of labelled
words, on code-switched sequences: segments of documents of different languages set one after another. Forward-backward
gives each word's label probabilities; a document gets the language with the greatest mean over its words.

Inference is exact and goes side by side over blocks of Settings.block words: the blocks' transfer matrices, a scan over
the blocks of each document, then forward and backward within blocks. One pass over the texts, no shuffle; memory is
bounded by a slice of texts (or one longer text).
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

ORDERS = (2, 3)
AFFIXES = (1, 2, 3)
_LETTER = regex.compile(r"\p{L}")


@dataclass(frozen=True)
class Settings:
    """documents: labelled documents of a language to learn from, about. segments: of each of them, at most, drawn from
    its whole length. words: in a segment. joined: segments in a training sequence. bits: of the feature hash."""

    documents: int = 300
    segments: int = 6
    words: int = 24
    joined: int = 4
    bits: int = 16
    rounds: int = 40
    step: float = 0.08
    l2: float = 2e-6
    block: int = 64
    seed: int = 3


@dataclass
class Model:
    settings: Settings
    labels: list[str]
    weights: np.ndarray
    start: np.ndarray
    move: np.ndarray


def _is_letter(data: np.ndarray) -> np.ndarray:
    return ((data >= 97) & (data <= 122)) | (data >= 128)


class _Words:
    """The words of texts, lower-cased: doc of each, whether it has a letter, and its features' places."""

    def __init__(self, texts: list[str | None], bits: int) -> None:
        b = self.b = common.Bytes([common.text_bytes(t.lower() if t else t) for t in texts])
        b.words()
        self.bits = np.uint64(64 - bits)
        self.begin, self.end, self.doc = b.word_begin, b.word_end, b.word_doc
        letters = np.zeros(len(b.data) + 1, np.int64)
        np.cumsum(_is_letter(b.data), out=letters[1:])
        self.has_letter = letters[self.end] > letters[self.begin]

    def _place(self, h: np.ndarray, salt: int) -> np.ndarray:
        return (common.mix64(h + np.uint64(salt * common.BASE % (1 << 64))) >> self.bits).astype(np.int32)

    def places(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(words, places) of the features, a kind at a time."""
        b, size = self.b, self.end - self.begin
        all_words = np.arange(len(size))
        yield all_words, self._place(b.hashes(self.begin, self.end), 1)
        for k in AFFIXES:
            long = all_words[size >= k]
            yield long, self._place(b.hashes(self.begin[long], self.begin[long] + k), 10 + k)
            yield long, self._place(b.hashes(self.end[long] - k, self.end[long]), 20 + k)

    def gram_sums(self, weights: np.ndarray) -> np.ndarray:
        """The sum of the weights of all n-grams of each word."""
        b, n = self.b, len(self.begin)
        if not n:
            return np.zeros((0, weights.shape[1]), np.float32)
        # letters of its word from a place on, itself included
        left = np.zeros(len(b.data), np.int32)
        size = self.end - self.begin
        inside = np.repeat(self.end, size)
        at = np.repeat(self.begin - np.cumsum(size) + size, size) + np.arange(len(inside))
        left[at] = inside - at
        padded = np.vstack([weights, np.zeros((1, weights.shape[1]), weights.dtype)])
        total = np.zeros((len(b.data), weights.shape[1]), np.float32)
        for k in ORDERS:
            if len(b.data) >= k:
                place = self._place(b.grams(k), 30 + k)
                place[left[: len(place)] < k] = len(weights)
                total[: len(place)] += padded[place]
        return np.add.reduceat(total, self.begin, axis=0)

    def gram_places(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        b = self.b
        for k in ORDERS:
            if len(b.data) < k:
                continue
            place = self._place(b.grams(k), 30 + k)
            at = np.arange(len(place))
            word = np.searchsorted(self.begin, at, "right") - 1
            ok = (word >= 0) & (at + k <= self.end[np.maximum(word, 0)]) if len(self.begin) else np.zeros(len(at), bool)
            yield word[ok], place[ok]

    def scores(self, weights: np.ndarray) -> np.ndarray:
        """Label scores of each word, per root of its length; none for a word without a letter."""
        out = self.gram_sums(weights)
        for word, place in self.places():
            out[word] += weights[place]
        out /= np.sqrt(np.maximum(1, self.end - self.begin))[:, None].astype(np.float32)
        out[~self.has_letter] = 0
        return out


def _normal(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(x.sum(-1, keepdims=True), 1e-300)


def marginal_sums(scores: np.ndarray, counted: np.ndarray, doc: np.ndarray, n_docs: int, m: Model) -> np.ndarray:
    """Sums of the label probabilities of the counted words, by document (n_docs, labels). doc is sorted."""
    k, size = len(m.labels), m.settings.block
    out = np.zeros((n_docs, k))
    n = len(scores)
    if not n:
        return out
    emit = np.exp(scores - scores.max(1, keepdims=True)).astype(np.float64)
    move = np.exp(m.move - m.move.max())
    begin = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]]))
    length = np.diff(np.append(begin, n))
    per = -(-length // size)
    owner = np.repeat(np.arange(len(begin)), per)
    place = np.arange(len(owner)) - np.repeat(np.cumsum(per) - per, per)
    first = begin[owner] + place * size
    count = np.minimum(size, length[owner] - place * size)
    order = np.argsort(-count, kind="stable")
    active = [int(np.searchsorted(-count[order], -t, "left")) for t in range(size)]  # blocks with more than t words
    f, head = first[order], place[order] == 0
    # transfer matrices: from the state before a block to that of its last word
    matrix = np.empty((len(f), k, k))
    for t in range(size):
        a = active[t]
        if not a:
            break
        e = emit[f[:a] + t][:, None, :]
        step = move if t else np.where(head[:a, None, None], np.eye(k), move)
        matrix[:a] = (matrix[:a] @ step if t else np.broadcast_to(step, (a, k, k))) * e
        matrix[:a] /= matrix[:a].sum((1, 2), keepdims=True)
    back = np.empty_like(order)
    back[order] = np.arange(len(order))
    # along the blocks of each document; documents with more blocks come first
    left, right = np.empty((len(f), k)), np.ones((len(f), k))
    base = np.cumsum(per) - per
    by_blocks = np.argsort(-per, kind="stable")
    state = np.tile(_normal(np.exp(m.start - m.start.max())), (len(begin), 1))
    most = int(per.max())
    for t in range(most):
        a = int(np.searchsorted(-per[by_blocks], -t, "left"))
        at = back[base[by_blocks[:a]] + t]
        left[at] = state[:a]
        state[:a] = _normal(np.einsum("nk,nkj->nj", state[:a], matrix[at]))
    state = np.ones((len(begin), k))
    for t in range(most - 1, -1, -1):
        a = int(np.searchsorted(-per[by_blocks], -t, "left"))
        at = back[base[by_blocks[:a]] + t]
        right[at] = state[:a]
        state[:a] = _normal(np.einsum("nkj,nj->nk", matrix[at], state[:a]))
    # within blocks
    forward = np.empty((size, len(f), k))
    alpha = left.copy()
    for t in range(size):
        a = active[t]
        if not a:
            break
        moved = alpha[:a] @ move if t else np.where(head[:a, None], alpha[:a], alpha[:a] @ move)
        alpha[:a] = forward[t, :a] = _normal(moved * emit[f[:a] + t])
    beta, sums = right, np.zeros((len(f), k))
    for t in range(size - 1, -1, -1):
        a = active[t]
        if not a:
            continue
        gamma = _normal(forward[t, :a] * beta[:a])
        sums[:a] += gamma * counted[f[:a] + t][:, None]
        beta[:a] = _normal((emit[f[:a] + t] * beta[:a]) @ move.T)
    for j in range(k):
        out[:, j] = np.bincount(doc[first[order]], sums[:, j], minlength=n_docs)
    return out


def predict(m: Model | None, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
    """Language and score of each text; und and 0 for null, for a text without a letter, and without a model."""
    names, scores = ["und"] * len(texts), np.zeros(len(texts))
    if m is None:
        return names, scores
    for a, b in common.slices(texts, 2 * common.SLICE_BYTES):
        own = texts[a:b]
        w = _Words(own, m.settings.bits)
        sums = marginal_sums(w.scores(m.weights), w.has_letter, w.doc, len(own), m)
        total = sums.sum(1)
        for i, t in enumerate(own):
            if t and total[i] > 0 and _LETTER.search(t):
                best = int(sums[i].argmax())  # of equal ones the first by name
                names[a + i], scores[a + i] = m.labels[best], min(1.0, sums[i, best] / total[i])
    return names, scores


def _likelihood_gradient(emit: np.ndarray, y: np.ndarray, start: np.ndarray, move: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Observed minus expected: (sequences, length, labels) for words, and for start and move. All sequences have one length."""
    n, length, k = emit.shape
    e = np.exp(emit - emit.max(2, keepdims=True))
    s, a = np.exp(start - start.max()), np.exp(move - move.max())
    alpha, beta = np.empty_like(e), np.ones_like(e)
    alpha[:, 0] = _normal(s * e[:, 0])
    for t in range(1, length):
        alpha[:, t] = _normal((alpha[:, t - 1] @ a) * e[:, t])
    for t in range(length - 2, -1, -1):
        beta[:, t] = _normal((beta[:, t + 1] * e[:, t + 1]) @ a.T)
    gamma = _normal(alpha * beta)
    moves = np.zeros((k, k))
    for t in range(1, length):
        pair = alpha[:, t - 1, :, None] * a * (e[:, t] * beta[:, t])[:, None, :]
        moves += (pair / np.maximum(pair.sum((1, 2), keepdims=True), 1e-300)).sum(0)
    seen = np.zeros((k, k))
    np.add.at(seen, (y[:, :-1].ravel(), y[:, 1:].ravel()), 1)
    out = -gamma
    np.put_along_axis(out, y[:, :, None], np.take_along_axis(out, y[:, :, None], 2) + 1, 2)
    return out, np.bincount(y[:, 0], minlength=k) - gamma[:, 0].sum(0), seen - moves


def fit(segments: list[tuple[int, list[str]]], labels: list[str], s: Settings) -> Model:
    """segments: (label, words), each of s.words words."""
    rng = np.random.default_rng(s.seed)
    k, n = len(labels), len(segments)
    vocabulary: dict[str, int] = {}
    ids = np.array([[vocabulary.setdefault(w, len(vocabulary)) for w in words] for _, words in segments], np.int64)
    y = np.array([label for label, _ in segments])
    w = _Words(list(vocabulary), s.bits)  # one word each
    if len(w.begin) != len(vocabulary):
        raise ValueError("a word holds white space")
    word, place = (np.concatenate(x) for x in zip(*w.places(), *w.gram_places()))
    at, place = np.unique(place, return_inverse=True)
    scale = (1 / np.sqrt(np.maximum(1, w.end - w.begin))) * w.has_letter
    value = scale[word]
    params = np.zeros(len(at) * k + k + k * k)
    first, second = np.zeros_like(params), np.zeros_like(params)
    whole = max(1, n // s.joined)
    for t in range(1, s.rounds + 1):
        order = rng.permutation(n)[: whole * s.joined] if n >= s.joined else rng.integers(0, n, s.joined)
        x = ids[order].reshape(whole, -1)
        labels_at = np.repeat(y[order], s.words).reshape(whole, -1)
        theta, start, move = params[: len(at) * k].reshape(-1, k), params[len(at) * k : len(at) * k + k], params[len(at) * k + k :].reshape(k, k)
        scores = np.stack([np.bincount(word, theta[place, j] * value, minlength=len(vocabulary)) for j in range(k)], 1)
        g, gs, gm = _likelihood_gradient(scores[x], labels_at, start, move)
        total = x.size
        by_word = np.stack([np.bincount(x.ravel(), g[:, :, j].ravel(), minlength=len(vocabulary)) for j in range(k)], 1)
        by_place = np.stack([np.bincount(place, by_word[word, j] * value, minlength=len(at)) for j in range(k)], 1)
        grad = -np.concatenate([by_place.ravel() / total - s.l2 * theta.ravel(), gs / whole / x.shape[1], gm.ravel() / total])
        first = 0.9 * first + 0.1 * grad
        second = 0.99 * second + 0.01 * grad * grad
        params = params - s.step * (first / (1 - 0.9**t)) / (np.sqrt(second / (1 - 0.99**t)) + 1e-10)
    weights = np.zeros((1 << s.bits, k), np.float32)
    weights[at] = params[: len(at) * k].reshape(-1, k)
    return Model(s, labels, weights, params[len(at) * k : len(at) * k + k].copy(), params[len(at) * k + k :].reshape(k, k).copy())


def train(docs: DataFrame, allowed, s: Settings = Settings()) -> Model | None:
    """Learns from text and non-null lang of allowed rows of docs(doc_id, text, lang): of each language about s.documents,
    by a hash of the id. None without any."""
    own = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & allowed).select(F.col("lang").cast("string").alias("lang"), "text", F.xxhash64("doc_id").alias("h"))
    per = sorted((r.lang, r["count"]) for r in own.groupBy("lang").count().collect())  # one row per language
    if not per:
        return None
    shares = F.create_map(*[F.lit(x) for lang, n in per for x in (lang, min(1.0, s.documents / n))])
    words, segments = s.words, s.segments

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, out = [], []
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()):
                w = [x.decode("utf-8", "surrogatepass") for x in common.text_bytes(text.lower()).split()]
                n = len(w) // words
                if n:
                    chosen = np.random.default_rng(zlib.crc32(common.text_bytes(text))).permutation(n)[:segments]
                    parts = [w[i * words : (i + 1) * words] for i in sorted(chosen)]
                elif w:
                    parts = [(w * words)[:words]]
                else:
                    continue
                langs += [lang] * len(parts)
                out += [" ".join(p) for p in parts]
            yield pa.RecordBatch.from_pydict({"lang": pa.array(langs, pa.string()), "words": pa.array(out, pa.string())})

    some = own.filter(F.pmod("h", F.lit(1_000_000)) < shares[F.col("lang")] * 1_000_000).select("lang", "text")
    got = some.mapInArrow(cut, "lang string, words string").toPandas()
    labels = sorted(set(got["lang"]))
    if not labels:
        return None
    number = {x: i for i, x in enumerate(labels)}
    parts = sorted((number[lang], text) for lang, text in zip(got["lang"], got["words"]))
    return fit([(i, [x.decode("utf-8", "surrogatepass") for x in text.encode("utf-8", "surrogatepass").split()]) for i, text in parts], labels, s)


def allowed(remainder: int = 1, modulus: int = 3):
    """Whether a document may be learned from."""
    return common.id_crc() % modulus != remainder


def identify(docs: DataFrame, s: Settings = Settings()) -> DataFrame:
    """doc_id, held_out, lang_pred, score for each row of docs(doc_id, text, lang).

    A null text, or one without a letter, is und with score 0. Repeated rows are predicted alike.
    """
    m = train(docs, allowed(), s)
    shared = docs.sparkSession.sparkContext.broadcast(m)  # 2**bits rows of one weight per language

    @F.pandas_udf("lang_pred string, score double")
    def guess(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for t in texts:
            names, scores = predict(shared.value, t.where(t.notna(), None).tolist())
            yield pd.DataFrame({"lang_pred": names, "score": scores})

    got = docs.select("doc_id", (~allowed()).alias("held_out"), guess("text").alias("g"))
    return got.select("doc_id", "held_out", "g.lang_pred", "g.score")

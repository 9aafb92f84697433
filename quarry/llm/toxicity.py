"""Toxicity: a linear classifier of character n-grams whose features are scaled by naive Bayes log-count ratios.

A feature is whether an n-gram of bytes (4 to 9) occurs in the lower-cased text, in which ASCII bytes other than letters
and digits are spaces; it may begin or end with a space, but doesn't reach over one. So stems with changing endings count. The executors count, over a bounded sample of labelled documents (Settings.most), in how many
documents of either class each n-gram occurs; the driver keeps the Settings.features strongest, scales them by the
ratio of the classes' smoothed frequencies, and fits a logistic regression with a quadratic penalty. n-grams are told
apart by a 64-bit hash, so no two share a weight. Every text is scored whole, in one pass without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, labelled

ORDERS = (4, 5, 6, 7, 8, 9)
_FOLD = bytes(i if chr(i).isalnum() and i < 128 or i >= 128 else 32 for i in range(256))
FLAG_BITS = 20


@dataclass(frozen=True)
class Settings:
    """most: labelled documents to fit on, at most. features: n-grams with a weight, at most."""

    most: int = 3000
    features: int = 20_000
    least: int = 3
    l2: float = 1e-3
    rounds: int = 150
    step: float = 0.02
    threshold: float = 0.5


@dataclass
class Model:
    """keys: sorted hashes. weights: of the keys, scaled by their ratios. flags: whether any key has these top bits."""

    bias: float
    keys: np.ndarray
    weights: np.ndarray
    flags: np.ndarray


def fold(text: str | None) -> bytes:
    return common.text_bytes(text.lower() if text else text).translate(_FOLD)


def _grams(texts: list[str | None], flags: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(document, hash) of all n-grams, or of those whose top bits are flagged. A space stands before and after a text."""
    b = common.Bytes([b"", *(fold(t) for t in texts)])
    docs, hashes = [], []
    spaces = np.zeros(len(b.data) + 1, np.int64)  # before each place
    np.cumsum(b.data == 32, out=spaces[1:])
    for n in ORDERS:
        h = b.grams(n) * np.uint64(common.BASE)
        # the other look-up needs no such test: no key reaches over a space
        at = np.flatnonzero(spaces[n - 1 : -1] == spaces[1 : -n + 1]) if flags is None else np.flatnonzero(flags[(h >> np.uint64(64 - FLAG_BITS)).astype(np.int32)])
        d = np.searchsorted(b.end, at, "right")  # the space that ends a document begins the next
        inside = (d > 0) & (d < b.n)
        at, d = at[inside], d[inside]
        inside = at + n <= b.end[d] + 1
        docs.append(d[inside] - 1)
        hashes.append(h[at[inside]] + np.uint64(n))
    return np.concatenate(docs), np.concatenate(hashes)


def _distinct(doc: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((key, doc))
    d, k = doc[order], key[order]
    new = np.ones(len(d), bool)
    new[1:] = (d[1:] != d[:-1]) | (k[1:] != k[:-1])
    return d[new], k[new]


def raw_scores(m: Model, texts: list[str | None]) -> np.ndarray:
    """The linear score: each n-gram with a weight counts once for a document."""
    doc, key = _grams(texts, m.flags)
    at = np.minimum(np.searchsorted(m.keys, key), max(0, len(m.keys) - 1))
    hit = m.keys[at] == key if len(m.keys) else np.zeros(0, bool)
    doc, at = _distinct(doc[hit], at[hit])
    return m.bias + np.bincount(doc, m.weights[at], minlength=len(texts))


def _flags(keys_without_order: np.ndarray) -> np.ndarray:
    flags = np.zeros(1 << FLAG_BITS, bool)
    flags[(keys_without_order >> np.uint64(64 - FLAG_BITS)).astype(np.int64)] = True
    return flags


def fit(row: np.ndarray, at: np.ndarray, ratio: np.ndarray, y: np.ndarray, s: Settings) -> tuple[float, np.ndarray]:
    """Bias and weights (already times ratio) that fit the logistic loss with equal weight of the classes, by Adam."""
    n, k = len(y), len(ratio)
    share = y.mean()
    weight = np.where(y > 0, 0.5 / share, 0.5 / (1 - share)) / n
    scaled = ratio[at]
    w, first, second = np.zeros(k + 1), np.zeros(k + 1), np.zeros(k + 1)
    for t in range(1, s.rounds + 1):
        out = w[0] + np.bincount(row, w[1 + at] * scaled, minlength=n)
        g = (1 / (1 + np.exp(-np.clip(out, -30, 30))) - y) * weight
        grad = np.concatenate([[g.sum()], np.bincount(at, g[row] * scaled, minlength=k) + s.l2 * w[1:]])
        first = 0.9 * first + 0.1 * grad
        second = 0.99 * second + 0.01 * grad * grad
        w = w - s.step * (first / (1 - 0.9**t)) / (np.sqrt(second / (1 - 0.99**t)) + 1e-8)
    return float(w[0]), w[1:] * ratio


def train(docs: DataFrame, labels: DataFrame, allowed, s: Settings = Settings()) -> Model | None:
    """Fits on a bounded sample; None where one class has no labelled document."""
    zero, one = labelled.counts(labels, "toxic", allowed)
    if not zero or not one:
        return None
    rows = common.settle(labelled.sample(docs, labels, "toxic", allowed, s.most))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, ys = batch.column("text").to_pylist(), np.array(batch.column("y").to_pylist(), np.int64)
            for a, b in common.slices(texts, common.SLICE_BYTES // 2):
                doc, key = _distinct(*_grams(texts[a:b]))
                k, at = np.unique(key, return_inverse=True)
                one = np.bincount(at, ys[a:b][doc], minlength=len(k)).astype(np.int64)
                yield pa.RecordBatch.from_pydict({"k": k.view(np.int64), "one": one, "zero": np.bincount(at, minlength=len(k)) - one})

    sizes = {r.y: r["count"] for r in rows.groupBy("y").count().collect()}
    n0, n1 = sizes.get(0, 0), sizes.get(1, 0)
    if not n0 or not n1:
        return None
    spread = rows.repartition(max(1, rows.sparkSession.sparkContext.defaultParallelism), "doc_id")
    found = spread.mapInArrow(count, "k long, one long, zero long").groupBy("k").agg(F.sum("one").alias("one"), F.sum("zero").alias("zero"))
    ratio = F.log((F.col("one") + 1) / (n1 + 2)) - F.log((F.col("zero") + 1) / (n0 + 2))
    gap = F.abs(F.col("one") / n1 - F.col("zero") / n0)
    found = found.filter(F.greatest("one", "zero") >= s.least).withColumn("ratio", ratio).withColumn("gain", F.abs("ratio") * gap)
    best = found.orderBy(F.desc("gain"), "k").limit(s.features).select("k", "ratio").toPandas()
    best["u"] = best["k"].to_numpy(np.int64).view(np.uint64)
    best = best.sort_values("u")
    keys, ratios = best["u"].to_numpy(), best["ratio"].to_numpy(float)
    if not len(keys):
        return None
    flags = np.zeros(1 << FLAG_BITS, bool)
    for n in ORDERS:
        flags |= _flags(keys - np.uint64(n))
    shared = rows.sparkSession.sparkContext.broadcast(Model(0.0, keys, ratios, flags))

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            texts, ys = batch.column("text").to_pylist(), batch.column("y").to_pylist()
            ids = batch.column("doc_id").cast(pa.string()).to_pylist()
            for a, b in common.slices(texts):
                doc, key = _grams(texts[a:b], m.flags)
                at = np.minimum(np.searchsorted(m.keys, key), len(m.keys) - 1)
                doc, at = _distinct(doc[m.keys[at] == key], at[m.keys[at] == key])
                cuts = np.searchsorted(doc, np.arange(b - a + 1))
                lists = pa.array([at[i:j].astype("int32") for i, j in zip(cuts, cuts[1:])], pa.list_(pa.int32()))
                yield pa.RecordBatch.from_pydict({"id": ids[a:b], "y": pa.array(ys[a:b], pa.int32()), "at": lists})

    got = spread.mapInArrow(extract, "id string, y int, at array<int>").toPandas().sort_values("id")
    row = np.repeat(np.arange(len(got)), got["at"].map(len))
    at = np.concatenate(list(got["at"])).astype(np.int64)
    bias, weights = fit(row, at, ratios, got["y"].to_numpy(float), s)
    del got, row, at
    common.release()
    return Model(bias, keys, weights, flags)


def score_column(spark, m: Model | None):
    """A function of a text column: the score, 0 to 1; empty and null texts have one too. Without a model, 0."""
    if m is None:
        return lambda text: F.lit(0.0)
    shared = spark.sparkContext.broadcast(m)  # at most Settings.features weights

    @F.pandas_udf("double")
    def score(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = shared.value
        for t in texts:
            t = t.tolist()
            out = [raw_scores(own, t[a:b]) for a, b in common.slices(t)]
            x = np.concatenate(out) if out else np.zeros(0)
            yield pd.Series(1 / (1 + np.exp(-np.clip(x, -30, 30))))

    return lambda text: score(F.coalesce(F.col(text), F.lit("")))


def allowed(remainder: int = 0, modulus: int = 5):
    """Whether a document may be learned from."""
    return common.id_crc() % modulus != remainder


def classify(docs: DataFrame, labels: DataFrame, s: Settings = Settings()) -> DataFrame:
    """doc_id, held_out, score, predicted for each row of docs(doc_id, text); labels(doc_id, toxic).

    A null text scores as an empty one. Repeated rows score alike. Without labels of both classes all scores are 0.
    """
    score = score_column(docs.sparkSession, train(docs, labels, allowed(), s))
    return labelled.scored(docs, ~allowed(), score("text"), s.threshold)


def kept(docs: DataFrame, labels: DataFrame, s: Settings = Settings()) -> DataFrame:
    """The rows of docs that are not rejected, with its columns."""
    score = score_column(docs.sparkSession, train(docs, labels, allowed(), s))
    name = common.unused("score", docs.columns)
    return docs.withColumn(name, score("text")).filter(F.col(name) < s.threshold).select(*docs.columns)

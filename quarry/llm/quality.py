"""Quality classifier: a factorisation machine.

Inputs of a document: hashed words with damped counts, normalised, and statistics of its structure and length,
standardised. The score is the logistic of

    b + sum_i w_i x_i + 1/2 sum_f ((sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2),

all pairwise interactions at a cost linear in the inputs. Fitted on a bounded sample of labelled documents (Settings.most)
with numpy on the driver, from features that the executors extract; every text is scored whole, in one pass without a
shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, labelled

N_STATS = 16


@dataclass(frozen=True)
class Settings:
    """most: labelled documents to fit on, at most. bits: of the word hash. rank: length of the interaction vectors."""

    most: int = 4000
    bits: int = 15
    rank: int = 4
    rounds: int = 80
    step: float = 0.05
    word_l2: float = 3e-3
    stat_l2: float = 1e-4
    seed: int = 5
    threshold: float = 0.7


@dataclass
class Model:
    settings: Settings
    bias: float
    w: np.ndarray
    v: np.ndarray
    mean: np.ndarray
    scale: np.ndarray


def _per_doc(values: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Sums of a boolean array over [begin, end)."""
    sums = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=sums[1:])
    return sums[end] - sums[begin]


def _repeats(doc: np.ndarray, key: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (doc, key) with counts; per document their number and the largest count."""
    order = np.lexsort((key, doc))
    d, k = doc[order], key[order]
    new = np.ones(len(d), bool)
    new[1:] = (d[1:] != d[:-1]) | (k[1:] != k[:-1])
    at = np.flatnonzero(new)
    count = np.diff(np.append(at, len(d)))
    most = np.zeros(n, np.int64)
    np.maximum.at(most, d[at], count)
    return d[at], k[at], count, np.bincount(d[at], minlength=n), most


def features(texts: list[str | None], bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(statistics (n, N_STATS), doc, index, value): the sparse part is sorted by doc; the values of a document have norm 1."""
    raw = [common.text_bytes(t) for t in texts]
    b = common.Bytes(raw)
    b.words()
    n, data = b.n, b.data
    size = np.maximum(1, b.end - b.begin).astype(float)
    per = lambda mask: _per_doc(mask, b.begin, b.end) / size
    words = np.bincount(b.word_doc, minlength=n)
    some = np.maximum(1, words).astype(float)
    last = data[b.word_end - 1] if len(b.word_end) else np.zeros(0, np.uint8)
    letter = lambda x: ((x >= 65) & (x <= 90)) | ((x >= 97) & (x <= 122)) | (x >= 128)
    usual = letter(last) | ((last >= 48) & (last <= 57)) | np.isin(last, np.frombuffer(b".,;:", np.uint8))
    odd = np.bincount(b.word_doc[~usual], minlength=n) / some
    single = np.bincount(b.word_doc[(b.word_end - b.word_begin) == 1], minlength=n) / some
    key = common.mix64(b.hashes(b.word_begin, b.word_end))
    index = (key >> np.uint64(64 - bits)).astype(np.int64)
    doc, at, count, distinct, most = _repeats(b.word_doc, index, n)
    value = np.log1p(count)
    norm = np.sqrt(np.bincount(doc, value * value, minlength=n))
    value = value / np.maximum(norm[doc], 1e-12)
    # lines: a text ends one, too
    line_end = np.union1d(np.flatnonzero(data == 10), b.end)
    line_begin = np.concatenate([[0], line_end[:-1] + 1])
    line_doc = np.searchsorted(b.end, line_begin, "right")
    keep = line_end > line_begin
    line_begin, line_end, line_doc = line_begin[keep], line_end[keep], line_doc[keep]
    _, _, _, lines, _ = _repeats(line_doc, b.hashes(line_begin, line_end), n)
    all_lines = np.bincount(line_doc, minlength=n)
    chars = np.array([len(t) if t else 0 for t in texts], float)
    stats = np.stack([
        np.log1p(chars), np.log1p(words), (b.end - b.begin) / some, per((data >= 65) & (data <= 90)), per((data >= 97) & (data <= 122)),
        per((data >= 48) & (data <= 57)), per((data > 32) & (data < 127) & ~letter(data) & ~((data >= 48) & (data <= 57))), per(data >= 128),
        per(data == 10), odd, single, distinct / some, most / some, (all_lines - lines) / np.maximum(1, all_lines),
        per(np.isin(data, np.frombuffer(b".,;:", np.uint8))), np.log1p(all_lines),
    ], 1)
    return stats, doc, at, value


def _sums(values: np.ndarray, row: np.ndarray, n: int) -> np.ndarray:
    if values.ndim == 1:
        return np.bincount(row, values, minlength=n)
    return np.stack([np.bincount(row, values[:, f], minlength=n) for f in range(values.shape[1])], 1)


def raw_scores(m: Model, stats: np.ndarray, row: np.ndarray, index: np.ndarray, value: np.ndarray) -> np.ndarray:
    """The machine's value before the logistic; statistics come after the hashed words in w and v."""
    n, dims = len(stats), 1 << m.settings.bits
    z = np.clip((stats - m.mean) / m.scale, -4, 4)
    vx = m.v[index] * value[:, None]
    sums = _sums(vx, row, n) + z @ m.v[dims:]
    squares = np.bincount(row, (vx * vx).sum(1), minlength=n) + (z * z) @ (m.v[dims:] ** 2).sum(1)
    linear = np.bincount(row, m.w[index] * value, minlength=n) + z @ m.w[dims:]
    return m.bias + linear + 0.5 * ((sums * sums).sum(1) - squares)


def fit(stats: np.ndarray, row: np.ndarray, index: np.ndarray, value: np.ndarray, y: np.ndarray, prior: float, s: Settings) -> Model:
    """Logistic loss by Adam over all rows; the bias is then moved from the sample's class share to prior."""
    n, dims = len(stats), 1 << s.bits
    rng = np.random.default_rng(s.seed)
    mean, scale = stats.mean(0), np.maximum(stats.std(0), 1e-6)
    m = Model(s, 0.0, np.zeros(dims + N_STATS), np.zeros((dims + N_STATS, s.rank)), mean, scale)
    seen = np.unique(index)
    m.v[seen] = rng.normal(0, 0.01, (len(seen), s.rank))
    m.v[dims:] = rng.normal(0, 0.05, (N_STATS, s.rank))
    z = np.clip((stats - mean) / scale, -4, 4)
    # equal weight of the classes
    share = max(y.mean(), 1e-9)
    weight = np.where(y > 0, 0.5 / share, 0.5 / max(1 - share, 1e-9)) / n
    at, local = np.unique(index, return_inverse=True)
    slots = np.concatenate([at, np.arange(dims, dims + N_STATS)])
    p = np.concatenate([[0.0], m.w[slots], m.v[slots].ravel()])
    first, second = np.zeros_like(p), np.zeros_like(p)
    k, a = len(slots), len(at)
    sums = np.empty((n, s.rank))
    decay = np.concatenate([np.full(a, s.word_l2), np.full(N_STATS, s.stat_l2)])
    for t in range(1, s.rounds + 1):
        w, v = p[1 : k + 1], p[k + 1 :].reshape(k, s.rank)
        # one factor after the other: arrays of all hashed words times the rank are the largest that the driver would hold
        square = np.zeros(len(local))
        for f in range(s.rank):
            vx = v[local, f] * value
            sums[:, f] = np.bincount(row, vx, minlength=n)
            square += vx * vx
        sums += z @ v[a:]
        squares = np.bincount(row, square, minlength=n) + (z * z) @ (v[a:] ** 2).sum(1)
        out = p[0] + np.bincount(row, w[local] * value, minlength=n) + z @ w[a:] + 0.5 * ((sums * sums).sum(1) - squares)
        g = (1 / (1 + np.exp(-np.clip(out, -30, 30))) - y) * weight
        gx = g[row] * value
        gw = np.concatenate([np.bincount(local, gx, minlength=a), z.T @ g])
        gv = np.stack([np.bincount(local, gx * (sums[row, f] - v[local, f] * value), minlength=a) for f in range(s.rank)], 1)
        gv = np.concatenate([gv, z.T @ (g[:, None] * sums) - ((z * z).T @ g)[:, None] * v[a:]])
        grad = np.concatenate([[g.sum()], gw + decay * w, (gv + decay[:, None] * v).ravel()])
        first = 0.9 * first + 0.1 * grad
        second = 0.99 * second + 0.01 * grad * grad
        p = p - s.step * (first / (1 - 0.9**t)) / (np.sqrt(second / (1 - 0.99**t)) + 1e-8)
    m.w[slots], m.v[slots] = p[1 : k + 1], p[k + 1 :].reshape(k, s.rank)
    clipped = min(max(prior, 1e-3), 1 - 1e-3)
    m.bias = float(p[0] + np.log(clipped / (1 - clipped)))
    return m


def train(docs: DataFrame, labels: DataFrame, allowed, s: Settings = Settings()) -> Model | None:
    """Fits on a bounded sample; None where one class has no labelled document."""
    bits = s.bits

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, ys = batch.column("text").to_pylist(), batch.column("y").to_pylist()
            ids = batch.column("doc_id").cast(pa.string()).to_pylist()
            for a, b in common.slices(texts):
                stats, row, index, value = features(texts[a:b], bits)
                cuts = np.searchsorted(row, np.arange(b - a + 1))
                yield pa.RecordBatch.from_pydict({
                    "id": ids[a:b], "y": pa.array(ys[a:b], pa.int32()), "stats": pa.array(list(stats), pa.list_(pa.float64())),
                    "at": pa.array([index[i:j].astype("int32") for i, j in zip(cuts, cuts[1:])], pa.list_(pa.int32())),
                    "value": pa.array([value[i:j].astype("float32") for i, j in zip(cuts, cuts[1:])], pa.list_(pa.float32())),
                })

    zero, one = labelled.counts(labels, "quality", allowed)
    if not zero or not one:
        return None
    rows = labelled.sample(docs, labels, "quality", allowed, s.most).mapInArrow(extract, "id string, y int, stats array<double>, at array<int>, value array<float>")
    # not by pandas, which would make an object of each row's list
    got = rows.toArrow().sort_by("id").combine_chunks()
    y = got.column("y").to_numpy().astype(float)
    if len(np.unique(y)) < 2:
        return None
    flat = lambda c: got.column(c).combine_chunks().flatten().to_numpy(zero_copy_only=False)
    row = np.repeat(np.arange(len(y)), pc.list_value_length(got.column("at")).to_numpy())
    m = fit(flat("stats").reshape(len(y), N_STATS), row, flat("at").astype(np.int64), flat("value").astype(float), y, one / (zero + one), s)
    del got, row, flat
    common.release()
    return m


def score_column(spark, m: Model | None):
    """A function of a text column: the score, 0 to 1; empty and null texts have one too. Without a model, 0.5."""
    if m is None:
        return lambda text: F.lit(0.5)
    shared = spark.sparkContext.broadcast(m)  # of fixed size: 2**bits + N_STATS rows

    @F.pandas_udf("double")
    def score(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = shared.value
        for t in texts:
            t = t.tolist()
            out = [raw_scores(own, *features(t[a:b], own.settings.bits)) for a, b in common.slices(t)]
            x = np.concatenate(out) if out else np.zeros(0)
            yield pd.Series(1 / (1 + np.exp(-np.clip(x, -30, 30))))

    return lambda text: score(F.coalesce(F.col(text), F.lit("")))


def allowed(remainder: int = 2, modulus: int = 4):
    """Whether a document may be learned from."""
    return common.id_crc() % modulus != remainder


def classify(docs: DataFrame, labels: DataFrame, s: Settings = Settings()) -> DataFrame:
    """doc_id, held_out, score, predicted for each row of docs(doc_id, text); labels(doc_id, quality).

    A null text scores as an empty one. Repeated rows score alike. Without labels of both classes all scores are 0.5.
    """
    score = score_column(docs.sparkSession, train(docs, labels, allowed(), s))
    return labelled.scored(docs, ~allowed(), score("text"), s.threshold)


def kept(docs: DataFrame, labels: DataFrame, s: Settings = Settings()) -> DataFrame:
    """The rows of docs that are not rejected, with its columns."""
    score = score_column(docs.sparkSession, train(docs, labels, allowed(), s))
    name = common.unused("score", docs.columns)
    return docs.withColumn(name, score("text")).filter(F.col(name) >= s.threshold).select(*docs.columns)

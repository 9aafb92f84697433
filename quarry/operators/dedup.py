"""Duplicates: exact by content hash or key, near by Hamming distance."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.operators.joins import first_by
from quarry.runtime import settle


def exact(files: DataFrame, digest: str, source: str, seq: str, preferred: str = "ntfs") -> DataFrame:
    """The first file of each digest: those of the preferred source come first, then by seq."""
    return first_by(files, [digest], [F.coalesce(F.col(source) != preferred, F.lit(True)), F.col(seq)])


def upsert(rows: DataFrame, key: str, seq: str) -> DataFrame:
    """One row per key: of each column the last value by seq that isn't null overlays the earlier ones."""
    rest = [c for c in rows.columns if c not in (key, seq)]
    return rows.groupBy(key).agg(*[F.max_by(c, F.when(F.col(c).isNotNull(), F.col(seq))).alias(c) for c in rest])


def hamming_pairs(hashes: DataFrame, key: str, h: str, limit: int, bits: int = 64) -> DataFrame:
    """(a, b, distance), a < b, of all pairs within limit bits: rows meet in one of limit + 1 blocks of bits in which
    close hashes must agree, and a pair counts in the first of them only."""
    n = limit + 1
    cuts = [bits * i // n for i in range(n + 1)]
    part = lambda x, i: F.shiftrightunsigned(x, cuts[i]).bitwiseAND(F.lit((1 << (cuts[i + 1] - cuts[i])) - 1))
    d = hashes.select(F.col(key).alias("k"), F.col(h).cast("long").alias("h")).filter("h is not null")
    e = d.select("k", "h", F.posexplode(F.array(*[part(F.col("h"), i) for i in range(n)])).alias("block", "value"))
    x, y = e.alias("x"), e.alias("y")
    differ = F.col("x.h").bitwiseXOR(F.col("y.h"))
    first = F.lit(n)
    for i in range(n - 1, -1, -1):
        first = F.when(part(differ, i) == 0, F.lit(i)).otherwise(first)
    both = x.join(y, (F.col("x.block") == F.col("y.block")) & (F.col("x.value") == F.col("y.value")) & (F.col("x.k") < F.col("y.k")) & (F.bit_count(differ) <= limit))
    return both.filter(first == F.col("x.block")).select(F.col("x.k").alias("a"), F.col("y.k").alias("b"), F.bit_count(differ).alias("distance"))


def _leaders(pdf: pd.DataFrame, limit: int) -> pd.DataFrame:
    """Greedy: the first unused row leads and takes every unused one within limit of itself."""
    pdf = pdf.sort_values("k", kind="stable")
    h = pdf["h"].to_numpy(np.int64).view(np.uint64)
    lead = np.full(len(h), -1)
    for i in range(len(h)):
        if lead[i] < 0:
            near = np.bitwise_count(h[i:] ^ h[i]) <= limit
            own = np.flatnonzero(near & (lead[i:] < 0)) + i
            lead[own] = i
    k = pdf["k"].to_numpy()
    return pd.DataFrame({"k": k, "leader": k[lead]})


def greedy_groups(hashes: DataFrame, key: str, h: str, limit: int = 5, components=None, bits: int = 64) -> DataFrame:
    """(key, leader) of groups of two or more.

    A leader takes only rows within limit of itself, so groups never leave a component of the pair graph: each component
    is folded on its own, in order of key. components: a function of pairs(a, b) that gives (k, root); by default a
    minimum spreads along the pairs.
    """
    rows = hashes.select(F.col(key).alias("k"), F.col(h).cast("long").alias("h")).filter("h is not null")
    pairs = hamming_pairs(rows, "k", "h", limit, bits)
    roots = (components or smallest_reachable)(pairs.select("a", "b"))
    some = rows.join(roots, "k")
    kind = rows.schema["k"].dataType.simpleString()
    got = some.groupBy("root").applyInPandas(lambda pdf: _leaders(pdf[["k", "h"]], limit), f"k {kind}, leader {kind}")
    size = got.groupBy("leader").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    return got.join(size, "leader", "left_semi").select(F.col("k").alias(key), "leader")


def smallest_reachable(pairs: DataFrame) -> DataFrame:
    """(k, root): the smallest key that each key of pairs(a, b) reaches. Rounds of a minimum over neighbours and of the
    root's own root, each written to the shared scratch folder."""
    both = settle(pairs.select("a", "b").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    now = settle(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("root")).select(F.col("a").alias("k"), "root"))
    while True:
        seen = both.join(now, both["b"] == now["k"]).groupBy("a").agg(F.min("root").alias("m"))
        step = now.join(seen, now["k"] == seen["a"]).select("k", F.least("root", "m").alias("root"))
        up = step.select(F.col("k").alias("_k"), F.col("root").alias("_r"))
        after = settle(step.join(up, step["root"] == up["_k"]).select("k", F.col("_r").alias("root")))
        changed = after.join(now.select(F.col("k").alias("_k"), F.col("root").alias("_r")), F.col("k") == F.col("_k")).filter("root <> _r")
        if changed.isEmpty():
            return after
        now = after


def sign_hash(vector: Column, bits: int) -> Column:
    """A hash with bit i set where component i (from 0) is positive."""
    return F.aggregate(
        F.transform(F.slice(vector, 1, bits), lambda x, i: F.when(x > 0, F.expr("1L")).otherwise(F.expr("0L"))),
        F.expr("0L"), lambda a, b: F.shiftleft(a, 1).bitwiseOR(b),
    )


def average_hash(images: DataFrame, key: str) -> DataFrame:
    """key and hash of images(key, width, height, rgb: bytes of red, green, blue): 8 x 8 nearest samples, bit where the grey is
    above the mean. Null for an image without pixels."""
    kind = images.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for w, h, data in zip(pdf["width"], pdf["height"], pdf["rgb"]):
                if not data or w <= 0 or h <= 0 or len(data) < w * h * 3:
                    out.append(None)
                    continue
                x = np.frombuffer(data, np.uint8)[: w * h * 3].reshape(h, w, 3)[np.arange(8) * h // 8][:, np.arange(8) * w // 8].astype(np.int64)
                grey = (x @ np.array([299, 587, 114]) // 1000).ravel()
                above = grey > grey.mean()
                out.append(int(np.packbits(above, bitorder="little").view(np.uint64)[0].astype(np.int64)))
            yield pd.DataFrame({key: pdf[key], "hash": pd.array(out, "Int64")})

    return images.select(key, "width", "height", "rgb").mapInPandas(run, f"{key} {kind}, hash long")

"""Striped arrays: where a stripe lies, parity, and what is missing."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The field's polynomial x^8 + x^4 + x^3 + x^2 + 1.
POLYNOMIAL = 0x11D


def _tables() -> tuple[np.ndarray, np.ndarray]:
    power, log = np.zeros(512, np.uint8), np.zeros(256, np.int64)
    x = 1
    for i in range(255):
        power[i] = power[i + 255] = x
        log[x] = i
        x <<= 1
        if x & 0x100:
            x ^= POLYNOMIAL
    return power, log


POWER, LOG = _tables()


def multiply(a: np.ndarray, k: int) -> np.ndarray:
    """Each byte times k in GF(256)."""
    if k == 0:
        return np.zeros_like(a)
    return np.where(a == 0, 0, POWER[LOG[a] + LOG[k]]).astype(np.uint8)


def inverse(k: int) -> int:
    return int(POWER[255 - LOG[k]])


def parity(columns: list[np.ndarray], order: int) -> np.ndarray:
    """The sum of column i times 2^(order * i): order 0, 1, 2 are P, Q, R."""
    out = np.zeros_like(columns[0])
    for i, c in enumerate(columns):
        out ^= multiply(c, int(POWER[order * i % 255]))
    return out


def invert(m: list[list[int]]) -> list[list[int]]:
    """Inverse of a small matrix over GF(256); ValueError if it has none."""
    n = len(m)
    one = lambda v: np.array([v], np.uint8)
    times = lambda a, b: int(multiply(one(a), b)[0])
    rows = [[*r, *(int(i == j) for j in range(n))] for i, r in enumerate(m)]
    for c in range(n):
        p = next((r for r in range(c, n) if rows[r][c]), None)
        if p is None:
            raise ValueError("the matrix is singular")
        rows[c], rows[p] = rows[p], rows[c]
        k = inverse(rows[c][c])
        rows[c] = [times(v, k) for v in rows[c]]
        for r in range(n):
            if r != c and rows[r][c]:
                k = rows[r][c]
                rows[r] = [a ^ times(b, k) for a, b in zip(rows[r], rows[c])]
    return [r[n:] for r in rows]


def rebuild(data: list[np.ndarray | None], parities: list[np.ndarray | None]) -> list[np.ndarray]:
    """Data columns of a stripe with up to as many missing (None) as there are parities left; ValueError beyond."""
    missing = [i for i, c in enumerate(data) if c is None]
    if not missing:
        return list(data)
    have = [k for k, p in enumerate(parities) if p is not None][: len(missing)]
    if len(have) < len(missing):
        raise ValueError("too many columns are missing")
    size = len(parities[have[0]])
    known = [c if c is not None else np.zeros(size, np.uint8) for c in data]
    sums = [parity(known, k) ^ parities[k] for k in have]
    m = invert([[int(POWER[k * i % 255]) for i in missing] for k in have])
    out = list(known)
    for r, i in enumerate(missing):
        total = np.zeros(size, np.uint8)
        for s, k in zip(sums, m[r]):
            total ^= multiply(s, k)
        out[i] = total
    return out


def locate(level: int, stripe, members: int):
    """(disk, row, parity disks) of a logical stripe, as Columns: left-asymmetric for level 5, rotating P and Q for level 6."""
    s = stripe
    if level == 0:
        return s % members, F.floor(s / members).cast("long"), F.array().cast("array<long>")
    if level == 1:
        return F.lit(0), s, F.array().cast("array<long>")
    if level == 10:
        half = members // 2
        return (s % half) * 2, F.floor(s / half).cast("long"), F.array().cast("array<long>")
    n = members - (1 if level == 5 else 2)
    row, place = F.floor(s / n).cast("long"), s % n
    p = (members - 1) - row % members
    if level == 5:
        return F.when(place >= p, place + 1).otherwise(place), row, F.array(p)
    q = (p + 1) % members
    # the n data disks follow q, wrapping around
    return (q + 1 + place) % members, row, F.array(p, q)


def read_striped(blocks: DataFrame, level: int, members: int, stripes: int) -> DataFrame:
    """(stripe, payload) of an array from blocks(disk, row, payload); a stripe whose block is missing has null.

    An equi-join on (disk, row). Level 1 and 10 take the first mirror that has the block."""
    spark = blocks.sparkSession
    s = spark.range(stripes).withColumnRenamed("id", "stripe")
    disk, row, _ = locate(level, F.col("stripe"), members)
    at = s.select("stripe", disk.cast("long").alias("disk"), row.cast("long").alias("row"))
    if level in (1, 10):
        width = members if level == 1 else 2
        at = at.select("stripe", "row", F.explode(F.sequence(F.col("disk"), F.col("disk") + width - 1)).alias("disk"))
    got = at.join(blocks.select(F.col("disk").cast("long").alias("disk"), F.col("row").cast("long").alias("row"), "payload"), ["disk", "row"], "left")
    return got.groupBy("stripe").agg(F.min_by("payload", F.when(F.col("payload").isNotNull(), F.col("disk"))).alias("payload"))


def rebuild_rows(blocks: DataFrame, level: int, members: int, size: int) -> DataFrame:
    """(row, disk, payload) of the data disks of level 5 or 6, with missing blocks rebuilt from parity: one group per row."""

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        row = int(pdf["row"].iloc[0])
        have = {int(d): np.frombuffer(b, np.uint8) for d, b in zip(pdf["disk"], pdf["payload"]) if b is not None}
        p = (members - 1) - row % members
        held = [p] if level == 5 else [p, (p + 1) % members]
        order = [d for d in range(members) if d != p] if level == 5 else [(held[1] + 1 + i) % members for i in range(members - 2)]
        got = rebuild([have.get(d) for d in order], [have.get(d) for d in held])
        return pd.DataFrame({"row": row, "disk": order, "payload": [c.tobytes() for c in got]})

    return blocks.groupBy("row").applyInPandas(solve, "row long, disk long, payload binary")


def parities(blocks: DataFrame, key: str, role: str, count: int = 2) -> DataFrame:
    """key, p0 .. of each group of blocks(key, role, payload), in order of role."""
    kind = blocks.schema[key].dataType.simpleString()

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        cols = [np.frombuffer(b, np.uint8) for b in pdf.sort_values(role)["payload"]]
        size = max(map(len, cols))
        cols = [np.pad(c, (0, size - len(c))) for c in cols]
        return pd.DataFrame({key: [pdf[key].iloc[0]], **{f"p{k}": [parity(cols, k).tobytes()] for k in range(count)}})

    return blocks.groupBy(key).applyInPandas(run, f"`{key}` {kind}, " + ", ".join(f"p{k} binary" for k in range(count)))


def xor_parity(df: DataFrame, key: str, word: str) -> DataFrame:
    """P of integer words: built in, partial before the shuffle."""
    return df.groupBy(key).agg(F.bit_xor(word).alias("parity"))



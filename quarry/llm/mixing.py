"""Mixing sources to target weights.

Each source is one long stream of words: its documents in the order of a hash bucket, then id. The stream is packed into
blocks of a fixed number of words. Output shards draw how many slots each source gets from a multinomial; the slots of a
source are numbered over the shards, and slot i takes the block that a pseudorandom permutation of the source's block
indices (a new one for each pass over the source) gives for i. Blocks and slots meet in a join on (source, block).

The independent draws of the shards would miss a source's target by the multinomial's noise. So the surplus slots of
sources that drew too many, numbered from the end, go to the sources that drew too few, and the last slot of a source is
cut: the words taken of a source equal its target, rounded down.

Nothing larger than one row per source comes to the driver. A source may hold any share of the rows: positions are
prefix sums in two levels, (source, bucket) and bucket totals, and the join keys (source, block) are all but unique.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

#: A word: a run without ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (3.0, 1.0, 2.0)
ROUNDS = 6


@dataclass(frozen=True)
class Settings:
    """share: words of the mix by words of the input. most: passes over a source at most. block: words in a block.
    shard: slots in a shard. bucket_rows: rows of a source's hash bucket, about."""

    share: float = 1.5
    most: float = 2.0
    weights: tuple[float, ...] = WEIGHTS
    block: int = 256
    shard: int = 4096
    bucket_rows: int = 2000
    seed: int = 17


def word_count(text: str) -> Column:
    """Number of words of the column; 0 for null."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: list[int], weights: list[float], total: float, most: float) -> list[float]:
    """Shares of total by weight, none above most times its size; what is cut goes to the others by weight."""
    out, open_ = [0.0] * len(sizes), set(range(len(sizes)))
    left = total
    while open_:
        weight = math.fsum(weights[i] for i in open_)
        over = [i for i in sorted(open_) if left * weights[i] / weight > most * sizes[i]]
        if not over:
            for i in open_:
                out[i] = left * weights[i] / weight
            break
        for i in over:
            out[i] = most * sizes[i]
            open_.remove(i)
        left = total - math.fsum(out)
    return out


def _rounds(half: np.ndarray, key: np.ndarray, k: int, mask: np.ndarray) -> np.ndarray:
    return common.mix64((half + np.uint64((k + 1) * common.BASE % (1 << 64))) ^ key) & mask


def permute(index: np.ndarray, n: np.ndarray, key: np.ndarray, inverse: bool = False) -> np.ndarray:
    """The place of each index (0 <= index < n) in the permutation of range(n) that its key selects.

    A Feistel network on the smallest even number of bits that holds n; results of n or more walk on until they fall
    below n, so that the map is one to one on range(n). On average under four steps.
    """
    index, n, key = (np.asarray(x).astype(np.uint64) for x in (index, n, key))
    bits = np.frexp(np.maximum(n, 2).astype(np.float64) - 0.5)[1]
    half = ((bits + 1) // 2).astype(np.uint64)
    mask = (np.uint64(1) << half) - np.uint64(1)
    out, todo = index.copy(), np.arange(len(index))
    while len(todo):
        h, m, c = half[todo], mask[todo], key[todo]
        left, right = out[todo] >> h, out[todo] & m
        for k in range(ROUNDS):
            if inverse:
                left, right = right ^ _rounds(left, c, ROUNDS - 1 - k, m), left
            else:
                left, right = right, left ^ _rounds(right, c, k, m)
        out[todo] = left << h | right
        todo = todo[out[todo] >= n[todo]]
    return out.astype(np.int64)


def _key(seed: int, source: np.ndarray, epoch: np.ndarray) -> np.ndarray:
    x = common.mix64(np.asarray(source).astype(np.uint64) + np.uint64(seed * common.BASE % (1 << 64)))
    return common.mix64(x + np.asarray(epoch).astype(np.uint64))


def slot_count(size: int, quota: int, block: int, seed: int, source: int) -> tuple[int, int]:
    """How many slots a source needs for quota words, and the words that the last of them gives."""
    if not size or not quota:
        return 0, 0
    blocks = -(-size // block)
    last = size - (blocks - 1) * block
    epoch, rest = divmod(quota, size)
    if not rest:
        epoch, rest = epoch - 1, size
    key = _key(seed, np.array([source]), np.array([epoch]))
    short = int(permute(np.array([blocks - 1]), np.array([blocks]), key, inverse=True)[0])
    given = lambda n: n * block - (block - last) * (short < n)  # noqa: E731  words of the first n slots of the pass
    n = -(-rest // block)
    n += given(n) < rest
    return epoch * blocks + n, rest - given(n - 1)


@dataclass(frozen=True)
class Plan:
    """One entry per source, by code point, null last."""

    names: tuple[str | None, ...]
    sizes: tuple[int, ...]
    targets: tuple[float, ...]
    slots: tuple[int, ...]
    last: tuple[int, ...]
    rows: int


def plan(sized: DataFrame, s: Settings) -> Plan:
    """Targets and slot counts from one row per source."""
    found = sized.groupBy("source").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("n")).collect()
    found.sort(key=lambda r: (r.source is None, r.source or ""))
    sizes = [int(r["size"]) for r in found]
    weights = [s.weights[i % len(s.weights)] for i in range(len(sizes))]
    goal = targets(sizes, weights, s.share * sum(sizes), s.most)
    slots = [slot_count(n, min(int(t), int(s.most * n)), s.block, s.seed, i) for i, (n, t) in enumerate(zip(sizes, goal))]
    return Plan(tuple(r.source for r in found), tuple(sizes), tuple(goal), tuple(a for a, _ in slots), tuple(b for _, b in slots), sum(r.n for r in found))


def _sources(sized: DataFrame, p: Plan) -> DataFrame:
    rows = [(i, name, n, float(t)) for i, (name, n, t) in enumerate(zip(p.names, p.sizes, p.targets))]
    return sized.sparkSession.createDataFrame(rows, "source_index int, name string, source_size long, target double")


def placed(sized: DataFrame, p: Plan, s: Settings) -> DataFrame:
    """sized with source_index, source_size, target and first, the place of a document's first word in its source.

    Rows that agree in all their columns share the places among them in any order.
    """
    buckets = 1 << max(0, math.ceil(math.log2(max(1, p.rows / s.bucket_rows))))
    others = [c for c in sized.columns if c not in ("source", "size")]
    own = _sources(sized, p)
    d = sized.join(own, sized["source"].eqNullSafe(own["name"])).drop("name")
    d = d.withColumn("bucket", F.pmod(F.xxhash64(*others), F.lit(buckets)).cast("int"))
    # whole buckets after one another: totals of the buckets first, then places within a bucket
    inner = Window.partitionBy("source_index", "bucket")
    d = d.withColumn("within", F.sum("size").over(inner.orderBy(*others, "size").rowsBetween(Window.unboundedPreceding, -1)))
    totals = d.groupBy("source_index", "bucket").agg(F.sum("size").alias("words"))
    before = Window.partitionBy("source_index").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("source_index", "bucket", F.coalesce(F.sum("words").over(before), F.lit(0)).alias("before"))
    return (
        d.join(totals.hint("merge"), ["source_index", "bucket"])
        .withColumn("first", F.col("before") + F.coalesce("within", F.lit(0)))
        .drop("bucket", "within", "before")
    )


def slots(spark, p: Plan, s: Settings) -> DataFrame:
    """One row per slot of the mix: shard, source_index, slot (its number in the source), block, words, epoch."""
    total = sum(p.slots)
    shards = -(-total // s.shard)
    share = np.array(p.slots, float) / max(1, total)
    drawn_schema = "shard long, source_index int, n long"

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for shard in pdf["id"]:
                size = min(s.shard, total - shard * s.shard)
                got = np.random.Generator(np.random.PCG64([s.seed, int(shard)])).multinomial(size, share)
                has = np.flatnonzero(got)
                yield pd.DataFrame({"shard": shard, "source_index": has.astype("int32"), "n": got[has]})

    parts = max(1, min(shards, spark.sparkContext.defaultParallelism))
    drawn = common.settle(spark.range(0, shards, 1, parts).mapInPandas(draw, drawn_schema))
    sums = {r.source_index: int(r.n) for r in drawn.groupBy("source_index").agg(F.sum("n").alias("n")).collect()}
    got = np.array([sums.get(i, 0) for i in range(len(p.slots))], np.int64)
    want = np.array(p.slots, np.int64)
    # the surplus slots of all sources in a row, and the sources that they go to
    surplus_from = np.concatenate([[0], np.cumsum(np.maximum(got - want, 0))])
    short = np.maximum(want - got, 0)
    short_from = np.concatenate([[0], np.cumsum(short)])

    def settled(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for shard, i, n, start in zip(pdf["shard"], pdf["source_index"], pdf["n"], pdf["start"]):
                own = min(start + n, want[i]) - start
                if own > 0:
                    out.append((shard, i, start, start + own))
                if own < n:  # the rest goes to others
                    a = surplus_from[i] + max(start, want[i]) - want[i]
                    b = surplus_from[i] + start + n - want[i]
                    j = int(np.searchsorted(short_from, a, "right")) - 1
                    while a < b:
                        to = min(b, short_from[j + 1])
                        if to > a:
                            out.append((shard, j, got[j] + a - short_from[j], got[j] + to - short_from[j]))
                        a, j = max(a, to), j + 1
            yield pd.DataFrame(out, columns=["shard", "source_index", "a", "b"])

    before = Window.partitionBy("source_index").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    runs = drawn.withColumn("start", F.coalesce(F.sum("n").over(before), F.lit(0))).mapInPandas(settled, "shard long, source_index int, a long, b long")
    blocks = np.maximum(1, -(-np.array(p.sizes, np.int64) // s.block))
    last = np.array(p.last, np.int64)

    @F.pandas_udf("block long, words long, epoch int")
    def taken(source: pd.Series, slot: pd.Series) -> pd.DataFrame:
        i, k = source.to_numpy(), slot.to_numpy()
        n = blocks[i]
        at = permute(k % n, n, _key(s.seed, i, k // n)) if len(i) else k
        return pd.DataFrame({"block": at, "words": np.where(k == want[i] - 1, last[i], s.block), "epoch": (k // n).astype("int32")})

    taken = taken.asNondeterministic()  # else it runs twice, once for a filter of keys that aren't null
    one = runs.select("shard", "source_index", F.explode(F.sequence("a", F.col("b") - 1)).alias("slot"))
    return one.select("*", taken("source_index", "slot").alias("t")).select("shard", "source_index", "slot", "t.block", "t.words", "t.epoch")


def spans(at: DataFrame, p: Plan, s: Settings) -> DataFrame:
    """The mix: one row per slot and document in its block: shard, slot, source_index, first (of the document in its
    source, which names it), from_word and to_word (in the document), epoch (of the source)."""
    size = F.lit(s.block)
    pieces = at.filter("size > 0").select(
        "source_index", "first", "size",
        F.explode(F.sequence(F.expr(f"first div {s.block}"), F.expr(f"(first + size - 1) div {s.block}"))).alias("block"),
    )
    given = slots(at.sparkSession, p, s)
    # the planner sees the size of the slots' runs, not of the slots: it would broadcast them
    both = pieces.join(given.hint("merge"), ["source_index", "block"])
    begin = F.greatest(F.col("first"), F.col("block") * size)
    end = F.least(F.col("first") + F.col("size"), F.col("block") * size + F.col("words"))
    return (
        both.withColumn("from_word", begin - F.col("first"))
        .withColumn("to_word", end - F.col("first"))
        .filter("to_word > from_word")
        .select("shard", "slot", "source_index", "epoch", "first", "from_word", "to_word")
    )


def mix(docs: DataFrame, s: Settings = Settings()) -> tuple[DataFrame, DataFrame]:
    """(documents, spans) of a mix of docs(doc_id, text, source); other columns are left out.

    documents: doc_id, source, digest (of the text), size, source_index, source_size, target, first; one row per row of
    docs, repeated rows too. spans: see spans(). A null text has no words; a null source is a source. Empty input gives
    two empty frames.
    """
    sized = docs.select(
        F.col("doc_id"), F.col("source").cast("string").alias("source"), F.xxhash64("text").alias("digest"), word_count("text").alias("size")
    )
    sized = common.settle(sized)
    p = plan(sized, s)
    at = common.settle(placed(sized, p, s))
    return at, spans(at, p, s)


def taken(docs: DataFrame, s: Settings = Settings()) -> DataFrame:
    """Per document: doc_id, size, source_size, target (its source's), taken (words of it in the mix, repeats counted)."""
    at, got = mix(docs, s)
    sums = got.groupBy("source_index", "first").agg(F.sum(F.col("to_word") - F.col("from_word")).alias("taken"))
    key = F.when(F.col("size") > 0, F.col("source_index"))  # documents without words stand at the same place as the next
    out = at.withColumn("k", key).join(sums.withColumnRenamed("source_index", "k"), ["k", "first"], "left")
    return out.select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


def mixed_documents(docs: DataFrame, s: Settings = Settings()) -> DataFrame:
    """The mix as rows of docs (the columns of docs, n_chars anew if there): one for each document and pass over its
    source from which the mix takes words, with the parts taken as text, in document order, joined by one space
    where they don't touch. A document that a pass takes whole keeps its text as it is."""
    at, got = mix(docs, s)
    runs = got.groupBy("source_index", "first", "epoch").agg(F.sort_array(F.collect_list(F.struct("from_word", "to_word"))).alias("runs"))
    key = ["doc_id", "source", "digest"]
    chosen = (
        at.filter("size > 0").select(*key, "size", "source_index", "first")
        .withColumn("copy", F.row_number().over(Window.partitionBy(*key).orderBy("first")))
        .join(runs, ["source_index", "first"])
        .select(*key, "copy", "size", "epoch", "runs")
    )
    names = {c: common.unused(c, docs.columns) for c in ("digest", "copy", "size", "epoch", "runs", "key_id", "key_source", "key_digest", "key_copy", "cut")}
    t = docs.withColumn(names["digest"], F.xxhash64("text"))
    # repeated rows: the first of them is the first copy, and so on
    if at.groupBy(*key).count().filter("count > 1").isEmpty():
        t = t.withColumn(names["copy"], F.lit(1))
    else:
        t = t.withColumn(names["copy"], F.row_number().over(Window.partitionBy("doc_id", F.col("source").cast("string"), names["digest"]).orderBy(F.lit(0))))
    chosen = chosen.select(
        F.col("doc_id").alias(names["key_id"]), F.col("source").alias(names["key_source"]), F.col("digest").alias(names["key_digest"]), F.col("copy").alias(names["key_copy"]),
        F.col("size").alias(names["size"]), F.col("epoch").alias(names["epoch"]), F.col("runs").alias(names["runs"]),
    )
    both = t.join(
        chosen,
        t["doc_id"].eqNullSafe(chosen[names["key_id"]]) & t["source"].cast("string").eqNullSafe(chosen[names["key_source"]])
        & (t[names["digest"]] == chosen[names["key_digest"]]) & (t[names["copy"]] == chosen[names["key_copy"]]),
    )

    word = re.compile(WORD)

    @F.pandas_udf("string")
    def cut(text: pd.Series, size: pd.Series, runs: pd.Series) -> pd.Series:
        out = []
        for t, n, rs in zip(text, size, runs):
            if sum(r["to_word"] - r["from_word"] for r in rs) == n:
                out.append(t)
                continue
            at = [m.span() for m in word.finditer(t)]
            joined: list[list[int]] = []
            for r in rs:
                if joined and joined[-1][1] == r["from_word"]:
                    joined[-1][1] = r["to_word"]
                else:
                    joined.append([r["from_word"], r["to_word"]])
            out.append(" ".join(t[at[a][0] : at[b - 1][1]] for a, b in joined))
        return pd.Series(out, dtype=object)

    both = both.withColumn(names["cut"], cut("text", names["size"], names["runs"]))
    out = both.withColumn("text", F.col(names["cut"]))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)

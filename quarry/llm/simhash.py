"""SimHash near-duplicates through a Gray-order hierarchical index.

A document's fingerprint has bit b if over half of its shingles' hashes have it. Distinct fingerprints are dealt out by
16-bit blocks: a group (block, pattern) is an upper node of the index, whose members share these masked bits. Within a
group, fingerprints are sorted by Gray rank; runs that share their first 8, 16, ... bits are the nodes below. A pair of
nodes whose shared patterns already differ in more than `radius` bits is pruned with all that is below it; what reaches
the bottom is a link. Two fingerprints within 3 bits agree in at least one of the 4 blocks of a word, so with one word
the search is exact. A group of more than Settings.hot members is dealt out anew by sub-blocks of its other bits, of
which again at least one must agree.

A task emits a spanning forest of its links, not the pairs, and the forests meet in an alternating large-star and
small-star iteration whose rounds are written to the shared scratch folder. Copies are one node: they share a fingerprint.

Near copies by similarity (Settings.similar, used by the pipeline) are documents whose sets of five-word shingles have a Jaccard
similarity of 0.8 or more. At 0.8 about one bit in seven of a fingerprint differs, so that the index alone finds only the closest
copies. Its links come first; further candidates share one of BANDS keys of four least hashes each (at 0.8 two sets miss each other
in all of them with a chance of 3 in 100,000). Each link is decided on the whole sets. Members of a key's group are first compared
with one of them; what is not connected by then meets in cells of bounded size, where all pairs of different components are
compared and only links leave the task.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

BLOCK_BITS = 16
BLOCKS = 4
SUB_BITS = 12
SEED = 42
#: Pairs of nodes held at once.
PAIRS = 1 << 18


@dataclass(frozen=True)
class Settings:
    """shingle: words of a shingle. words: 64-bit words of a fingerprint. radius: differing bits in the word through
    which two fingerprints meet, at most. radius_all: in all words, at most. hot: members of a group from which it is split.
    similar: if not 0, documents are linked by the Jaccard similarity of their sets of shingles, in per cent, not by fingerprints.
    tile, tile_shingles: rows, and shingles, of one side of a cell, about."""

    shingle: int = 3
    words: int = 1
    radius: int = 3
    radius_all: int = 3
    hot: int = 20_000
    similar: int = 0
    tile: int = 1024
    tile_shingles: int = 1 << 20


#: Near copies of the pipeline: five-word shingles that agree to 0.8.
WIDE = Settings(shingle=5, similar=80)
#: Keys of a set of shingles, and least hashes in each.
BANDS, BAND = 20, 4
#: Of the BANDS * BAND least hashes, two sets of similarity 0.8 have 64 in common on average; fewer than these with a chance below 1 in 10 million.
AGREE = 44
_FACTORS = common.mix64(np.arange(1, BANDS * BAND + 1, dtype=np.uint64) * np.uint64(common.BASE)) | np.uint64(1)

_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.float64)


def shingle_hashes(text: bytes, k: int) -> list[int]:
    """XXH64 of each run of k words joined by spaces, A-Z lower-cased; of all words, if fewer; none without words."""
    words = text.lower().split()
    if not words:
        return []
    h, line = xxhash.xxh64_intdigest, b" ".join(words)
    if len(words) <= k:
        return [h(line, SEED)]
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    return [h(line[a:b], SEED) for a, b in zip(starts[: len(words) - k + 1].tolist(), ends[k - 1 :].tolist())]


def fingerprint(hashes: np.ndarray, words: int) -> np.ndarray:
    """words uint64 values; the first takes the hashes as they are, the others mix them anew."""
    if not len(hashes):
        return np.zeros(words, np.uint64)
    if words > 1:
        salts = np.arange(words, dtype=np.uint64) * np.uint64(common.BASE)
        hashes = np.where(salts == 0, hashes[:, None], common.mix64(hashes[:, None] + salts))
    seen = np.ascontiguousarray(hashes).view(np.uint8).reshape(len(hashes), -1)
    width = seen.shape[1]
    # how often each byte value stands at each place, and from that how often each bit is set
    places = np.bincount((seen + np.arange(width, dtype=np.int32) * 256).ravel(), minlength=256 * width).reshape(width, 256)
    return np.packbits((2 * (places @ _BITS) > len(hashes)).astype(np.uint8), axis=1, bitorder="little").ravel().view(np.uint64)


def fingerprints(docs: DataFrame, s: Settings = Settings()) -> DataFrame:
    """doc_id and fp (array of s.words longs) of each row of docs(doc_id, text). Without words (or null): zeros."""
    schema = T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("fp", T.ArrayType(T.LongType()))])
    k, words = s.shingle, s.words

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [fingerprint(np.array(shingle_hashes(common.text_bytes(t), k), np.uint64), words) for t in batch.column("text").to_pylist()]
            flat = np.concatenate(out).view(np.int64) if out else np.zeros(0, np.int64)
            offsets = pa.array(np.arange(len(out) + 1, dtype=np.int32) * words)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.ListArray.from_arrays(offsets, pa.array(flat))], ["doc_id", "fp"])

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def gray_rank(x: np.ndarray) -> np.ndarray:
    """The place of x in Gray order: the number whose Gray code is x."""
    for k in (1, 2, 4, 8, 16, 32):
        x = x ^ (x >> np.uint64(k))
    return x


def _expand(ca: np.ndarray, cb: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each pair of counts all pairs of places: (which, place in a, place in b)."""
    n = ca * cb
    which = np.repeat(np.arange(len(n)), n)
    place = np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)
    return which, place // cb[which], place % cb[which]


class _Forest:
    """Smallest linked place of each place."""

    def __init__(self, n: int) -> None:
        self.up = np.arange(n)

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        up = self.up
        while True:
            ra, rb = up[a], up[b]
            apart = ra != rb
            if not apart.any():
                return
            a, b, ra, rb = a[apart], b[apart], ra[apart], rb[apart]
            np.minimum.at(up, np.maximum(ra, rb), np.minimum(ra, rb))
            while True:
                next_ = up[up]
                if np.array_equal(next_, up):
                    break
                up = next_
            self.up = up


def forest(group: np.ndarray, own: np.ndarray, fp: np.ndarray, radius: int, radius_all: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order, a, b): links a spanning forest of all links within groups, as places in order.

    own: the word through which the members of a group meet; fp: (n, words), all words.
    """
    rank = gray_rank(own)
    order = np.lexsort((rank, group))
    group, rank, own, fp = group[order], rank[order], own[order], fp[order]
    n = len(own)
    trees = _Forest(n)
    # nodes by depth: runs that agree in the group and in the first bits
    starts = []
    for bits in range(0, 65, 8):
        new = np.ones(n, bool)
        same = group[1:] == group[:-1]
        if bits:
            same &= (rank[1:] >> np.uint64(64 - bits)) == (rank[:-1] >> np.uint64(64 - bits))
        new[1:] = ~same
        starts.append(np.flatnonzero(new))
    starts.append(np.arange(n))  # equal words, too, stand alone at the bottom
    first = [np.searchsorted(lower, upper) for upper, lower in zip(starts, starts[1:])]
    count = [np.diff(np.append(f, len(lower))) for f, lower in zip(first, starts[1:])]
    size = [np.diff(np.append(x, n)) for x in starts]
    masks = [np.uint64((0xFFFFFFFFFFFFFFFF << (64 - min(64, 8 * k))) & 0xFFFFFFFFFFFFFFFF) for k in range(len(starts))]
    alone = np.flatnonzero(size[0] > 1)
    work = [(0, alone, alone)]
    while work:
        depth, a, b = work.pop()
        if depth == len(starts) - 1:
            keep = a != b
            a, b = a[keep], b[keep]
            near = np.bitwise_count(fp[a] ^ fp[b]).sum(1, dtype=np.int64) <= radius_all
            trees.join(a[near], b[near])
            continue
        ca, cb = count[depth][a], count[depth][b]
        cuts = np.searchsorted(np.cumsum(ca * cb), np.arange(PAIRS, int((ca * cb).sum()) + PAIRS, PAIRS))
        begin = 0
        for cut in np.unique(np.minimum(cuts + 1, len(a))):
            x, y = slice(begin, cut), slice(begin, cut)
            begin = cut
            which, i, j = _expand(ca[x], cb[y])
            if not len(which):
                continue
            na, nb = first[depth][a[x]][which] + i, first[depth][b[y]][which] + j
            same = a[x][which] == b[y][which]
            keep = ~same | (na < nb) | ((na == nb) & (size[depth + 1][na] > 1))
            na, nb = na[keep], nb[keep]
            pa_, pb = own[starts[depth + 1][na]], own[starts[depth + 1][nb]]
            keep = np.bitwise_count((pa_ ^ pb) & masks[depth + 1]) <= radius
            if keep.any():
                work.append((depth + 1, na[keep], nb[keep]))
    linked = np.flatnonzero(trees.up != np.arange(n))
    return order, linked, trees.up[linked]


def _entries(nodes: DataFrame, s: Settings) -> DataFrame:
    """A row for each node and group it is in: group columns t, key, sub, and own (the word), node, fp."""
    blocks = F.expr(
        f"explode(flatten(transform(sequence(0, {s.words - 1}), w -> transform(sequence(0, {BLOCKS - 1}), "
        f"b -> named_struct('t', w * {BLOCKS} + b, 'key', cast(shiftrightunsigned(fp[w], b * {BLOCK_BITS}) & {(1 << BLOCK_BITS) - 1} as int), 'own', fp[w])))))"
    )
    e = nodes.select("node", "fp", blocks.alias("e")).select("e.t", "e.key", "e.own", "node", "fp")
    hot = e.groupBy("t", "key").count().filter(F.col("count") > s.hot).select("t", "key", F.lit(True).alias("split"))
    # at most (blocks * nodes / hot) rows: small, but left to the planner
    e = e.join(hot, ["t", "key"], "left")
    # the 48 other bits, in 4 parts of 12
    rest = f"(case t when 0 then shiftrightunsigned(own, 16) when 3 then own & {(1 << 48) - 1} when 1 then shiftleft(shiftrightunsigned(own, 32), 16) | (own & 65535) else shiftleft(shiftrightunsigned(own, 48), 32) | (own & {(1 << 32) - 1}) end)"
    parts = F.expr(f"transform(sequence(0, 3), b -> named_struct('sub', 1 + b, 'value', cast(shiftrightunsigned({rest}, b * {SUB_BITS}) & {(1 << SUB_BITS) - 1} as int)))")
    one = F.expr("array(named_struct('sub', 0, 'value', 0))")
    return e.select("t", "key", "own", "node", "fp", F.explode(F.when(F.col("split"), parts).otherwise(one)).alias("p")).select("t", "key", "p.sub", "p.value", "own", "node", "fp")


def edges(nodes: DataFrame, s: Settings) -> DataFrame:
    """(u, v), u > v: spanning forests of the links between nodes(node, fp), one for each task."""
    words, radius, radius_all = s.words, s.radius, s.radius_all
    limit = 50_000

    def solve(table: pa.Table) -> pa.RecordBatch:
        cols = [table.column(c).to_numpy() for c in ("t", "key", "sub", "value")]
        new = np.ones(table.num_rows, bool)
        new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in cols])
        fp = table.column("fp").combine_chunks().flatten().to_numpy(zero_copy_only=False).view(np.uint64).reshape(-1, words)
        own = table.column("own").to_numpy().view(np.uint64)
        node = table.column("node").to_numpy()
        order, a, b = forest(np.cumsum(new), own, fp, radius, radius_all)
        x, y = node[order[a]], node[order[b]]
        return pa.RecordBatch.from_pydict({"u": pa.array(np.maximum(x, y)), "v": pa.array(np.minimum(x, y))})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        rows = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            rows += batch.num_rows
            if rows < limit:
                continue
            table = pa.Table.from_batches(held)
            # the last group may go on in the next batch
            cols = [table.column(c).to_numpy() for c in ("t", "key", "sub", "value")]
            last = np.flatnonzero(np.logical_or.reduce([c != c[-1] for c in cols]))
            cut = int(last[-1]) + 1 if len(last) else 0
            if cut:
                yield solve(table.slice(0, cut))
            held = table.slice(cut).to_batches()
            rows = table.num_rows - cut
        if rows:
            yield solve(pa.Table.from_batches(held))

    e = _entries(nodes, s)
    keys = ["t", "key", "sub", "value"]
    n = int(e.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return e.repartition(n, *keys).sortWithinPartitions(*keys).mapInArrow(run, "u long, v long").filter("u <> v").distinct()


def components(links: DataFrame) -> DataFrame:
    """(u, v): v is the smallest node that u reaches over links(u, v); a smallest node itself has no row."""
    now = common.settle(links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v").distinct())
    before = None
    # a window instead of a join with the least: one exchange, and no table that is small enough today is gathered in the driver
    least = F.min("v").over(Window.partitionBy("u"))
    pair = lambda a, b: F.struct(F.col(a).alias("u"), F.col(b).alias("v"))
    while True:
        mark = tuple(now.agg(F.count(F.lit(1)), F.sum(F.col("v").cast("decimal(38,0)")), F.bit_xor(F.xxhash64("u", "v"))).first())
        if mark == before or not mark[0]:
            return now
        before = mark
        both = now.select(F.explode(F.array(pair("u", "v"), pair("v", "u"))).alias("e")).select("e.u", "e.v")
        large = both.withColumn("m", F.least("u", least)).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        linked = large.withColumn("m", least).select(F.explode(F.array(pair("u", "m"), pair("v", "m"))).alias("e")).select("e.u", "e.v")
        now = common.settle(linked.filter("u <> v").distinct())


def shingle_sets(texts: list[str | None], k: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, ends): the sorted distinct 64-bit hashes of each text's runs of k words (A-Z lower-cased; of all its words, if fewer),
    one text after another, and where each text's end."""
    b = common.Bytes([common.text_bytes(t).lower() for t in texts])
    b.words()
    word, doc = common.mix64(b.hashes(b.word_begin, b.word_end)), b.word_doc
    n = len(word)
    many = np.bincount(doc, minlength=b.n)
    hashes = common.mix64(word)
    for j in range(1, min(k, n)):
        near = np.flatnonzero(doc[j:] == doc[: n - j])
        hashes[near] = common.mix64(hashes[near] * np.uint64(common.BASE) + word[near + j])
    first = np.ones(n, bool)
    first[1:] = doc[1:] != doc[:-1]
    whole = np.zeros(n, bool)
    if n >= k:
        whole[: n - k + 1] = doc[k - 1 :] == doc[: n - k + 1]
    keep = whole | (first & (many[doc] < k))
    hashes, doc = hashes[keep], doc[keep]
    order = np.lexsort((hashes, doc))
    hashes, doc = hashes[order], doc[order]
    new = np.ones(len(doc), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (doc[1:] != doc[:-1])
    return hashes[new], np.cumsum(np.bincount(doc[new], minlength=b.n))


def least_hashes(hashes: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """(sets, BANDS * BAND) uint32: the least of each set's hashes under each factor; zeros for an empty set."""
    begins = np.concatenate([[0], ends[:-1]]).astype(np.int64)
    some = np.flatnonzero(ends > begins)
    out = np.zeros((len(ends), BANDS * BAND), np.uint32)
    if len(some):
        for i, factor in enumerate(_FACTORS):
            out[some, i] = np.minimum.reduceat(hashes * factor, begins[some]) >> np.uint64(32)
    return out


def sketches(docs: DataFrame, s: Settings) -> DataFrame:
    """doc_id, row, node (a hash of the set), n (its size), fp (SimHash of the set) and keys (one of each band) of docs(doc_id, row, text)."""
    kinds = {"doc_id": docs.schema["doc_id"].dataType, "row": T.LongType(), "node": T.LongType(), "n": T.LongType(), "fp": T.ArrayType(T.LongType()), "keys": T.ArrayType(T.LongType())}
    schema = T.StructType([T.StructField(c, t) for c, t in kinds.items()])
    k = s.shingle

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for a, b in common.slices(texts):
                hashes, ends = shingle_sets(texts[a:b], k)
                begins = np.concatenate([[0], ends[:-1]]).astype(np.int64)
                some = np.flatnonzero(ends > begins)
                n = ends - begins
                node, fp = np.zeros(b - a, np.uint64), np.zeros((b - a, 8), np.uint8)
                if len(some):
                    at = begins[some]
                    node[some] = np.add.reduceat(common.mix64(hashes ^ np.uint64(common.BASE)), at)
                    for i in range(8):
                        bits = np.unpackbits((hashes >> np.uint64(8 * i)).astype(np.uint8)[:, None], axis=1, bitorder="little")
                        over = 2 * np.add.reduceat(bits, at, axis=0, dtype=np.int32) > n[some][:, None]
                        fp[some, i] = np.packbits(over, axis=1, bitorder="little")[:, 0]
                least = least_hashes(hashes, ends).astype(np.uint64).reshape(b - a, BANDS, BAND)
                keys = np.broadcast_to(np.arange(BANDS, dtype=np.uint64), (b - a, BANDS))
                for i in range(BAND):
                    keys = common.mix64(keys * np.uint64(common.BASE) + least[:, :, i])
                node = common.mix64(node + n.astype(np.uint64)).view(np.int64)
                arrays = [batch.column("doc_id").slice(a, b - a), batch.column("row").slice(a, b - a), pa.array(node), pa.array(n.astype(np.int64))]
                arrays.append(pa.ListArray.from_arrays(pa.array(np.arange(b - a + 1, dtype=np.int32)), pa.array(fp.view(np.int64).ravel())))
                arrays.append(pa.ListArray.from_arrays(pa.array(np.arange(0, (b - a + 1) * BANDS, BANDS, dtype=np.int32)), pa.array(keys.ravel().view(np.int64))))
                yield pa.RecordBatch.from_arrays(arrays, schema.names)
        common.release()

    return docs.select("doc_id", "row", "text").mapInArrow(run, schema)


def _sets(docs: DataFrame, asked: DataFrame, s: Settings) -> DataFrame:
    """node and set (sorted hashes) of asked(node, row), read from the texts of docs(row, text) anew: most sets are never asked for."""
    k = s.shingle

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for a, b in common.slices(texts):
                hashes, ends = shingle_sets(texts[a:b], k)
                offsets = pa.array(np.concatenate([[0], ends]).astype(np.int32))
                yield pa.RecordBatch.from_arrays([batch.column("node").slice(a, b - a), pa.ListArray.from_arrays(offsets, pa.array(hashes.view(np.int64)))], ["node", "set"])
        common.release()

    texts = docs.select("row", "text").join(asked.select("row", "node").hint("merge"), "row").select("node", "text")
    return common.settle(texts.mapInArrow(run, "node long, set array<long>").dropDuplicates(["node"]))


def _verified(pairs: DataFrame, sets: DataFrame, similar: int) -> DataFrame:
    """(u, v): those of pairs(a, b) whose whole sets are similar enough."""
    one, other = (sets.select(F.col("node").alias(x), F.col("set").alias(f"set_{x}")) for x in "ab")
    both = pairs.join(one.hint("merge"), "a").join(other.hint("merge"), "b")
    shared = F.size(F.array_intersect("set_a", "set_b"))
    near = shared * (100 + similar) >= (F.size("set_a") + F.size("set_b")) * similar
    return common.settle(both.filter(near).select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")))


class _Cell:
    """Rows of a cell, and the links between its components."""

    def __init__(self, table: pa.Table, s: Settings) -> None:
        column = lambda c: table.column(c).to_numpy()
        self.node, self.root, self.major, self.tile = column("node"), column("root").copy(), column("major"), column("tile")
        self.band, self.kind, self.diagonal = int(column("band")[0]), int(column("kind")[0]), int(column("g")[0]) == 0
        sets = table.column("set").combine_chunks()
        offsets = sets.offsets.to_numpy().astype(np.int64)
        self.hashes = sets.values.to_numpy()[offsets[0] : offsets[-1]].view(np.uint64)
        self.begin, self.n, self.similar = offsets[:-1] - offsets[0], np.diff(offsets), s.similar

    def links(self) -> list[tuple[int, int]]:
        least = least_hashes(self.hashes, self.begin + self.n)
        out, places = [], np.arange(len(self.node))
        for i in np.flatnonzero(~self.major):
            if self.kind:
                others = (places > i) & (self.tile != self.tile[i])
            else:
                others = self.major | ((places > i) & self.diagonal)
            small, large = np.minimum(self.n, self.n[i]), np.maximum(self.n, self.n[i])
            j = np.flatnonzero(others & (self.root != self.root[i]) & (small * 100 >= large * self.similar))
            same = least[j] == least[i]
            # pairs meet in the first band that they share, and nowhere else
            first = same.reshape(len(j), BANDS, BAND).all(axis=2).argmax(axis=1) == self.band
            j = j[first & (same.sum(axis=1) >= AGREE)]
            if not len(j):
                continue
            own = self.hashes[self.begin[i] : self.begin[i] + self.n[i]]
            n = self.n[j]
            ends = np.cumsum(n)
            which = np.arange(int(ends[-1])) + np.repeat(self.begin[j] - (ends - n), n)
            theirs = self.hashes[which]
            shared = np.add.reduceat(own[np.minimum(np.searchsorted(own, theirs), len(own) - 1)] == theirs, ends - n, dtype=np.int64)
            for x in j[shared * (100 + self.similar) >= (n + len(own)) * self.similar]:
                if self.root[x] != self.root[i]:
                    out.append((max(self.node[i], self.node[x]), min(self.node[i], self.node[x])))
                    self.root[self.root == self.root[x]] = self.root[i]
        return out


def _groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """The rows of each key, of batches that are sorted by keys."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(c).to_numpy() for c in keys]
        cuts = [0, *(np.flatnonzero(np.logical_or.reduce([c[1:] != c[:-1] for c in columns])) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            key = tuple(c[a] for c in columns)
            if held and key != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
            last = key
    if held:
        yield pa.Table.from_batches(held)


def _rest(rows: DataFrame, roots: DataFrame, sets: DataFrame, s: Settings) -> DataFrame:
    """(u, v): links between different components within the groups of rows(key, band, lead, node, n)."""
    name = lambda c, to: roots.select(F.col("u").alias(c), F.col("v").alias(to)).hint("merge")
    now = rows.join(name("node", "_a"), "node", "left").join(name("lead", "_b"), "lead", "left")
    now = now.withColumn("root", F.coalesce("_a", "node")).withColumn("major", F.col("root") == F.coalesce("_b", "lead")).select("key", "band", "node", "n", "root", "major")
    now = common.settle(now)
    # most members of an open group are in the lead's component: only the others meet all
    parts = lambda is_: F.ceil(F.greatest(F.count(F.when(is_, 1)) / s.tile, F.sum(F.when(is_, F.col("n"))) / s.tile_shingles)).cast("int")
    open_ = now.groupBy("key").agg(parts(F.col("major")).alias("majors"), parts(~F.col("major")).alias("minors")).filter("minors > 0")
    one = now.join(open_.hint("merge"), "key").withColumn("tile", F.pmod(F.xxhash64("node", "key"), F.when(F.col("major"), F.col("majors")).otherwise(F.col("minors"))).cast("int"))
    cells = F.expr(
        "explode(case when major then transform(sequence(0, minors - 1), x -> named_struct('kind', 0, 'g', tile, 'h', x)) "
        "else concat(transform(sequence(0, majors - 1), x -> named_struct('kind', 0, 'g', x, 'h', tile)), "
        "transform(filter(sequence(0, minors - 1), x -> x <> tile), x -> named_struct('kind', 1, 'g', least(tile, x), 'h', greatest(tile, x)))) end)"
    )
    dealt = one.select("key", "band", "node", "root", "major", "tile", cells.alias("c")).select("key", "band", "node", "root", "major", "tile", "c.kind", "c.g", "c.h")
    dealt = dealt.join(sets.hint("merge"), "node")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _groups(batches, ["key", "kind", "g", "h"]):
            if found := _Cell(table, s).links():
                yield pa.RecordBatch.from_pydict({"u": pa.array([int(u) for u, _ in found], pa.int64()), "v": pa.array([int(v) for _, v in found], pa.int64())})
        common.release()

    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = ["key", "kind", "g", "h"]
    return common.settle(dealt.repartition(n, *keys).sortWithinPartitions(*keys).mapInArrow(run, "u long, v long").distinct())


def similar_components(docs: DataFrame, nodes: DataFrame, s: Settings) -> DataFrame:
    """(u, v): v is the smallest node that u reaches over pairs of nodes(node, row, n, fp, keys) that are similar enough."""
    rows = nodes.select("node", "n", F.posexplode("keys").alias("band", "key"))
    groups = rows.groupBy("key").agg(F.min("node").alias("lead"), F.count(F.lit(1)).alias("c")).filter("c > 1").select("key", "lead")
    rows = common.settle(rows.join(groups.hint("merge"), "key"))
    close = edges(nodes.select("node", "fp"), s).select(F.col("v").alias("a"), F.col("u").alias("b"))
    met = rows.filter("node <> lead").select(F.col("lead").alias("a"), F.col("node").alias("b"))
    pairs = common.settle(met.unionByName(close).distinct())
    asked = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    sets = _sets(docs, nodes.select("node", "row").join(asked.hint("merge"), "node"), s)
    roots = components(_verified(pairs, sets, s.similar))
    rest = _rest(rows, roots, sets, s)
    # a node and its root are linked, too: the links need not be closed a second time
    return roots if rest.isEmpty() else components(roots.unionByName(rest))


def similar_groups(docs: DataFrame, s: Settings = WIDE) -> DataFrame:
    """doc_id, row (a hash of id and text), node (one for each distinct set of shingles), root (one for each group) and component_id, as
    grouped() gives them: linked are documents with a Jaccard similarity of at least s.similar per cent. Documents without words are
    copies of each other."""
    docs = docs.select("doc_id", F.xxhash64("doc_id", "text").alias("row"), "text")
    own = common.settle(sketches(docs, s))
    nodes = own.groupBy("node").agg(F.min("doc_id").alias("least"), F.min("row").alias("row"), F.first("n").alias("n"), F.first("fp").alias("fp"), F.first("keys").alias("keys"))
    nodes = common.settle(nodes)
    return _named(own.select("doc_id", "row", "node"), nodes, similar_components(docs, nodes, s))


def _named(own: DataFrame, nodes: DataFrame, roots: DataFrame) -> DataFrame:
    """own with root and component_id: the least id of the nodes that are linked with a row's node."""
    known = nodes.select("node", "least").join(roots.withColumnRenamed("u", "node").hint("merge"), "node", "left").select("node", "least", F.coalesce("v", "node").alias("root"))
    known = known.withColumn("component_id", F.min("least").over(Window.partitionBy("root")))
    return own.join(known.select("node", "root", "component_id").hint("merge"), "node")


def grouped(docs: DataFrame, s: Settings = Settings()) -> DataFrame:
    """doc_id, fp, node (one for each distinct fingerprint) and component_id: the smallest doc_id in the group.

    One row per row of docs(doc_id, text); without fp if s.similar is set. Documents without words have a zero fingerprint, linked like any other.
    Repeated rows and copies share a node. A null id counts only if its group has no other (then component_id is null).
    """
    if s.similar:
        return similar_groups(docs, s).select("doc_id", "node", "component_id")
    own = fingerprints(docs, s)
    own = own.withColumn("node", F.col("fp")[0] if s.words == 1 else F.xxhash64("fp"))
    own = common.settle(own)
    nodes = own.groupBy("node").agg(F.min("doc_id").alias("least"), F.first("fp").alias("fp"))
    nodes = common.settle(nodes)
    roots = components(edges(nodes.select("node", "fp"), s))
    return _named(own, nodes, roots).select("doc_id", "fp", "node", "component_id")


def classes(docs: DataFrame, s: Settings = Settings()) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id."""
    return grouped(docs, s).select("doc_id", F.lpad(F.lower(F.hex(F.col("fp")[0])), 16, "0").alias("fingerprint"), "component_id")


def kept(docs: DataFrame, s: Settings = WIDE) -> DataFrame:
    """One row of each group of near copies, that of the smallest doc_id, with the columns of docs; of repeated rows, one. A row
    without an id stays only if its group has no row with one."""
    at = similar_groups(docs, s)
    row, place, id_ = (common.unused(c, docs.columns) for c in ("row", "place", "kept_id"))
    best = at.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")).alias("b"))
    best = common.settle(best.select(F.col("b.row").alias(row), F.col("b.doc_id").alias(id_)).distinct())
    mine = docs.withColumn(row, F.xxhash64("doc_id", "text")).join(best.hint("merge"), row).filter(F.col("doc_id").eqNullSafe(F.col(id_)))
    # repeated rows are together already
    first = mine.withColumn(place, F.row_number().over(Window.partitionBy(row).orderBy(row)))
    return first.filter(F.col(place) == 1).select(*docs.columns)

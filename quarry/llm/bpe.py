"""Byte-level BPE encoding and decoding.

1. Executors split texts into pre-tokens (words) and number the distinct words of a chunk of about 16 MB of text; a text
   becomes the numbers of its words in order of position.
2. Global distinct-word shuffle: the words of all chunks meet by a hash of the word, packed (one row for each chunk and
   hash bucket), and each distinct word of a bucket is encoded once by merging byte pairs by rank.
3. The ids go back to their chunks in a join on the chunk, and each text is put together again by position.
4. Decoding joins the ids of a chunk's distinct words with the token-byte table by id. All executors have the table, whose size is
   that of the vocabulary and whose rows stand at their ids, so that the join is one gather; words' bytes are slices of its result.

Only distinct words of chunks and their ids are shuffled, with the numbers of the words: no row per word. A frequent word
comes once from a chunk, so that no bucket is hot. Memory in a task: one chunk, or the distinct words of one bucket.
The ranks are read from a file on the driver and broadcast; a tokenizer is never trained.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

#: Characters of text in a chunk, about; a longer text is a chunk of its own.
CHUNK = 16 << 20


def _public() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


@dataclass(frozen=True)
class Settings:
    """path: a file of base64 tokens with their ranks. pattern: splits texts into words."""

    path: str = field(default_factory=lambda: _public()[0])
    pattern: str = field(default_factory=lambda: _public()[1])
    chunk: int = CHUNK


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}


def merge(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The ids of one word: its bytes, of which the neighbours whose union has the least rank merge (leftmost first) until
    none has one. A heap finds them, so that a very long word takes n log n steps."""
    whole = ranks.get(word)
    if whole is not None:
        return [whole]
    n = len(word)
    after, before, end = list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1))
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(word[i : i + 2])) is not None]
    heapq.heapify(heap)
    live = bytearray(b"\1") * n
    while heap:
        _, i, stop = heapq.heappop(heap)
        j = after[i] if live[i] else n
        if j >= n or end[j] != stop:  # one of the two has merged otherwise meanwhile
            continue
        live[j], end[i], after[i] = 0, stop, after[j]
        if after[j] < n:
            before[after[j]] = i
        for a in (before[i], i):
            b = after[a] if a >= 0 else n
            if b < n and (r := ranks.get(word[a : end[b]])) is not None:
                heapq.heappush(heap, (r, a, end[b]))
    return [ranks[word[i : end[i]]] for i in range(n) if live[i]]


def _pack(parts: list[np.ndarray | bytes]) -> bytes:
    raw = b"".join(p if isinstance(p, bytes) else p.tobytes() for p in parts)
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def _unpack(blob: bytes) -> bytes:
    return pa.decompress(blob[8:], decompressed_size=int.from_bytes(blob[:8], "little"), codec="zstd", asbytes=True)


def _planes(x: np.ndarray) -> np.ndarray:
    """The bytes of 32-bit values, all the first, then all the second ...: compresses better."""
    return np.ascontiguousarray(x.astype("<u4").view(np.uint8).reshape(-1, 4).T)


def _unplane(raw: bytes | memoryview, n: int) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8, 4 * n).reshape(4, n).T).view("<u4").ravel()


class _Numbers(dict):
    """Gives each new key the next number."""

    def __missing__(self, key):
        self[key] = n = len(self)
        return n


def _split(docs: DataFrame, s: Settings, buckets: int) -> DataFrame:
    """Chunks: rows with ids, counts and codes (a chunk's texts), and rows with bucket and words (its distinct words)."""
    kind = docs.schema["doc_id"].dataType
    schema = T.StructType([
        T.StructField("chunk", T.LongType()), T.StructField("bucket", T.IntegerType()), T.StructField("blob", T.BinaryType()),
        T.StructField("ids", T.ArrayType(kind)),
    ])
    pattern, most = s.pattern, s.chunk

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = regex.compile(pattern).findall
        task = TaskContext.get().partitionId() << 32
        state: dict = {}

        def reset() -> None:
            state.update(numbers=_Numbers(), codes=[], ids=[], size=0)

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal task
            words = [w.encode("utf-8", "surrogatepass") for w in state["numbers"]]
            counts = np.array([len(c) for c in state["codes"]], np.uint32)
            # frequent words get small numbers, which compress well
            codes = np.concatenate(state["codes"])
            frequent = np.argsort(-np.bincount(codes, minlength=len(words)), kind="stable")
            number = np.empty(len(words), np.uint32)
            number[frequent] = np.arange(len(words), dtype=np.uint32)
            codes, words = number[codes], [words[i] for i in frequent]
            bucket = np.fromiter((zlib.crc32(w) % buckets for w in words), np.int64, len(words))
            order = np.argsort(bucket, kind="stable")
            place = np.empty(len(words), np.uint32)
            place[order] = np.arange(len(words), dtype=np.uint32)
            ids = pa.concat_arrays(state["ids"])
            out_bucket, blobs = [-1], [_pack([counts, _planes(codes), _planes(place)])]
            cuts = np.searchsorted(bucket[order], np.arange(buckets + 1))
            for b in np.flatnonzero(np.diff(cuts)):
                own = [words[i] for i in order[cuts[b] : cuts[b + 1]]]
                lengths = np.array([len(w) for w in own], np.uint32)
                out_bucket.append(int(b))
                blobs.append(_pack([np.uint32(len(own)), lengths, *own]))
            n = len(blobs)
            lists = pa.ListArray.from_arrays(pa.array([0] + [len(ids)] * n, pa.int32()), ids)
            yield pa.RecordBatch.from_arrays([pa.array([task] * n, pa.int64()), pa.array(out_bucket, pa.int32()), pa.array(blobs, pa.binary()), lists], schema.names)
            task += 1
            reset()

        reset()
        for batch in batches:
            texts, ids = batch.column("text").to_pylist(), batch.column("doc_id")
            for i, text in enumerate(texts):
                if state["size"] and state["size"] + len(text or "") > most:
                    yield from flush()
                words = find(text) if text else []
                state["codes"].append(np.fromiter(map(state["numbers"].__getitem__, words), np.uint32, len(words)))
                state["ids"].append(ids.slice(i, 1))
                state["size"] += len(text or "") + 1
        if state["ids"]:
            yield from flush()
        state.clear()
        common.release()

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def _unpack_words(blob: bytes) -> list[bytes]:
    raw = _unpack(blob)
    n = int(np.frombuffer(raw, np.uint32, 1)[0])
    ends = np.cumsum(np.frombuffer(raw, np.uint32, n, 4), dtype=np.int64) + 4 + 4 * n
    return [raw[a:b] for a, b in zip([4 + 4 * n, *ends[:-1].tolist()], ends.tolist())]


def _encode_words(words: DataFrame, shared, buckets: int) -> DataFrame:
    """(chunk, bucket, blob) of words to the same with ids; a task holds whole buckets and encodes each of their words once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks = shared.value
        known: dict[bytes, list[int]] = {}
        now = None
        for batch in batches:
            blobs = []
            for bucket, blob in zip(batch.column("bucket").to_pylist(), batch.column("blob").to_pylist()):
                if bucket != now:
                    known, now = {}, bucket
                flat: list[int] = []
                counts: list[int] = []
                for w in _unpack_words(blob):
                    ids = known.get(w)
                    if ids is None:
                        known[w] = ids = merge(w, ranks)
                    counts.append(len(ids))
                    flat += ids
                blobs.append(_pack([np.array([len(counts), len(flat)], np.uint32), _planes(np.array(counts, np.uint32)), _planes(np.array(flat, np.uint32))]))
            yield pa.RecordBatch.from_arrays([batch.column("chunk"), batch.column("bucket"), pa.array(blobs, pa.binary())], ["chunk", "bucket", "blob"])
        known = {}
        common.release()

    dealt = words.repartition(buckets, "bucket").sortWithinPartitions("bucket", "chunk")
    return dealt.mapInArrow(run, "chunk long, bucket int, blob binary")


def _settled_by_chunk(rows: DataFrame, buckets: int) -> DataFrame:
    """rows written to the shared scratch folder in buckets by chunk, and read back: the join by chunk then moves ids only,
    not the texts' numbers. The catalogue's entry goes at once; the files stay."""
    spark, path = rows.sparkSession, common.scratch(rows.sparkSession)
    name = path.rpartition("/")[2].replace("-", "_")
    rows.write.format("parquet").option("path", path).option("compression", "zstd").bucketBy(buckets, "chunk").saveAsTable(name)
    out = spark.table(name)
    spark.sql(f"DROP TABLE {name}")
    return out


def encode(docs: DataFrame, s: Settings | None = None, ids: bool = True, digests: bool = False) -> DataFrame:
    """doc_id and ids (array of int; if ids) of each row of docs(doc_id, text), and, with digests, n_tokens, ids_sha256 (of the
    decimal ids joined by commas) and decoded_sha256 (of the bytes that the ids decode to).

    Special tokens are ordinary text. A null text counts as empty: no ids. Repeated rows each give a row. Other columns are
    left out. Empty input gives an empty frame.
    """
    s = s or Settings()
    spark = docs.sparkSession
    ranks = read_ranks(s.path)
    shared = spark.sparkContext.broadcast(ranks)  # of fixed size: the vocabulary
    at_id: list[bytes | None] = [None] * (max(ranks.values(), default=-1) + 1)
    for token, i in ranks.items():
        at_id[i] = token
    table = spark.sparkContext.broadcast(pa.array(at_id, pa.binary()))
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    both = _settled_by_chunk(_split(docs, s, buckets), buckets)
    coded = both.filter("bucket = -1").select("chunk", "blob", "ids")
    words = _encode_words(both.filter("bucket >= 0").select("chunk", "bucket", "blob"), shared, buckets)
    fields = [T.StructField("doc_id", docs.schema["doc_id"].dataType)]
    if digests:
        fields += [T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]
    if ids:
        fields += [T.StructField("ids", T.ArrayType(T.IntegerType()))]
    names = [f.name for f in fields]

    def assemble(left: pa.Table, right: pa.Table) -> pa.Table:
        common.release()  # what the chunk before this held
        flat_parts, count_parts = [], []
        for _, blob in sorted(zip(right.column("bucket").to_pylist(), right.column("blob").to_pylist())):
            raw = _unpack(blob)
            n, m = (int(x) for x in np.frombuffer(raw, np.uint32, 2))
            count_parts.append(_unplane(raw[8 : 8 + 4 * n], n))
            flat_parts.append(_unplane(raw[8 + 4 * n :], m))
        none = [np.zeros(0, np.uint32)]
        lengths, flat = np.concatenate(count_parts or none).astype(np.int64), np.concatenate(flat_parts or none)
        ends = np.cumsum(lengths)
        pieces = flat.tolist()
        spans = list(zip((ends - lengths).tolist(), ends.tolist()))
        out: list[list] = [[] for _ in names[1:]]
        keys = left.column("ids").combine_chunks().flatten()
        if digests:
            said = [",".join(map(str, pieces[a:b])).encode() for a, b in spans]
            joined = table.value.take(pa.array(flat))
            places = np.frombuffer(joined.buffers()[1], np.int32, len(joined) + 1, 4 * joined.offset) if len(joined) else np.zeros(1, np.int32)
            whole = joined.buffers()[2].to_pybytes() if len(joined) else b""
            decoded = [whole[a:b] for a, b in zip(places[ends - lengths].tolist(), places[ends].tolist())]
        for blob in left.column("blob").to_pylist():
            raw = _unpack(blob)
            n = len(keys)
            counts = np.frombuffer(raw, np.uint32, n).astype(np.int64)
            size = int(counts.sum())
            codes = _unplane(raw[4 * n + 4 * size :], len(lengths))[_unplane(raw[4 * n : 4 * n + 4 * size], size)]
            stops = np.cumsum(counts)
            for a, b in zip((stops - counts).tolist(), stops.tolist()):
                own = codes[a:b]
                if digests:
                    at = own.tolist()
                    out[0].append(int(lengths[own].sum()))
                    out[1].append(hashlib.sha256(b",".join([said[i] for i in at])).hexdigest())
                    out[2].append(hashlib.sha256(b"".join([decoded[i] for i in at])).hexdigest())
                if ids:
                    k = lengths[own]
                    at = np.repeat(ends[own] - np.cumsum(k), k) + np.arange(int(k.sum()))
                    out[-1].append(flat[at].astype(np.int32))
        types = [pa.int64(), pa.string(), pa.string()] * digests + [pa.list_(pa.int32())] * ids
        return pa.Table.from_arrays([keys, *(pa.array(o, t) for o, t in zip(out, types))], names)

    return coded.groupBy("chunk").cogroup(words.groupBy("chunk")).applyInArrow(assemble, T.StructType(fields))


def token_bytes(spark: SparkSession, s: Settings | None = None) -> DataFrame:
    """The token-byte table: id, bytes."""
    s = s or Settings()
    return spark.createDataFrame([(i, bytearray(t)) for t, i in read_ranks(s.path).items()], "id int, bytes binary")


def decode(encoded: DataFrame, key: str = "doc_id", s: Settings | None = None) -> DataFrame:
    """key and bytes (binary) of each row of encoded(key, ids): the tokens' bytes, joined in order.

    ids are exploded with positions, joined with the token-byte table, and put together by position. key tells rows
    apart; rows with the same key give one row, of any of them. No ids (or null) gives no bytes; an id outside the
    vocabulary gives null.
    """
    table = token_bytes(encoded.sparkSession, s)
    one = encoded.select(F.col(key).alias("k"), F.col("ids").alias("ids")).groupBy("k").agg(F.first("ids", True).alias("ids"))
    rows = one.select("k", F.posexplode_outer("ids").alias("pos", "id")).join(F.broadcast(table), "id", "left")  # the vocabulary: of fixed size
    got = rows.groupBy("k").agg(
        F.array_sort(F.collect_list(F.when(F.col("pos").isNotNull(), F.struct("pos", "bytes")))).alias("parts"),
        F.bool_or(F.col("pos").isNotNull() & F.col("bytes").isNull()).alias("unknown"),
    )
    joined = F.expr("unhex(array_join(transform(parts, x -> hex(x.bytes)), ''))")
    return got.select(F.col("k").alias(key), F.when(~F.col("unknown"), joined).alias("bytes"))


def digests(docs: DataFrame, s: Settings | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: see encode()."""
    return encode(docs, s, ids=False, digests=True)

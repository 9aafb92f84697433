"""Media columns: telephony audio.

A WAVE file holds 8-bit mu-law or A-law samples, or IMA ADPCM blocks of 64 bytes. Mu-law and A-law expand by tables of
256 entries; ADPCM blocks, which don't depend on one another, decode side by side in numpy: one step for the k-th sample
of all blocks of all files at hand. The PCM is resampled to twice the rate by linear interpolation.

Each file is handled in one task, on its own: no shuffle, and memory is bounded by a slice of files (or one longer file).
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

RATE = 8000
BLOCK = 64
BLOCK_SAMPLES = 2 * (BLOCK - 4) + 1
#: Format tags of a WAVE file.
TAGS = {"mulaw": 7, "alaw": 6, "adpcm": 17}
CODECS = tuple(TAGS)

#: Fixed values of the IMA ADPCM format: step sizes, and the change of the step index by the low three bits of a code.
STEPS = np.array([
    7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107, 118, 130, 143, 157, 173, 190, 209, 230, 253, 279, 307,
    337, 371, 408, 449, 494, 544, 598, 658, 724, 796, 876, 963, 1060, 1166, 1282, 1411, 1552, 1707, 1878, 2066, 2272, 2499, 2749, 3024, 3327, 3660, 4026, 4428, 4871, 5358,
    5894, 6484, 7132, 7845, 8630, 9493, 10442, 11487, 12635, 13899, 15289, 16818, 18500, 20350, 22385, 24623, 27086, 29794, 32767,
], np.int32)
INDEX_CHANGE = np.array([-1, -1, -1, -1, 2, 4, 6, 8], np.int32)


def _mulaw_table() -> np.ndarray:
    """Segment and step of the inverted byte; 132 is the bias of the law."""
    b = ~np.arange(256, dtype=np.int32) & 0xFF
    size = (((b & 15) << 3) + 132 << (b >> 4 & 7)) - 132
    return np.where(b & 0x80, -size, size).astype(np.int16)


def _alaw_table() -> np.ndarray:
    """Even bits are inverted; segment 0 has no leading one."""
    b = np.arange(256, dtype=np.int32) ^ 0x55
    segment, step = b >> 4 & 7, b & 15
    size = np.where(segment == 0, (step << 4) + 8, (step << 4) + 0x108 << np.maximum(segment - 1, 0))
    return np.where(b & 0x80, size, -size).astype(np.int16)


EXPAND = {"mulaw": _mulaw_table(), "alaw": _alaw_table()}


def decode_adpcm(blocks: np.ndarray) -> np.ndarray:
    """int16 samples (blocks, BLOCK_SAMPLES) of uint8 blocks (blocks, BLOCK); a step index beyond the table is clipped."""
    n = len(blocks)
    out = np.empty((BLOCK_SAMPLES, n), np.int16)
    value = (blocks[:, 0].astype(np.int32) | blocks[:, 1].astype(np.int32) << 8).astype(np.int16).astype(np.int32)
    index = np.minimum(blocks[:, 2].astype(np.int32), len(STEPS) - 1)
    out[0] = value
    codes = np.empty((BLOCK_SAMPLES - 1, n), np.uint8)
    codes[0::2] = (blocks[:, 4:] & 15).T
    codes[1::2] = (blocks[:, 4:] >> 4).T
    for k, code in enumerate(codes):
        step = STEPS[index]
        change = step >> 3
        change += np.where(code & 4, step, 0)
        change += np.where(code & 2, step >> 1, 0)
        change += np.where(code & 1, step >> 2, 0)
        value = np.clip(np.where(code & 8, value - change, value + change), -32768, 32767)
        index = np.clip(index + INDEX_CHANGE[code & 7], 0, len(STEPS) - 1)
        out[k + 1] = value
    return out.T


def resample(pcm: np.ndarray) -> np.ndarray:
    """Twice the rate: the mean of two neighbours, rounded down, between them; the last sample twice."""
    out = np.empty(2 * len(pcm), np.int16)
    out[0::2] = pcm
    if len(pcm):
        out[1:-1:2] = (pcm[:-1].astype(np.int32) + pcm[1:]) >> 1
        out[-1] = pcm[-1]
    return out


def write_wave(payload: bytes, codec: str) -> bytes:
    """A mono WAVE file with payload as its data chunk."""
    samples, align, bits = (len(payload) // BLOCK * BLOCK_SAMPLES, BLOCK, 4) if codec == "adpcm" else (len(payload), 1, 8)
    rate = RATE * BLOCK // BLOCK_SAMPLES if codec == "adpcm" else RATE
    extra = struct.pack("<H", BLOCK_SAMPLES) if codec == "adpcm" else b""
    fmt = struct.pack("<HHIIHHH", TAGS[codec], 1, RATE, rate, align, bits, len(extra)) + extra
    body = b"WAVE" + struct.pack("<4sI", b"fmt ", len(fmt)) + fmt + struct.pack("<4sII", b"fact", 4, samples)
    body += struct.pack("<4sI", b"data", len(payload)) + payload + b"\0" * (len(payload) % 2)
    return struct.pack("<4sI", b"RIFF", len(body)) + body


def read_wave(media: bytes) -> tuple[str, bytes]:
    """(codec, data chunk) of a WAVE file; ValueError for anything else."""
    if len(media) < 12 or media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("not a WAVE file")
    at, tag = 12, None
    while at + 8 <= len(media):
        kind, size = struct.unpack_from("<4sI", media, at)
        if kind == b"fmt " and size >= 2:
            tag = struct.unpack_from("<H", media, at + 8)[0]
        elif kind == b"data":
            codec = next((c for c, t in TAGS.items() if t == tag), None)
            if codec is None or at + 8 + size > len(media):
                break
            return codec, media[at + 8 : at + 8 + size]
        at += 8 + size + size % 2
    raise ValueError("no telephony audio in the WAVE file")


def decode(files: list[bytes]) -> list[tuple[str, bytes, np.ndarray]]:
    """(codec, data, PCM at RATE) of each file; ADPCM blocks of all files decode together. A last part of a block is left out."""
    read = [read_wave(f) for f in files]
    own = [i for i, (codec, _) in enumerate(read) if codec == "adpcm"]
    counts = [len(read[i][1]) // BLOCK for i in own]
    whole = b"".join(read[i][1][: n * BLOCK] for i, n in zip(own, counts))
    samples = decode_adpcm(np.frombuffer(whole, np.uint8).reshape(-1, BLOCK))
    ends = np.cumsum(counts)
    adpcm = {i: samples[e - n : e].reshape(-1) for i, n, e in zip(own, counts, ends)}
    return [(c, d, adpcm[i] if c == "adpcm" else EXPAND[c][np.frombuffer(d, np.uint8)]) for i, (c, d) in enumerate(read)]


def feature(codec: str, pcm: np.ndarray) -> str:
    """Codec, samples, peak, root mean square, zero crossings and checksum of PCM."""
    wide = pcm.astype(np.int32)
    peak = int(np.abs(wide).max(initial=0))
    rms = float(np.sqrt(np.dot(wide.astype(np.float64), wide) / max(1, len(wide))))
    crossings = int(np.count_nonzero((wide[1:] < 0) != (wide[:-1] < 0)))
    return f"{codec};n={len(pcm)};peak={peak};rms={rms:.3f};zc={crossings};crc={zlib.crc32(pcm.astype('<i2').tobytes()):08x}"


def payload_of(text: str | None) -> tuple[bytes, int]:
    """The UTF-8 bytes, filled up with zero bytes to a positive multiple of 64; their number before that."""
    raw = common.text_bytes(text)
    return raw + b"\0" * (max(64, -(-len(raw) // 64) * 64) - len(raw)), len(raw)


def codec_of(payload: bytes) -> str:
    """Spreads payloads over the three codecs; equal payloads get the same."""
    return CODECS[zlib.crc32(payload) % len(CODECS)]


def files(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes (of the text) and media, a WAVE file of each text of docs(doc_id, text)."""
    schema = T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("n_bytes", T.LongType()), T.StructField("media", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in common.spans(batch.column("text")):
                made = [payload_of(t) for t in batch.column("text").slice(a, b - a).to_pylist()]
                media = [write_wave(payload, codec_of(payload)) for payload, _ in made]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, b - a), pa.array([n for _, n in made], pa.int64()), pa.array(media, pa.binary())], schema.names)

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def read_back(media: DataFrame) -> DataFrame:
    """media with what its files hold: payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature, and pcm (16-bit
    little-endian samples at twice RATE). Files of a batch decode together, in slices of about 256 KB."""
    fields = [
        *media.schema.fields, T.StructField("payload_bytes", T.LongType()), T.StructField("payload_sha256", T.StringType()), T.StructField("tail_crc32", T.LongType()),
        T.StructField("media_bytes", T.LongType()), T.StructField("media_sha256", T.StringType()), T.StructField("feature", T.StringType()), T.StructField("pcm", T.BinaryType()),
    ]
    types = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.binary()]
    given, names = [f.name for f in media.schema.fields], [f.name for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in common.spans(batch.column("media"), 1 << 18):  # a byte of it becomes dozens while it is decoded
                rows, files_ = [], batch.column("media").slice(a, b - a).to_pylist()
                for file, (codec, data, samples) in zip(files_, decode(files_)):
                    wide = resample(samples)
                    rows.append((len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-64:]), len(file), hashlib.sha256(file).hexdigest(), feature(codec, wide), wide.astype("<i2").tobytes()))
                own = [batch.column(c).slice(a, b - a) for c in given]
                yield pa.RecordBatch.from_arrays([*own, *(pa.array(c, t) for c, t in zip(zip(*rows), types))], names)
        common.release()

    return media.mapInArrow(run, T.StructType(fields))


def stored(docs: DataFrame) -> DataFrame:
    """Each text of docs(doc_id, text) as a WAVE file, stored as a table in the shared scratch folder and read from it again.

    One row per row: doc_id, n_bytes, media (the file), and the columns of read_back(), pcm among them. A null text counts as
    empty: 64 zero bytes. Other columns are left out. Empty input gives an empty frame.
    """
    return read_back(common.settle(files(docs)))


def digests(docs: DataFrame) -> DataFrame:
    """stored() with the length and sha256 of the PCM, without the files and the PCM themselves."""
    out = stored(docs).withColumn("pcm_bytes", F.length("pcm").cast("long")).withColumn("pcm_sha256", F.sha2("pcm", 256))
    return out.drop("media", "pcm")

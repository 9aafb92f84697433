"""Files in pieces, put together again by what their formats check: chunks of PNG by checksum, entries of ZIP by their headers, atoms of
MP4 by their kind. Each function takes the bytes from a file's header on, foreign ones among them, and returns the file, the
number of breaks that it went over, and whether the file is whole."""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from quarry.operators.carving import _u

Stitched = tuple[bytes, int, bool]
NOTHING: Stitched = (b"", 0, False)
#: Bytes after a break in which the next piece is looked for.
WINDOW = 64 << 20
#: Kinds of chunks and of atoms.
CHUNKS = (b"IHDR", b"PLTE", b"IDAT", b"IEND", b"tRNS", b"cHRM", b"gAMA", b"iCCP", b"sBIT", b"sRGB", b"tEXt", b"zTXt", b"iTXt", b"bKGD", b"hIST", b"pHYs", b"sPLT", b"tIME")
ATOMS = (b"ftyp", b"moov", b"mdat", b"free", b"skip", b"wide", b"udta", b"meta", b"moof", b"mfra", b"sidx", b"styp", b"uuid", b"pdin")
_CHUNK, _ATOM = re.compile(b"|".join(CHUNKS)), re.compile(b"|".join(ATOMS))


def _chunk(data: bytes, at: int) -> bytes | None:
    """The chunk at a place, if its kind is known and its checksum holds."""
    size = _u(data, at, ">I")
    if at < 0 or size is None or data[at + 4 : at + 8] not in CHUNKS or at + 12 + size > len(data):
        return None
    return data[at : at + 12 + size] if zlib.crc32(data[at + 4 : at + 8 + size]) == _u(data, at + 8 + size, ">I") else None


def png(data: bytes, window: int = WINDOW) -> Stitched:
    """Chunks whose checksums hold, one after another; after a break the next such chunk within window bytes."""
    if not data.startswith(b"\x89PNG\r\n\x1a\n"):
        return NOTHING
    out, at, breaks = [data[:8]], 8, 0
    while True:
        chunk = _chunk(data, at)
        if chunk is None:
            breaks += 1
            places = (m.start() - 4 for m in _CHUNK.finditer(data, at + 4, at + window))
            found = next((p for p in places if p >= at and _chunk(data, p)), None)
            if found is None:
                return b"".join(out), breaks, False
            at, chunk = found, _chunk(data, found)
        out.append(chunk)
        at += len(chunk)
        if chunk[4:8] == b"IEND":
            return b"".join(out), breaks, len(out) > 3


def mp4(data: bytes, window: int = WINDOW) -> Stitched:
    """Atoms of known kinds one after another; after a break the next one, at a multiple of 512 bytes, within window bytes. Whole: the
    kinds that a player needs are there, and no atom reaches beyond the bytes."""
    if data[4:8] != b"ftyp":
        return NOTHING
    out, at, breaks, kinds = [], 0, 0, set()
    while at + 8 <= len(data):
        size, kind = _u(data, at, ">I"), data[at + 4 : at + 8]
        size = _u(data, at + 8, ">Q") if size == 1 else size
        if kind not in ATOMS or size is None or size < 8:
            if {b"moov", b"mdat"} <= kinds:
                break  # what follows is another file
            places = (m.start() - 4 for m in _ATOM.finditer(data, at + 4, at + window))
            found = next((p for p in places if p > at and p % 512 == 0 and (_u(data, p, ">I") or 0) >= 8 and p + _u(data, p, ">I") <= len(data)), None)
            if found is None:
                break
            breaks, at = breaks + 1, found
            continue
        if at + size > len(data):
            break
        out.append(data[at : at + size])
        kinds.add(kind)
        at += size
    return b"".join(out), breaks, {b"ftyp", b"moov", b"mdat"} <= kinds


def _entry(data: bytes, at: int, size: int | None = None) -> tuple[bytes, bytes, tuple] | None:
    """(name, packed bytes, fields) of the local header at a place; size as the directory states it, else the header's own, else up to
    the next header."""
    if data[at : at + 4] != b"PK\3\4" or at + 30 > len(data):
        return None
    version, flags, method, time, date, crc, packed, whole, n, extra = struct.unpack_from("<5H3I2H", data, at + 4)
    begin = at + 30 + n + extra
    name = data[at + 30 : at + 30 + n]
    size = packed if size is None else size
    if flags & 8 and not packed and size == packed:  # sizes stand behind the data
        ends = [e for e in (data.find(m, begin) for m in (b"PK\3\4", b"PK\1\2", b"PK\5\6")) if e >= 0]
        stop = min(ends, default=len(data))
        mark = data.rfind(b"PK\7\x08", begin, stop)
        if mark >= 0 and mark + 16 <= len(data):
            crc, size, whole = struct.unpack_from("<3I", data, mark + 4)
            if begin + size != mark:
                size = mark - begin
        else:
            size = stop - begin
    if not n or begin + size > len(data):
        return None
    return name, data[begin : begin + size], (version, flags & ~8, method, time, date, crc, size, whole)


def _archive(entries: list[tuple[bytes, bytes, tuple]]) -> bytes:
    body, table = b"", b""
    for name, packed, fields in entries:
        table += b"PK\1\2" + struct.pack("<H5H3I5H2I", 20, *fields, len(name), 0, 0, 0, 0, 0, len(body)) + name
        body += b"PK\3\4" + struct.pack("<5H3I2H", *fields, len(name), 0) + name + packed
    return body + table + b"PK\5\6" + struct.pack("<4H2IH", 0, 0, len(entries), len(entries), len(table), len(body), 0)


def _sound(entry: tuple[bytes, bytes, tuple]) -> bool:
    """Whether the bytes unpack to what the checksum says; other methods than stored and deflated are believed."""
    _, packed, (_, flags, method, _, _, crc, _, _) = entry
    if flags & 1 or method not in (0, 8):
        return True
    try:
        raw = packed if method == 0 else zlib.decompress(packed, -15)
    except zlib.error:
        return False
    return zlib.crc32(raw) == crc


def zip_local(data: bytes) -> Stitched:
    """An archive of the entries whose local headers and bytes are sound, with a directory made anew."""
    found, at = [], data.find(b"PK\3\4")
    breaks = 0
    while at >= 0:
        entry = _entry(data, at)
        if entry and _sound(entry):
            found.append(entry)
            at = data.find(b"PK\3\4", at + 30 + len(entry[0]) + len(entry[1]))
        else:
            breaks += 1
            at = data.find(b"PK\3\4", at + 4)
    return (_archive(found), breaks, not breaks) if found else NOTHING


def zip_(data: bytes) -> Stitched:
    """An archive of the entries that its directory lists, as far as they are sound; without a directory, of all that are found."""
    end = data.rfind(b"PK\5\6")
    while end >= 0:
        start, n = _u(data, end + 16, "<I"), _u(data, end + 10, "<H")
        if start is not None and n and data[start : start + 4] == b"PK\1\2" and start < end:
            break
        end = data.rfind(b"PK\5\6", 0, end)
    if end < 0:
        return zip_local(data)
    found, at, lost = [], start, 0
    for _ in range(n):
        if data[at : at + 4] != b"PK\1\2" or at + 46 > len(data):
            return zip_local(data)
        crc, packed, whole, name, extra, note = struct.unpack_from("<3I3H", data, at + 16)
        entry = _entry(data, struct.unpack_from("<I", data, at + 42)[0], packed)
        if entry:
            entry = entry[0], entry[1], (*entry[2][:5], crc, packed, whole)
        if entry and _sound(entry):
            found.append(entry)
        else:
            lost += 1
        at += 46 + name + extra + note
    return (_archive(found), lost, not lost) if found else zip_local(data)


STITCHERS: dict[str, Callable[[bytes], Stitched]] = {"png": png, **dict.fromkeys(("zip", "docx", "xlsx", "pptx", "epub", "jar", "apk"), zip_), **dict.fromkeys(("mp4", "mov", "m4a", "3gp"), mp4)}


def stitch(extension: str, data: bytes) -> Stitched:
    try:
        return STITCHERS[extension](data) if extension in STITCHERS else NOTHING
    except (struct.error, OverflowError):
        return NOTHING


def stitched(candidates: DataFrame) -> DataFrame:
    """candidates(extension, payload, ...) with payload put together, breaks and whole; payload is null where nothing was found."""
    kept = [f for f in candidates.schema.fields if f.name not in ("payload", "breaks", "whole")]
    names = [*(f.name for f in kept), "payload", "breaks", "whole"]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in kept] + ["payload binary, breaks int, whole boolean"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [stitch(e or "", p or b"") for e, p in zip(batch.column("extension").to_pylist(), batch.column("payload").to_pylist())]
            columns = [pa.array([g[0] or None for g in got], pa.binary()), pa.array([g[1] for g in got], pa.int32()), pa.array([g[2] for g in got], pa.bool_())]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names[:-3]), *columns], names)

    return candidates.mapInArrow(run, schema)

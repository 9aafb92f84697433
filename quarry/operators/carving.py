"""Carving: sizes of files from their own structure, container types, and the pipeline from blocks to files.

Detectors take the bytes from a header on, and the largest size; they return the size, 0 where the structure doesn't hold.
They never raise, whatever the bytes.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.operators.matching import Automaton
from quarry.operators.windows import numbered_ranges
from quarry.runtime import settle
from quarry.schema import as_files
from quarry.sources import signatures


class Head(bytes):
    """The first bytes of a file, which remember whether a detector wanted to see more of them than there are."""

    short = False

    def __getitem__(self, key):
        if isinstance(key, slice):
            self.short |= key.stop is None or key.stop > len(self)
        else:
            self.short |= key >= len(self)
        return bytes.__getitem__(self, key)

    def find(self, part, start=0, end=1 << 62):
        at = bytes.find(self, part, start, min(end, len(self)))
        self.short |= at < 0 and end > len(self)
        return at

    def rfind(self, part, start=0, end=1 << 62):
        self.short |= end > len(self)  # a later one may follow
        return bytes.rfind(self, part, start, min(end, len(self)))


def _wanted(data: bytes, at: int, most: int) -> None:
    """A detector stops before place at, since the bytes end there."""
    if isinstance(data, Head) and at > len(data) and len(data) < most:
        data.short = True


def _u(data: bytes, at: int, kind: str) -> int | None:
    size = struct.calcsize(kind)
    if 0 <= at and at + size <= len(data):
        return struct.unpack_from(kind, data, at)[0]
    _wanted(data, at + size, 1 << 62)
    return None


def jpeg(data: bytes, most: int) -> int:
    """Segments by their lengths; entropy-coded data up to the next true marker; the end marker ends the file."""
    at = 2
    while True:
        at = data.find(b"\xff", at, most)
        if at < 0:
            return 0
        while data[at : at + 1] == b"\xff":
            at += 1
        if at >= min(len(data), most):
            return 0
        kind = data[at]
        at += 1
        if kind == 0xD9:
            return at
        if kind in (0x00, 0x01) or 0xD0 <= kind <= 0xD7:
            continue
        size = _u(data, at, ">H")
        if size is None or size < 2:
            return 0
        at += size  # after a start of scan, stuffed bytes and restart markers are skipped above


def png(data: bytes, most: int) -> int:
    at = 8
    while (size := _u(data, at, ">I")) is not None and at + 12 + size <= min(most, len(data)):
        kind = data[at + 4 : at + 8]
        if not kind.isalpha():
            return 0
        at += 12 + size
        if kind == b"IEND":
            return at
    if size is not None and at + 12 + size <= most:
        _wanted(data, at + 12 + size, most)
    return 0


def pdf(data: bytes, most: int) -> int:
    """After the last end-of-file mark, with one line end."""
    at = data.rfind(b"%%EOF", 0, most)
    if at < 0:
        return 0
    at += 5
    if data[at : at + 2] == b"\r\n":
        return min(at + 2, most)
    return min(at + (data[at : at + 1] in (b"\r", b"\n")), most)


def zip_(data: bytes, most: int) -> int:
    """The largest end record whose directory lies before it."""
    best, at = 0, data.find(b"PK\5\6", 0, most)
    while at >= 0:
        size, start, note = _u(data, at + 12, "<I"), _u(data, at + 16, "<I"), _u(data, at + 20, "<H")
        if note is not None and start + size <= at and at + 22 + note <= most:
            best = max(best, at + 22 + note)
        at = data.find(b"PK\5\6", at + 1, most)
    return best


def _atoms(data: bytes, at: int, end: int) -> Iterator[tuple[bytes, int, int, int]]:
    """(type, begin of body, end as stated, begin)."""
    while at + 8 <= end:
        size, kind, body = _u(data, at, ">I"), data[at + 4 : at + 8], at + 8
        if size == 1:
            size, body = _u(data, at + 8, ">Q"), at + 16
        elif size == 0:
            size = end - at
        if size is None or size < body - at or not all(32 <= c < 127 or c == 0xA9 for c in kind):
            return
        yield kind, body, at + size, at
        at += size


def sample_end(data: bytes, most: int) -> int:
    """The end of the last chunk of any track by its sample tables."""
    best, end = 0, min(most, len(data))
    work = [(0, end)]
    while work:
        a, b = work.pop()
        sizes: list[int] = []
        chunks: list[int] = []
        runs: list[tuple[int, int]] = []
        for kind, body, stop, _ in _atoms(data, a, b):
            stop = min(stop, b)
            if kind in (b"moov", b"trak", b"mdia", b"minf", b"stbl"):
                work.append((body, stop))
            elif kind == b"stsz":
                one, n = _u(data, body + 4, ">I"), _u(data, body + 8, ">I")
                if n is not None and n <= (stop - body) // 4 + (10**7 if one else 0):
                    sizes = [one] * n if one else [_u(data, body + 12 + 4 * i, ">I") or 0 for i in range(n)]
            elif kind in (b"stco", b"co64"):
                step, code = (4, ">I") if kind == b"stco" else (8, ">Q")
                n = min(_u(data, body + 4, ">I") or 0, (stop - body) // step)
                chunks = [_u(data, body + 8 + step * i, code) or 0 for i in range(n)]
            elif kind == b"stsc":
                n = min(_u(data, body + 4, ">I") or 0, (stop - body) // 12)
                runs = [(_u(data, body + 8 + 12 * i, ">I") or 0, _u(data, body + 12 + 12 * i, ">I") or 0) for i in range(n)]
        if sizes and chunks and runs:
            sample, run = 0, 0
            for i, begin in enumerate(chunks, 1):
                while run + 1 < len(runs) and runs[run + 1][0] <= i:
                    run += 1
                own = sizes[sample : sample + runs[run][1]]
                sample += len(own)
                best = max(best, begin + sum(own))
    return best if best <= most else 0


def mp4(data: bytes, most: int) -> int:
    """The chain of atoms; the last may reach beyond the range and is clipped. No less than the sample tables tell."""
    end = 0
    for _, _, stop, _ in _atoms(data, 0, min(most, len(data))):
        end = min(stop, most)
    _wanted(data, end + 8, most)
    return max(end, sample_end(data, most)) if end else 0


#: Fixed values of the MPEG audio format: kbit/s by version 1 or 2 and layer, Hz by version.
_RATES = {
    (1, 1): (32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448), (1, 2): (32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384),
    (1, 3): (32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320), (2, 1): (32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256),
    (2, 2): (8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160), (2, 3): (8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
}
_HZ = {3: (44100, 48000, 32000), 2: (22050, 24000, 16000), 0: (11025, 12000, 8000)}


def mpeg_frame(data: bytes, at: int) -> tuple[int, int] | None:
    """(size, bits that all frames of a stream share) of the frame at a place."""
    h = _u(data, at, ">I")
    if h is None or h >> 21 != 0x7FF:
        return None
    version, layer, rate, hz = h >> 19 & 3, 4 - (h >> 17 & 3), h >> 12 & 15, h >> 10 & 3
    if version == 1 or layer == 4 or rate in (0, 15) or hz == 3:
        return None
    bits = _RATES[1 if version == 3 else 2, layer][rate - 1] * 1000
    per = _HZ[version][hz]
    if layer == 1:
        size = (12 * bits // per + (h >> 9 & 1)) * 4
    else:
        size = (72 if layer == 3 and version != 3 else 144) * bits // per + (h >> 9 & 1)
    return size, h & 0xFFFE0C00


def mp3(data: bytes, most: int, least: int = 2) -> int:
    """An ID3 tag, if any, then frames that chain with the same stream bits; a trailing TAG."""
    at = 0
    if data[:3] == b"ID3":
        if len(data) < 10 or not 2 <= data[3] <= 4 or any(b & 0x80 for b in data[6:10]):
            return 0
        at = 10 + (data[6] << 21 | data[7] << 14 | data[8] << 7 | data[9]) + 10 * bool(data[5] & 0x10)
    n, bits = 0, None
    while at < min(most, len(data)) and (f := mpeg_frame(data, at)) and (bits is None or f[1] == bits) and at + f[0] <= most:
        at, bits, n = at + f[0], f[1], n + 1
    _wanted(data, at + 4, most)
    if n < least:
        return 0
    at = min(at, len(data))
    return at + 128 if data[at : at + 3] == b"TAG" and at + 128 <= min(most, len(data)) else at


def riff(data: bytes, most: int) -> int:
    size = _u(data, 4, "<I")
    return min(size + 8, most) if size else 0


def ole2(data: bytes, most: int) -> int:
    """Header, plus the sectors that the allocation tables have room for; 0 if the header doesn't hold."""
    shift, tables = _u(data, 30, "<H"), _u(data, 44, "<I")
    if tables is None or shift not in (9, 12) or not tables:
        return 0
    size = (1 << shift) * (1 + tables * ((1 << shift) // 4))
    return min(size, most)


def exe(data: bytes, most: int) -> int:
    pe = _u(data, 0x3C, "<I")
    if pe is None or data[pe : pe + 4] != b"PE\0\0":
        return 0
    n, optional = _u(data, pe + 6, "<H"), _u(data, pe + 20, "<H")
    if optional is None or not 1 <= n <= 96:
        return 0
    end = 0
    for i in range(n):
        at = pe + 24 + optional + 40 * i
        size, start = _u(data, at + 16, "<I"), _u(data, at + 20, "<I")
        if start is None:
            return 0
        end = max(end, start + size)
    return end if 0 < end <= most else 0


def bmp(data: bytes, most: int) -> int:
    size, zero, start, header = (_u(data, at, "<I") for at in (2, 6, 10, 14))
    if header not in (12, 40, 52, 56, 64, 108, 124) or zero or not 14 + header <= start <= size:
        return 0
    return size if size <= most else 0


def aac(data: bytes, most: int, least: int = 3) -> int:
    at = n = 0
    while at + 7 <= min(most, len(data)) and data[at] == 0xFF and data[at + 1] & 0xF6 == 0xF0 and data[at + 2] >> 2 & 15 < 13:
        size = (data[at + 3] & 3) << 11 | data[at + 4] << 3 | data[at + 5] >> 5
        if size < 7 or at + size > most:
            break
        at, n = at + size, n + 1
    _wanted(data, at + 7, most)
    return min(at, len(data)) if n >= least else 0


def gif(data: bytes, most: int) -> int:
    if len(data) < 13:
        _wanted(data, 13, most)
        return 0
    at = 13 + (3 << (data[10] & 7) + 1 if data[10] & 0x80 else 0)

    def blocks(at: int) -> int:
        while at < len(data) and data[at]:
            at += data[at] + 1
        return at + 1

    while at < min(most, len(data)):
        if data[at] == 0x3B:
            return at + 1
        if data[at] == 0x21:
            at = blocks(at + 2)
        elif data[at] == 0x2C and at + 10 < len(data):
            local = data[at + 9]
            at = blocks(at + 11 + (3 << (local & 7) + 1 if local & 0x80 else 0))
        else:
            _wanted(data, at + 11, most)
            return 0
    _wanted(data, at + 1, most)
    return 0


def tiff(data: bytes, most: int) -> int:
    """The greatest extent of any directory or value."""
    order = {b"II": "<", b"MM": ">"}.get(data[:2])
    if not order or _u(data, 2, order + "H") != 42:
        return 0
    sizes = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4, 10: 8, 11: 4, 12: 8}
    end, seen, todo = 8, set(), [_u(data, 4, order + "I")]
    while todo:
        at = todo.pop()
        if not at or at in seen or len(seen) > 64 or (n := _u(data, at, order + "H")) is None:
            continue
        seen.add(at)
        end = max(end, at + 2 + 12 * n + 4)
        strips: dict[int, list[int]] = {}
        for i in range(n):
            e = at + 2 + 12 * i
            tag, kind, count = _u(data, e, order + "H"), _u(data, e + 2, order + "H"), _u(data, e + 4, order + "I")
            if count is None or kind not in sizes:
                continue
            size = sizes[kind] * count
            place = e + 8 if size <= 4 else _u(data, e + 8, order + "I") or 0
            end = max(end, place + size if size > 4 else 0)
            if tag in (273, 279, 324, 325, 330, 0x8769) and kind in (3, 4) and count <= 65536:
                strips[tag] = [_u(data, place + sizes[kind] * j, order + ("H" if kind == 3 else "I")) or 0 for j in range(count)]
        for a, b in ((273, 279), (324, 325)):
            end = max([end, *(x + y for x, y in zip(strips.get(a, []), strips.get(b, [])))])
        todo += [*strips.get(330, []), *strips.get(0x8769, []), _u(data, at + 2 + 12 * n, order + "I")]
    return end if 8 < end <= most else 0


def ico(data: bytes, most: int) -> int:
    n = _u(data, 4, "<H")
    if not n or n > 256:
        return 0
    end = 0
    for i in range(n):
        size, start = _u(data, 14 + 16 * i, "<I"), _u(data, 18 + 16 * i, "<I")
        if start is None or not size or start < 6 + 16 * n:
            return 0
        end = max(end, start + size)
    return end if end <= most else 0


def djvu(data: bytes, most: int) -> int:
    size = _u(data, 8, ">I")
    return size + 12 if size and size + 12 <= most else 0


def midi(data: bytes, most: int) -> int:
    head, tracks = _u(data, 4, ">I"), _u(data, 10, ">H")
    if head is None or tracks is None or head < 6:
        return 0
    at = 8 + head
    for _ in range(tracks):
        if data[at : at + 4] != b"MTrk" or (size := _u(data, at + 4, ">I")) is None:
            return 0
        at += 8 + size
    return at if tracks and at <= most else 0


DETECTORS: dict[str, Callable[[bytes, int], int]] = {
    "jpg": jpeg, "png": png, "pdf": pdf, "zip": zip_, "mp4": mp4, "heic": mp4, "avif": mp4, "mp3": mp3, "riff": riff, "ole2": ole2, "exe": exe, "bmp": bmp,
    "aac": aac, "gif": gif, "tiff": tiff, "ico": ico, "djvu": djvu, "mid": midi,
}


def size_of(extension: str, data: bytes, most: int | None = None) -> int:
    """By the format's detector, else up to the last footer, else 0: such a match is dropped."""
    most = signatures.largest().get(extension, 0) if most is None else most
    if extension in DETECTORS:
        return DETECTORS[extension](data, most)
    return max((at + len(f) for f in signatures.footers().get(extension, []) if (at := data.rfind(f, 0, most)) >= 0), default=0)


#: Brands and subtypes.
FTYP_BRANDS = {
    **dict.fromkeys(("heic", "heix", "heim", "heis", "hevc", "hevx"), ("heic", "image")), **dict.fromkeys(("mif1", "msf1", "mif2"), ("heif", "image")),
    **dict.fromkeys(("avif", "avis", "avio"), ("avif", "image")), **dict.fromkeys(("M4A ", "M4B "), ("m4a", "audio")),
    **dict.fromkeys(("3gp4", "3gp5", "3gp6", "3g2a", "3g2b"), ("3gp", "video")), "qt  ": ("mov", "video"), "crx ": ("cr3", "image"),
}
RIFF_KINDS = {"WAVE": ("wav", "audio"), "AVI ": ("avi", "video"), "WEBP": ("webp", "image"), "RMID": ("mid", "audio"), "CDDA": ("cda", "audio"), "ACON": ("ani", "image")}
OLE2_STREAMS = {"WordDocument": "doc", "Workbook": "xls", "PowerPoint": "ppt", "Visio": "vsd"}
OFFICE_FOLDERS = {"word": "docx", "xl": "xlsx", "ppt": "pptx"}
MIME_KINDS = {b"epub": "epub", b"opendocument.text": "odt", b"opendocument.spreadsheet": "ods", b"opendocument.presentation": "odp"}


def classify(extension: str, data: bytes) -> tuple[str, str]:
    """(extension, category) of a container by what it holds; itself if that says no more."""
    own = extension, signatures.categories().get(extension, "other")
    if extension in ("mp4", "heic", "avif"):
        return FTYP_BRANDS.get(data[8:12].decode("latin-1"), own)
    if extension == "tiff":
        return ("cr2", "image") if data[8:12] == b"CR\2\0" else own
    if extension == "riff":
        return RIFF_KINDS.get(data[8:12].decode("latin-1"), own)
    if extension == "ole2":
        head = data[:4096]
        if len(head) >= 512:
            for name, kind in OLE2_STREAMS.items():
                if name.encode() in head or name.encode("utf-16-le")[:-1] in head:
                    return kind, "document"
        return own
    if extension == "zip":
        head = data[:16384]
        if len(head) < 30:
            return own
        if b"[Content_Types].xml" in head or b"_rels/" in head:
            for folder, kind in OFFICE_FOLDERS.items():
                if f"{folder}/".encode() in head or f"{folder}\\".encode() in head:
                    return kind, "document"
        for marks, kind in (((b"word/document.xml", b"word/styles.xml"), "docx"), ((b"xl/workbook.xml", b"xl/sharedStrings.xml", b"xl/worksheets/"), "xlsx"), ((b"ppt/presentation.xml", b"ppt/slides/"), "pptx")):
            if any(m in head for m in marks):
                return kind, "document"
        name_size, extra = struct.unpack_from("<HH", head, 26)
        first = head[30 : 30 + name_size]
        if 0 < name_size <= 220:
            if first == b"mimetype":
                mime = head[30 + name_size + extra :][:60]
                for mark, kind in MIME_KINDS.items():
                    if mark in mime:
                        return kind, "document"
            if first in (b"META-INF/", b"META-INF/MANIFEST.MF"):
                return "jar", "archive"
            if first in (b"AndroidManifest.xml", b"classes.dex"):
                return "apk", "archive"
    return own


def _judged(files: DataFrame, answer: Callable[[str, bytes], tuple], fields: str) -> DataFrame:
    """files without payload, with the fields of answer(extension, payload)."""
    kept = [f for f in files.schema.fields if f.name != "payload"]
    names = [f.split()[0] for f in fields.split(", ")]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in kept] + [fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [answer(e or "", p or b"") for e, p in zip(batch.column("extension").to_pylist(), batch.column("payload").to_pylist())]
            columns = [pa.array([g[i] for g in got], pa.int64() if "long" in f else pa.string()) for i, f in enumerate(fields.split(", "))]
            yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in kept), *columns], [*(f.name for f in kept), *names])

    return files.mapInArrow(run, schema)


def sized(files: DataFrame) -> DataFrame:
    """files(extension, payload, ...) with size, by size_of(); payload is left out."""
    return _judged(files, lambda e, p: (size_of(e, p),), "size long")


def classified(files: DataFrame) -> DataFrame:
    """files(extension, payload, ...) with kind and category, by classify(); payload is left out."""
    return _judged(files, classify, "kind string, category string")


#: Bytes from the header on that are looked at in each round; only candidates whose detector wanted more go on to the next.
WINDOWS = (64 * signatures.KB, signatures.MB, 16 * signatures.MB, 128 * signatures.MB, signatures.GB)
_FOUND = "image string, offset long, matched string, extension string, category string, size long, open boolean"


def decide(extension: str, data: bytes, last: bool) -> tuple[str, str, int, bool]:
    """(extension, category, size, open) of a candidate by its first bytes. Open: more bytes may change the answer, and there may
    be more (not last)."""
    head = Head(data)
    most = signatures.largest().get(extension, 0)
    size = size_of(extension, head, most)
    if not last and len(data) < most and (head.short or 0 < size and len(data) < min(size, 16384)):
        return extension, "other", 0, True
    return (*(classify(extension, data[:size]) if size else (extension, "other")), size, False)


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    names = [f.split()[0] for f in _FOUND.split(", ")]
    kinds = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.bool_()]
    columns = list(zip(*rows)) if rows else [[] for _ in names]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names)


def _in_blocks(wide: DataFrame) -> DataFrame:
    """Candidates of wide(image, offset, payload, own), judged by the bytes of their own block: nothing moves."""
    patterns = signatures.headers()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = Automaton(patterns)
        for batch in batches:
            for image, offset, payload, own in zip(*(batch.column(c).to_pylist() for c in ("image", "offset", "payload", "own"))):
                best: dict[int, tuple[int, str]] = {}
                for at, pattern, extension in machine.search(payload):
                    if at < own:  # of matches at one place, the shortest pattern, then by extension
                        best[at] = min(best.get(at, (1 << 30, "")), (len(pattern), extension))
                rows = [(image, offset + at, ext, *decide(ext, payload[at:], False)) for at, (_, ext) in sorted(best.items())]
                yield _rows([r for r in rows if r[5] or r[6]])

    return wide.mapInArrow(run, _FOUND)


def _next_window(candidates: DataFrame, blocks: DataFrame, step: int, window: int) -> DataFrame:
    """Open candidates judged by their first window bytes: only the blocks that these reach are joined."""
    # the window, and a byte more, which tells whether the image goes on
    places = candidates.select("image", "offset", "matched", F.explode(F.sequence(F.floor(F.col("offset") / step), F.floor((F.col("offset") + window) / step))).alias("block"))
    bytes_ = blocks.select("image", F.floor(F.col("offset") / step).alias("block"), "payload")
    first = F.greatest(F.lit(0), F.col("offset") - F.col("block") * step)
    stop = F.least(F.lit(step), F.col("offset") + window + 1 - F.col("block") * step)
    cut = F.substring(F.col("payload"), (first + 1).cast("int"), (stop - first).cast("int"))
    parts = places.join(bytes_, ["image", "block"]).select("image", "offset", "matched", "block", cut.alias("payload"))

    def judge(table: pa.Table) -> pa.Table:
        table = table.sort_by("block")
        data = b"".join(table.column("payload").to_pylist())
        image, offset, matched = (table.column(c)[0].as_py() for c in ("image", "offset", "matched"))
        return pa.Table.from_batches([_rows([(image, offset, matched, *decide(matched, data[:window], len(data) <= window))])])

    return parts.groupBy("image", "offset", "matched").applyInArrow(judge, _FOUND)


def carve(blocks: DataFrame, step: int | None = None, windows: tuple[int, ...] = WINDOWS) -> DataFrame:
    """Files found in blocks(image, offset, payload): matches, one per offset, sized, classified, with a confidence of 0.7 where a
    detector gave the size and 0.55 where a footer did.

    A candidate is first judged within its block; most false ones end there. The others are judged by ever more bytes,
    windows[0], windows[1] ..., joined from the blocks after it, until the detector has seen all that it asked for, or the
    signature's largest size, or the image's end. What still wants more than the last window has the size that it shows.
    All blocks must have one length but the last (step; by default the largest).
    """
    if step is None:
        step = int(blocks.agg(F.max(F.length("payload"))).first()[0] or 1)
    # a pattern may begin at the end of a block: its first bytes of the next one are joined on
    reach = signatures.overlap([p for p, _ in signatures.headers()])
    nxt = blocks.select("image", (F.col("offset") - step).alias("offset"), F.expr(f"substring(payload, 1, {reach})").alias("more"))
    wide = blocks.join(nxt, ["image", "offset"], "left").select("image", "offset", F.expr("concat(payload, coalesce(more, X''))").alias("payload"), F.length("payload").alias("own"))
    now = settle(_in_blocks(wide))
    found = [now.filter("not open")]
    for i, window in enumerate(windows):
        open_ = now.filter("open")
        if open_.isEmpty():
            break
        now = settle(_next_window(open_, blocks, step, window))
        found.append(now if i == len(windows) - 1 else now.filter("not open"))
    sure = F.when(F.col("matched").isin(*DETECTORS), 0.7).otherwise(0.55).alias("confidence")
    return reduce(DataFrame.unionByName, found).filter("size > 0").select("image", "offset", "matched", "extension", "category", "size", sure)


def as_catalogue(carved: DataFrame) -> DataFrame:
    """Carved rows as files; names count up within an extension by image and offset."""
    d = numbered_ranges(carved, ["extension"], ["image", "offset"], "n")
    return as_files(
        d, id=F.concat(F.lit("carve_"), F.col("image"), F.lit("_"), F.col("offset").cast("string")), source=F.lit("carver"), fileName=F.concat(F.col("extension"), F.lit("_"), F.lpad(F.col("n").cast("string"), 5, "0"), F.lit("."), F.col("extension")),
        extension="extension", category="category", size="size", offset="offset", confidence="confidence", isDeleted=F.lit(True),
    )

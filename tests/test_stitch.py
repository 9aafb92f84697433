"""Files cut in pieces, with foreign bytes between them."""

import io
import os
import struct
import zipfile
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from quarry.operators import stitch, validate
from quarry.sources import parsers


def chunk(kind, body):
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def make_png(rows=400, parts=4):
    packed = zlib.compress(b"".join(b"\0" + os.urandom(30) for _ in range(rows)))
    step = -(-len(packed) // parts)
    idat = [chunk(b"IDAT", packed[i : i + step]) for i in range(0, len(packed), step)]
    return [b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 10, rows, 8, 2, 0, 0, 0)), *idat, chunk(b"IEND", b"")]


def make_zip(n=4, data_descriptors=False):
    out = io.BytesIO()

    class Pipe(io.RawIOBase):  # without seeking, sizes stand behind the data
        def writable(self):
            return True

        def write(self, b):
            return out.write(b)

    with zipfile.ZipFile(Pipe() if data_descriptors else out, "w", zipfile.ZIP_DEFLATED) as z:
        for i in range(n):
            z.writestr(f"dir/f{i}.txt", f"text {i} " * 50 + os.urandom(20).hex())
    return out.getvalue()


def test_png_over_gaps():
    parts = make_png()
    whole = b"".join(parts)
    gap = os.urandom(3000) + b"IDAT" + os.urandom(100)
    data = parts[0] + parts[1] + gap + b"".join(parts[2:4]) + gap + b"".join(parts[4:]) + b"\x11" * 500
    assert stitch.png(data) == (whole, 2, True) and validate.png(whole)[:2] == (True, 1.0)
    assert stitch.png(whole) == (whole, 0, True)
    assert stitch.png(data, window=100) == (parts[0] + parts[1], 1, False)
    assert stitch.png(b"no") == (b"", 0, False)


@pytest.mark.parametrize("late", [False, True])
def test_zip_from_its_headers(late):
    data = make_zip(5, late)
    names = zipfile.ZipFile(io.BytesIO(data)).namelist()
    texts = {n: zipfile.ZipFile(io.BytesIO(data)).read(n) for n in names}
    cut = data[: data.index(b"PK\1\2")]
    got, breaks, whole = stitch.zip_(cut)
    z = zipfile.ZipFile(io.BytesIO(got))
    assert z.testzip() is None and {n: z.read(n) for n in z.namelist()} == texts and whole and not breaks
    again = zipfile.ZipFile(io.BytesIO(stitch.zip_(data)[0]))
    assert {n: again.read(n) for n in again.namelist()} == texts
    broken = bytearray(data)
    at = data.index(b"PK\3\4", 40)
    broken[at + 60 : at + 70] = b"\xff" * 10
    got, lost, whole = stitch.zip_(bytes(broken))
    assert lost == 1 and not whole and zipfile.ZipFile(io.BytesIO(got)).namelist() == [names[0], *names[2:]]


def test_mp4_over_gaps(spark):
    atom = lambda kind, n: struct.pack(">I", 8 + n) + kind + b"\x5a" * n
    head, movie, data = atom(b"ftyp", 16), atom(b"moov", 1000), atom(b"mdat", 5000)
    gap = b"\x99" * (2048 - len(head) - len(movie))
    assert stitch.mp4(head + movie + data) == (head + movie + data, 0, True)
    assert stitch.mp4(head + movie + gap + data + b"\x11" * 600) == (head + movie + data, 1, True)
    assert stitch.mp4(head + movie + gap) == (head + movie, 0, False)
    rows = [("mp4", bytearray(head + movie + data)), ("png", bytearray(b"".join(make_png()))), ("txt", bytearray(b"abc")), ("zip", None)]
    got = [(r.extension, r.payload is not None, r.whole) for r in stitch.stitched(spark.createDataFrame(rows, "extension string, payload binary")).collect()]
    assert got == [("mp4", True, True), ("png", True, True), ("txt", False, False), ("zip", False, False)]


@settings(max_examples=150, deadline=None)
@given(st.sampled_from(sorted(stitch.STITCHERS)), st.binary(max_size=300))
def test_nothing_raises(extension, data):
    for head in (b"", b"\x89PNG\r\n\x1a\n", b"PK\3\4", b"\0\0\0\x10ftyp", b"PK\5\6"):
        stitch.stitch(extension, head + data)


def test_plist_both_ways():
    value = {"a": [1, 2.5, "x"], "b": {"c": b"\0\1"}}
    assert parsers.plist(parsers.plist_bytes(value)) == value and parsers.plist_bytes({1: object()}) is None

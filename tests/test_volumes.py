"""Volumes, records and their union, on made-up sectors."""

import struct
import uuid
import zlib

from pyspark.sql import functions as F

from quarry.sources import volumes

BLOCKS = "image string, offset long, payload binary"


def boot(kind, start, sectors):
    b = bytearray(512)
    b[446:462] = struct.pack("<B3sB3sII", 0x80, b"", kind, b"", start, sectors)
    b[510:] = b"\x55\xaa"
    return b


def test_partitions(spark):
    own = uuid.uuid4()
    head = bytearray(struct.pack("<8sIIIIQQQQ16sQIII", b"EFI PART", 0x10000, 92, 0, 0, 1, 99, 34, 90, own.bytes_le, 2, 4, 128, 0))
    struct.pack_into("<I", head, 16, zlib.crc32(bytes(head)))
    entry = own.bytes_le * 2 + struct.pack("<QQQ", 8, 15, 0) + bytes(72)
    ntfs = bytearray(b"\xeb\x52\x90NTFS    ").ljust(512, b"\0")
    rows = [("a", 0, boot(7, 4, 10)), ("g", 0, boot(0xEE, 1, 99)), ("g", 512, head.ljust(512, b"\0")), ("g", 1024, bytearray(entry).ljust(512, b"\0")), ("a", 2048, ntfs), ("a", 4096, ntfs)]
    d = spark.createDataFrame(rows, BLOCKS)
    got = sorted((r.image, r.start, r.sectors, r.strategy) for r in volumes.partitions(d, brute_force=True).collect())
    assert got == [("a", 2048, 10, 0), ("a", 4096, 0, 2), ("g", 4096, 8, 1)]
    assert {(r.image, r.offset, r.kind) for r in volumes.volume_kinds(d).collect()} == {("a", 2048, "ntfs"), ("a", 4096, "ntfs")}


def record(number, parent, name, used=1, size=3):
    text = name.encode("utf-16-le")
    names = struct.pack("<Q", parent) + bytes(56) + bytes([len(name), 1]) + text
    attributes = b""
    for kind, body in ((0x30, names), (0x80, b"x" * size)):
        total = -(-(24 + len(body)) // 8) * 8
        attributes += (struct.pack("<IIBBHHHIHH", kind, total, 0, 0, 0, 0, 0, len(body), 24, 0) + body).ljust(total, b"\0")
    b = bytearray(1024)
    struct.pack_into("<4sHHQHHHHIIQHHI", b, 0, b"FILE", 48, 3, 0, 1, 1, 56, used, 0, 1024, 0, 0, 0, number)
    b[56 : 56 + len(attributes)] = attributes
    struct.pack_into("<I", b, 56 + len(attributes), 0xFFFFFFFF)
    b[48:50] = b"\x01\x00"
    for i in (1, 2):
        b[48 + 2 * i : 50 + 2 * i] = b[512 * i - 2 : 512 * i]
        b[512 * i - 2 : 512 * i] = b"\x01\x00"
    return b


def test_files_of_records(spark):
    rows = [("d", 0, record(30, 5, "docs", 3)), ("d", 1024, record(31, 30, "a.TXT", 0)), ("d", 2048, record(32, 77, "lost.bin")), ("d", 3072, bytearray(1024)), ("d", 4096, record(2, 5, "$System"))]
    got = volumes.mft_files(volumes.mft_records(spark.createDataFrame(rows, BLOCKS))).collect()
    assert {(r.fileName, r.extension, r.originalPath, r.isDeleted, r["size"]) for r in got} == {("a.TXT", "txt", "docs/a.TXT", True, 3), ("lost.bin", "bin", "lost.bin", False, 3)}


def test_scan_leaves_out_what_fails(spark):
    def broken():
        raise OSError("no such image")

    one = spark.createDataFrame([("1", "x")], "id string, fileName string").withColumn("source", F.lit("s"))
    out = volumes.scan({"one": lambda: one, "broken": broken})
    assert [(r.id, r.source, r.sha256) for r in out.collect()] == [("1", "s", None)]


def test_counters(spark):
    log = spark.createDataFrame([("r", i, s) for i, s in enumerate([1, 2, 1, 3, 4, 5, 1, 5])], "reader string, seq int, sector int")
    assert [tuple(r) for r in volumes.cache_counters(log, 3).collect()] == [("r", 2, 6, 6, 3)]
    # a sector stays as long as fewer than capacity others were used since, however often
    log = spark.createDataFrame([("r", i, s) for i, s in enumerate([1, 2, 2, 2, 2, 1, 3, 4, 1, 2])], "reader string, seq int, sector int")
    assert [tuple(r) for r in volumes.cache_counters(log, 3).collect()] == [("r", 5, 5, 5, 2)]

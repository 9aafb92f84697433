"""Matcher, carving, validation, parsers, arrays and sinks on small made-up bytes."""

import datetime as dt
import io
import itertools
import os
import random
import struct
import tarfile
import uuid
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quarry.operators import carving, dedup, joins, matching, raid, validate
from quarry.schema import as_files
from quarry.sources import blocks, parsers, signatures, sinks


def make_png(pixels=b"\0\1\2\3" * 20):
    def chunk(kind, body):
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))

    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", b"\0" * 13) + chunk(b"IDAT", zlib.compress(pixels)) + chunk(b"IEND", b"")


JPEG = b"\xff\xd8\xff\xe0\0\x10JFIF" + b"\0" * 10 + b"\xff\xdb\0\4ab\xff\xc0\0\4cd\xff\xc4\0\4ef\xff\xda\0\4gh" + b"\1\xff\0\2" * 300 + b"\xff\xd9"
PDF = b"%PDF-1.4\n1 0 obj\n<<>>\nendobj\nxref\n0 1\nstartxref\n30\n%%EOF\n"


def make_zip():
    import zipfile

    b = io.BytesIO()
    with zipfile.ZipFile(b, "w") as z:
        z.writestr("[Content_Types].xml", "x")
        z.writestr("word/document.xml", "y" * 50)
    return b.getvalue()


def plain_matches(data, patterns):
    return sorted((i, p, n) for p, n in patterns if p for i in range(len(data)) if data.startswith(p, i))


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=200), st.lists(st.binary(min_size=0, max_size=4), max_size=6, unique=True))
def test_automaton_equals_a_loop(data, patterns):
    named = [(p, p.hex() or "empty") for p in patterns]
    assert sorted(matching.Automaton(named).search(data)) == plain_matches(data, named)


@pytest.mark.parametrize("size", [1, 3, 7, 64])
def test_matches_do_not_depend_on_the_blocks(spark, size):
    data = random.Random(size).randbytes(300).replace(b"\7", b"abcab")
    patterns = [(b"abc", "x"), (b"bca", "y"), (b"abcab", "z"), (b"\0", "w")]
    over = max(len(p) for p, _ in patterns) - 1
    rows = [("i", a, bytearray(data[a : a + size + over]), size) for a in range(0, len(data), size)]
    d = spark.createDataFrame(rows, "image string, offset long, payload binary, own int")
    got = sorted((r.offset, bytes(r.pattern), r.extension) for r in matching.matches(d, patterns, own="own").collect())
    assert got == plain_matches(data, patterns)


def test_catalogue(spark):
    assert len(signatures.SIGNATURES) == 46 and sum(len(h.split()) for _, _, h, _, _ in signatures.SIGNATURES) == 76
    assert signatures.table(spark).filter("size(headers) = 0").count() == 1


@pytest.mark.parametrize("ext, data", [("jpg", JPEG), ("png", make_png()), ("pdf", PDF), ("zip", make_zip()), ("gif", b"GIF89a\1\0\1\0\0\0\0,\0\0\0\0\1\0\1\0\0\2\2ab\0;"), ("riff", b"RIFF\x0c\0\0\0WAVEabcdefgh"), ("mid", b"MThd\0\0\0\6\0\0\0\1\0\1MTrk\0\0\0\2ab")])
def test_sizes(ext, data):
    assert carving.size_of(ext, data + b"\x11" * 50) == len(data)
    assert carving.size_of(ext, data[: len(data) // 2]) in (0, len(data) // 2) or ext in ("riff", "mid")


def test_mp3_frames():
    frame = b"\xff\xfb\x90\x64" + b"\0" * 413
    assert carving.mpeg_frame(frame, 0)[0] == 417
    assert carving.mp3(frame * 5 + b"junk", 10**6) == 417 * 5
    assert carving.mp3(frame + b"junk" * 50, 10**6) == 0 and carving.mp3(b"\xff" * 2000, 10**6) == 0


def test_classify():
    assert carving.classify("zip", make_zip()) == ("docx", "document")
    assert carving.classify("riff", b"RIFF\0\0\0\0WEBP") == ("webp", "image")
    assert carving.classify("mp4", b"\0\0\0\x18ftypheic") == ("heic", "image")
    assert carving.classify("ole2", b"\xd0\xcf" + b"\0" * 600 + "Workbook".encode("utf-16-le")) == ("xls", "document")


@settings(max_examples=150, deadline=None)
@given(st.sampled_from(sorted(carving.DETECTORS)), st.binary(max_size=400))
def test_nothing_raises(ext, data):
    head = {e: h for h, e in reversed(signatures.headers(()))}.get(ext, b"")
    for d in (data, head + data):
        assert carving.size_of(ext, d) >= 0
        carving.classify(ext, d)
        validate.validate(ext, d)
        validate.fragment(ext, d, 16)
    for parse in (parsers.mbr, parsers.gpt_header, parsers.ntfs_boot, parsers.mft_record, parsers.data_runs, parsers.usn_records, parsers.fat_boot, parsers.fat_directory, parsers.ext_superblock, parsers.ext_extents, parsers.lznt1, parsers.lz4_block, parsers.plist, parsers.android_header, parsers.mdadm_member, parsers.volume_kind):
        parse(data)


def test_carve(spark):
    image = b"\x11" * 700 + make_png() + b"\x22" * 333 + JPEG + b"\x33" * 500 + PDF + b"\x11" * 100
    for step in (256, 1000, len(image)):
        rows = [("disk", a, bytearray(image[a : a + step])) for a in range(0, len(image), step)]
        got = carving.carve(spark.createDataFrame(rows, "image string, offset long, payload binary"), step=step, windows=(512, 2048, 1 << 16))
        found = {(r.offset, r.extension, r["size"]) for r in got.collect()}
        assert {(700, "png", len(make_png())), (image.index(JPEG), "jpg", len(JPEG)), (image.index(PDF), "pdf", len(PDF))} <= found
    files = carving.as_catalogue(got)
    assert files.columns == as_files(files).columns and files.filter("source = 'carver'").count() == len(found)


def big_png(n):
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", b"\0" * 13) + chunk(b"IDAT", b"\x5a" * n) + chunk(b"IEND", b"")


def test_carve_files_of_many_blocks(spark):
    """Files above every window but the last, and a large one of which only the atoms' headers count."""
    pngs = [big_png(n) for n in (1 << 20, 6 << 20)]
    atoms = b"\0\0\0\x18ftypisom\0\0\0\0isomiso2" + struct.pack(">I", 8 + (5 << 20)) + b"mdat" + b"\x5a" * (5 << 20) + b"\0\0\0\x08moov"
    image = b"\x11" * 1000 + pngs[0] + b"\x11" * 77 + pngs[1] + b"\x11" * 1234 + atoms + b"\x11" * 5000
    rows = [("disk", a, bytearray(image[a : a + (1 << 18)])) for a in range(0, len(image), 1 << 18)]
    got = carving.carve(spark.createDataFrame(rows, "image string, offset long, payload binary"))
    assert {(r.offset, r.extension, r["size"]) for r in got.collect()} == {(1000, "png", len(pngs[0])), (1077 + len(pngs[0]), "png", len(pngs[1])), (image.index(atoms), "mp4", len(atoms))}


@pytest.mark.parametrize("ext, data", [("jpg", JPEG), ("png", make_png()), ("gif", b"GIF89a\1\0\1\0\0\0\0,\0\0\0\0\1\0\1\0\0\2\2ab\0;"), ("mid", b"MThd\0\0\0\6\0\0\0\1\0\1MTrk\0\0\0\2ab"), ("mp3", (b"\xff\xfb\x90\x64" + b"\0" * 413) * 4)])
def test_decided_only_with_enough_bytes(ext, data):
    """Whatever a prefix decides, the whole file says too; and noise is rejected by its first bytes."""
    rest = b"\x11" * 40_000
    want = carving.decide(ext, data + rest, True)
    assert want[2] == len(data)
    for n in range(1, len(data) + 3):
        got = carving.decide(ext, (data + rest)[:n], False)
        assert got[3] or got == want
    assert carving.decide("bmp", b"BM" + b"\x01" * 60, False) == ("bmp", "other", 0, False)


def test_scores():
    assert validate.validate("jpg", JPEG)[0] and validate.validate("png", make_png())[:2] == (True, 1.0)
    assert validate.validate("pdf", PDF)[0] and validate.validate("docx", make_zip())[0]
    broken = bytearray(make_png())
    broken[20] ^= 0xFF
    assert validate.validate("png", bytes(broken))[:2] == (True, 0.7) and validate.validate("png", big_png(200))[:2] == (False, 0.0) and not validate.validate("png", make_png()[:20])[0]
    assert validate.validate("mp4", b"\0\0\0\x10ftypisom\0\0\0\0")[:2] == (False, 0.2)
    assert validate.validate("dat", bytes(100))[:2] == (False, 0.0)
    assert validate.magic_holds("ntfs", "", b"") and not validate.magic_holds("carver", "", b"") and not validate.magic_holds("carver", "png", b"abc")


def test_scores_reject_foreign_bytes():
    big = b"\xff\xd8\xff\xe0\0\4ab\xff\xda\0\4ab" + b"\x11\xff\x00\xff\xd0" * 400 + b"\xff\xd9"
    assert validate.validate("jpg", big)[:2] == (True, 1.0) and validate.validate("jpg", big[:-2])[:2] == (False, 0.0)
    assert validate.validate("jpg", big.replace(b"\xff\xd0", b"\xff\xc4"))[:2] == (False, 0.0)
    assert validate.validate("jpg", b"\xff\xd8" + b"\0" * 98)[:2] == (False, 0.0)
    assert validate.validate("jpeg", big, True)[:2] == (True, 1.0)
    assert validate.stream_health(b"\xff\xd8" + b"\0" * 40 + b"\xff\xd9") == 0.3
    assert validate.validate("png", b"XX" + make_png())[1] == 0 and validate.validate("mp4", b"\0" * 64)[1] == 0 and validate.validate("bmp", b"XX" + b"\0" * 60)[1] == 0
    assert validate.validate("bmp", b"BM" + struct.pack("<IIII", 60, 0, 54, 40) + b"\0" * 42)[:2] == (True, 1.0)
    mp4 = b"\0\0\0\x10ftypmp42\0\0\0\0" + b"\0\0\0\x0amoovab" + b"\0\0\0\x0cmdatabcd"
    assert validate.validate("mp4", mp4)[:2] == (True, 1.0) and validate.validate("mp4", mp4 + b"\0\0\0\x01")[:2] == (True, 1.0) and validate.validate("mp4", mp4[:-1])[1] == 0.95
    assert validate.validate("dat", b"ab" * 3000)[1] == 0.5 and validate.validate("dat", os.urandom(5000))[1] == 0.6 and validate.validate("dat", b"a" * 9)[1] == 0.2


def test_paranoid_fragments():
    even = bytes(range(256)) * 1024
    assert validate.fragment_paranoid("png", even) == 0 and validate.fragment_paranoid("png", even[: len(even) // 2] + b"%PDF-" + even[len(even) // 2 + 5 :]) == 0.85
    assert validate.fragment_paranoid("txt", bytes(130_000) + even) == 0.6 and validate.fragment_paranoid("jpg", JPEG * 5000) == 0.9
    atom = b"\0\1\0\0ftyp" + bytes(65528)
    assert validate.fragment_paranoid("mp4", atom + b"\0\0\0\4mdat" + bytes(9)) == 0.8 and validate.fragment_paranoid("mp4", atom + b"\0\0\1\0\1\2\3\4" + bytes(9)) == 0.75


def test_repair():
    assert validate.repair_jpeg(b"xx" + JPEG + b"tail")[0] == JPEG
    assert validate.repair_jpeg(JPEG[:-2])[0].endswith(b"\xff\xd9") and validate.repair_jpeg(b"no") == (b"", "no start marker")


def test_fragment_and_entropy():
    assert validate.fragment("jpg", JPEG * 200, 4096) and not validate.fragment("txt", JPEG * 200, 4096) and not validate.fragment("jpg", JPEG, 1 << 16)
    assert validate.entropy_jump(bytes(150_000) + os.urandom(250_000)) and not validate.entropy_jump(os.urandom(300_000))
    assert validate.entropy(bytes(range(256))) == 8.0


def test_image_source(spark, tmp_path):
    data = os.urandom(10_000)
    (tmp_path / "a.img").write_bytes(data)
    d = blocks.image_blocks(spark, [str(tmp_path / "a.img")], block_size=1024, overlap=16)
    rows = sorted(d.collect(), key=lambda r: r.offset)
    assert b"".join(bytes(r.payload)[: r.own] for r in rows) == data
    assert all(len(r.payload) == min(1040, len(data) - r.offset) for r in rows)
    assert blocks.bad_ranges(d).collect() == [] and not blocks.too_bad(d).first().abort


def test_resilient_read():
    bad = {(1024, 1536), (2048, 8192)}

    def read(offset, length):
        if any(a < offset + length and offset < b for a, b in bad):
            raise OSError("bad sector")
        return b"x" * min(length, max(0, 16_384 - offset))

    data, failed = blocks.read_resilient(read, 0, 16_384)
    assert len(data) == 16_384 and failed[0] == (1024, 512) and data[:1024] == b"x" * 1024 and failed[1][0] == 2048 and sum(failed[1]) >= 8192


def test_partition_tables():
    sector = bytearray(512)
    sector[446:462] = struct.pack("<B3sB3sII", 0x80, b"", 7, b"", 2048, 4096)
    sector[510:] = b"\x55\xaa"
    assert parsers.mbr(bytes(sector)) == [{"type": 7, "boot": True, "start": 2048, "sectors": 4096}]
    kind, own = uuid.uuid4(), uuid.uuid4()
    entry = kind.bytes_le + own.bytes_le + struct.pack("<QQQ", 34, 99, 0) + "data".encode("utf-16-le").ljust(72, b"\0")
    head = bytearray(struct.pack("<8sIIIIQQQQ16sQIII", b"EFI PART", 0x10000, 92, 0, 0, 1, 99, 34, 90, own.bytes_le, 2, 1, 128, 0))
    struct.pack_into("<I", head, 16, zlib.crc32(bytes(head)))
    assert parsers.gpt_header(bytes(head).ljust(512, b"\0"))["count"] == 1
    head[24] ^= 1
    assert parsers.gpt_header(bytes(head).ljust(512, b"\0")) is None
    assert parsers.gpt_entries(entry, 1, 128) == [{"type": str(kind).upper(), "id": str(own).upper(), "start": 34, "end": 99, "name": "data"}]


def test_ntfs_structures():
    assert parsers.data_runs(b"\x21\x18\x34\x56\x11\x30\xf0\x01\x40\x00") == [(0x5634, 24), (0x5624, 48), (None, 64)]
    assert parsers.filetime(116_444_736_000_000_000 + 10**7) == dt.datetime(1970, 1, 1, 0, 0, 1)
    name = "é.txt".encode("utf-16-le")
    record = struct.pack("<IHHQQQQIIQHH", 60 + 12, 2, 0, 5 | 7 << 48, 9, 40, 0, 0x200, 0, 0, len(name), 60) + name
    got = parsers.usn_records(bytes(16) + record.ljust(72, b"\0"))
    assert len(got) == 1 and got[0]["file"] == 5 and got[0]["name"] == "é.txt" and got[0]["reason"] == 0x200


def test_fat_chain():
    table = struct.pack("<8H", 0xFFF8, 0xFFFF, 3, 5, 0, 2, 0xFFF7, 6)
    assert parsers.fat_chain(table, 16, 2, 6) == [2, 3, 5] and parsers.fat_chain(table, 16, 6, 6) == [6] and parsers.fat_chain(table, 16, 9, 6) == []


def test_decompress():
    assert parsers.lznt1(struct.pack("<H", 2) + b"abc" + b"\0\0") == b"abc"
    assert parsers.lznt1(struct.pack("<H", 0xB000 | 6 - 1) + b"\x08abc" + struct.pack("<H", (3 - 1) << 12 | 6 - 3)) == b"abcabcabc"
    assert parsers.lz4_block(b"\x35abc\x03\0") == b"abc" + b"abc" * 3


def test_backup_sources(spark):
    b = io.BytesIO()
    with tarfile.open(fileobj=b, mode="w") as t:
        for name in ("apps/x/_manifest", "apps/x/f/a.txt", "shared/0/p.jpg"):
            info = tarfile.TarInfo(name)
            info.size = 3
            t.addfile(info, io.BytesIO(b"abc"))
    data = b"ANDROID BACKUP\n5\n1\nnone\n" + zlib.compress(b.getvalue())
    assert [f["name"] for f in parsers.android_files(data)] == ["apps/x/f/a.txt", "shared/0/p.jpg"]
    d = spark.createDataFrame([("i", 0, bytearray(data))], "image string, offset long, payload binary")
    assert parsers.parsed(d, parsers.android_files, "name string, size long, app string").count() == 2
    text = "Contents of shadow copy set ID: {a}\n   Contained 1 shadow copies at creation time: 1/2/2024\n      Shadow Copy ID: {b}\n         Original Volume: (C:)\n         Shadow Copy Volume: \\\\?\\x\n"
    assert parsers.shadows(text) == [{"id": "{b}", "volume": "(C:)", "device": "\\\\?\\x", "created": "1/2/2024"}]


# ---- arrays


def test_parity_rebuilds_any_loss():
    rng = np.random.default_rng(1)
    data = [rng.integers(0, 256, 40, dtype=np.uint8) for _ in range(6)]
    parities = [raid.parity(data, k) for k in range(3)]
    for n in (1, 2, 3):
        for gone in itertools.combinations(range(6), n):
            got = raid.rebuild([None if i in gone else c for i, c in enumerate(data)], parities)
            assert all((a == b).all() for a, b in zip(got, data))
    with pytest.raises(ValueError):
        raid.rebuild([None, None, *data[2:]], parities[:1])


@pytest.mark.parametrize("level, members", [(0, 3), (1, 2), (10, 4), (5, 4), (6, 5)])
def test_striped_reads(spark, level, members):
    rng = np.random.default_rng(level)
    n = {0: members, 1: 1, 10: members // 2, 5: members - 1, 6: members - 2}[level]
    rows_, payloads, out = 6, [], []
    for row in range(rows_):
        data = [rng.integers(0, 256, 16, dtype=np.uint8) for _ in range(n)]
        payloads += [d.tobytes() for d in data]
        disks = {}
        if level == 0:
            disks = dict(enumerate(data))
        elif level == 1:
            disks = {d: data[0] for d in range(members)}
        elif level == 10:
            disks = {2 * i + m: c for i, c in enumerate(data) for m in (0, 1)}
        else:
            p = members - 1 - row % members
            order = [d for d in range(members) if d != p] if level == 5 else [((p + 1) % members + 1 + i) % members for i in range(n)]
            disks = dict(zip(order, data)) | {p: raid.parity(data, 0)} | ({(p + 1) % members: raid.parity(data, 1)} if level == 6 else {})
        out += [(d, row, bytearray(c.tobytes())) for d, c in disks.items()]
    schema = "disk long, row long, payload binary"
    got = {r.stripe: r.payload for r in raid.read_striped(spark.createDataFrame(out, schema), level, members, len(payloads)).collect()}
    assert [bytes(got[i]) for i in range(len(payloads))] == payloads
    if level in (5, 6):
        lost = [o for o in out if o[0] not in ((1,) if level == 5 else (0, 2))]
        whole = {(r.row, r.disk): bytes(r.payload) for r in raid.rebuild_rows(spark.createDataFrame(lost, schema), level, members, 16).collect()}
        assert all(whole[row, d] == bytes(c) for d, row, c in out if (row, d) in whole) and len(whole) == rows_ * n
    if level in (1, 10):
        half = [o for o in out if o[0] != 0]
        got = {r.stripe: r.payload for r in raid.read_striped(spark.createDataFrame(half, schema), level, members, len(payloads)).collect()}
        assert [bytes(got[i]) for i in range(len(payloads))] == payloads


# ---- duplicates and joins


def test_greedy_groups(spark):
    rows = [(0, -1), (1, -2), (2, 0), (3, 0b111111), (4, 0b111), (5, 1 << 40)]
    got = {r.id: r.leader for r in dedup.greedy_groups(spark.createDataFrame(rows, "id long, h long"), "id", "h", 5).collect()}
    # 2 leads 4 and 5, whose distance to 2 is small; 3 is six bits from 2 and alone, since 4 is taken
    assert got == {0: 0, 1: 0, 2: 2, 4: 2, 5: 2}


def test_hamming_pairs_equal_a_loop(spark):
    rng = random.Random(2)
    base = [rng.getrandbits(63) for _ in range(20)]
    h = [b ^ sum(1 << rng.randrange(63) for _ in range(rng.randint(0, 4))) & (1 << 63) - 1 for b in base for _ in range(4)]
    d = spark.createDataFrame([(i, x) for i, x in enumerate(h)], "id long, h long")
    want = sorted((i, j, (h[i] ^ h[j]).bit_count()) for i, j in itertools.combinations(range(len(h)), 2) if (h[i] ^ h[j]).bit_count() <= 5)
    assert sorted(map(tuple, dedup.hamming_pairs(d, "id", "h", 5).collect())) == want


def test_average_hash(spark):
    half = (b"\0" * 24 + b"\xff" * 24) * 16
    d = spark.createDataFrame([(1, 16, 16, bytearray(half)), (2, 0, 0, None)], "id long, width int, height int, rgb binary")
    got = {r.id: r.hash for r in dedup.average_hash(d, "id").collect()}
    assert got[1] & 0xFF == 0xF0 and got[2] is None


def test_paths(spark):
    rows = [(10, 5, "a"), (11, 10, "b"), (12, 11, "c"), (20, 20, "self"), (21, 99, "orphan"), (30, 31, "x"), (31, 30, "y")] + [(100 + i, 99 + i if i else 5, f"d{i}") for i in range(101)]
    e = spark.createDataFrame(rows, "child long, parent long, name string")
    got = {r.child: r.path for r in joins.rebuild_paths(e, 5, 100).collect()}
    assert got[12] == "a/b/c" and got[20] == "self" and got[21] == "orphan" and got[30] == "x" and got[31] == "y"
    assert got[199].count("/") == 99 and got[200] == "d100"
    assert {r.child for r in joins.rebuild_paths(e, 5, 100, top_down=True).collect()} == {10, 11, 12, *range(100, 200)}


def test_ranges_are_half_open(spark):
    c = spark.createDataFrame([(0, 10, 100), (10, 5, 500), (40, 100, 0)], "start long, len long, phys long")
    p = spark.createDataFrame([(x,) for x in (0, 9, 10, 14, 15, 39, 40, 139, 140)], "logical long")
    got = {r.logical: r.physical for r in joins.to_physical(p, c).collect()}
    assert got == {0: 100, 9: 109, 10: 500, 14: 504, 40: 0, 139: 99}


def test_members(spark):
    b = spark.createDataFrame([("u", 1, "b"), ("u", 0, "a"), ("v", 2, "c"), ("v", 2, "d")], "uuid string, role int, path string")
    got = {r.uuid: r for r in joins.array_members(b).collect()}
    assert [m.path for m in got["u"].members] == ["a", "b"] and not got["u"].degraded and got["v"].degraded and got["v"].conflict


# ---- sinks


def test_sinks(spark, tmp_path):
    files = as_files(
        spark.createDataFrame([("1", "a.txt", 10, "x/a.txt"), ("2", "b.txt", 0, "")], "id string, fileName string, size long, originalPath string"),
        id="id", fileName="fileName", size="size", originalPath="originalPath", source=F.lit("ntfs"), offset=F.lit(0), isDeleted=F.lit(True), confidence=F.lit(0.9),
    )
    records = spark.createDataFrame([("1", "success"), ("3", "skipped")], "fileId string, state string").withColumn("message", F.lit("Duplicate"))
    sinks.csv_report(records, str(tmp_path / "csv"))
    text = next((tmp_path / "csv").glob("*.csv")).read_text(encoding="utf-8")
    assert text.startswith(sinks.BOM + "fileId,state") and text.count("\n") == 3
    with pytest.raises(ValueError):
        sinks.csv_report(records.limit(0), str(tmp_path / "none"))
    assert sinks.manifest(records, files).count() == 2
    s = sinks.manifest_summary(records, files).first()
    assert (s.total, s.success, s.skipped, s.duplicates) == (2, 1, 1, 1)
    sinks.dfxml(files, str(tmp_path / "xml"))
    text = "".join(p.read_text() for p in (tmp_path / "xml").glob("part-*"))
    assert text.count("<fileobject>") == 2 and 'len="10"' in text and text.count("byte_run ") == 1
    rows = sinks.custody(spark.createDataFrame([("a", bytearray(b"1"), 1), ("b", bytearray(b"2"), 1)], "path string, payload binary, size long"))
    one = sinks.custody_digest(rows).first().digest
    assert one == sinks.custody_digest(rows.repartition(3)).first().digest
    changed = rows.withColumn("sha256", F.when(F.col("path") == "a", "0").otherwise(F.col("sha256"))).filter("path <> 'b'")
    assert sorted(map(tuple, sinks.custody_mismatches(rows, changed).collect())) == [("a", "hash"), ("b", "missing")]
    out = sinks.write_payloads(spark.createDataFrame([("d/f.bin", bytearray(b"abc")), ("../../out", bytearray(b"x"))], "path string, payload binary"), str(tmp_path / "files"))
    assert sorted((r.path, r.ok) for r in out.collect()) == [("../../out", False), ("d/f.bin", True)] and (tmp_path / "files/d/f.bin").read_bytes() == b"abc"


def test_assemble(spark):
    e = spark.createDataFrame([("f", 0, 2, 2, False, 14), ("f", 1, 0, 1, True, 14), ("f", 2, 7, 1, False, 14)], "file_id string, seq int, cluster_offset long, cluster_count long, sparse boolean, size long")
    b = spark.createDataFrame([(2, bytearray(b"abcd")), (3, bytearray(b"efgh")), (7, bytearray(b"ijkl"))], "cluster long, payload binary")
    assert bytes(sinks.assemble(e, b, 4).first().payload) == b"abcdefgh\0\0\0\0ij"

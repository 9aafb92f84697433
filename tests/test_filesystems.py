"""File systems on images made here, byte by byte."""

import plistlib
import sqlite3
import struct

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from quarry.schema import BLOCKS
from quarry.sources import filesystems as fs

START = 4096  # of the volume in the image


def image_rows(spark, image, step):
    return spark.createDataFrame([("d", a, bytearray(image[a : a + step])) for a in range(0, len(image), step)], BLOCKS)


def volume(spark, data, step=1000):
    """Blocks whose length fits nothing, and the volume's place."""
    return image_rows(spark, b"\x33" * START + data, step), spark.createDataFrame([("d", START)], "image string, start long"), step


def put(b, at, data):
    b[at : at + len(data)] = data


def paths(rows):
    return {r.path: r for r in rows}


def test_read_ranges(spark):
    data = bytes(range(256)) * 20
    want = [(0, 1), (5, 3000), (999, 2), (1000, 1000), (4000, 1120), (3, 4)]
    got = fs.read_ranges(image_rows(spark, data, 1000), spark.createDataFrame([("d", a, n) for a, n in want], "image string, at long, size long"), 1000)
    assert {(r["at"], r["size"]): bytes(r.payload) for r in got.collect()} == {(a, n): data[a : a + n] for a, n in want}


def entry(name, first, size, attributes=0, deleted=False):
    base, _, ext = name.partition(".")
    e = struct.pack("<8s3sBBBHHHHHHHI", base.upper().ljust(8).encode(), ext.upper().ljust(3).encode(), attributes, 0, 0, 0, 0, 0, first >> 16, 0x6000, 0x5821, first & 0xFFFF, size)
    return b"\xe5" + e[1:] if deleted else e


def fat_volume(bits):
    """One sector a cluster; the directory SUB goes over two clusters that aren't neighbours."""
    clusters = {12: 100, 16: 5000}[bits]
    fat_sectors = -(-(clusters + 2) * bits // 8 // 512)
    b = bytearray(512 * (1 + fat_sectors + 1 + clusters))
    put(b, 11, struct.pack("<HBHBHHBH", 512, 1, 1, 1, 16, 1 + fat_sectors + 1 + clusters if clusters < 60000 else 0, 0xF8, fat_sectors))
    b[510:512] = b"\x55\xaa"
    table = {2: 5, 5: 0xFFFF, 3: 0xFFFF, 7: 0xFFFF}
    for c, n in table.items():
        if bits == 16:
            put(b, 512 + 2 * c, struct.pack("<H", n))
        else:
            at, v = 512 + c * 3 // 2, n & 0xFFF
            old = struct.unpack_from("<H", b, at)[0]
            put(b, at, struct.pack("<H", old & 0x000F | v << 4 if c & 1 else old & 0xF000 | v))
    root, data = 512 * (1 + fat_sectors), 512 * (2 + fat_sectors)
    place = lambda c: data + 512 * (c - 2)
    put(b, root, entry("sub", 2, 0, 16) + entry("a.txt", 3, 11) + entry("gone.jpg", 9, 77, deleted=True))
    many = b"".join(entry(f"f{i}.dat", 100 + i, i) for i in range(16))
    put(b, place(2), many)
    put(b, place(5), entry("deep", 7, 0, 16) + entry("last.bin", 8, 5))
    put(b, place(7), entry("x.png", 9, 9))
    return bytes(b)


@pytest.mark.parametrize("bits", [12, 16])
def test_fat_walk(spark, bits):
    got = fs.fat_files(*volume(spark, fat_volume(bits)))
    rows = paths(got.collect())
    assert set(rows) == {"SUB", "A.TXT", "?ONE.JPG", *(f"SUB/F{i}.DAT" for i in range(16)), "SUB/DEEP", "SUB/LAST.BIN", "SUB/DEEP/X.PNG"}
    assert rows["?ONE.JPG"].deleted and rows["SUB/DEEP"].directory and rows["SUB/LAST.BIN"]["size"] == 5 and rows["A.TXT"].modified.year == 2024
    files = fs.listed(got, "fat").collect()
    assert len(files) == 20 and {r.extension for r in files} == {"txt", "jpg", "dat", "bin", "png"} and sum(r.isDeleted for r in files) == 1


def exfat_set(name, first, size, directory=False, contiguous=False, live=0x80):
    chunks = [name[i : i + 15] for i in range(0, len(name), 15)]
    e = bytes([live | 5, 1 + len(chunks), 0, 0]) + struct.pack("<HHII", 16 if directory else 32, 0, 0x58216000, 0x58216000) + bytes(16)
    s = bytes([live | 0x40, 1 | 2 * contiguous, 0, len(name)]) + struct.pack("<HHQIIQ", 0, 0, size, 0, first, size)
    return e + s + b"".join(bytes([live | 0x41, 0]) + c.encode("utf-16-le").ljust(30, b"\0") for c in chunks)


def test_exfat_sets(spark):
    b = bytearray(512 * 64)
    put(b, 3, b"EXFAT   ")
    put(b, 80, struct.pack("<IIIII", 1, 1, 4, 50, 4))
    b[108], b[109], b[510:512] = 9, 0, b"\x55\xaa"
    for c, n in {4: 6, 6: 0xFFFFFFFF}.items():
        put(b, 512 + 4 * c, struct.pack("<I", n))
    place = lambda c: 512 * (4 + c - 2)
    long = "a rather long file name.jpeg"
    first = exfat_set("dir", 10, 1024, True, True) + exfat_set(long, 20, 70_000) + exfat_set("lost.txt", 21, 3, live=0) + exfat_set("pad1", 30, 1) + exfat_set("pad2", 31, 1)
    assert len(first) == 512
    put(b, place(4), first)
    put(b, place(6), exfat_set("second.mp4", 22, 1 << 33))
    put(b, place(10), b"".join(exfat_set(f"n{i}", 40, i) for i in range(5)) + bytes([0x85, 1]) + bytes(30))
    put(b, place(11), exfat_set("inner", 12, 512, True, True))
    put(b, place(12), exfat_set("end.txt", 13, 4))
    rows = paths(fs.fat_files(*volume(spark, bytes(b))).collect())
    assert set(rows) == {"dir", long, "lost.txt", "pad1", "pad2", "second.mp4", *(f"dir/n{i}" for i in range(5)), "dir/inner", "dir/inner/end.txt"}
    assert rows["lost.txt"].deleted and rows["second.mp4"]["size"] == 1 << 33 and rows["dir"].contiguous and rows[long].modified.year == 2024


def ext_volume(extents):
    """Blocks of 1 KB, inodes of 128 bytes, two groups. Inode 13 has 300 blocks: a list of lists, or an extent tree of two levels."""
    size, per = 1024, 64
    b = bytearray(size * 900)
    put(b, 1024, struct.pack("<II", 2 * per, 900))
    put(b, 1024 + 20, struct.pack("<III", 1, 0, 0))
    put(b, 1024 + 32, struct.pack("<IIII", 8192, 8192, per, 0))
    put(b, 1024 + 56, b"\x53\xef")
    put(b, 1024 + 88, struct.pack("<H", 128))
    put(b, 2 * size + 8, struct.pack("<I", 10))
    put(b, 2 * size + 32 + 8, struct.pack("<I", 20))
    leaf = lambda runs: struct.pack("<HHHHI", 0xF30A, len(runs), 4, 0, 0) + b"".join(struct.pack("<IHHI", a, n, 0, p) for a, p, n in runs)

    def inode(number, mode, nbytes, node, deleted=0):
        table = 10 if number <= per else 20
        at = table * size + 128 * ((number - 1) % per)
        put(b, at, struct.pack("<HHIIIIIHHII", mode, 0, nbytes, 0, 0, 1_700_000_000, deleted, 0, 1, 0, 0x80000 if extents else 0) + bytes(4))
        put(b, at + 40, node.ljust(60, b"\0"))

    one = lambda block: leaf([(0, block, 1)]) if extents else struct.pack("<I", block)
    inode(2, 0x41ED, 1024, one(40))
    inode(12, 0x41ED, 1024, one(41))
    inode(14, 0x81A4, 3, one(42))
    if extents:
        inode(70, 0x81A4, 300 * size, struct.pack("<HHHHI", 0xF30A, 1, 4, 1, 0) + struct.pack("<IIHH", 0, 50, 0, 0))
        put(b, 50 * size, leaf([(0, 100, 100), (100, 300, 200)]))
    else:
        inode(70, 0x81A4, 300 * size, struct.pack("<14I", *range(100, 112), 50, 51))
        put(b, 50 * size, struct.pack("<256I", *range(112, 112 + 256)))
        put(b, 51 * size, struct.pack("<I", 52))
        put(b, 52 * size, struct.pack("<32I", *range(368, 400)))
    row = lambda i, name, step: struct.pack("<IHBB", i, step, len(name), 0) + name.encode().ljust(step - 8, b"\0")
    put(b, 40 * size, row(2, ".", 12) + row(2, "..", 12) + row(12, "sub", 12) + row(0, "zip", 12) + row(70, "big.bin", 976))
    put(b, 41 * size, row(12, ".", 12) + row(2, "..", 12) + row(14, "note.txt", 1000))
    return bytes(b)


@pytest.mark.parametrize("extents", [False, True])
def test_ext(spark, extents):
    rows = paths(fs.ext_files(*volume(spark, ext_volume(extents), 1536)).collect())
    assert set(rows) == {"sub", "sub/note.txt", "big.bin"}
    runs = [(0, 100, 100), (100, 300, 200)] if extents else [(0, 100, 300)]
    assert [tuple(x) for x in rows["big.bin"].runs] == runs and rows["sub"].directory and rows["sub/note.txt"]["size"] == 3 and rows["sub/note.txt"].modified.year == 2023


def hfs_volume():
    """Blocks of 1 KB, nodes of 2 KB; the catalog has two extents, and a file nine extents."""
    size, node = 1024, 2048
    b = bytearray(size * 80)
    fork = lambda n, pairs: struct.pack(">QII", n, 0, sum(c for _, c in pairs)) + b"".join(struct.pack(">II", *p) for p in pairs).ljust(64, b"\0")
    put(b, 1024, b"H+" + bytes(38) + struct.pack(">I", size))
    put(b, 1024 + 192, fork(2 * node, [(30, 4)]))
    put(b, 1024 + 272, fork(3 * node, [(10, 4), (20, 2)]))

    def tree(kind, records):
        out = bytearray(node)
        put(out, 8, struct.pack(">bBH", kind, 1, len(records)))
        at, ends = 14, [14]
        for r in records:
            put(out, at, r)
            at += len(r)
            ends.append(at)
        for i, e in enumerate(ends):
            put(out, node - 2 * (i + 1), struct.pack(">H", e))
        return bytes(out)

    def record(parent, name, data):
        key = struct.pack(">IH", parent, len(name)) + name.encode("utf-16-be")
        return struct.pack(">H", len(key)) + key + data

    folder = lambda i: struct.pack(">hHIIII", 1, 0, 0, i, 0, 3_800_000_000).ljust(88, b"\0")
    file = lambda i, f: struct.pack(">hHIIII", 2, 0, 0, i, 0, 3_800_000_000).ljust(88, b"\0") + f + bytes(80)
    head = tree(1, [struct.pack(">HIIIIH", 1, 1, 3, 1, 2, node).ljust(106, b"\0")])
    pairs = [(40 + 3 * i, 2) for i in range(8)]
    leaves = [
        [record(1, "Disk", folder(2)), record(2, "Papers", folder(16)), record(16, "", struct.pack(">hhIH", 3, 0, 2, 0))],
        [record(16, "thesis.pdf", file(17, fork(20 * size, pairs))), record(2, "café.txt", file(18, fork(5, [(70, 1)])))],
    ]
    put(b, 10 * size, head + tree(-1, leaves[0]))
    put(b, 20 * size, tree(-1, leaves[1]))
    more = struct.pack(">HBBII", 10, 0, 0, 17, 16) + struct.pack(">II", 75, 4).ljust(64, b"\0")
    other = struct.pack(">HBBII", 10, 255, 0, 17, 16) + struct.pack(">II", 60, 4).ljust(64, b"\0")
    put(b, 30 * size, head + tree(-1, [more, other]))
    return bytes(b)


def test_hfs(spark):
    rows = paths(fs.hfs_files(*volume(spark, hfs_volume(), 700)).collect())
    assert set(rows) == {"Papers", "Papers/thesis.pdf", "café.txt"}
    assert [tuple(x) for x in rows["Papers/thesis.pdf"].runs] == [(2 * i, 40 + 3 * i, 2) for i in range(8)] + [(16, 75, 4)]
    assert rows["café.txt"]["size"] == 5 and rows["Papers"].directory and rows["Papers"].modified.year == 2024


def apfs_node(oid, kind, items, fixed, root=True, size=4096):
    b = bytearray(size)
    put(b, 8, struct.pack("<QQII", oid, 1, 2 if root else 3, kind))
    table = len(items) * (4 if fixed else 8)
    put(b, 32, struct.pack("<HHIHH", (1 if root else 0) | 2 | (4 if fixed else 0), 0, len(items), 0, table))
    k, v, end = 0, 0, size - (40 if root else 0)
    for i, (key, value) in enumerate(items):
        v += len(value)
        put(b, 56 + (4 if fixed else 8) * i, struct.pack("<HH", k, v) if fixed else struct.pack("<4H", k, len(key), v, len(value)))
        put(b, 56 + table + k, key)
        put(b, end - v, value)
        k += len(key)
    return bytes(b)


def apfs_volume():
    b = bytearray(4096 * 12)
    put(b, 32, b"NXSB" + struct.pack("<IQ", 4096, 12))
    omap = lambda *rows: [(struct.pack("<QQ", o, x), struct.pack("<IIQ", 0, 4096, p)) for o, x, p in rows]
    put(b, 4096 * 2, apfs_node(2, 0x0B, omap((1000, 5, 4), (1000, 9, 6), (1001, 7, 7)), True))
    key = lambda kind, i, rest=b"": (struct.pack("<Q", kind << 60 | i) + rest, None)[0]
    name = lambda n: struct.pack("<I", len(n) + 1) + n.encode() + b"\0"

    def inode(parent, mode, size=None):
        v = struct.pack("<QQQQ", parent, 0, 0, 1_700_000_000 * 10**9).ljust(80, b"\0") + struct.pack("<HHQ", mode, 0, 0)
        return v + (struct.pack("<HHBBH", 1, 0, 8, 0, 40) + struct.pack("<Q", size) + bytes(32) if size is not None else b"")

    old = [(key(9, 2, name("stale")), struct.pack("<QQH", 99, 0, 8)), (key(3, 99), inode(2, 0x81A4, 1))]
    now = [(key(3, 2), inode(1, 0x41ED)), (key(9, 2, name("Users")), struct.pack("<QQH", 20, 0, 4)), (key(3, 20), inode(2, 0x41ED))]
    more = [(key(9, 20, name("über.mov")), struct.pack("<QQH", 21, 0, 8)), (key(3, 21), inode(20, 0x81A4, 9000)), (key(8, 21, struct.pack("<Q", 8192)), struct.pack("<QQQ", 4096, 77, 0)), (key(8, 21, struct.pack("<Q", 0)), struct.pack("<QQQ", 8192, 70, 0))]
    put(b, 4096 * 4, apfs_node(1000, 0x0E, old, False))
    put(b, 4096 * 6, apfs_node(1000, 0x0E, now, False))
    put(b, 4096 * 7, apfs_node(1001, 0x0E, more, False, False))
    return bytes(b)


def test_apfs_reads_the_latest_copies(spark):
    rows = paths(fs.apfs_files(*volume(spark, apfs_volume(), 5000)).collect())
    assert set(rows) == {"Users", "Users/über.mov"}
    assert rows["Users/über.mov"]["size"] == 9000 and [tuple(x) for x in rows["Users/über.mov"].runs] == [(0, 70, 8192), (8192, 77, 4096)]


def test_xfs(spark):
    size = 1024
    b = bytearray(size * 32)
    put(b, 0, b"XFSB" + struct.pack(">I", size))
    put(b, 56, struct.pack(">Q", 16 * 2 + 0))
    put(b, 84, struct.pack(">II", 16, 2))
    put(b, 104, struct.pack(">HH", 512, 2))
    b[123], b[124] = 1, 4

    def inode(mode, shape, nbytes, extents, own, fork):
        core = struct.pack(">2sHBB", b"IN", mode, 3, shape).ljust(40, b"\0") + struct.pack(">II", 1_700_000_000, 0)
        core = core.ljust(56, b"\0") + struct.pack(">QQII", nbytes, 0, 0, extents)
        return (core.ljust(152, b"\0") + struct.pack(">Q", own)).ljust(176, b"\0") + fork

    short = lambda parent, rows: bytes([len(rows), 0]) + struct.pack(">I", parent) + b"".join(bytes([len(n), 0, 0]) + n.encode() + b"\1" + struct.pack(">I", i) for n, i in rows)
    pack = lambda a, p, n: (a << 73 | p << 21 | n).to_bytes(16, "big")
    put(b, 16 * size, inode(0x41ED, 1, 20, 0, 32, short(32, [("docs", 33), ("a.bin", 34)])))
    put(b, 16 * size + 512, inode(0x41ED, 1, 20, 0, 33, short(32, [("b.txt", 35)])))
    put(b, 17 * size, inode(0x81A4, 2, 5000, 2, 34, pack(0, 21, 3) + pack(3, (1 << 40) + 7, 2)))
    put(b, 17 * size + 512, inode(0x81A4, 1, 3, 0, 35, b"abc"))
    put(b, 20 * size, b"IN" + b"\xff" * 300)
    rows = paths(fs.xfs_files(*volume(spark, bytes(b), 900)).collect())
    assert set(rows) == {"docs", "a.bin", "docs/b.txt"}
    assert [tuple(x) for x in rows["a.bin"].runs] == [(0, 21, 3), (3, (1 << 40) + 7, 2)] and rows["docs/b.txt"]["size"] == 3


def test_btrfs_keeps_the_latest_leaf(spark):
    node, fsid = 4096, bytes(range(16))
    b = bytearray(65536 + node * 6)
    sb = bytearray(4096)
    put(sb, 32, fsid)
    put(sb, 64, b"_BHRfS_M")
    put(sb, 148, struct.pack("<I", node))
    put(sb, 160, struct.pack("<I", 97))
    put(sb, 811, struct.pack("<QBQ", 256, 228, 1 << 20) + struct.pack("<QQQQIIIHH", 1 << 22, 2, 65536, 2, 4096, 4096, 4096, 1, 0) + struct.pack("<QQ", 1, 1 << 20) + bytes(16))
    put(b, 65536, sb)

    def leaf(bytenr, generation, items, owner=5, who=fsid):
        out = bytearray(node)
        put(out, 32, who + struct.pack("<Q", bytenr))
        put(out, 80, struct.pack("<QQIB", generation, owner, len(items), 0))
        end = node - 101
        for i, (oid, kind, offset, data) in enumerate(items):
            end -= len(data)
            put(out, 101 + 25 * i, struct.pack("<QBQII", oid, kind, offset, end, len(data)))
            put(out, 101 + end, data)
        return bytes(out)

    inode = lambda size, mode: struct.pack("<QQQ", 1, 1, size).ljust(52, b"\0") + struct.pack("<I", mode).ljust(84, b"\0") + struct.pack("<QI", 1_700_000_000, 0) + bytes(12)
    ref = lambda n: struct.pack("<QH", 2, len(n)) + n.encode()
    extent = struct.pack("<QQBBHB", 9, 8192, 0, 0, 0, 1) + struct.pack("<QQQQ", 1 << 21, 8192, 4096, 4096)
    now = [(256, 1, 0, inode(0, 0o40755)), (257, 1, 0, inode(0, 0o40755)), (257, 12, 256, ref("home")), (258, 1, 0, inode(4096, 0o100644)), (258, 12, 257, ref("x.iso")), (258, 108, 0, extent)]
    put(b, 65536 + node, leaf(5 << 20, 8, [(258, 1, 0, inode(1, 0o100644)), (258, 12, 256, ref("old"))]))
    put(b, 65536 + 2 * node, leaf(5 << 20, 9, now))
    put(b, 65536 + 3 * node, leaf(6 << 20, 9, [(300, 12, 256, ref("foreign"))], who=bytes(16)))
    put(b, 65536 + 4 * node, leaf(7 << 20, 9, [(301, 12, 256, ref("subvolume"))], owner=257))
    rows = paths(fs.btrfs_files(*volume(spark, bytes(b), 3000)).collect())
    assert set(rows) == {"home", "home/x.iso"} and rows["home/x.iso"]["size"] == 4096
    assert [tuple(x) for x in rows["home/x.iso"].runs] == [(0, (1 << 21) + 4096, 4096)]
    assert fs.btrfs_superblock(bytes(sb))["chunks"] == [{"logical": 1 << 20, "length": 1 << 22, "physical": 1 << 20}]


def test_f2fs(spark):
    size = 4096
    b = bytearray(size * 1100)
    sb = bytearray(512)
    put(sb, 0, struct.pack("<I", 0xF2F52010))
    put(sb, 16, struct.pack("<I", 12))
    put(sb, 36, struct.pack("<Q", 1100))
    put(sb, 60, struct.pack("<I", 2))
    put(sb, 84, struct.pack("<IIII", 4, 0, 0, 3))
    put(b, 1024, sb)

    def node(number, mode, parent, name, nbytes, blocks, where, inline=0):
        n = bytearray(size)
        put(n, 0, struct.pack("<HBB", mode, 0, inline))
        put(n, 16, struct.pack("<Q", nbytes))
        put(n, 48, struct.pack("<Q", 1_700_000_000))
        put(n, 84, struct.pack("<II", parent, len(name)) + name.encode())
        put(n, 360, struct.pack(f"<{len(blocks)}I", *blocks))
        put(n, 4072, struct.pack("<II", number, number))
        put(b, where * size, n)
        put(b, (4 + number // 455) * size + 9 * (number % 455) + 1, struct.pack("<II", number, where))

    node(3, 0x41ED, 3, "", 4096, [90], 60)
    node(4, 0x41ED, 3, "DCIM", 4096, [91], 61)
    node(460, 0x81A4, 4, "a.jpg", 5 * 4096, [100, 101, 102, 0, 110], 62)
    node(5, 0x81A4, 3, "in.txt", 3, [7, 7], 63, 2)
    put(b, 4 * size + 9 * 6 + 1, struct.pack("<II", 5, 64))  # a node of another inode
    rows = paths(fs.f2fs_files(*volume(spark, bytes(b), 10_000)).collect())
    assert set(rows) == {"DCIM", "DCIM/a.jpg", "in.txt"} and rows["in.txt"].runs is None
    assert [tuple(x) for x in rows["DCIM/a.jpg"].runs] == [(0, 100, 3), (4, 110, 1)] and rows["DCIM"].directory


def test_zfs_objects():
    d = bytearray(512)
    put(d, 0, struct.pack("<8BHHI Q", 19, 17, 1, 1, 44, 7, 15, 0, 2, 64, 0, 3))
    assert fs.zfs_dnode(bytes(d)) == {"kind": 19, "levels": 1, "pointers": 1, "bonus_kind": 44, "checksum": 7, "compress": 15, "block": 1024, "bonus": 64, "last": 3}
    z = struct.pack("<QQQ", 1 << 63 | 3, 1, 0).ljust(64, b"\0") + (struct.pack("<QIH", 4 << 60 | 34, 0, 0) + b"etc").ljust(64, b"\0") + bytes(64) + (struct.pack("<QIH", 8 << 60 | 35, 0, 0) + b"motd").ljust(64, b"\0")
    assert fs.zfs_micro_directory(z) == [{"name": "etc", "child": 34, "directory": True}, {"name": "motd", "child": 35, "directory": False}]


def test_backup_manifest(spark):
    db = sqlite3.connect(":memory:")
    db.execute("CREATE TABLE Files (fileID TEXT PRIMARY KEY, domain TEXT, relativePath TEXT, flags INTEGER, file BLOB)")
    blob = plistlib.dumps({"$objects": ["$null", {"Size": 77, "LastModified": 1_700_000_000}]}, fmt=plistlib.FMT_BINARY)
    db.executemany("INSERT INTO Files VALUES (?, ?, ?, ?, ?)", [("ab", "CameraRollDomain", "Media/1.JPG", 1, blob), ("cd", "HomeDomain", "Library", 2, None)])
    rows = [("one", bytearray(db.serialize())), ("bad", bytearray(b"no database")), ("none", None)]
    got = {r.file_id: r for r in fs.backup_manifest(spark.createDataFrame(rows, "backup string, payload binary")).collect()}
    assert set(got) == {"ab", "cd"} and got["ab"]["size"] == 77 and got["ab"].modified.year == 2023 and got["cd"]["size"] is None and got["cd"].flags == 2


@settings(max_examples=150, deadline=None)
@given(st.binary(max_size=600), st.sampled_from([b"", b"IN\x81\xa4\3\2", b"\x85\2", b"H+", b"XFSB"]))
def test_parsers_never_raise(data, head):
    for parse in (
        fs.exfat_boot, fs.exfat_directory, fs.ext_inode, fs.ext_directory, fs.hfs_header, fs.hfs_records, fs.hfs_catalog, fs.hfs_overflow, fs.apfs_records, fs.apfs_omap, fs.apfs_fs,
        fs.xfs_superblock, fs.xfs_inode, fs.btrfs_superblock, fs.btrfs_items, fs.zfs_dnode, fs.zfs_micro_directory, fs.f2fs_superblock, fs.f2fs_addresses, fs.f2fs_inode,
    ):
        parse(head + data)

"""Directories and inodes of file systems: structures are found by their place or magic in blocks, parsed where they lie, and put
together by joins; no tree is walked node by node on the driver.

Blocks are rows (image, offset, payload) of one length, but for the last. Offsets are within the image; a volume's own offsets count
from `start` on, the begin of its partition.
"""

from __future__ import annotations

import datetime as dt
import sqlite3
import struct
from collections.abc import Iterator
from functools import reduce

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.operators.joins import first_by, rebuild_paths
from quarry.runtime import settle
from quarry.schema import as_files
from quarry.sources.parsers import _safe, _u, ext_extents, ext_superblock, fat_boot, fat_directory, parsed, plist

RUNS = "array<struct<logical:bigint,physical:bigint,length:bigint>>"


def _big(b: bytes, at: int, kind: str) -> int:
    return struct.unpack_from(">" + kind, b, at)[0]


def read_ranges(blocks: DataFrame, ranges: DataFrame, step: int) -> DataFrame:
    """ranges(image, at, size, ...) with their bytes as payload: an equi-join on the blocks that a range touches. What lies beyond
    the image is missing at the end; a range is one row, so size must be small (a node, a cluster)."""
    names = ranges.columns
    first, last = F.floor(F.col("at") / step), F.floor((F.col("at") + F.col("size") - 1) / step)
    want = ranges.withColumn("_id", F.xxhash64(*names)).withColumn("_block", F.explode(F.sequence(first, last)))
    have = blocks.select("image", F.floor(F.col("offset") / step).alias("_block"), "payload")
    begin = F.greatest(F.lit(0), F.col("at") - F.col("_block") * step)
    stop = F.least(F.lit(step), F.col("at") + F.col("size") - F.col("_block") * step)
    cut = F.substring("payload", (begin + 1).cast("int"), (stop - begin).cast("int"))
    parts = want.join(have, ["image", "_block"]).select(*names, "_block", cut.alias("_part"))
    joined = F.unhex(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_block", "_part"))), lambda x: F.hex(x["_part"])), ""))
    return parts.groupBy(*names).agg(joined.alias("payload"))


def unix_time(seconds: int) -> dt.datetime | None:
    return dt.datetime(1970, 1, 1) + dt.timedelta(seconds=seconds) if 0 < seconds < 1 << 40 else None


# ---- FAT and exFAT


@_safe
def exfat_boot(sector: bytes) -> dict | None:
    if sector[3:11] != b"EXFAT   " or not 9 <= sector[108] <= 12 or sector[108] + sector[109] > 25:
        return None
    size = 1 << sector[108]
    return {"fat": _u(sector, 80, "I") * size, "data": _u(sector, 88, "I") * size, "clusters": _u(sector, 92, "I"), "root": _u(sector, 96, "I"), "cluster": size << sector[109], "bits": 64}


def _dos(stamp: int) -> dt.datetime | None:
    try:
        return dt.datetime(1980 + (stamp >> 25), stamp >> 21 & 15, stamp >> 16 & 31, stamp >> 11 & 31, stamp >> 5 & 63, (stamp & 31) * 2)
    except ValueError:
        return None


@_safe
def exfat_directory(b: bytes) -> list[dict]:
    """Entry sets (file, stream, names), those in use and deleted ones; a set that isn't whole is left out."""
    out, at = [], 0
    while at + 32 <= len(b):
        kind = b[at]
        if not kind:
            break
        n = b[at + 1]
        rest = [b[at + 32 * i : at + 32 * i + 32] for i in range(1, n + 1)]
        live = kind & 0x80
        if kind & 0x7F != 0x05 or not 2 <= n <= 18 or len(rest[-1]) < 32 or rest[0][0] != (0x40 | live) or any(e[0] != (0x41 | live) for e in rest[1:2]):
            at += 32
            continue
        stream = rest[0]
        name = b"".join(e[2:32] for e in rest[1:] if e[0] == (0x41 | live)).decode("utf-16-le", "replace")[: stream[3]]
        out.append({
            "name": name, "directory": bool(_u(b, at + 4, "H") & 16), "deleted": not live, "first": _u(stream, 20, "I"), "size": _u(stream, 24, "Q"),
            "contiguous": bool(stream[1] & 2), "created": _dos(_u(b, at + 8, "I")), "modified": _dos(_u(b, at + 12, "I")),
        })
        at += 32 * (n + 1)
    return out


def _fat_entries(e: dict) -> dict:
    return {**e, "contiguous": False, "created": None, "modified": _dos(e["date"] << 16 | e["time"])}


def _links(blocks: DataFrame, boots: DataFrame, step: int) -> DataFrame:
    """(image, start, cluster, next) of the allocation tables: a row for each entry that leads on."""
    width = {16: 2, 32: 4, 64: 4}
    bits = F.col("bits")
    size = F.when(bits == 12, (F.col("clusters") + 2) * 3 / 2 + 1).when(bits == 16, (F.col("clusters") + 2) * 2).otherwise((F.col("clusters") + 2) * 4).cast("long")
    # the table of a 12-bit system has 6 KB at most; the others are cut into pieces
    piece = F.when(bits == 12, 8192).otherwise(65536)
    cut = boots.withColumn("all", size).withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("all") - 1) / piece))))
    ranges = cut.select("image", "start", "bits", (F.col("k") * piece).alias("from_"), (F.col("start") + F.col("fat") + F.col("k") * piece).alias("at"), F.least(piece, F.col("all") - F.col("k") * piece).alias("size"))
    keys = ["image", "start"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for r in pdf.itertuples(index=False):
                b, rows = bytes(r.payload), []
                if r.bits == 12:
                    for c in range(2, len(b) * 2 // 3):
                        v = struct.unpack_from("<H", b, c * 3 // 2)[0] if c * 3 // 2 + 2 <= len(b) else 0
                        rows.append((c, v >> 4 if c & 1 else v & 0xFFF))
                    stop = 0xFF7
                else:
                    w = width[r.bits]
                    values = struct.unpack(f"<{len(b) // w}{'H' if w == 2 else 'I'}", b[: len(b) // w * w])
                    rows = [(r.from_ // w + i, v & 0x0FFFFFFF if r.bits == 32 else v) for i, v in enumerate(values)]
                    stop = {16: 0xFFF7, 32: 0x0FFFFFF7, 64: 0xFFFFFFF7}[r.bits]
                rows = [x for x in rows if x[0] >= 2 and 2 <= x[1] < stop]
                yield pd.DataFrame({"image": r.image, "start": r.start, "cluster": [x[0] for x in rows], "next": [x[1] for x in rows]}).astype({"cluster": "int64", "next": "int64"})

    return settle(read_ranges(blocks, ranges, step).select(*keys, "bits", "from_", "payload").mapInPandas(run, "image string, start long, cluster long, next long"))


def fat_files(blocks: DataFrame, volumes: DataFrame, step: int, rounds: int = 1000) -> DataFrame:
    """Files and directories, deleted ones too, of FAT and exFAT volumes(image, start): image, start, path, name, directory, deleted,
    size, first (cluster), contiguous, created, modified.

    All directories of a level are read at once: a round joins the clusters that are known with their bytes, and goes on with the next
    cluster of each and the first ones of directories found. A deleted directory is listed but not followed; a cluster is read once.
    """
    sectors = read_ranges(blocks, volumes.select("image", "start", F.col("start").alias("at"), F.lit(512).alias("size")), step)

    def boot(b: bytes) -> dict | None:
        if got := exfat_boot(b):
            return {**got, "kind": "exfat", "root_bytes": 0}
        got = fat_boot(b)
        return got and {**got, "kind": "fat", "root_bytes": struct.unpack_from("<H", b, 17)[0] * 32}

    boots = settle(parsed(sectors, boot, "kind string, fat long, data long, clusters long, root long, cluster long, bits int, root_bytes long", ("image", "start")))
    links = _links(blocks, boots, step)
    head = boots.select("image", "start", "kind", "data", F.col("cluster").alias("bytes"), "clusters")
    place = F.col("start") + F.col("data") + (F.col("cluster") - 2) * F.col("bytes")
    fixed = F.col("root_bytes") > 0  # older systems have a root directory of their own, before the clusters
    todo = boots.select("image", "start", F.lit("").alias("path"), F.when(fixed, 0).otherwise(F.col("root")).cast("long").alias("cluster"), F.lit(0).cast("long").alias("left"))
    roots = boots.filter(fixed).select("image", "start", (F.col("start") + F.col("data") - F.col("root_bytes")).alias("at"), F.col("root_bytes").alias("size"))
    seen = found = None
    schema = "name string, directory boolean, deleted boolean, first long, size long, contiguous boolean, created timestamp_ntz, modified timestamp_ntz"

    def entries(b: bytes) -> list[dict]:
        own = exfat_directory(b[1:]) if b[:1] == b"x" else [_fat_entries(e) for e in fat_directory(b[1:])]
        return own

    for _ in range(rounds):
        todo = settle(todo)
        if todo.isEmpty():
            break
        at = todo.join(head, ["image", "start"])
        ranges = at.filter("cluster >= 2 and cluster < clusters + 2").select("image", "start", "path", "kind", place.alias("at"), F.col("bytes").alias("size"))
        first = at.filter("cluster = 0").join(roots, ["image", "start"]).select("image", "start", "path", "kind", "at", "size")
        data = read_ranges(blocks, ranges.unionByName(first), step)
        tagged = data.select("image", "start", "path", F.concat(F.when(F.col("kind") == "exfat", F.lit(b"x")).otherwise(F.lit(b"f")), "payload").alias("payload"))
        rows = settle(parsed(tagged, entries, schema, ("image", "start", "path")))
        found = rows if found is None else found.unionByName(rows)
        here = todo.select("image", "start", "cluster").distinct()
        seen = here if seen is None else settle(seen.unionByName(here).distinct())
        # a contiguous directory has its length, any other its chain
        on = todo.filter("left = 0 and cluster >= 2").join(links, ["image", "start", "cluster"]).select("image", "start", "path", F.col("next").alias("cluster"), "left")
        run = todo.filter("left > 1").select("image", "start", "path", (F.col("cluster") + 1).alias("cluster"), (F.col("left") - 1).alias("left"))
        sub = rows.filter("directory and not deleted and first >= 2").join(head.select("image", "start", "bytes"), ["image", "start"])
        count = F.when(F.col("contiguous"), F.greatest(F.lit(1), F.ceil(F.col("size") / F.col("bytes")))).otherwise(0).cast("long")
        down = sub.select("image", "start", F.concat("path", "name", F.lit("/")).alias("path"), F.col("first").alias("cluster"), count.alias("left"))
        todo = on.unionByName(run).unionByName(down).join(seen, ["image", "start", "cluster"], "left_anti")
    return found.select("image", "start", F.concat("path", "name").alias("path"), "name", "directory", "deleted", "size", "first", "contiguous", "created", "modified")


# ---- ext2, ext3, ext4


@_safe
def ext_groups(b: bytes, size: int, wide: bool) -> list[dict]:
    return [{"number": i, "table": _u(b, size * i + 8, "I") | (_u(b, size * i + 40, "I") << 32 if wide else 0)} for i in range(len(b) // size)]


@_safe
def ext_inode(b: bytes) -> dict | None:
    """Mode, size, times, whether it has extents, and the 60 bytes that lead to its blocks; None for one never used."""
    mode = _u(b, 0, "H")
    if not mode:
        return None
    return {
        "mode": mode, "size": _u(b, 4, "I") | _u(b, 108, "I") << 32, "links": _u(b, 26, "H"), "modified": unix_time(_u(b, 16, "I")), "deleted": unix_time(_u(b, 20, "I")),
        "extents": bool(_u(b, 32, "I") & 0x80000), "node": b[40:100],
    }


@_safe
def ext_directory(b: bytes) -> list[dict]:
    out, at = [], 0
    while at + 8 <= len(b):
        inode, step, n = _u(b, at, "I"), _u(b, at + 4, "H"), b[at + 6]
        if step < 8 or at + step > len(b):
            break
        name = b[at + 8 : at + 8 + n].decode("utf-8", "replace")
        if inode and n and name not in (".", ".."):
            out.append({"inode": inode, "name": name})
        at += step
    return out


def ext_runs(inodes: DataFrame, blocks: DataFrame, step: int) -> DataFrame:
    """(image, start, inode, logical, physical, length), in blocks, of inodes(image, start, inode, extents, node, block): extent trees
    and lists of blocks with up to three levels of lists between; a round reads all nodes of a level."""
    schema = "kind string, logical long, physical long, length long"

    def steps(b: bytes) -> list[dict]:
        """The first byte: e for an extent node, 0 to 3 for a list so many levels above the blocks; then block size and the place of
        what the list leads to."""
        kind, size, base = b[:1], struct.unpack_from("<I", b, 1)[0], struct.unpack_from("<Q", b, 5)[0]
        body = b[13:]
        if kind == b"e":
            return [{"kind": "run" if n else "e", "logical": a, "physical": p, "length": n} for a, p, n in ext_extents(body)]
        per, level, out = size // 4, int(kind) if kind.isdigit() else -1, []
        if kind == b"i":  # an inode's own list: twelve blocks, then lists of one, two and three levels
            values = struct.unpack_from("<15I", body)
            at = 12
            for i, v in enumerate(values):
                if i < 12:
                    out += [{"kind": "run", "logical": i, "physical": v, "length": 1}] if v else []
                    continue
                out += [{"kind": str(i - 12), "logical": at, "physical": v, "length": 0}] if v else []
                at += per ** (i - 11)
            return out
        for i, v in enumerate(struct.unpack(f"<{len(body) // 4}I", body[: len(body) // 4 * 4])):
            if v:
                out.append({"kind": "run" if level == 0 else str(level - 1), "logical": base + i * per**level, "physical": v, "length": 1 if level == 0 else 0})
        return out

    keys = ("image", "start", "inode", "block")
    le = lambda c, n: F.concat(*[F.unhex(F.lpad(F.hex(F.shiftright(c, 8 * i).bitwiseAND(255)), 2, "0")) for i in range(n)])
    now = inodes.select(*keys, F.concat(F.when(F.col("extents"), F.lit(b"e")).otherwise(F.lit(b"i")), le(F.col("block").cast("long"), 4), le(F.lit(0).cast("long"), 8), "node").alias("payload"))
    out = []
    for _ in range(7):
        got = settle(parsed(now, steps, schema, keys))
        out.append(got.filter("kind = 'run'").select("image", "start", "inode", "logical", "physical", "length"))
        more = got.filter("kind <> 'run' and physical > 0")
        if more.isEmpty():
            break
        ranges = more.select(*keys, "kind", "logical", (F.col("start") + F.col("physical") * F.col("block")).alias("at"), F.col("block").cast("long").alias("size"))
        read = read_ranges(blocks, ranges, step)
        now = read.select(*keys, F.concat(F.encode("kind", "UTF-8"), le(F.col("block").cast("long"), 4), le(F.col("logical"), 8), "payload").alias("payload"))
    runs = reduce(DataFrame.unionByName, out)
    # lists of blocks give runs of one: neighbours become one run
    w = Window.partitionBy("image", "start", "inode").orderBy("logical")
    runs = runs.withColumn("same", (F.col("logical") - F.col("physical") == F.lag(F.col("logical") - F.col("physical")).over(w)) & (F.lag(F.col("logical") + F.col("length")).over(w) == F.col("logical")))
    runs = runs.withColumn("run", F.sum(F.when(F.col("same"), 0).otherwise(1)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return runs.groupBy("image", "start", "inode", "run").agg(F.min("logical").alias("logical"), F.min("physical").alias("physical"), F.sum("length").alias("length")).drop("run")


def ext_files(blocks: DataFrame, volumes: DataFrame, step: int) -> DataFrame:
    """Files and directories of ext2, ext3 and ext4 volumes(image, start): image, start, inode, path, name, directory, size, modified,
    deleted (time), runs (in blocks, by place in the file). Inodes without a name are left out; sizes come from the inode."""
    heads = read_ranges(blocks, volumes.select("image", "start", (F.col("start") + 1024).alias("at"), F.lit(1024).alias("size")), step)

    def head(b: bytes) -> dict | None:
        s = ext_superblock(b)
        if not s or not s["inodes_per_group"]:
            return None
        wide = bool(struct.unpack_from("<I", b, 96)[0] & 0x80)
        size = max(32, struct.unpack_from("<H", b, 254)[0]) if wide else 32
        return {**s, "wide": wide and size >= 64, "desc": size, "first": struct.unpack_from("<I", b, 20)[0], "groups": -(-s["inodes"] // s["inodes_per_group"])}

    vol = settle(parsed(heads, head, "block long, inodes long, inodes_per_group long, inode int, wide boolean, desc int, first long, groups long", ("image", "start")))
    # the descriptors of all groups, and of each its table of inodes, a block at a time
    piece = 64
    per = vol.withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("groups") - 1) / piece))))
    at = F.col("start") + (F.col("first") + 1) * F.col("block") + F.col("k") * piece * F.col("desc")
    table = read_ranges(blocks, per.select("image", "start", "k", "desc", "wide", at.alias("at"), (F.least(F.lit(piece), F.col("groups") - F.col("k") * piece) * F.col("desc")).alias("size")), step)
    told = table.select("image", "start", "k", F.concat(F.unhex(F.lpad(F.hex("desc"), 4, "0")), F.when(F.col("wide"), F.lit(b"\1")).otherwise(F.lit(b"\0")), "payload").alias("payload"))
    groups = parsed(told, lambda b: ext_groups(b[3:], b[0] << 8 | b[1], bool(b[2])), "number long, table long", ("image", "start", "k"))
    groups = groups.select("image", "start", (F.col("k") * piece + F.col("number")).alias("group"), "table").join(vol.select("image", "start", "block", "inodes_per_group", "inode"), ["image", "start"])
    rows = F.ceil(F.col("inodes_per_group") * F.col("inode") / F.col("block")) - 1
    parts = groups.withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), rows)))
    ranges = parts.select(
        "image", "start", "inode", "block", (F.col("group") * F.col("inodes_per_group") + F.col("k") * F.floor(F.col("block") / F.col("inode"))).alias("before"),
        (F.col("start") + (F.col("table") + F.col("k")) * F.col("block")).alias("at"), F.col("block").alias("size"),
    )
    raw = read_ranges(blocks, ranges, step).select("image", "start", "before", "block", F.concat(F.unhex(F.lpad(F.hex("inode"), 4, "0")), "payload").alias("payload"))

    def inodes_of(b: bytes) -> list[dict]:
        size = b[0] << 8 | b[1]
        got = [(i, ext_inode(b[2 + size * i : 2 + size * (i + 1)])) for i in range((len(b) - 2) // size)]
        return [{**x, "place": i} for i, x in got if x]

    inodes = parsed(raw, inodes_of, "place int, mode int, size long, links int, modified timestamp_ntz, deleted timestamp_ntz, extents boolean, node binary", ("image", "start", "before", "block"))
    inodes = settle(inodes.withColumn("inode", F.col("before") + F.col("place") + 1).withColumn("directory", F.col("mode").bitwiseAND(0xF000) == 0x4000).drop("before", "place"))
    kinds = inodes.filter(F.col("mode").bitwiseAND(0xF000).isin(0x4000, 0x8000))
    runs = settle(ext_runs(kinds, blocks, step))
    dirs = kinds.filter("directory").select("image", "start", "inode", "block").join(runs, ["image", "start", "inode"])
    one = dirs.withColumn("k", F.explode(F.expr("sequence(0L, length - 1)")))
    data = read_ranges(blocks, one.select("image", "start", "inode", (F.col("logical") + F.col("k")).alias("logical"), (F.col("start") + (F.col("physical") + F.col("k")) * F.col("block")).alias("at"), F.col("block").alias("size")), step)
    names = parsed(data.withColumnRenamed("inode", "parent"), lambda b: [{"child": e["inode"], "name": e["name"]} for e in ext_directory(b)], "child long, name string", ("image", "start", "parent"))
    return _with_paths(names, kinds, runs, 2)


def _with_paths(names: DataFrame, inodes: DataFrame, runs: DataFrame, root: int) -> DataFrame:
    """names(image, start, parent, child, name) with rebuilt paths, beside inodes and their runs."""
    key = lambda c: F.concat_ws("|", "image", F.col("start").cast("string"), F.col(c).cast("string"))
    up = F.when(F.col("parent") == root, F.lit("root")).otherwise(key("parent"))
    one = settle(first_by(names, ["image", "start", "child"], [F.col("parent"), F.col("name")]))
    paths = rebuild_paths(one.select(key("child").alias("child"), up.alias("parent"), "name"), "root", 200).select(F.col("child").alias("_key"), "path")
    lists = runs.groupBy("image", "start", "inode").agg(F.array_sort(F.collect_list(F.struct("logical", "physical", "length"))).alias("runs"))
    named = one.withColumn("_key", key("child")).join(paths, "_key").withColumnRenamed("child", "inode").drop("_key", "parent")
    keep = [c for c in ("directory", "size", "modified", "deleted") if c in inodes.columns]
    return named.join(inodes.select("image", "start", "inode", *keep), ["image", "start", "inode"]).join(lists, ["image", "start", "inode"], "left").select("image", "start", "inode", "path", "name", *keep, "runs")


# ---- HFS+


def _mac_time(seconds: int) -> dt.datetime | None:
    return dt.datetime(1904, 1, 1) + dt.timedelta(seconds=seconds) if seconds else None


def _fork(b: bytes, at: int) -> tuple[int, list[tuple[int, int]]]:
    """Size and (first block, blocks) of the extents of a fork."""
    pairs = struct.unpack_from(">16I", b, at + 16)
    return _big(b, at, "Q"), [(a, n) for a, n in zip(pairs[::2], pairs[1::2]) if n]


@_safe
def hfs_header(b: bytes) -> dict | None:
    """Block size, and the extents of the catalog and of the file of further extents."""
    if b[:2] not in (b"H+", b"HX") or not 512 <= _big(b, 40, "I") <= 1 << 20:
        return None
    extents = lambda at: [{"physical": a, "length": n} for a, n in _fork(b, at)[1]]
    return {"block": _big(b, 40, "I"), "overflow": extents(192), "catalog": extents(272)}


@_safe
def hfs_records(node: bytes) -> list[tuple[bytes, bytes]]:
    """(key, data) of a leaf node of a B-tree; none for other nodes."""
    if len(node) < 14 or node[8] != 0xFF or node[9] != 1:
        return []
    n, out = _big(node, 10, "H"), []
    ends = [_big(node, len(node) - 2 * (i + 1), "H") for i in range(n + 1)]
    for a, b in zip(ends, ends[1:]):
        if not 14 <= a < b <= len(node):
            break
        size = _big(node, a, "H")
        data = a + 2 + size + (size & 1)
        out.append((node[a + 2 : a + 2 + size], node[data:b]))
    return out


@_safe
def hfs_catalog(node: bytes) -> list[dict]:
    out = []
    for key, data in hfs_records(node):
        kind = _big(data, 0, "h")
        if kind not in (1, 2):
            continue
        row = {"parent": _big(key, 0, "I"), "name": key[6 : 6 + 2 * _big(key, 4, "H")].decode("utf-16-be", "replace"), "inode": _big(data, 8, "I"), "directory": kind == 1, "size": 0, "modified": _mac_time(_big(data, 16, "I")), "extents": []}
        if kind == 2:
            row["size"], pairs = _fork(data, 88)
            row["extents"] = [{"physical": a, "length": n} for a, n in pairs]
        out.append(row)
    return out


@_safe
def hfs_overflow(node: bytes) -> list[dict]:
    """Further extents: fork (0 data, 255 resource), inode, first block in the file, and up to eight extents."""
    out = []
    for key, data in hfs_records(node):
        pairs = struct.unpack_from(">16I", data)
        out.append({"fork": key[0], "inode": _big(key, 2, "I"), "logical": _big(key, 6, "I"), "extents": [{"physical": a, "length": n} for a, n in zip(pairs[::2], pairs[1::2]) if n]})
    return out


_PAIRS = "array<struct<physical:bigint,length:bigint>>"


def _placed(extents: str, first) -> F.Column:
    """Pairs as runs, whose logical places follow each other from first on."""
    start = lambda i: F.aggregate(F.slice(extents, F.lit(1), i), F.lit(0).cast("long"), lambda a, x: a + x["length"])
    return F.transform(extents, lambda x, i: F.struct((first + start(i)).alias("logical"), x["physical"].alias("physical"), x["length"].alias("length")))


def hfs_files(blocks: DataFrame, volumes: DataFrame, step: int) -> DataFrame:
    """Files and directories of HFS+ volumes(image, start): image, start, inode, path, name, directory, size, modified, runs. All nodes
    of the catalog are read at once and leaves told by their kind; the catalog's own extents come from the volume's header."""
    heads = read_ranges(blocks, volumes.select("image", "start", (F.col("start") + 1024).alias("at"), F.lit(512).alias("size")), step)
    vol = settle(parsed(heads, hfs_header, f"block long, overflow {_PAIRS}, catalog {_PAIRS}", ("image", "start")))

    def nodes(which: str) -> DataFrame:
        """Nodes of a tree: its first node tells their size."""
        own = vol.filter(F.size(which) > 0)
        first = own.select("image", "start", (F.col("start") + F.col(which)[0]["physical"] * F.col("block")).alias("at"), F.lit(512).alias("size"))
        sizes = parsed(read_ranges(blocks, first, step), lambda b: {"node": struct.unpack_from(">H", b, 32)[0]} if len(b) >= 34 and b[8] == 1 else None, "node long", ("image", "start"))
        runs = own.join(sizes.filter("node >= 512"), ["image", "start"]).select("image", "start", "block", "node", F.explode(_placed(which, F.lit(0).cast("long"))).alias("r"))
        # a node may be larger than a block, but extents hold whole nodes
        at = runs.withColumn("k", F.explode(F.expr("sequence(0L, r.length * block div node - 1)")))
        ranges = at.select("image", "start", "block", (F.col("start") + F.col("r.physical") * F.col("block") + F.col("k") * F.col("node")).alias("at"), F.col("node").alias("size"))
        return read_ranges(blocks, ranges, step)

    rows = settle(parsed(nodes("catalog"), hfs_catalog, f"parent long, name string, inode long, directory boolean, size long, modified timestamp_ntz, extents {_PAIRS}", ("image", "start")))
    more = parsed(nodes("overflow"), hfs_overflow, f"fork int, inode long, logical long, extents {_PAIRS}", ("image", "start")).filter("fork = 0")
    runs = rows.select("image", "start", "inode", F.explode(_placed("extents", F.lit(0).cast("long"))).alias("r")).select("image", "start", "inode", "r.*")
    runs = runs.unionByName(more.select("image", "start", "inode", F.explode(_placed("extents", F.col("logical"))).alias("r")).select("image", "start", "inode", "r.*"))
    # the root directory (2) has a row of its own, below number 1
    names = rows.filter("parent > 1").select("image", "start", "parent", F.col("inode").alias("child"), "name")
    return _with_paths(names, rows.select("image", "start", "inode", "directory", "size", "modified"), runs, 2)


# ---- APFS


@_safe
def apfs_records(node: bytes) -> list[tuple[bytes, bytes]]:
    """(key, value) of a leaf node; none for other blocks."""
    flags, level, n, table, space = *struct.unpack_from("<HHI", node, 32), *struct.unpack_from("<HH", node, 40)
    if level or not flags & 2 or _u(node, 24, "I") & 0xFFFF not in (2, 3):
        return []
    keys, end, out = 56 + table + space, len(node) - (40 if flags & 1 else 0), []
    for i in range(n):
        if flags & 4:
            k, v = struct.unpack_from("<HH", node, 56 + table + 4 * i)
            ks, vs = 16, 16
        else:
            k, ks, v, vs = struct.unpack_from("<4H", node, 56 + table + 8 * i)
        if v == 0xFFFF or keys + k + ks > len(node) or v > end:
            continue
        out.append((node[keys + k : keys + k + ks], node[end - v : end - v + vs]))
    return out


@_safe
def apfs_omap(node: bytes) -> list[dict]:
    """Entries of an object map: object, transaction, place in blocks."""
    if _u(node, 28, "I") != 0x0B:
        return []
    return [{"oid": _u(k, 0, "Q"), "xid": _u(k, 8, "Q"), "paddr": _u(v, 8, "Q")} for k, v in apfs_records(node)]


def _apfs_size(value: bytes) -> int:
    """The size in the extended field of kind 8 of an inode."""
    n, at, data = _u(value, 92, "H"), 96, 96 + 4 * _u(value, 92, "H")
    for _ in range(n):
        kind, size = value[at], _u(value, at + 2, "H")
        if kind == 8:
            return _u(value, data, "Q")
        at, data = at + 4, data + -(-size // 8) * 8
    return 0


@_safe
def apfs_fs(node: bytes) -> list[dict]:
    """Inodes, names and extents in a leaf of a file-system tree, told apart by kind: 3, 9 and 8."""
    if _u(node, 28, "I") != 0x0E:
        return []
    out = []
    for k, v in apfs_records(node):
        head = _u(k, 0, "Q")
        row = {"oid": _u(node, 8, "Q"), "kind": head >> 60, "inode": head & (1 << 60) - 1}
        if row["kind"] == 3:
            row |= {"parent": _u(v, 0, "Q"), "directory": _u(v, 80, "H") & 0xF000 == 0x4000, "size": _apfs_size(v) if len(v) >= 96 else 0, "modified": unix_time(_u(v, 24, "Q") // 10**9)}
        elif row["kind"] == 9:
            row |= {"name": k[12 : 12 + (_u(k, 8, "I") & 0x3FF)].split(b"\0")[0].decode("utf-8", "replace"), "child": _u(v, 0, "Q")}
        elif row["kind"] == 8:
            row |= {"logical": _u(k, 8, "Q"), "length": _u(v, 0, "Q") & (1 << 56) - 1, "physical": _u(v, 8, "Q")}
        else:
            continue
        out.append(row)
    return out


def object_map(entries: DataFrame) -> DataFrame:
    """(image, start, oid, xid, paddr): of each object the entry of the greatest transaction."""
    best = entries.groupBy("image", "start", "oid").agg(F.max(F.struct("xid", "paddr")).alias("b"))
    return best.select("image", "start", "oid", "b.xid", "b.paddr")


def apfs_files(blocks: DataFrame, volumes: DataFrame, step: int) -> DataFrame:
    """Files and directories of APFS containers(image, start): image, start, inode, path, name, directory, size, modified, runs (logical
    and length in bytes, physical in blocks).

    Every block of the container is looked at once; leaves are told by their kind. A leaf of a file-system tree counts if the object
    maps give its place for its object in the latest transaction: older copies of it fall out.
    """
    heads = read_ranges(blocks, volumes.select("image", "start", F.col("start").alias("at"), F.lit(64).alias("size")), step)
    vol = parsed(heads, lambda b: {"block": struct.unpack_from("<I", b, 36)[0], "blocks": struct.unpack_from("<Q", b, 40)[0]} if b[32:36] == b"NXSB" else None, "block long, blocks long", ("image", "start"))
    vol = settle(vol.filter("block between 4096 and 65536"))
    each = vol.withColumn("paddr", F.explode(F.expr("sequence(1L, blocks - 1)")))
    ranges = each.select("image", "start", "paddr", (F.col("start") + F.col("paddr") * F.col("block")).alias("at"), F.col("block").alias("size"))
    raw = read_ranges(blocks, ranges, step).filter(F.substring("payload", 29, 1).isin(bytearray(b"\x0b"), bytearray(b"\x0e")))
    raw = settle(raw.select("image", "start", "paddr", "payload"))
    map_ = object_map(parsed(raw, apfs_omap, "oid long, xid long, paddr long", ("image", "start")))
    rows = parsed(raw, apfs_fs, "oid long, kind int, inode long, parent long, directory boolean, size long, modified timestamp_ntz, name string, child long, logical long, length long, physical long", ("image", "start", "paddr"))
    rows = settle(rows.join(map_.select("image", "start", "oid", "paddr"), ["image", "start", "oid", "paddr"], "left_semi"))
    names = rows.filter("kind = 9").select("image", "start", F.col("inode").alias("parent"), "child", "name")
    runs = rows.filter("kind = 8").select("image", "start", "inode", "logical", "physical", "length")
    return _with_paths(names, rows.filter("kind = 3").select("image", "start", "inode", "directory", "size", "modified"), runs, 2)


# ---- XFS


@_safe
def xfs_superblock(b: bytes) -> dict | None:
    if b[:4] != b"XFSB":
        return None
    return {"block": _big(b, 4, "I"), "root": _big(b, 56, "Q"), "ag_blocks": _big(b, 84, "I"), "ags": _big(b, 88, "I"), "inode": _big(b, 104, "H"), "per_block": b[123], "ag_bits": b[124]}


def xfs_extent(b: bytes) -> dict:
    """An extent's 128 bits: a flag, place in the file (54), block (52), blocks (21)."""
    x = int.from_bytes(b, "big")
    return {"logical": x >> 73 & (1 << 54) - 1, "physical": x >> 21 & (1 << 52) - 1, "length": x & (1 << 21) - 1}


def xfs_short_directory(b: bytes, typed: bool) -> list[dict]:
    wide = bool(b[1])
    n, size = b[1] if wide else b[0], 8 if wide else 4
    out, at = [], 2 + size
    for _ in range(n):
        k = b[at]
        name = b[at + 3 : at + 3 + k].decode("utf-8", "replace")
        at += 3 + k + typed
        out.append({"child": int.from_bytes(b[at : at + size], "big"), "name": name})
        at += size
    return out


@_safe
def xfs_inode(b: bytes) -> dict | None:
    """Mode, size, time, runs or names of a short directory; the number only where the inode holds it (version 3)."""
    if b[:2] != b"IN" or not (mode := _big(b, 2, "H")):
        return None
    version, shape = b[4], b[5]
    core = 176 if version == 3 else 100
    out = {"mode": mode, "size": _big(b, 56, "Q"), "modified": unix_time(_big(b, 40, "I")), "inode": _big(b, 152, "Q") if version == 3 else None, "runs": [], "entries": []}
    if shape == 2:
        out["runs"] = [xfs_extent(b[core + 16 * i : core + 16 * i + 16]) for i in range(min(_big(b, 76, "I"), (len(b) - core) // 16))]
    elif shape == 1 and mode & 0xF000 == 0x4000:
        out["entries"] = xfs_short_directory(b[core:], version == 3)
    return out


def xfs_files(blocks: DataFrame, volumes: DataFrame, step: int) -> DataFrame:
    """Files and directories of XFS volumes(image, start) that short directories name: image, start, inode, path, name, directory, size,
    modified, runs (physical in blocks of the volume's numbering). Inodes are told by their magic at multiples of their size in every
    block, group by group; the number is that in the inode, or its place. Damaged ones are skipped."""
    heads = read_ranges(blocks, volumes.select("image", "start", F.col("start").alias("at"), F.lit(512).alias("size")), step)
    vol = settle(parsed(heads, xfs_superblock, "block long, root long, ag_blocks long, ags long, inode int, per_block int, ag_bits int", ("image", "start")).filter("inode >= 256 and block >= 512"))
    each = vol.withColumn("n", F.explode(F.expr("sequence(0L, ags * ag_blocks - 1)")))
    place = F.expr("shiftleft(n div ag_blocks, ag_bits + per_block) + shiftleft(n % ag_blocks, per_block)")
    ranges = each.select("image", "start", "root", "inode", place.alias("first"), (F.col("start") + F.col("n") * F.col("block")).alias("at"), F.col("block").alias("size"))
    raw = read_ranges(blocks, ranges, step).filter(F.substring("payload", 1, 2) == F.lit(b"IN"))
    told = raw.select("image", "start", "root", "first", F.concat(F.unhex(F.lpad(F.hex("inode"), 4, "0")), "payload").alias("payload"))

    def inodes_of(b: bytes) -> list[dict]:
        size = b[0] << 8 | b[1]
        got = [(i, xfs_inode(b[2 + size * i : 2 + size * (i + 1)])) for i in range((len(b) - 2) // size)]
        return [{**x, "place": i, "own": x["inode"]} for i, x in got if x]

    schema = f"place int, own long, mode int, size long, modified timestamp_ntz, runs {RUNS}, entries array<struct<child:bigint,name:string>>"
    rows = parsed(told, inodes_of, schema, ("image", "start", "root", "first"))
    rows = settle(rows.withColumn("inode", F.coalesce("own", F.col("first") + F.col("place"))).withColumn("directory", F.col("mode").bitwiseAND(0xF000) == 0x4000))
    names = rows.select("image", "start", F.when(F.col("inode") == F.col("root"), 0).otherwise(F.col("inode")).alias("parent"), F.explode("entries").alias("e")).select("image", "start", "parent", "e.child", "e.name")
    runs = rows.select("image", "start", "inode", F.explode("runs").alias("r")).select("image", "start", "inode", "r.*")
    return _with_paths(names, rows, runs, 0)


# ---- Btrfs


@_safe
def btrfs_superblock(b: bytes) -> dict | None:
    """Of the block at 64 KB: identity, node size, roots, and the chunks that the system's own chunks lie in."""
    if b[64:72] != b"_BHRfS_M":
        return None
    size, at, chunks = _u(b, 160, "I"), 811, []
    while at + 17 + 80 <= 811 + size:
        n = _u(b, at + 17 + 44, "H")
        chunks.append({"logical": _u(b, at + 9, "Q"), "length": _u(b, at + 17, "Q"), "physical": _u(b, at + 17 + 56, "Q")})
        at += 17 + 48 + 32 * n
    return {"fsid": b[32:48].hex(), "root": _u(b, 80, "Q"), "chunk_root": _u(b, 88, "Q"), "node": _u(b, 148, "I"), "chunks": chunks}


@_safe
def btrfs_items(node: bytes) -> list[dict]:
    """Items of a leaf: inodes (1), names (12), extents (108), chunks (228); none for other nodes."""
    if node[100]:
        return []
    head = {"fsid": node[32:48].hex(), "bytenr": _u(node, 48, "Q"), "generation": _u(node, 80, "Q"), "owner": _u(node, 88, "Q")}
    out = []
    for i in range(min(_u(node, 96, "I"), (len(node) - 101) // 25)):
        k = 101 + 25 * i
        oid, kind, offset = struct.unpack_from("<QBQ", node, k)
        a, size = struct.unpack_from("<II", node, k + 17)
        d = node[101 + a : 101 + a + size]
        row = {**head, "inode": oid, "kind": kind}
        if kind == 1 and len(d) >= 160:
            row |= {"size": _u(d, 16, "Q"), "directory": _u(d, 52, "I") & 0xF000 == 0x4000, "modified": unix_time(_u(d, 136, "Q"))}
        elif kind == 12 and len(d) >= 10:
            row |= {"parent": offset, "name": d[10 : 10 + _u(d, 8, "H")].decode("utf-8", "replace")}
        elif kind == 108 and len(d) >= 53 and d[20] == 1:
            row |= {"logical": offset, "physical": _u(d, 21, "Q") + _u(d, 37, "Q"), "length": _u(d, 45, "Q")}
        elif kind == 228 and len(d) >= 80:
            row |= {"logical": offset, "length": _u(d, 0, "Q"), "physical": _u(d, 56, "Q")}
        else:
            continue
        out.append(row)
    return out


def btrfs_files(blocks: DataFrame, volumes: DataFrame, step: int) -> DataFrame:
    """Files and directories in the trees of Btrfs volumes(image, start): image, start, inode, path, name, directory, size, modified, runs
    (bytes; physical is the logical address of the volume). Every node-sized place is looked at; a leaf counts if it has the
    volume's identity, and of leaves with one address that of the latest generation. Compressed or inline data have no runs; of
    several trees the default one (5) is listed."""
    heads = read_ranges(blocks, volumes.select("image", "start", (F.col("start") + 65536).alias("at"), F.lit(4096).alias("size")), step)
    vol = settle(parsed(heads, btrfs_superblock, f"fsid string, node long, root long, chunk_root long, chunks {RUNS}", ("image", "start")).filter("node between 4096 and 65536"))
    ends = blocks.groupBy("image").agg(F.max(F.col("offset") + F.length("payload")).alias("end"))
    each = vol.join(ends, "image").withColumn("n", F.explode(F.expr("sequence(1L, (end - start) div node - 1)")))
    raw = read_ranges(blocks, each.select("image", "start", "fsid", (F.col("start") + F.col("n") * F.col("node")).alias("at"), F.col("node").alias("size")), step)
    raw = raw.filter(F.lower(F.hex(F.substring("payload", 33, 16))) == F.col("fsid"))
    schema = "bytenr long, generation long, owner long, inode long, kind int, size long, directory boolean, modified timestamp_ntz, parent long, name string, logical long, physical long, length long"
    rows = settle(parsed(raw, btrfs_items, schema, ("image", "start")))
    latest = rows.groupBy("image", "start", "bytenr").agg(F.max("generation").alias("generation"))
    rows = rows.join(latest, ["image", "start", "bytenr", "generation"], "left_semi").filter("owner = 5").dropDuplicates(["image", "start", "inode", "kind", "parent", "name", "logical"])
    names = rows.filter("kind = 12 and parent <> inode").select("image", "start", F.when(F.col("parent") == 256, 0).otherwise(F.col("parent")).alias("parent"), F.col("inode").alias("child"), "name")
    runs = rows.filter("kind = 108 and physical > 0").select("image", "start", "inode", "logical", "physical", "length")
    return _with_paths(names, rows.filter("kind = 1").select("image", "start", "inode", "directory", "size", "modified"), runs, 0)


# ---- F2FS


@_safe
def f2fs_superblock(b: bytes) -> dict | None:
    if _u(b, 0, "I") != 0xF2F52010 or _u(b, 16, "I") != 12:
        return None
    return {"nat": _u(b, 84, "I"), "segments": _u(b, 60, "I"), "root": _u(b, 96, "I"), "blocks": _u(b, 36, "Q")}


@_safe
def f2fs_addresses(block: bytes) -> list[dict]:
    """Entries of a block of the address table that lead to a block: place in the table's block, inode, address."""
    out = []
    for i in range(455):
        inode, address = struct.unpack_from("<II", block, 9 * i + 1)
        if inode and address not in (0, 0xFFFFFFFF):
            out.append({"place": i, "owner": inode, "address": address})
    return out


@_safe
def f2fs_inode(b: bytes) -> dict | None:
    """An inode's block: its number stands twice in the footer; with its name, parent and direct blocks."""
    node, owner = struct.unpack_from("<II", b, 4072)
    mode = _u(b, 0, "H")
    if not node or node != owner or not mode:
        return None
    blocks = [] if b[3] & 0x0A else [{"logical": i, "physical": x, "length": 1} for i, x in enumerate(struct.unpack_from("<923I", b, 360)) if x and x != 0xFFFFFFFF]
    runs: list[dict] = []
    for r in blocks:  # neighbours become one run
        if runs and r["logical"] == runs[-1]["logical"] + runs[-1]["length"] and r["physical"] == runs[-1]["physical"] + runs[-1]["length"]:
            runs[-1]["length"] += 1
        else:
            runs.append(r)
    return {
        "inode": node, "directory": mode & 0xF000 == 0x4000, "size": _u(b, 16, "Q"), "modified": unix_time(_u(b, 48, "Q")), "parent": _u(b, 84, "I"),
        "name": b[92 : 92 + min(255, _u(b, 88, "I"))].decode("utf-8", "replace"), "runs": runs,
    }


def f2fs_files(blocks: DataFrame, volumes: DataFrame, step: int) -> DataFrame:
    """Files and directories of F2FS volumes(image, start): image, start, inode, path, name, directory, size, modified, runs (direct blocks
    only; none for data within the inode). The first copy of the address table tells where each inode lies; names and parents
    stand in the inodes."""
    heads = read_ranges(blocks, volumes.select("image", "start", (F.col("start") + 1024).alias("at"), F.lit(512).alias("size")), step)
    vol = settle(parsed(heads, f2fs_superblock, "nat long, segments long, root long, blocks long", ("image", "start")))
    # segments of the table come in pairs, of which the first is read: 512 blocks each
    each = vol.withColumn("n", F.explode(F.expr("sequence(0L, greatest(1L, segments div 2) * 512 - 1)")))
    place = F.col("nat") + F.expr("(n div 512) * 1024 + n % 512")
    table = read_ranges(blocks, each.select("image", "start", "n", "blocks", (F.col("start") + place * 4096).alias("at"), F.lit(4096).alias("size")), step)
    found = parsed(table, f2fs_addresses, "place long, owner long, address long", ("image", "start", "n", "blocks"))
    own = found.filter((F.col("n") * 455 + F.col("place") == F.col("owner")) & (F.col("address") < F.col("blocks")))
    nodes = read_ranges(blocks, own.select("image", "start", "owner", (F.col("start") + F.col("address") * 4096).alias("at"), F.lit(4096).alias("size")), step)
    rows = settle(parsed(nodes, f2fs_inode, f"inode long, directory boolean, size long, modified timestamp_ntz, parent long, name string, runs {RUNS}", ("image", "start", "owner")).filter("inode = owner"))
    rows = rows.join(vol.select("image", "start", "root"), ["image", "start"])
    names = rows.filter("inode <> root").select("image", "start", F.when(F.col("parent") == F.col("root"), 0).otherwise(F.col("parent")).alias("parent"), F.col("inode").alias("child"), "name")
    runs = rows.select("image", "start", "inode", F.explode("runs").alias("r")).select("image", "start", "inode", "r.*")
    return _with_paths(names, rows, runs, 0)


# ---- ZFS


@_safe
def zfs_dnode(b: bytes) -> dict | None:
    if not b[0]:
        return None
    return {"kind": b[0], "levels": b[2], "pointers": b[3], "bonus_kind": b[4], "checksum": b[5], "compress": b[6], "block": _u(b, 8, "H") * 512, "bonus": _u(b, 10, "H"), "last": _u(b, 16, "Q")}


@_safe
def zfs_micro_directory(b: bytes) -> list[dict]:
    """Names and numbers of a small directory object; the kind of an entry is in its top four bits."""
    if _u(b, 0, "Q") != 1 << 63 | 3:
        return []
    out = []
    for at in range(64, len(b) - 63, 64):
        name = b[at + 14 : at + 64].split(b"\0")[0]
        if name:
            value = _u(b, at, "Q")
            out.append({"name": name.decode("utf-8", "replace"), "child": value & (1 << 48) - 1, "directory": value >> 60 == 4})
    return out


# ---- backups


def _backup_attributes(blob: bytes | None) -> tuple[int | None, dt.datetime | None]:
    """Size and time of change in an archived record of a backup's file."""
    whole = plist(blob or b"")
    objects = whole.get("$objects") if isinstance(whole, dict) else None
    for o in objects if isinstance(objects, list) else []:
        if isinstance(o, dict) and "Size" in o and "LastModified" in o:
            return o["Size"], unix_time(o["LastModified"])
    return None, None


def backup_manifest(manifests: DataFrame) -> DataFrame:
    """(backup, file_id, domain, path, flags, size, modified) of manifests(backup, payload), SQLite databases with a table Files. One
    that can't be read has no rows. Flags: 1 file, 2 directory, 4 link."""
    names = ["backup", "file_id", "domain", "path", "flags", "size", "modified"]
    schema = "backup string, file_id string, domain string, path string, flags int, size long, modified timestamp_ntz"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.string(), pa.string(), pa.string(), pa.string(), pa.int32(), pa.int64(), pa.timestamp("us")]
        for batch in batches:
            for backup, payload in zip(batch.column("backup").to_pylist(), batch.column("payload").to_pylist()):
                if not (payload or b"").startswith(b"SQLite format 3\0"):
                    continue
                db = sqlite3.connect(":memory:")
                try:
                    db.deserialize(payload)
                    found = db.execute("SELECT fileID, domain, relativePath, flags, file FROM Files")
                    while part := found.fetchmany(5000):
                        rows = [(backup, *r[:4], *_backup_attributes(r[4])) for r in part]
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)
                except (sqlite3.Error, OverflowError, pa.ArrowInvalid):
                    pass
                finally:
                    db.close()

    return manifests.select("backup", "payload").mapInArrow(run, schema)


def listed(files: DataFrame, source: str) -> DataFrame:
    """The files of one of the systems above as rows of the catalogue; directories are left out."""
    have = lambda c, kind: F.col(c) if c in files.columns else F.lit(None).cast(kind)
    gone = have("deleted", "boolean")
    gone = gone if dict(files.dtypes).get("deleted", "boolean") == "boolean" else gone.isNotNull()
    place = F.coalesce(*[F.col(c).cast("string") for c in ("inode", "first") if c in files.columns])
    return as_files(
        files.filter(~F.col("directory")), id=F.concat_ws("_", F.lit(source), "image", F.col("start").cast("string"), place, F.xxhash64("path").cast("string")), source=F.lit(source), fileName="name",
        extension=F.lower(F.regexp_extract("name", r"\.([^.]*)$", 1)), size="size", offset=F.lit(0), modifiedTime=have("modified", "timestamp_ntz"), isDeleted=F.coalesce(gone, F.lit(False)), originalPath="path",
    )

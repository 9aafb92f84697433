"""From blocks of images to volumes, records and files: native conditions find the candidates, parsers read only those."""

from __future__ import annotations

import logging
import struct
from collections import OrderedDict
from collections.abc import Callable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from quarry.operators.joins import array_members, first_by, rebuild_paths
from quarry.schema import as_files
from quarry.sources import parsers

log = logging.getLogger(__name__)
PARTITION = "offset long, sectors long, type string, boot boolean, strategy int"


def starts_with(payload: str, at: int, magic: bytes) -> Column:
    """Whether the bytes at a place of a binary column are magic."""
    return F.substring(payload, at + 1, len(magic)) == F.lit(magic)


def volume_kinds(blocks: DataFrame) -> DataFrame:
    """(image, offset, kind) of blocks that begin a volume: one CASE over magics, no parsing. FAT needs its boot sector read."""
    kind = F.lit(None).cast("string")
    for name, at, magic in reversed(parsers.VOLUME_MAGICS):
        kind = F.when(starts_with("payload", at, magic), F.lit(name)).otherwise(kind)
    found = blocks.select("image", "offset", "payload", kind.alias("kind"))
    known = found.filter("kind is not null").select("image", "offset", "kind")
    boots = found.filter(F.col("kind").isNull() & starts_with("payload", 510, b"\x55\xaa")).select("image", "offset", "payload")
    fat = parsers.parsed(boots, parsers.fat_boot, "bits int").select("image", "offset", F.lit("fat").alias("kind"))
    return known.unionByName(fat)


def partitions(blocks: DataFrame, sector: int = 512, brute_force: bool = False) -> DataFrame:
    """(image, start, sectors, type, boot, strategy): master boot record, GPT (its backup only where the primary can't be
    read), and, if asked for, volumes found by magic. One row per start, of the first strategy that gives it.

    blocks must begin at sectors 0 and 1 and hold the entries; sector-sized blocks do.
    """
    one = blocks.filter(F.col("offset") == 0)
    boot = parsers.parsed(one, parsers.mbr, "type int, boot boolean, start long, sectors long")
    rows = boot.filter("type <> 238").select("image", (F.col("start") * sector).alias("start"), "sectors", F.col("type").cast("string").alias("type"), "boot", F.lit(0).alias("strategy"))
    heads = parsers.parsed(blocks.filter(starts_with("payload", 0, b"EFI PART")), parsers.gpt_header, "lba long, entries long, count int, size int")
    # the primary header stands first; the backup only counts without it
    head = first_by(heads, ["image"], [F.col("lba")])
    table = blocks.join(head.select("image", "entries", "count", "size"), "image")
    table = table.filter((F.col("offset") >= F.col("entries") * sector) & (F.col("offset") < F.col("entries") * sector + F.col("count") * F.col("size")))

    def entries(payload: bytes) -> list[dict]:
        left, size = struct.unpack_from(">II", payload)
        return parsers.gpt_entries(payload[8:], min(left, (len(payload) - 8) // max(128, size)), size)

    # the header says how large an entry is, and how many there are: both go before a block's bytes
    left = F.col("count") - F.floor((F.col("offset") - F.col("entries") * sector) / F.col("size")).cast("int")
    number = lambda c: F.unhex(F.lpad(F.hex(c), 8, "0"))
    table = table.filter("size >= 128").select("image", "offset", F.concat(number(left), number(F.col("size")), "payload").alias("payload"))
    gpt = parsers.parsed(table, entries, "type string, start long, end long")
    gpt = gpt.select("image", (F.col("start") * sector).alias("start"), (F.col("end") - F.col("start") + 1).alias("sectors"), "type", F.lit(False).alias("boot"), F.lit(1).alias("strategy"))
    all_ = [rows, gpt]
    if brute_force:
        all_.append(volume_kinds(blocks).select("image", F.col("offset").alias("start"), F.lit(0).cast("long").alias("sectors"), F.col("kind").alias("type"), F.lit(False).alias("boot"), F.lit(2).alias("strategy")))
    return first_by(reduce(DataFrame.unionByName, all_), ["image", "start"], [F.col("strategy"), F.col("type")])


MFT = """record long, sequence int, used boolean, directory boolean, base long, name string, parent long, size long,
runs array<struct<cluster:bigint,length:bigint>>, created timestamp_ntz, modified timestamp_ntz""".replace("\n", " ")


def _mft(payload: bytes) -> dict | None:
    r = parsers.mft_record(payload)
    return r and {**r, "runs": [{"cluster": c, "length": n} for c, n in r["runs"]]}


def mft_records(records: DataFrame) -> DataFrame:
    """File records of records(image, offset, payload), one to a row; extension records add their runs to the base record."""
    rows = parsers.parsed(records.filter(starts_with("payload", 0, b"FILE")), _mft, MFT)
    extra = rows.filter("base <> 0").groupBy("image", F.col("base").alias("record")).agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("record", "runs"))), lambda x: x["runs"])).alias("more"))
    none = F.expr("cast(array() as array<struct<cluster:bigint,length:bigint>>)")
    both = rows.filter("base = 0").join(extra, ["image", "record"], "left")
    return both.withColumn("runs", F.concat("runs", F.coalesce("more", none))).drop("more", "base")


def mft_files(records: DataFrame, root: int = 5) -> DataFrame:
    """Files of mft_records(), with rebuilt paths; entries of the system (below 24) are left out."""
    r = records.withColumn("child", F.concat_ws("|", "image", F.col("record").cast("string")))
    # paths of all images at once: the root of each is the one root
    up = F.when(F.col("parent") == root, F.lit("root")).otherwise(F.concat_ws("|", "image", F.col("parent").cast("string")))
    paths = rebuild_paths(r.filter(F.col("record") != root).select("child", up.alias("parent"), "name"), "root", 100).select("child", F.col("path").alias("_path"))
    d = r.filter("record >= 24 and not directory and name <> ''").join(paths, "child", "left")
    ext = F.lower(F.regexp_extract("name", r"\.([^.]*)$", 1))
    return as_files(
        d, id=F.concat(F.lit("ntfs_"), F.col("child")), source=F.lit("ntfs"), fileName="name", extension=ext, size="size", offset=F.lit(0), createdTime="created", modifiedTime="modified",
        isDeleted=~F.col("used"), originalPath="_path", confidence=F.when(F.size("runs") > 0, 0.9).otherwise(0.6),
    )


def deletions(journal: DataFrame) -> DataFrame:
    """First deletion of each (file, name) in journal(image, offset, payload)."""
    rows = parsers.parsed(journal, parsers.usn_records, "file long, parent long, usn long, time timestamp_ntz, reason long, name string")
    return first_by(rows.filter(F.col("reason").bitwiseAND(0x200) != 0), ["image", "file", "name"], [F.col("usn")])


def arrays(blocks: DataFrame) -> DataFrame:
    """Software arrays by the superblocks in blocks: see array_members()."""
    rows = parsers.parsed(blocks.filter(starts_with("payload", 0, b"\xfc\x4e\x2b\xa9")), parsers.mdadm_member, "uuid string, level int, disks int, role int")
    return array_members(rows.select("uuid", "role", F.col("image").alias("path")))


def best_uberblock(slots: DataFrame) -> DataFrame:
    """Of slots(image, slot, txg) the one with the greatest transaction group, the first of equal ones, of each image."""
    return first_by(slots, ["image"], [F.desc("txg"), F.col("slot")])


def scan(sources: dict[str, Callable[[], DataFrame]]) -> DataFrame:
    """The union of all sources' files; a source that can't be planned is logged and left out."""
    found = []
    for name, make in sources.items():
        try:
            found.append(as_files(d := make(), **{c: c for c in d.columns}))
        except Exception:
            log.exception("source %s is left out", name)
    if not found:
        raise ValueError("no source could be read")
    return reduce(DataFrame.unionByName, found)


def cache_counters(accesses: DataFrame, capacity: int, key: str = "sector", order: str = "seq", by: str = "reader") -> DataFrame:
    """hits, misses, puts and evictions of each reader's cache of capacity sectors, of which the least recently used goes first,
    from an access log: a sector that isn't there is read and put in. A task streams over sorted accesses and holds one cache."""
    kind = accesses.schema[by].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict = {}
        cache: OrderedDict = OrderedDict()
        now = object()
        for batch in batches:
            for reader, sector in zip(batch.column(by).to_pylist(), batch.column(key).to_pylist()):
                if reader != now:
                    cache, now = OrderedDict(), reader
                    counts[reader] = [0, 0, 0, 0]
                n = counts[reader]
                if sector in cache:
                    cache.move_to_end(sector)
                    n[0] += 1
                    continue
                n[1] += 1
                n[2] += 1
                if len(cache) >= capacity:
                    cache.popitem(last=False)
                    n[3] += 1
                cache[sector] = True
        names = [by, "hits", "misses", "puts", "evictions"]
        yield pa.RecordBatch.from_pydict({name: [x[i] for x in ([r, *c] for r, c in counts.items())] for i, name in enumerate(names)}, schema)

    schema = pa.schema([(by, to_arrow_type(accesses.schema[by].dataType)), *((c, pa.int64()) for c in ("hits", "misses", "puts", "evictions"))])
    dealt = accesses.select(by, order, key).repartition(by).sortWithinPartitions(by, order)
    return dealt.mapInArrow(run, f"`{by}` {kind}, hits long, misses long, puts long, evictions long")

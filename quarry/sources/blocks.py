"""Byte sources: disk images as rows of blocks.

`image_blocks` is a Python data source: one input partition for each range of blocks, so that a large image is read by many
tasks. A block that can't be read is filled with zeros where its sectors fail, and says so.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "image string, block long, offset long, own int, payload binary, bad array<struct<offset:bigint,length:bigint>>"
CHUNK = 8 << 20
SECTOR = 512


@dataclass
class Blocks(InputPartition):
    path: str
    begin: int
    end: int


def looks_like_device(path: str) -> bool:
    return path.startswith(("/dev/", "\\\\.\\", "//./"))


def read_resilient(read, offset: int, length: int, sector: int = SECTOR, retries: int = 2, most_skip: int = 1 << 20) -> tuple[bytes, list[tuple[int, int]]]:
    """Bytes of [offset, offset + length) and the ranges that are zeros because they can't be read.

    read(offset, length) returns bytes, fewer at the end, or raises OSError. After a failed read each sector is tried;
    after four in a row that fail, the next try is ever further on, twice as far each time, and what lies between is bad.
    """
    try:
        return read(offset, length), []
    except OSError:
        pass
    out, bad, at, run, skip = bytearray(), [], offset, 0, sector
    end = offset + length
    while at < end:
        n = min(sector, end - at)
        data = None
        for _ in range(retries):
            try:
                data = read(at, n)
                break
            except OSError:
                continue
        if data is not None:
            out += data
            if len(data) < n:
                break
            at, run, skip = at + n, 0, sector
            continue
        run += 1
        if run >= 4:
            n, skip = min(skip, end - at), min(2 * skip, most_skip)
        if bad and sum(bad[-1]) == at:
            bad[-1] = (bad[-1][0], bad[-1][1] + n)
        else:
            bad.append((at, n))
        out += bytes(n)
        at += n
    return bytes(out), bad


class _Reader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.chunk = int(options.get("blocksize", CHUNK))
        self.overlap = int(options.get("overlap", 0))
        self.per = int(options.get("blockspertask", 16))
        self.paths = [p for p in options.get("path", "").split(",") if p]
        if not self.paths or self.chunk < 1 or self.overlap < 0:
            raise ValueError("image_blocks needs path, blockSize > 0 and overlap >= 0")

    def partitions(self) -> list[InputPartition]:
        out: list[InputPartition] = []
        for p in self.paths:
            if looks_like_device(p):
                raise ValueError(f"a device is not read here; dump it to an image first: {p}")
            size = os.path.getsize(p)
            n = -(-size // self.chunk)
            out += [Blocks(p, a, min(a + self.per, n)) for a in range(0, n, self.per)]
        return out or [Blocks("", 0, 0)]

    def read(self, partition: Blocks) -> Iterator[tuple]:
        if not partition.path:
            return
        with open(partition.path, "rb", buffering=0) as f:

            def read(offset: int, length: int) -> bytes:
                f.seek(offset)
                parts = []
                while length and (part := f.read(length)):
                    parts.append(part)
                    length -= len(part)
                return b"".join(parts)

            for i in range(partition.begin, partition.end):
                data, bad = read_resilient(read, i * self.chunk, self.chunk + self.overlap)
                yield (partition.path, i, i * self.chunk, min(self.chunk, len(data)), data, bad)


class ImageBlocks(DataSource):
    @classmethod
    def name(cls) -> str:
        return "image_blocks"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader({k.lower(): v for k, v in self.options.items()})


def image_blocks(spark: SparkSession, paths: list[str], block_size: int = CHUNK, overlap: int = 0) -> DataFrame:
    """Blocks of images in a file system that all executors mount; see binary_files() for other stores."""
    spark.dataSource.register(ImageBlocks)
    return spark.read.format("image_blocks").option("path", ",".join(paths)).option("blockSize", block_size).option("overlap", overlap).load()


def binary_files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(image, offset, payload, modified, length) of whole files in any store that Spark reads."""
    d = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path)
    return d.select(F.col("path").alias("image"), F.expr("0L").alias("offset"), F.col("content").alias("payload"), F.col("modificationTime").alias("modified"), "length")


def text_blocks(df: DataFrame, image, text: str) -> DataFrame:
    """Texts as blocks of their own."""
    return df.select(image.cast("string").alias("image"), F.expr("0L").alias("offset"), F.encode(text, "UTF-8").alias("payload"))


def bad_ranges(blocks: DataFrame) -> DataFrame:
    """(image, offset, length): failed ranges, neighbours merged: gaps and islands within an image."""
    from pyspark.sql import Window

    w = Window.partitionBy("image").orderBy("offset")
    r = blocks.select("image", F.explode("bad").alias("b")).select("image", "b.offset", "b.length").distinct()
    r = r.withColumn("end", F.col("offset") + F.col("length"))
    r = r.withColumn("new", (F.col("offset") > F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))).cast("int"))
    r = r.withColumn("island", F.sum(F.coalesce("new", F.lit(1))).over(w))
    return r.groupBy("image", "island").agg(F.min("offset").alias("offset"), (F.max("end") - F.min("offset")).alias("length")).drop("island")


def too_bad(blocks: DataFrame, share: float = 0.1):
    """Whether more than share of the bytes could not be read: a dump stops then."""
    return blocks.agg((F.sum(F.aggregate("bad", F.expr("0L"), lambda a, b: a + b["length"])) > F.sum("own") * share).alias("abort"))

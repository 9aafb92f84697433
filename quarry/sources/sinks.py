"""Outputs: reports, timelines, manifests, custody, and recovered payloads."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.operators import timeline as times
from quarry.operators.aggregates import state_summary

BOM = "﻿"


def csv_report(records: DataFrame, path: str) -> None:
    """One CSV file with a header that begins with a byte-order mark; an empty report is an error."""
    if records.isEmpty():
        raise ValueError("nothing to report")
    first = records.columns[0]
    records.withColumnRenamed(first, BOM + first).coalesce(1).write.mode("overwrite").csv(path, header=True)


def manifest(records: DataFrame, files: DataFrame, confidence: str = "confidence") -> DataFrame:
    """One JSON document a row: each record with its file's hash and source."""
    f = files.select(F.col("id").alias("_id"), "sha256", F.col("source").alias("source"), "originalPath", "confidence")
    r = records.join(f, records["fileId"] == f["_id"], "left").drop("_id")
    return r.select(F.to_json(F.struct(*r.columns)).alias("json"))


def manifest_summary(records: DataFrame, files: DataFrame) -> DataFrame:
    f = files.select(F.col("id").alias("_id"), "confidence")
    return state_summary(records.join(f, records["fileId"] == f["_id"], "left"))


def body_file(timeline: DataFrame, path: str) -> None:
    timeline.orderBy("time", "id", "action").select(times.mactime().alias("value")).write.mode("overwrite").text(path)


def json_lines(timeline: DataFrame, path: str) -> None:
    timeline.write.mode("overwrite").json(path)


def dfxml(files: DataFrame, path: str) -> None:
    """File objects with a byte run where the size is positive, by Spark's XML writer."""
    run = F.when(F.col("size") > 0, F.struct(F.col("offset").alias("_img_offset"), F.col("size").alias("_len")))
    rows = files.select(
        F.coalesce(F.nullif("originalPath", F.lit("")), "fileName").alias("filename"), F.col("size").alias("filesize"), F.struct(run.alias("byte_run")).alias("byte_runs"),
        F.col("sha256").alias("hashdigest"), F.date_format("modifiedTime", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("mtime"), F.when(F.col("isDeleted"), 0).otherwise(1).alias("alloc"),
    )
    rows.write.mode("overwrite").format("xml").option("rootTag", "dfxml").option("rowTag", "fileobject").save(path)


def custody(files: DataFrame) -> DataFrame:
    """files(path, payload or sha256, size) hashed, and one digest over all of them in order of path.

    The digest is a hash of the hashes of the ranges of paths, so that no task holds the list: (path, sha256, size) rows, and
    see custody_digest().
    """
    digest = F.col("sha256") if "sha256" in files.columns else F.sha2("payload", 256)
    return files.select("path", digest.alias("sha256"), F.col("size").cast("long").alias("size"))


def custody_digest(rows: DataFrame, per_bucket: int = 10_000) -> DataFrame:
    """One row: sha256 over the buckets' digests, and the number of buckets; a bucket, by hash of the path, has about per_bucket files
    and is hashed over its lines in order of path, so that no task holds the list. The same rows give the same digest."""
    buckets = max(1, -(-rows.count() // per_bucket))
    line = F.concat_ws("|", "path", "sha256", F.col("size").cast("string"))
    b = rows.select(F.pmod(F.xxhash64("path"), F.lit(buckets)).alias("b"), "path", line.alias("line"))
    per = b.groupBy("b").agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("path", "line"))), lambda x: x["line"]), "\n"), 256).alias("d"))
    return per.agg(F.sha2(F.concat_ws("\n", F.transform(F.array_sort(F.collect_list(F.struct("b", "d"))), lambda x: x["d"])), 256).alias("digest"), F.count(F.lit(1)).alias("buckets"))


def custody_mismatches(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """Files of expected(path, sha256, size) that are missing or differ in actual."""
    a = actual.select(F.col("path").alias("_p"), F.lower("sha256").alias("_h"), F.col("size").alias("_s"))
    both = expected.join(a, expected["path"] == a["_p"], "left")
    kind = F.when(F.col("_p").isNull(), "missing").when(F.lower("sha256") != F.col("_h"), "hash").when(F.col("size") != F.col("_s"), "size")
    return both.select("path", kind.alias("problem")).filter("problem is not null")


def assemble(extents: DataFrame, blocks: DataFrame, cluster: int) -> DataFrame:
    """(file_id, payload) from extents(file_id, seq, cluster_offset, cluster_count, sparse, size) and blocks(cluster, payload): runs in
    order, sparse ones as zeros, cut at the file's size. One file is one group; a block is joined where it is used."""
    runs = extents.withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.col("cluster_count") - 1)))
    at = runs.select("file_id", "size", "seq", "k", F.when(~F.col("sparse"), F.col("cluster_offset") + F.col("k")).alias("cluster"))
    parts = at.join(blocks.select(F.col("cluster").alias("_c"), "payload"), F.col("cluster") == F.col("_c"), "left")
    kind = extents.schema["file_id"].dataType.simpleString()

    def join(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["seq", "k"])
        data = b"".join((bytes(p) if p is not None else b"").ljust(cluster, b"\0")[:cluster] for p in pdf["payload"])
        return pd.DataFrame({"file_id": [pdf["file_id"].iloc[0]], "payload": [data[: int(pdf["size"].iloc[0])]]})

    return parts.select("file_id", "size", "seq", "k", "payload").groupBy("file_id").applyInPandas(join, f"file_id {kind}, payload binary")


def write_payloads(files: DataFrame, folder: str) -> DataFrame:
    """Writes files(path, payload) below a folder that all executors mount, and returns (path, sha256, size, ok): a file is
    written beside its place, checked by its hash, and moved."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import hashlib
        import os

        for pdf in batches:
            rows = []
            for path, data in zip(pdf["path"], pdf["payload"]):
                target = os.path.normpath(os.path.join(folder, path.lstrip("/")))
                if not target.startswith(os.path.normpath(folder) + os.sep):
                    rows.append((path, None, 0, False))
                    continue
                os.makedirs(os.path.dirname(target), exist_ok=True)
                part = f"{target}.part{os.getpid()}"
                with open(part, "wb") as f:
                    f.write(data)
                want = hashlib.sha256(data).hexdigest()
                with open(part, "rb") as f:
                    ok = hashlib.sha256(f.read()).hexdigest() == want
                os.replace(part, target)
                rows.append((path, want, len(data), ok))
            yield pd.DataFrame(rows, columns=["path", "sha256", "size", "ok"])

    return files.select("path", "payload").mapInPandas(run, "path string, sha256 string, size long, ok boolean")

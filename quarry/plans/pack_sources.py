"""Queries that write rows of the tables as structures of file systems, records and reports, and read them back with the parsers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions import scalar
from quarry.operators import joins, stitch
from quarry.plans.pack_bytes import _bytes, _number
from quarry.plans.registry import query
from quarry.plans.tables import load
from quarry.runtime import scratch, settle
from quarry.sources import filesystems, parsers, signatures, sinks, volumes


def _utf16(text: str) -> str:
    """SQL of an ASCII text in UTF-16LE."""
    return f"unhex(regexp_replace(hex({text}), '(..)', '$100'))"


def _le(x: str, size: int = 4) -> str:
    return _number(x, "little", size)


@query(
    "scan_usn_deletions",
    """SELECT user_id AS file, event_type AS name, min(event_id) AS usn, user_id % 100 + 5 AS parent FROM events WHERE event_type IN ('error', 'signup') GROUP BY user_id, event_type""",
)
def scan_usn_deletions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as records of a change journal; two kinds of them are deletions."""
    reason = "CASE WHEN event_type IN ('error', 'signup') THEN 512 ELSE 256 END"
    record = _bytes(
        _le("60 + 2 * length(event_type)"), b"\2\0\0\0", _le("user_id", 8), _le("user_id % 100 + 5", 8), _le("event_id", 8), _le("133500000000000000", 8), _le(reason), bytes(12), _le("2 * length(event_type)", 2),
        b"\x3c\0", _utf16("event_type"),
    )
    d = load(spark, sf_dir, "events").selectExpr("'disk' AS image", "event_id * 128 AS offset", f"{record} AS payload")
    return volumes.deletions(d).select("file", "name", "usn", "parent")


@query(
    "scan_fat_entries",
    """SELECT o_orderkey, concat('F', lpad(CAST(o_orderkey AS STRING), 7, '0'), '.', CASE WHEN o_orderkey % 3 = 0 THEN 'JPG' ELSE 'TXT' END) AS name, o_orderkey % 5 = 0 AS directory,
    CAST(o_custkey + 2 AS BIGINT) AS first, CAST(o_orderkey * 7 AS BIGINT) AS size FROM orders""",
)
def scan_fat_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = "encode(concat('F', lpad(CAST(o_orderkey AS STRING), 7, '0'), CASE WHEN o_orderkey % 3 = 0 THEN 'JPG' ELSE 'TXT' END), 'UTF-8')"
    kind = "CASE WHEN o_orderkey % 5 = 0 THEN X'10' ELSE X'20' END"
    entry = _bytes(name, kind, bytes(8), _le("(o_custkey + 2) div 65536", 2), bytes(4), _le("(o_custkey + 2) % 65536", 2), _le("o_orderkey * 7"))
    d = load(spark, sf_dir, "orders").selectExpr("o_orderkey", f"{entry} AS payload")
    return parsers.parsed(d, parsers.fat_directory, "name string, directory boolean, first long, size long", ("o_orderkey",))


@query(
    "scan_exfat_sets",
    """SELECT doc_id, concat('document ', CAST(doc_id AS STRING), '.', lang) AS name, doc_id % 4 = 1 AS deleted, doc_id % 2 = 0 AS contiguous, doc_id + 2 AS first, CAST(n_chars AS BIGINT) AS size FROM documents WHERE lang IS NOT NULL""",
)
def scan_exfat_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    live = lambda a, b: f"CASE WHEN doc_id % 4 = 1 THEN X'{a.hex()}' ELSE X'{b.hex()}' END"
    name = "concat('document ', CAST(doc_id AS STRING), '.', lang)"
    part = lambda i: _bytes(live(b"\x41\0", b"\xc1\0"), f"substring(rpad({_utf16(name)}, 60, X'00'), {30 * i + 1}, 30)")
    flags = "CASE WHEN doc_id % 2 = 0 THEN X'03' ELSE X'01' END"
    entry = _bytes(live(b"\5\3", b"\x85\3"), bytes(2), b"\x20\0", bytes(26), live(b"\x40", b"\xc0"), flags, bytes(1), _number(f"length({name})", "little", 1), bytes(16), _le("doc_id + 2"), _le("n_chars", 8), part(0), part(1))
    d = load(spark, sf_dir, "documents").filter("lang IS NOT NULL").selectExpr("doc_id", f"{entry} AS payload")
    return parsers.parsed(d, filesystems.exfat_directory, "name string, deleted boolean, contiguous boolean, first long, size long", ("doc_id",))


@query(
    "scan_ext_runs",
    "SELECT o_orderkey AS inode, CAST(0 AS BIGINT) AS logical, CAST(o_custkey AS BIGINT) AS physical, CAST(1 + o_orderkey % 9 AS BIGINT) AS length FROM orders UNION ALL SELECT o_orderkey, 100, o_custkey + 50000, 3 FROM orders",
)
def scan_ext_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extents of inodes, packed into the nodes that they hold themselves."""
    node = _bytes(b"\x0a\xf3\2\0\4\0\0\0\0\0\0\0", _le("0"), _le("1 + o_orderkey % 9", 2), b"\0\0", _le("o_custkey"), _le("100"), b"\3\0\0\0", _le("o_custkey + 50000"), bytes(24))
    d = load(spark, sf_dir, "orders").selectExpr("'disk' AS image", "0L AS start", "o_orderkey AS inode", "1024L AS block", "true AS extents", f"{node} AS node")
    blocks = spark.createDataFrame([], "image string, offset long, payload binary")
    return filesystems.ext_runs(d, blocks, 1024).select("inode", "logical", "physical", "length")


@query(
    "scan_object_map",
    "SELECT l_partkey AS oid, max(l_orderkey * 10 + l_linenumber) AS xid, arg_max(CAST(l_suppkey AS BIGINT), l_orderkey * 10 + l_linenumber) AS paddr FROM lineitem GROUP BY l_partkey",
)
def scan_object_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = load(spark, sf_dir, "lineitem").selectExpr("'disk' AS image", "0L AS start", "l_partkey AS oid", "l_orderkey * 10 + l_linenumber AS xid", "CAST(l_suppkey AS BIGINT) AS paddr")
    return filesystems.object_map(d).select("oid", "xid", "paddr")


@query("scan_uberblock", "SELECT user_id % 7 AS image, max(event_id // 3) AS txg, min(event_id) FILTER (WHERE event_id // 3 = m) AS slot FROM (SELECT *, max(event_id // 3) OVER (PARTITION BY user_id % 7) AS m FROM events) GROUP BY user_id % 7")
def scan_uberblock(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = load(spark, sf_dir, "events").selectExpr("user_id % 7 AS image", "event_id AS slot", "event_id div 3 AS txg")
    return volumes.best_uberblock(d).select("image", "txg", "slot")


@query(
    "join_file_rows",
    """WITH e AS (SELECT o_orderkey, l_linenumber, l_partkey, l_suppkey FROM orders JOIN lineitem ON l_orderkey = o_orderkey), r AS (SELECT o_orderkey, string_agg(concat(CAST(l_linenumber AS STRING), ':', CAST(l_partkey AS STRING)), ' ' ORDER BY l_linenumber, l_partkey) AS runs FROM e GROUP BY o_orderkey)
    SELECT o.o_orderkey AS inode, concat('c', CAST(o_custkey AS STRING)) AS name, o_orderstatus AS status, runs FROM orders o LEFT JOIN r USING (o_orderkey)""",
)
def join_file_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = load(spark, sf_dir, "orders")
    extents = load(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("inode"), F.col("l_linenumber").alias("logical"), F.col("l_partkey").alias("physical"), F.col("l_suppkey").alias("length"))
    got = joins.file_rows(o.select(F.col("o_orderkey").alias("inode"), F.col("o_orderstatus").alias("status")), o.select(F.col("o_orderkey").alias("inode"), F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("name")), extents, "inode")
    runs = F.array_join(F.transform("extents", lambda x: F.concat_ws(":", x["logical"].cast("string"), x["physical"].cast("string"))), " ")
    return got.select("inode", "name", "status", runs.alias("runs"))


@query(
    "join_slot_digest",
    "SELECT p_partkey AS slot, min(l_orderkey) AS digest FROM part LEFT JOIN lineitem ON l_partkey = p_partkey GROUP BY p_partkey",
)
def join_slot_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    digests = load(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("digest")).agg(F.collect_set("l_partkey").alias("slots"))  # the lines of one order
    return joins.slot_digest(load(spark, sf_dir, "part").select(F.col("p_partkey").alias("slot")), digests)


@query("fn_guid", "SELECT doc_id, upper(concat(h[7:8], h[5:6], h[3:4], h[1:2], '-', h[11:12], h[9:10], '-', h[15:16], h[13:14], '-', h[17:20], '-', h[21:32])) AS guid FROM (SELECT doc_id, md5(source) AS h FROM documents WHERE source IS NOT NULL)")
def fn_guid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "documents").filter("source IS NOT NULL").select("doc_id", scalar.guid_text(F.unhex(F.md5("source"))).alias("guid"))


@query("fn_utf16", "SELECT c_custkey, c_name AS name FROM customer")
def fn_utf16(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "customer").selectExpr("c_custkey", f"concat({_utf16('c_name')}, X'00004142') AS b").select("c_custkey", scalar.utf16le("b").alias("name"))


@query(
    "fn_dos_time",
    "SELECT o_orderkey, CASE WHEN o_orderkey % 11 <> 0 THEN make_timestamp(1990 + o_orderkey % 30, 1 + o_orderkey % 12, 1 + o_orderkey % 28, o_orderkey % 24, o_orderkey % 60, 2.0 * (o_orderkey % 30)) END AS t FROM orders",
)
def fn_dos_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    date = F.when(k % 11 != 0, (k % 30 + 10) * 512 + (k % 12 + 1) * 32 + k % 28 + 1).otherwise(0).cast("int")
    time = ((k % 24) * 2048 + (k % 60) * 32 + k % 30).cast("int")
    return load(spark, sf_dir, "orders").select("o_orderkey", scalar.dos_datetime(date, time).alias("t"))


@query("fn_ids", "SELECT event_id, concat('ntfs_', upper(to_hex(event_id * 4096)), '_', CAST(user_id AS STRING)) AS ntfs, concat('carve_', CAST(event_id AS STRING)) AS carve FROM events")
def fn_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "events").select("event_id", scalar.ntfs_file_id(F.col("event_id") * 4096, "user_id").alias("ntfs"), scalar.carve_file_id("event_id").alias("carve"))


@query(
    "signature_catalogue",
    "SELECT * FROM (VALUES " + ", ".join(f"('{e}', '{c}', {len(h.split())}, {len(f.split())}, CAST({mb} AS BIGINT) * 1048576)" for e, c, h, f, mb in signatures.SIGNATURES) + ") t(extension, category, headers, footers, max_size)",
)
def signature_catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signatures.table(spark).select("extension", "category", F.size("headers").alias("headers"), F.size("footers").alias("footers"), "max_size")


@query(
    "custody_check",
    "SELECT concat('d/', CAST(doc_id AS STRING)) AS path, CASE WHEN doc_id % 13 = 0 THEN 'missing' WHEN doc_id % 11 = 0 THEN 'hash' ELSE 'size' END AS problem FROM documents WHERE doc_id % 13 = 0 OR doc_id % 11 = 0 OR doc_id % 7 = 0",
)
def custody_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = load(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("d/"), F.col("doc_id").cast("string")).alias("path"), F.encode("text", "UTF-8").alias("payload"), F.length("text").alias("size"))
    changed = F.when(F.col("doc_id") % 11 == 0, F.concat("payload", F.lit(b"!"))).otherwise(F.col("payload"))
    now = d.filter(F.col("doc_id") % 13 != 0).select("path", changed.alias("payload"), F.when(F.col("doc_id") % 7 == 0, F.col("size") + 1).otherwise(F.col("size")).alias("size"))
    return sinks.custody_mismatches(sinks.custody(d.select("path", "payload", "size")), sinks.custody(now))


@query("report_csv", "SELECT o_orderkey, concat(o_orderstatus, ',\"', o_orderpriority, '\"') AS note FROM orders")
def report_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A report written and read again, with its mark and its quotes."""
    path = scratch(spark)
    note = F.concat("o_orderstatus", F.lit(',"'), "o_orderpriority", F.lit('"'))
    sinks.csv_report(load(spark, sf_dir, "orders").select("o_orderkey", note.alias("note")), path)
    back = spark.read.option("header", True).option("escape", "\\").csv(path)
    return back.select(F.col(back.columns[0]).cast("long").alias("o_orderkey"), F.col("note"))


@query("runs_assembled", "SELECT doc_id AS file_id, sha256(text) AS sha256 FROM documents WHERE octet_length(encode(text)) > 0")
def runs_assembled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts cut into clusters that lie anywhere, put together again by their runs."""
    size = 512
    d = load(spark, sf_dir, "documents").select(F.col("doc_id").alias("file_id"), F.encode("text", "UTF-8").alias("payload")).withColumn("size", F.length("payload").cast("long")).filter("size > 0")
    one = d.withColumn("seq", F.explode(F.expr(f"sequence(0, CAST((size - 1) div {size} AS INT))")))
    parts = one.select("file_id", "seq", "size", (F.col("file_id") * 1_000_000 + F.col("seq") * 17 % 1009 * 1000 + F.col("seq")).alias("cluster"), F.expr(f"substring(payload, seq * {size} + 1, {size})").alias("payload"))
    parts = settle(parts)
    extents = parts.select("file_id", "seq", F.col("cluster").alias("cluster_offset"), F.lit(1).cast("long").alias("cluster_count"), F.lit(False).alias("sparse"), "size")
    return sinks.assemble(extents, parts.select("cluster", "payload"), size).select("file_id", F.sha2("payload", 256).alias("sha256"))


@query(
    "stitch_png",
    "SELECT doc_id, CAST(octet_length(encode(text)) + 57 AS BIGINT) AS size, CASE WHEN doc_id % 3 = 0 THEN 1 ELSE 0 END AS breaks, true AS whole FROM documents",
)
def stitch_png(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts as chunks of a PNG; in every third foreign bytes stand before the text."""
    chunk = lambda kind, body: _bytes(_number(f"length({body})"), kind, body, _number(f"crc32(concat(X'{kind.hex()}', {body}))"))
    text, gap = "encode(text, 'UTF-8')", "CASE WHEN doc_id % 3 = 0 THEN encode(repeat('foreign ', 50), 'UTF-8') ELSE X'' END"
    file = _bytes(b"\x89PNG\r\n\x1a\n", chunk(b"IHDR", "X'00000001000000010802000000'"), gap, chunk(b"IDAT", text), chunk(b"IEND", "X''"))
    got = stitch.stitched(load(spark, sf_dir, "documents").selectExpr("doc_id", "'png' AS extension", f"{file} AS payload"))
    return got.select("doc_id", F.length("payload").cast("long").alias("size"), "breaks", "whole")

"""Queries with an order: windows, sorting and paging, buckets, timelines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.operators import buckets, timeline, windows
from quarry.operators.aggregates import with_empty
from quarry.plans.pack_catalogue import _PATH, _SCORE, _SYSTEM
from quarry.plans.registry import query
from quarry.plans.tables import FILES_SQL, files, load

_NOW = "2024-12-31 00:00:00"
_BUCKET = f"""CASE WHEN {_SYSTEM} THEN NULL WHEN contains({_PATH}, 'windows.old/') THEN 'windowsOld' WHEN contains({_PATH}, '/desktop/') OR starts_with({_PATH}, 'desktop/') THEN 'desktop'
    WHEN category = 'image' THEN 'photos' WHEN category = 'document' THEN 'documents' WHEN modifiedTime >= TIMESTAMP '{_NOW}' - INTERVAL 30 DAYS THEN 'recent' ELSE 'other' END"""


def _now():
    return F.lit(_NOW).cast("timestamp_ntz")


@query("bucket_priority", f"WITH {FILES_SQL} SELECT id, {_BUCKET} AS bucket FROM files")
def bucket_priority(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files(spark, sf_dir).select("id", buckets.bucket(_now()).alias("bucket"))


@query(
    "bucket_topk",
    f"""WITH {FILES_SQL}, b AS (SELECT id, seq, {_BUCKET} AS bucket, {_SCORE} AS score FROM files)
    SELECT bucket, row_number() OVER (PARTITION BY bucket ORDER BY score DESC, seq) AS rank, id, score FROM b WHERE bucket IS NOT NULL
    QUALIFY rank <= CASE WHEN bucket = 'photos' THEN 4 ELSE 3 END""",
)
def bucket_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return buckets.peek(files(spark, sf_dir), _now())


@query(
    "bucket_counts",
    f"""WITH {FILES_SQL}, b AS (SELECT size, {_BUCKET} AS bucket FROM files), k(bucket) AS (VALUES ('windowsOld'), ('desktop'), ('photos'), ('documents'), ('recent'), ('other'))
    SELECT k.bucket, count(b.bucket) AS n, CAST(coalesce(sum(size), 0) AS BIGINT) AS bytes FROM k LEFT JOIN b USING (bucket) GROUP BY k.bucket""",
)
def bucket_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = spark.createDataFrame([(b,) for b in buckets.BUCKETS], "bucket string")
    return with_empty(files(spark, sf_dir).withColumn("bucket", buckets.bucket(_now())), keys, "bucket", {"bytes": F.sum("size")})


@query("sort_page", "SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber LIMIT 200 OFFSET 200")
def sort_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = load(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice")
    return windows.page(d, [F.desc("l_extendedprice"), "l_orderkey", "l_linenumber"], 2)


@query("sort_source_priority", f"WITH {FILES_SQL} SELECT id, row_number() OVER (PARTITION BY category ORDER BY source <> 'ntfs', seq) AS place FROM files")
def sort_source_priority(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.numbered_ranges(files(spark, sf_dir).select("id", "category", "source", "seq"), ["category"], [F.col("source") != "ntfs", "seq"], "place").select("id", "place")


@query("win_seq_ext", f"WITH {FILES_SQL} SELECT id, extension, row_number() OVER (PARTITION BY extension ORDER BY \"offset\") AS seq FROM files")
def win_seq_ext(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.numbered_ranges(files(spark, sf_dir).select("id", "extension", "offset"), ["extension"], ["offset"]).select("id", "extension", "seq")


@query(
    "win_batch_500",
    "SELECT l_orderkey, l_linenumber, (row_number() OVER (PARTITION BY l_shipdate ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey) - 1) // 500 + 1 AS batch FROM lineitem",
)
def win_batch_500(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = load(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate")
    return windows.batches(d, ["l_shipdate"], ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]).select("l_orderkey", "l_linenumber", "batch")


@query(
    "win_output_path",
    f"""WITH {FILES_SQL}, b AS (SELECT *, (row_number() OVER (PARTITION BY coalesce(isValid, false) AND confidence >= 0.5, category ORDER BY seq) - 1) // 500 + 1 AS batch FROM files)
    SELECT id, concat_ws('/', CASE WHEN NOT (coalesce(isValid, false) AND confidence >= 0.5) THEN 'low_confidence' END, category, concat('batch_', lpad(CAST(batch AS STRING), 3, '0')), fileName) AS path FROM b""",
)
def win_output_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = files(spark, sf_dir).select("id", "seq", "category", "fileName", "isValid", "confidence").withColumn("good", F.coalesce("isValid", F.lit(False)) & (F.col("confidence") >= 0.5))
    b = windows.batches(d, ["good", "category"], ["seq"])
    return b.select("id", windows.output_path(F.col("isValid"), F.col("confidence"), F.col("category"), F.col("batch"), F.col("fileName")).alias("path"))


_USER = "PARTITION BY user_id ORDER BY ts, event_id"


@query(
    "win_progress_merge",
    f"""SELECT event_id, user_id, last_value(nullif(files, 0) IGNORE NULLS) OVER ({_USER} ROWS UNBOUNDED PRECEDING) AS files
    FROM (SELECT event_id, user_id, ts, CASE WHEN event_id % 3 = 0 THEN event_id * 2 ELSE 0 END AS files FROM events)""",
)
def win_progress_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = load(spark, sf_dir, "events").select("event_id", "user_id", "ts", F.when(F.col("event_id") % 3 == 0, F.col("event_id") * 2).otherwise(0).alias("files"))
    return windows.carried(e, ["user_id"], ["ts", "event_id"], ["files"]).select("event_id", "user_id", "files")


_SPEED = f"""d AS (SELECT event_id, user_id, ts, (epoch_us(ts) - lag(epoch_us(ts)) OVER ({_USER})) / 1e6 AS dt, value - lag(value) OVER ({_USER}) AS da FROM events),
    s AS (SELECT event_id, user_id, ts, last_value(CASE WHEN dt > 0.1 THEN da / dt END IGNORE NULLS) OVER ({_USER} ROWS UNBOUNDED PRECEDING) AS speed FROM d)"""


def _speeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = load(spark, sf_dir, "events").select("event_id", "user_id", "ts", "value")
    return windows.speed(e, ["user_id"], ["ts", "event_id"], F.unix_micros(F.col("ts").cast("timestamp")), F.col("value"))


@query("win_speed", f"WITH {_SPEED} SELECT event_id, round(speed, 6) + 0.0 AS speed FROM s")
def win_speed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _speeds(spark, sf_dir).select("event_id", (F.round("speed", 6) + 0.0).alias("speed"))


@query(
    "win_slow_drive",
    f"""WITH e AS (SELECT *, CASE WHEN value < 25 THEN 1 ELSE 0 END AS slow FROM events WHERE value > 0),
    i AS (SELECT *, sum(1 - slow) OVER ({_USER} ROWS UNBOUNDED PRECEDING) AS island FROM e),
    r AS (SELECT *, sum(slow) OVER (PARTITION BY user_id, island ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS run FROM i)
    SELECT user_id, event_id, ts FROM r WHERE run = 6 AND slow = 1 QUALIFY row_number() OVER ({_USER}) = 1""",
)
def win_slow_drive(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = load(spark, sf_dir, "events").select("user_id", "event_id", "ts", "value")
    return windows.slow_alarm(e, ["user_id"], ["ts", "event_id"], "value", 25.0, 6).select("user_id", "event_id", "ts")


@query(
    "win_prefix_pos",
    """SELECT l_orderkey, l_linenumber, CAST(coalesce(sum(CAST(l_quantity AS BIGINT)) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start FROM lineitem""",
)
def win_prefix_pos(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = load(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.col("l_quantity").cast("long").alias("len"))
    return windows.prefix_sum(d, ["l_orderkey"], ["l_linenumber", "l_partkey", "l_suppkey"], "len", "start").select("l_orderkey", "l_linenumber", "start")


@query(
    "win_phase_percent",
    f"""WITH p(phase, b, e) AS (VALUES ('view', 0.0, 40.0), ('click', 40.0, 90.0), ('error', 90.0, 100.0))
    SELECT event_id, round(max(CAST(b + (e - b) * least(greatest(value, 0), 100) / 100 AS DOUBLE)) OVER ({_USER} ROWS UNBOUNDED PRECEDING), 6) AS overall FROM events JOIN p ON event_type = phase""",
)
def win_phase_percent(spark: SparkSession, sf_dir: str) -> DataFrame:
    phases = spark.createDataFrame([("view", 0.0, 40.0), ("click", 40.0, 90.0), ("error", 90.0, 100.0)], "phase string, begin double, end double")
    e = load(spark, sf_dir, "events").select("event_id", "user_id", "ts", F.col("event_type").alias("phase"), F.col("value").alias("percent"))
    return windows.phase_percent(e, phases, ["user_id"], ["ts", "event_id"]).select("event_id", F.round("overall", 6).alias("overall"))


@query(
    "win_throttle",
    """SELECT event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS n, count(*) OVER (PARTITION BY event_type) AS c FROM events) WHERE n = 1 OR n = c OR n % 500 = 0""",
)
def win_throttle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.throttled(load(spark, sf_dir, "events").select("event_id", "event_type", "ts"), ["ts", "event_id"], 500, ("event_type",)).select("event_id", "event_type")


_EVENTS = f"""{FILES_SQL}, t AS (
    SELECT modifiedTime AS time, 'modified' AS action, id, fileName, originalPath AS filePath, size, source, isDeleted FROM files WHERE modifiedTime IS NOT NULL
    UNION ALL SELECT createdTime, 'created', id, fileName, originalPath, size, source, isDeleted FROM files WHERE createdTime IS NOT NULL
    UNION ALL SELECT TIMESTAMP '{_NOW}', 'found', id, fileName, originalPath, size, source, isDeleted FROM files WHERE modifiedTime IS NULL AND createdTime IS NULL)"""


@query("timeline_events", f"WITH {_EVENTS} SELECT * FROM t")
def timeline_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timeline.ordered(timeline.events(files(spark, sf_dir), _now()))


@query(
    "timeline_mactime",
    f"""WITH {_EVENTS} SELECT concat(strftime(time, '%Y-%m-%dT%H:%M:%SZ'), '|', CAST(size AS STRING), '|', CASE action WHEN 'modified' THEN 'm..' WHEN 'created' THEN '..b' WHEN 'found' THEN 'X..X' END,
    '|0|0|0|0|', CASE WHEN filePath = '' THEN fileName ELSE filePath END, CASE WHEN isDeleted THEN ' (deleted)' ELSE '' END) AS line FROM t""",
)
def timeline_mactime(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timeline.events(files(spark, sf_dir), _now()).select(timeline.mactime().alias("line"))

"""Queries over streams, drained to the end."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.plans.registry import query
from quarry.plans.tables import load
from quarry.runtime import scratch
from quarry.streaming import streams


def _stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table as a stream: a glob, since the source lists folders."""
    return streams.read_files(spark, f"{sf_dir}/events.parquet*", load(spark, sf_dir, "events").schema)


@query(
    "stream_batcher",
    "SELECT event_id, user_id, (row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1) // 20 + 1 AS batch FROM events",
)
def stream_batcher(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _stream(spark, sf_dir).select("event_id", "user_id", "ts")
    return streams.drain(streams.batched(s, "user_id", ["ts", "event_id"], 20)).select("event_id", "user_id", "batch")


@query("stream_dedupe_watermark", "SELECT DISTINCT user_id, event_type FROM events")
def stream_dedupe_watermark(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = streams.with_time(_stream(spark, sf_dir), "ts", "60 days")
    return streams.drain(streams.first_seen(s, ["user_id", "event_type"]).select("user_id", "event_type"))


@query("stream_tumbling", "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def stream_tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = streams.with_time(_stream(spark, sf_dir), "ts", "1 hour")
    return streams.drain(streams.tumbling(s, "ts", "1 hour", ["event_type"]), "complete").withColumn("start", F.col("start").cast("timestamp_ntz"))


@query(
    "stream_sliding",
    """SELECT time_bucket(INTERVAL 30 MINUTE, ts) - s * INTERVAL 30 MINUTE AS start, count(*) AS n FROM events, range(2) r(s) GROUP BY 1""",
)
def stream_sliding(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = streams.with_time(_stream(spark, sf_dir), "ts", "1 hour")
    return streams.drain(streams.tumbling(s, "ts", "1 hour", [], "30 minutes"), "complete").withColumn("start", F.col("start").cast("timestamp_ntz"))


@query(
    "stream_session",
    """WITH g AS (SELECT user_id, ts, CASE WHEN ts <= lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM events),
    s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
    SELECT min(ts) AS start, user_id, count(*) AS n FROM s GROUP BY user_id, k""",
)
def stream_session(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = streams.with_time(_stream(spark, sf_dir), "ts", "1 hour")
    return streams.drain(streams.sessions(s, "ts", "6 hours", ["user_id"]), "complete").withColumn("start", F.col("start").cast("timestamp_ntz"))


_USER = "PARTITION BY user_id ORDER BY ts, event_id"


@query(
    "stream_heartbeat",
    f"""WITH d AS (SELECT event_id, user_id, ts, (epoch_us(ts) - lag(epoch_us(ts)) OVER ({_USER})) / 1e6 AS dt, value - lag(value) OVER ({_USER}) AS da FROM events),
    s AS (SELECT event_id, user_id, ts, last_value(CASE WHEN dt > 0.1 THEN da / dt END IGNORE NULLS) OVER ({_USER} ROWS UNBOUNDED PRECEDING) AS speed FROM d),
    n AS (SELECT *, coalesce(speed <> 0 AND speed < 1e-4, false) AS slow, sum(CASE WHEN speed >= 1e-4 THEN 1 ELSE 0 END) OVER ({_USER} ROWS UNBOUNDED PRECEDING) AS run FROM s),
    c AS (SELECT *, slow AND sum(CASE WHEN slow THEN 1 ELSE 0 END) OVER (PARTITION BY user_id, run ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) = 6 AS sixth FROM n)
    SELECT event_id, round(speed, 6) + 0.0 AS speed, sixth AND row_number() OVER (PARTITION BY user_id, sixth ORDER BY ts, event_id) = 1 AS alarm FROM c""",
)
def stream_heartbeat(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _stream(spark, sf_dir).select("event_id", "user_id", "ts", "value")
    return streams.drain(streams.heartbeat(s, "user_id", ["ts", "event_id"], "ts", "value", 1e-4, 6)).select("event_id", (F.round("speed", 6) + 0.0).alias("speed"), "alarm")


@query(
    "session_replay",
    """SELECT user_id AS id, max(event_id) AS seq, arg_max(value, event_id) AS value FROM events WHERE event_id % 10 <> 7 GROUP BY user_id""",
)
def session_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = load(spark, sf_dir, "events")
    line = F.to_json(F.struct(F.lit(2).alias("version"), F.col("user_id").alias("id"), F.col("event_id").alias("seq"), "value"))
    cut = F.when(F.col("event_id") % 10 == 7, F.expr("substring(line, 1, length(line) - 4)")).otherwise(F.col("line"))
    path = scratch(spark)
    e.withColumn("line", line).select(cut.alias("line")).write.text(f"{path}/log/batch=0")
    schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("seq", T.LongType()), T.StructField("value", T.DoubleType())])
    streams.compact(spark, path, schema)
    return streams.replay(spark, path, schema)

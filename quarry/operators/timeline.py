"""Timelines: times of files as events, and their text forms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FLAGS = {"modified": "m..", "accessed": ".a.", "created": "..b", "found": "X..X"}


def events(files: DataFrame, scanned_at: Column) -> DataFrame:
    """time, action, fileName, filePath, size, source, isDeleted: one row for each time that a file has, and one `found` row,
    at scanned_at, for a file without any. Unsorted: see ordered()."""
    pair = lambda action, time: F.struct(F.lit(action).alias("action"), time.alias("time"))
    times = F.filter(F.array(pair("modified", F.col("modifiedTime")), pair("created", F.col("createdTime"))), lambda x: x["time"].isNotNull())
    all_ = F.when(F.size(times) > 0, times).otherwise(F.array(pair("found", scanned_at)))
    d = files.select(F.explode(all_).alias("e"), "id", "fileName", F.col("originalPath").alias("filePath"), "size", "source", "isDeleted")
    return d.select("e.time", "e.action", "id", "fileName", "filePath", "size", "source", "isDeleted")


def ordered(timeline: DataFrame) -> DataFrame:
    """By time; ties by id and action, so that the order is one."""
    return timeline.orderBy("time", "id", "action")


def mactime() -> Column:
    """A line of the pipe-separated body format, from the columns of events()."""
    flag = F.lit("...")
    for action, text in FLAGS.items():
        flag = F.when(F.col("action") == action, F.lit(text)).otherwise(flag)
    path = F.when(F.coalesce("filePath", F.lit("")) == "", F.coalesce("fileName", F.lit(""))).otherwise(F.col("filePath"))
    path = F.concat(path, F.when(F.coalesce("isDeleted", F.lit(False)), F.lit(" (deleted)")).otherwise(""))
    return F.concat_ws("|", F.concat(F.date_format("time", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z")), F.col("size").cast("string"), flag, F.lit("0|0|0|0"), path)

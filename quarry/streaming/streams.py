"""Live event streams: batches, duplicates, heartbeats, windows, and a session that can be replayed.

Streams end in files below the session's checkpoint folder; offsets and state are Spark's own checkpoints, so a stream that
stops goes on where its last committed batch ended.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from quarry.runtime import scratch


def read_files(spark: SparkSession, path: str, schema: T.StructType, per_batch: int | None = None) -> DataFrame:
    """Parquet files as a stream."""
    reader = spark.readStream.schema(schema)
    return (reader.option("maxFilesPerTrigger", per_batch) if per_batch else reader).parquet(path)


def drain(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Runs a stream over all that is available, and returns what it wrote. complete and update replace or add whole batches."""
    spark, at = stream.sparkSession, scratch(stream.sparkSession)
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{at}/checkpoint").trigger(availableNow=True)
    if mode == "append":
        q = writer.format("parquet").option("path", f"{at}/rows").start()
    else:
        q = writer.foreachBatch(lambda df, _: df.write.mode("overwrite" if mode == "complete" else "append").parquet(f"{at}/rows")).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{at}/rows")


def with_time(stream: DataFrame, column: str, delay: str) -> DataFrame:
    """The event time as a timestamp with a watermark."""
    return stream.withColumn(column, F.col(column).cast("timestamp")).withWatermark(column, delay)


def first_seen(stream: DataFrame, keys: list[str]) -> DataFrame:
    """One row per key within the watermark: late repeats are dropped, and old keys are forgotten."""
    return stream.dropDuplicatesWithinWatermark(keys)


def _typed(schema: T.StructType, name: str) -> str:
    return f"`{name}` {schema[name].dataType.simpleString()}"


def batched(stream: DataFrame, key: str, order: list[str], size: int = 200) -> DataFrame:
    """Rows with batch: a new one after size rows of a key. The state is a counter per key."""
    names = stream.columns
    schema = ", ".join([_typed(stream.schema, n) for n in names] + ["batch long"])

    def run(_: tuple, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n = state.get[0] if state.exists else 0
        pdf = pd.concat(list(pdfs)).sort_values(order, kind="stable")
        pdf["batch"] = (n + pd.RangeIndex(len(pdf)).to_numpy()) // size + 1
        state.update((n + len(pdf),))
        yield pdf

    return stream.groupBy(key).applyInPandasWithState(run, schema, "n long", "append", GroupStateTimeout.NoTimeout)


def flushed(stream: DataFrame, key: str, order: list[str], time: str, size: int = 200, millis: int = 100) -> DataFrame:
    """Rows with batch, of a batcher that is looked at whenever a row comes: a batch ends with the row that makes it size rows, or
    that comes millis or more after the last end (at first, after the first row). State: batch, its rows, the last end."""
    names = stream.columns
    schema = ", ".join([_typed(stream.schema, n) for n in names] + ["batch long"])

    def run(_: tuple, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        batch, held, last = state.get if state.exists else (1, 0, None)
        pdf = pd.concat(list(pdfs)).sort_values(order, kind="stable")
        out = []
        for t in (pdf[time].astype("datetime64[us]").astype("int64") // 1000).tolist():
            last = t if last is None else last
            out.append(batch)
            held += 1
            if held >= size or t - last >= millis:
                batch, held, last = batch + 1, 0, t
        state.update((batch, held, last))
        pdf["batch"] = out
        yield pdf

    return stream.groupBy(key).applyInPandasWithState(run, schema, "batch long, held long, last long", "append", GroupStateTimeout.NoTimeout)


def heartbeat(stream: DataFrame, key: str, order: list[str], time: str, amount: str, limit: float, count: int) -> DataFrame:
    """Rows with speed (change of amount per second; a gap of up to 0.1 s keeps the last) and alarm: once per key, where count
    speeds in a row are below limit; a speed of zero neither counts nor resets. State: the last sample, run and alarm."""
    names = stream.columns
    schema = ", ".join([_typed(stream.schema, n) for n in names] + ["speed double, alarm boolean"])

    def run(_: tuple, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, had, speed, slow, fired = state.get if state.exists else (None, None, None, 0, False)
        pdf = pd.concat(list(pdfs)).sort_values(order, kind="stable")
        speeds, alarms = [], []
        for t, x in zip(pdf[time].astype("datetime64[us]").astype("int64"), pdf[amount]):
            if last is not None and (t - last) / 1e6 > 0.1:
                speed = (x - had) / ((t - last) / 1e6)
            last, had = int(t), float(x)
            if speed:
                slow = slow + 1 if speed < limit else 0
            alarm = slow == count and not fired and bool(speed)
            fired = fired or alarm
            speeds.append(speed)
            alarms.append(alarm)
        state.update((last, had, speed, slow, fired))
        pdf["speed"], pdf["alarm"] = speeds, alarms
        yield pdf

    return stream.groupBy(key).applyInPandasWithState(run, schema, "last long, had double, speed double, slow long, fired boolean", "append", GroupStateTimeout.NoTimeout)


def tumbling(df: DataFrame, time: str, width: str, keys: list[str], slide: str | None = None) -> DataFrame:
    w = F.window(time, width, slide) if slide else F.window(time, width)
    return df.groupBy(w.alias("w"), *keys).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), *keys, "n")


def sessions(df: DataFrame, time: str, gap: str, keys: list[str]) -> DataFrame:
    return df.groupBy(F.session_window(time, gap).alias("w"), *keys).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), *keys, "n")


def append_log(stream: DataFrame, path: str, checkpoint: str, compact_every: int = 5000, key: str = "id", seq: str = "seq"):
    """Writes each micro-batch as JSON lines to a folder of its own, log/batch=N, so that a batch that is tried again replaces
    itself, and folds the log into a snapshot once it has compact_every rows."""
    rows: dict[int, int] = {}

    def write(df: DataFrame, batch: int) -> None:
        spark = df.sparkSession
        seen = Observation()
        df.observe(seen, F.count(F.lit(1)).alias("n")).write.mode("overwrite").json(f"{path}/log/batch={batch}")
        if not rows:  # after a start: what the log has from before
            rows.update({r.batch: r["count"] for r in spark.read.text(f"{path}/log").groupBy("batch").count().collect()})
        rows[batch] = seen.get["n"]
        if sum(rows.values()) >= compact_every:
            compact(spark, path, df.schema, key, seq)
            rows.clear()
            rows[-1] = 0

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)


def _folder(spark: SparkSession, path: str):
    """(file system, function from a name below path to its Hadoop path)."""
    jvm = spark.sparkContext._jvm
    at = lambda name: jvm.org.apache.hadoop.fs.Path(f"{path}/{name}" if name else path)
    return at("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def _names(spark: SparkSession, path: str, folder: str, prefix: str) -> dict[int, str]:
    """Numbers and paths of the subfolders of path/folder that are named prefix and a number."""
    fs, at = _folder(spark, path)
    if not fs.exists(at(folder)):
        return {}
    names = [f.getPath().getName() for f in fs.listStatus(at(folder))]
    return {int(n.removeprefix(prefix)): f"{folder}/{n}" for n in names if n.startswith(prefix) and n.removeprefix(prefix).isdigit()}


def _snapshot(spark: SparkSession, path: str) -> tuple[int, str | None]:
    """The last batch in the newest snapshot that was written to its end, and its folder; (-1, None) without one."""
    fs, at = _folder(spark, path)
    whole = {n: f for n, f in _names(spark, path, "snapshot", "upto=").items() if fs.exists(at(f"{f}/_SUCCESS"))}
    return max(whole.items(), default=(-1, None))


def replay(spark: SparkSession, path: str, schema: T.StructType, key: str = "id", seq: str = "seq", read: Callable | None = None) -> DataFrame:
    """The newest whole snapshot and the log's batches after it, the last row of each key; lines that can't be read (a cut last
    one) are skipped. Lines beside the batches' folders count as well."""
    load = read or (lambda p: spark.read.schema(schema).option("mode", "DROPMALFORMED").json(p))
    upto, folder = _snapshot(spark, path)
    fs, at = _folder(spark, path)
    parts = [load(f"{path}/{folder}")] if folder else []
    parts += [load(f"{path}/{f}") for n, f in sorted(_names(spark, path, "log", "batch=").items()) if n > upto]
    if fs.exists(at("log")) and any(f.isFile() for f in fs.listStatus(at("log"))):
        parts.append(load(f"{path}/log/*.json"))
    if not parts:
        return spark.createDataFrame([], schema)
    names = [f.name for f in schema.fields]
    both = reduce(DataFrame.unionByName, parts)
    return latest(both.filter(F.col(key).isNotNull()), key, seq).select(*names)


def latest(rows: DataFrame, key: str, seq: str) -> DataFrame:
    rest = [c for c in rows.columns if c not in (key, seq)]
    return rows.groupBy(key).agg(F.max(seq).alias(seq), F.max_by(F.struct(*rest), seq).alias("_v")).select(key, seq, "_v.*")


def compact(spark: SparkSession, path: str, schema: T.StructType, key: str = "id", seq: str = "seq") -> None:
    """Writes the replayed rows as a new snapshot, named by the last batch in it, and then deletes what it replaces. A crash at
    any point loses nothing: a snapshot counts from its success mark on, and batches up to it no longer count."""
    old, folder = _snapshot(spark, path)
    batches = _names(spark, path, "log", "batch=")
    upto = max([old, *batches, 0])
    fs, at = _folder(spark, path)
    loose = fs.exists(at("log")) and any(f.isFile() for f in fs.listStatus(at("log")))
    if upto == old and not loose:
        return
    if upto == old:  # lines beside the batches only: the new snapshot needs a name of its own
        upto += 1
    replay(spark, path, schema, key, seq).write.mode("overwrite").json(f"{path}/snapshot/upto={upto}")
    if loose:
        for f in fs.listStatus(at("log")):
            if f.isFile():
                fs.delete(f.getPath(), False)
    for n, name in batches.items():
        if n <= upto:
            fs.delete(at(name), True)
    if folder and folder != f"snapshot/upto={upto}":
        fs.delete(at(folder), True)


def parse_lines(lines: DataFrame, column: str, schema: str, versions: tuple[int, ...] = (1, 2)) -> DataFrame:
    """JSON lines of known versions; others, and lines that can't be read, are left out."""
    d = lines.select(F.from_json(column, schema).alias("j")).select("j.*")
    return d.filter(F.coalesce("version", F.lit(1)).isin(*versions) & F.col("id").isNotNull())

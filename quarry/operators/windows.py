"""Ordered analytics. Each window is over one key: a drive, an extension, a bucket."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.runtime import settle


def numbered(df: DataFrame, keys: list[str], order: list, name: str = "seq") -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)).cast("long"))


def numbered_ranges(df: DataFrame, keys: list[str], order: list, name: str = "seq") -> DataFrame:
    """numbered() for keys of which one may hold any share of the rows: rows are dealt out in ranges of (keys, order), numbered within
    each, and each range of a key begins where the ranges before it end. No task sorts a whole key. order names columns of df,
    or expressions of them."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = settle(df.repartitionByRange(n, *keys, *order).withColumn("_part", F.spark_partition_id()))
    counts = ranged.groupBy("_part", *keys).agg(F.count(F.lit(1)).alias("_n"))  # a row for each key, and one more for each range
    w = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select(F.col("_part").alias("_range"), *[F.col(k).alias(f"_key_{k}") for k in keys], F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_before"))
    inner = F.row_number().over(Window.partitionBy("_part", *keys).orderBy(*order))
    own = ranged.withColumn("_in", inner)
    same = reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"_key_{k}")) for k in keys], F.col("_part") == F.col("_range"))
    return own.join(before, same).withColumn(name, (F.col("_in") + F.col("_before")).cast("long")).select(*df.columns, name)


def batches(df: DataFrame, keys: list[str], order: list, size: int = 500, name: str = "batch") -> DataFrame:
    """Batch number, from 1, of size rows each."""
    out = numbered(df, keys, order, "_seq")
    return out.withColumn(name, F.floor((F.col("_seq") - 1) / size).cast("long") + 1).drop("_seq")


def output_path(valid: Column, confidence: Column, category: Column, batch: Column, name: Column) -> Column:
    """category/batch_NNN/name, below low_confidence for invalid or weak files."""
    low = ~F.coalesce(valid, F.lit(False)) | (F.coalesce(confidence, F.lit(0.0)) < 0.5)
    return F.concat_ws("/", F.when(low, F.lit("low_confidence")), category, F.concat(F.lit("batch_"), F.lpad(batch.cast("string"), 3, "0")), name)


def carried(df: DataFrame, keys: list[str], order: list, columns: list[str]) -> DataFrame:
    """Zero (or null) keeps the last value before it."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumns({c: F.last(F.nullif(F.col(c), F.lit(0).cast(df.schema[c].dataType)), True).over(w) for c in columns})


def speed(df: DataFrame, keys: list[str], order: list, micros: Column, amount: Column, least: float = 0.1) -> DataFrame:
    """Change of amount per second between neighbours; a gap of at most `least` seconds keeps the last speed."""
    w = Window.partitionBy(*keys).orderBy(*order)
    d = df.withColumn("_dt", (micros - F.lag(micros).over(w)) / 1e6).withColumn("_da", amount - F.lag(amount).over(w))
    own = F.when(F.col("_dt") > least, F.col("_da") / F.col("_dt"))
    return d.withColumn("speed", F.last(own, True).over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_dt", "_da")


def slow_alarm(df: DataFrame, keys: list[str], order: list, speed_column: str, limit: float, count: int) -> DataFrame:
    """The first sample of each key that ends `count` slow samples in a row; a zero speed neither counts nor resets."""
    w = Window.partitionBy(*keys).orderBy(*order)
    x = F.coalesce(F.col(speed_column), F.lit(0))
    d = df.filter(x > 0).withColumn("_slow", (x < limit).cast("int"))
    d = d.withColumn("_island", F.sum(1 - F.col("_slow")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    inner = Window.partitionBy(*keys, "_island").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    d = d.withColumn("_run", F.sum("_slow").over(inner)).filter((F.col("_run") == count) & (F.col("_slow") == 1))
    return d.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_slow", "_island", "_run", "_n")


def jumps(df: DataFrame, keys: list[str], order: list, value: str, limit: float) -> DataFrame:
    """value with its change since the sample before, and whether that is more than limit."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("change", F.round(F.col(value) - F.lag(value).over(w), 6)).withColumn("jump", F.coalesce(F.abs("change") > limit, F.lit(False)))


def prefix_sum(df: DataFrame, keys: list[str], order: list, value: str, name: str) -> DataFrame:
    """The sum of the values before each row: where its run begins."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn(name, F.coalesce(F.sum(value).over(w), F.lit(0)))


def phase_percent(df: DataFrame, phases: DataFrame, keys: list[str], order: list) -> DataFrame:
    """df(phase, percent) mapped to its slice of the whole: phases(phase, begin, end); never falls back."""
    local = F.least(F.greatest("percent", F.lit(0.0)), F.lit(100.0)) / 100
    d = df.join(phases, "phase").withColumn("overall", F.col("begin") + (F.col("end") - F.col("begin")) * local)
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return d.withColumn("overall", F.max("overall").over(w)).drop("begin", "end")


def throttled(df: DataFrame, order: list, every: int = 500, keys: tuple[str, ...] = ()) -> DataFrame:
    """First, last, and each every-th row of a key; one may hold any share of the rows."""
    one = df if keys else df.withColumn("_one", F.lit(0))
    names = [*keys] or ["_one"]
    d = numbered_ranges(one, names, order, "_nth")
    last = d.groupBy(*[F.col(k).alias(f"_last_{k}") for k in names]).agg(F.max("_nth").alias("_all"))
    same = reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"_last_{k}")) for k in names])
    # rows that can be the last of a key are few: most are left out before the join
    some = d.filter((F.col("_nth") == 1) | (F.col("_nth") % every == 0)).select(*df.columns)
    ends = d.join(last, same & (F.col("_nth") == F.col("_all"))).filter((F.col("_nth") != 1) & (F.col("_nth") % every != 0)).select(*df.columns)
    return some.unionByName(ends)


def top_k(df: DataFrame, keys: list[str], order: list, k: Column | int) -> DataFrame:
    return numbered(df, keys, order, "rank").filter(F.col("rank") <= k)


def page(df: DataFrame, order: list, number: int, size: int = 200) -> DataFrame:
    """Page `number`, from 1, of the sorted rows."""
    return df.orderBy(*order).offset((number - 1) * size).limit(size)


def read_order(rows: DataFrame, offset: str = "offset", parts: int | None = None) -> DataFrame:
    """Rows in ranges of offset, sorted within each: reading by it goes forward only."""
    n = parts or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartitionByRange(n, offset).sortWithinPartitions(offset)

"""Aggregations: all built in, with partial sums before the shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def counted(df: DataFrame, key: Column, name: str, missing: str) -> DataFrame:
    """Rows by key; null and empty count as missing."""
    return df.groupBy(F.coalesce(F.nullif(key, F.lit("")), F.lit(missing)).alias(name)).agg(F.count(F.lit(1)).alias("n"))


def with_empty(df: DataFrame, keys: DataFrame, key: str, sums: dict[str, Column]) -> DataFrame:
    """A row for each of keys, also without rows: n and the sums, 0 where there are none."""
    got = df.groupBy(key).agg(F.count(F.lit(1)).alias("n"), *[c.alias(k) for k, c in sums.items()])
    return keys.join(got, key, "left").select(key, *[F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c) for c in ["n", *sums]])


def state_summary(records: DataFrame, state: str = "state", message: str = "message", confidence: str = "confidence") -> DataFrame:
    """One row: total, success, high (success that isn't low), low_confidence, partial, failed, skipped, duplicates."""
    s, low = F.col(state), F.coalesce(F.col(confidence), F.lit(0.0)) < 0.5
    duplicate = (s == "skipped") & F.coalesce(F.lower(F.col(message)), F.lit("")).contains("duplicate")
    return records.agg(
        F.count(F.lit(1)).alias("total"), F.count_if(s == "success").alias("success"), F.count_if((s == "success") & ~low).alias("high"),
        F.count_if((s == "success") & low).alias("low_confidence"), F.count_if(s == "partial").alias("partial"), F.count_if(s == "failed").alias("failed"),
        F.count_if(s == "skipped").alias("skipped"), F.count_if(duplicate).alias("duplicates"),
    )


def percent(part: Column, whole: Column) -> Column:
    """part of whole in percent with one decimal, half up, from integers; -- without a whole."""
    tenths = F.floor((part * 2000 + whole) / (whole * 2)).cast("long")
    return F.when(whole > 0, F.concat(F.floor(tenths / 10).cast("long").cast("string"), F.lit("."), (tenths % 10).cast("string"), F.lit("%"))).otherwise("--")


def hits_and_emitted(hits: DataFrame, emitted: DataFrame, key: str) -> DataFrame:
    """Counts of both by key (in either), pass and drop rate."""
    h, e = hits.groupBy(key).agg(F.count(F.lit(1)).alias("hits")), emitted.groupBy(key).agg(F.count(F.lit(1)).alias("emitted"))
    both = h.join(e, key, "full").select(key, F.coalesce("hits", F.lit(0)).alias("hits"), F.coalesce("emitted", F.lit(0)).alias("emitted"))
    return both.select("*", percent(F.col("emitted"), F.col("hits")).alias("pass_rate"), percent(F.col("hits") - F.col("emitted"), F.col("hits")).alias("drop_rate"))


def newest(df: DataFrame, by: list[str], value: list[str]) -> DataFrame:
    """One row: the values of the row with the greatest by."""
    return df.agg(F.max_by(F.struct(*value), F.struct(*by)).alias("v")).select("v.*")


def entropy(df: DataFrame, key: list[str], text: str) -> DataFrame:
    """Shannon entropy in bits of the characters of text, by key: counts of (key, character), then of keys.

    Characters are counted within their row first: only distinct characters are shuffled, not the text.
    """
    one = df.select(*key, F.explode(F.split(text, "")).alias("ch")).filter("ch <> ''")
    n = one.groupBy(*key, "ch").agg(F.count(F.lit(1)).alias("n"))
    sums = n.groupBy(*key).agg(F.sum("n").alias("all"), F.sum(F.col("n") * F.log2("n")).alias("s"))
    return sums.select(*key, F.round(F.log2("all") - F.col("s") / F.col("all"), 6).alias("entropy"), F.col("all").alias("length"))


def directory_sizes(files: DataFrame, path: str, size: str, depth: int) -> DataFrame:
    """Bytes and files of each directory, of files at most depth levels below it."""
    parts = F.filter(F.split(path, r"[/\\]+"), lambda x: x != "")
    up = F.transform(F.sequence(F.greatest(F.size("parts") - depth, F.lit(1)), F.size("parts") - 1), lambda i: F.array_join(F.slice("parts", F.lit(1), i), "/"))
    some = files.withColumn("parts", parts).filter(F.size("parts") > 1)
    return some.select(F.explode(up).alias("directory"), F.col(size).alias("_size")).groupBy("directory").agg(F.sum("_size").alias("bytes"), F.count(F.lit(1)).alias("files"))


def findings_by_file(findings: DataFrame, file: str = "file", line: str = "line", rule: str = "rule", most: int = 100) -> DataFrame:
    """A row per file: findings, rules (distinct), and the first `most` of them by line, for display. What is listed is bounded: a
    file's findings are numbered before they are gathered."""
    n = F.row_number().over(Window.partitionBy(file).orderBy(line, rule))
    head = findings.withColumn("_n", n).filter(F.col("_n") <= most).groupBy(file).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_n", line, rule))), lambda x: F.concat_ws(":", x[line].cast("string"), x[rule])), " ").alias("first"))
    return findings.groupBy(file).agg(F.count(F.lit(1)).alias("findings"), F.count_distinct(rule).alias("rules")).join(head, file)

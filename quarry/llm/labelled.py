"""Bounded samples of labelled documents, for the classifiers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def sample(docs: DataFrame, labels: DataFrame, column: str, allowed, most: int) -> DataFrame:
    """(doc_id, text, y) of up to most / 2 documents of either class, chosen by a hash of the id.

    docs(doc_id, text); labels(doc_id, column): 0, 1 or null (no label). allowed: a condition on doc_id. A document with
    both labels, or without a text row, is left out; of repeated rows of a document the greatest text counts. Also the
    class counts of all allowed labels: see counts().
    """
    own = known(labels, column, allowed)
    parts = [own.filter(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most // 2) for y in (0, 1)]
    ids = parts[0].unionByName(parts[1]).withColumnRenamed("doc_id", "k")
    # at most `most` rows of an id and a bit: safe to broadcast
    both = docs.select("doc_id", "text").join(F.broadcast(ids), F.col("doc_id") == F.col("k"))
    return both.groupBy("doc_id").agg(F.max(F.coalesce("text", F.lit(""))).alias("text"), F.max("y").alias("y"))


def known(labels: DataFrame, column: str, allowed) -> DataFrame:
    """(doc_id, y) of allowed documents with one label."""
    own = labels.filter(F.col("doc_id").isNotNull() & F.col(column).isNotNull() & allowed)
    own = own.groupBy("doc_id").agg(F.min(column).alias("y"), F.max(column).alias("_top"))
    return own.filter(F.col("y") == F.col("_top")).select("doc_id", (F.col("y") > 0).cast("int").alias("y"))


def counts(labels: DataFrame, column: str, allowed) -> tuple[int, int]:
    """How many allowed documents have label 0, and 1."""
    got = {r.y: r["count"] for r in known(labels, column, allowed).groupBy("y").count().collect()}
    return got.get(0, 0), got.get(1, 0)


def scored(docs: DataFrame, held_out, score, threshold: float, extra: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    return docs.select("doc_id", *extra, F.coalesce(held_out, F.lit(False)).alias("held_out"), score.alias("score")).withColumn(
        "predicted", (F.col("score") >= threshold).cast("int")
    )

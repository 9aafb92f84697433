"""Priority buckets of the catalogue."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions.scalar import cases, recovery_score
from quarry.operators.predicates import KEPT_TREE, is_system_file, low, path_text
from quarry.operators.windows import top_k

BUCKETS = ("windowsOld", "desktop", "photos", "documents", "recent", "other")


def bucket(now: Column, days: int = 30) -> Column:
    """The first that holds: old system tree, desktop, photos, documents, changed in the last days, other; null for a
    system file."""
    p, kind = path_text(), low("category")
    recent = F.col("modifiedTime").isNotNull() & (F.col("modifiedTime") >= now - F.expr(f"INTERVAL {days} DAYS"))
    return cases(
        [
            (is_system_file(), F.lit(None).cast("string")), (p.contains(KEPT_TREE), F.lit("windowsOld")), (p.contains("/desktop/") | p.startswith("desktop/"), F.lit("desktop")),
            (kind == "image", F.lit("photos")), (kind == "document", F.lit("documents")), (recent, F.lit("recent")),
        ],
        F.lit("other"),
    )


def peek(files: DataFrame, now: Column, photos: int = 4, others: int = 3) -> DataFrame:
    """bucket, rank, id, score: the best of each bucket by score, ties by id."""
    d = files.withColumn("bucket", bucket(now)).filter("bucket is not null").withColumn("score", recovery_score("confidence", "isValid"))
    return top_k(d, ["bucket"], [F.desc("score"), F.asc("seq")], F.when(F.col("bucket") == "photos", photos).otherwise(others)).select("bucket", "rank", "id", "score")

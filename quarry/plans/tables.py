"""Proxies of the catalogue's tables over the test tables.

The test tables hold no disk bytes; these views stand for the file catalogue. Each column is one SQL expression that both
engines read the same way, but for a few words, which are filled in for each.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quarry.runtime import ship

SPARK = {"ntz": "TIMESTAMP_NTZ", "sha": "sha2(%s, 256)"}
DUCK = {"ntz": "TIMESTAMP", "sha": "sha256(%s)"}

_NAME = "concat('f', CAST(doc_id AS STRING), CASE WHEN doc_id % 9 = 8 THEN '' ELSE concat('.', {ext}) END)"
_EXT = "CASE doc_id % 9 WHEN 0 THEN 'jpg' WHEN 1 THEN 'pdf' WHEN 2 THEN 'exe' WHEN 3 THEN 'docx' WHEN 4 THEN 'mp4' WHEN 5 THEN 'dll' WHEN 6 THEN 'zip' WHEN 7 THEN 'heic' ELSE '' END"
_CATEGORY = "CASE doc_id % 9 WHEN 0 THEN 'image' WHEN 1 THEN 'document' WHEN 3 THEN 'document' WHEN 4 THEN 'video' WHEN 6 THEN 'archive' WHEN 7 THEN 'image' WHEN 8 THEN '' ELSE 'other' END"
_FOLDER = (
    "CASE doc_id % 11 WHEN 0 THEN 'Windows.old/Users/u/' WHEN 1 THEN 'Users/bob/Desktop/' WHEN 2 THEN 'Windows/System32/' WHEN 3 THEN 'data/boot/x/' "
    "WHEN 4 THEN 'C:/Program Files/app/' WHEN 5 THEN '' WHEN 6 THEN 'home/Users/ann/' ELSE concat('media/', lang, '/', source, '/') END"
)


def file_expressions(words: dict[str, str]) -> dict[str, str]:
    name = _NAME.replace("{ext}", _EXT)
    day = f"CAST(DATE '2024-01-01' + CAST(doc_id % 400 AS INT) AS {words['ntz']})"
    return {
        "id": "CAST(doc_id AS STRING)",
        "seq": "doc_id",
        "source": "CASE doc_id % 6 WHEN 0 THEN 'ntfs' WHEN 1 THEN 'carver' WHEN 2 THEN '' WHEN 3 THEN 'ext4' ELSE source END",
        "fileName": name,
        "extension": _EXT,
        "category": _CATEGORY,
        "size": "n_chars * 37",
        "offset": "doc_id * 4096",
        "confidence": "CAST((doc_id * 37) % 101 AS DOUBLE) / 100",
        "createdTime": f"CASE WHEN doc_id % 6 < 2 THEN {day} END",
        "modifiedTime": f"CASE WHEN doc_id % 6 IN (1, 3, 4) THEN {day} END",
        "isDeleted": "doc_id % 4 = 0",
        "originalPath": f"CASE WHEN doc_id % 11 = 5 THEN '' ELSE concat({_FOLDER}, {name}) END",
        "isValid": "CASE doc_id % 3 WHEN 0 THEN true WHEN 1 THEN false END",
        "sha256": words["sha"] % "text",
    }


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "documents").selectExpr(*[f"{e} AS {k}" for k, e in file_expressions(SPARK).items()])


#: A common table expression `files` for DuckDB.
FILES_SQL = "files AS (SELECT " + ", ".join(f'{e} AS "{k}"' for k, e in file_expressions(DUCK).items()) + " FROM documents)"

_STATE = "CASE o_orderstatus WHEN 'F' THEN 'success' WHEN 'O' THEN CASE WHEN o_orderkey % 5 = 0 THEN 'skipped' ELSE 'failed' END ELSE 'partial' END"
RECORD_EXPRESSIONS = {
    "fileId": "o_custkey",
    "orderId": "o_orderkey",
    "state": _STATE,
    "message": "CASE WHEN o_orderkey % 10 = 0 THEN 'Duplicate of another' ELSE 'done' END",
    "confidence": "CAST(o_orderkey % 100 AS DOUBLE) / 100",
}


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "orders").selectExpr(*[f"{e} AS {k}" for k, e in RECORD_EXPRESSIONS.items()])


RECORDS_SQL = "records AS (SELECT " + ", ".join(f'{e} AS "{k}"' for k, e in RECORD_EXPRESSIONS.items()) + " FROM orders)"

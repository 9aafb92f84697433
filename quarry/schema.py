"""The canonical row types of the catalogue."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: One row per file found, whatever the source.
FILES = """id string, source string, fileName string, extension string, category string, size long, offset long, confidence double,
createdTime timestamp_ntz, modifiedTime timestamp_ntz, isDeleted boolean, originalPath string, description string, isValid boolean,
validationMsg string, sha256 string, fragHint string"""

#: One row per recovered file.
RECORDS = """fileId string, fileName string, category string, size long, state string, outputPath string, message string,
durationMs long, completedAt timestamp_ntz"""

#: A stretch of bytes of an image.
BLOCKS = "image string, offset long, payload binary"

FILE_COLUMNS = [(c.split()[0], c.split()[1]) for c in FILES.replace("\n", " ").split(", ")]


def as_files(df: DataFrame, **given: object) -> DataFrame:
    """df as rows of FILES: given maps columns of FILES to Columns or names; the rest are null."""
    return df.select(*[(F.col(g) if isinstance(g, str) else g if g is not None else F.lit(None)).cast(kind).alias(name) for name, kind in FILE_COLUMNS for g in [given.get(name)]])

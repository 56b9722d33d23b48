"""What the corpus operators share: the session's shared folder and small column helpers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from carepath.sources.scratch import discard, shared_dir, stored

__all__ = ["BATCH_ROWS", "BLANKS", "discard", "documents", "lower_ascii", "prepare", "shared_dir", "stored", "valid"]

#: Rows in an Arrow batch handed to Python; whole texts can be long, so the default of 10,000 is too many.
BATCH_ROWS = 256


def prepare(spark: SparkSession) -> SparkSession:
    """Bounds the Arrow batches by rows, unless the session already asks for fewer."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key, "10000")) > BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))
    return spark


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/documents.parquet")


def valid(text: Column) -> Column:
    """The text with U+FFFD for what is no UTF-8, so that Python can read it; others stay as they are."""
    return F.make_valid_utf8(text)


def lower_ascii(c: Column) -> Column:
    """Lower-cases A-Z only."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


#: The six characters of [\x20\x09-\x0D].
BLANKS = " \t\n\x0b\x0c\r"

"""What the operators of this package share: word patterns, row keys and tables cut from their lineage."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import ranges

#: Words are what stands between ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: The ASCII white space itself, as characters for trim().
BLANKS = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. A session without one gets a temporary folder in local mode
    (tests), where there are no other machines; on a cluster that is an error."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not at:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        at = tempfile.mkdtemp(prefix="tidelog-")
        spark.sparkContext.setCheckpointDir(at)
    return at.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/tidelog-{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder: its lineage ends there and lost executors can't lose it."""
    spark = df.sparkSession
    at = new_path(spark, name)
    df.write.option("compression", "zstd").parquet(at)
    return spark.read.schema(df.schema).parquet(at)


def small_enough(df: DataFrame, rows: int) -> bool:
    """Whether a materialized table has at most so many rows; Parquet footers tell, no column is read."""
    return df.count() <= rows


def maybe_broadcast(df: DataFrame, rows: int) -> DataFrame:
    """A broadcast hint for a table of at most so many rows of bounded width; any other is joined by shuffle."""
    return F.broadcast(df) if small_enough(df, rows) else df


def ascii_lower(c: Column) -> Column:
    """A-Z only. lower() has a fast path for ASCII strings; it would change other letters, so those are translated."""
    return F.when(F.octet_length(c) == F.char_length(c), F.lower(c)).otherwise(F.translate(c, UPPER, LOWER))


def count_words(c: Column, pattern: str = WORD) -> Column:
    return F.coalesce(F.regexp_count(c, F.lit(pattern)), F.lit(0)).cast("long")


def hash_pair(c: Column) -> tuple[Column, Column]:
    """Two independent 64-bit hashes, together a key of 128 bits."""
    return F.xxhash64(c), F.xxhash64(F.lit(7), c)


def running_totals(df: DataFrame, key: str, sums: dict[str, Column], rows_a_part: int = 50_000) -> DataFrame:
    """ranges.running_totals() of a materialized table, with so many rows a range."""
    return ranges.running_totals(df, key, sums, min(1024, df.count() // rows_a_part + 1))

"""JSON control documents and listings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_json_dir(spark: SparkSession, folder: str, schema: str, pattern: str = "*", strict: bool = False) -> DataFrame:
    """Each file of a folder as a row, with its name as key. strict: one that can't be read fails the scan."""
    mode = "FAILFAST" if strict else "DROPMALFORMED"
    df = spark.read.schema(schema).option("multiLine", "true").option("mode", mode).option("pathGlobFilter", pattern).json(folder)
    return df.withColumn("key", F.regexp_replace("_metadata.file_name", r"\.json$", ""))


def read_reports(spark: SparkSession, root: str) -> DataFrame:
    return read_json_dir(spark, f"{root}/retain", "log_id string, opened map<string,bigint>, pruned_seq bigint, min_seg_format int")


def read_leases(spark: SparkSession, root: str) -> DataFrame:
    """All or nothing: with one lease unread, nothing can be said of who is live."""
    return read_json_dir(spark, f"{root}/nodes", "node_id string, incarnation string, addr string, renewals bigint, expires_ms bigint, draining boolean, ended boolean, positions map<string,bigint>", strict=True)


def read_assignments(spark: SparkSession, root: str) -> DataFrame:
    member = "struct<node_id:string,incarnation:string,addr:string>"
    span = "struct<epoch:bigint,node_id:string,incarnation:string,`from`:bigint,`until`:bigint>"
    return read_json_dir(spark, f"{root}/assign", f"shard bigint, epoch bigint, version bigint, floor bigint, owner {member}, replicas array<{member}>, history array<{span}>, frozen bigint")


def scan_keys(rows: DataFrame, start: bytes, end: bytes) -> DataFrame:
    """Rows with start <= key < end; binary comparison is pushed to the scan."""
    return rows.filter((F.col("key") >= F.lit(bytearray(start))) & (F.col("key") < F.lit(bytearray(end))))


def next_pages(listing: DataFrame, cursor: str | None, pages: int, page: int = 1000) -> DataFrame:
    """The next pages of a listing in key order, past a cursor."""
    rest = listing if cursor is None else listing.filter(F.col("path") > cursor)
    return rest.orderBy("path").limit(pages * page)


def conditional_write(stored: DataFrame, expected: DataFrame) -> DataFrame:
    """Keys whose stored etag isn't the expected one: those writes would conflict."""
    return expected.join(stored.select("key", "etag"), ["key", "etag"], "left_anti")


def apply_writes(stored: DataFrame, writes: DataFrame) -> DataFrame:
    """stored (key, etag, value) after writes (key, i, expected, etag, value) in order of i, of which each takes effect
    only if the document has the etag that it expects then (null: if there is none). A key's writes are a fold: the
    state goes through them one by one. Returns key, etag, value and n, how many took effect."""
    row = F.struct("i", "expected", "etag", "value")
    per = writes.groupBy("key").agg(F.array_sort(F.collect_list(row)).alias("_writes"))
    both = stored.select("key", F.col("etag").alias("_etag"), F.col("value").alias("_value")).join(per, "key", "full_outer")
    first = F.struct(F.col("_etag").alias("etag"), F.col("_value").alias("value"), F.lit(0).cast("long").alias("n"))
    step = lambda s, w: F.when(s["etag"].eqNullSafe(w["expected"]), F.struct(w["etag"].alias("etag"), w["value"].alias("value"), (s["n"] + 1).alias("n"))).otherwise(s)
    out = both.withColumn("_s", F.when(F.col("_writes").isNull(), first).otherwise(F.aggregate("_writes", first, step)))
    return out.filter("_s.etag is not null").select("key", "_s.etag", "_s.value", "_s.n")

"""Segmented logs: zone maps, gap-free prefixes, seeks, merges of many logs and replays of a window of them.

Logs are rows (log_id, ordinal, idx, seq, ...); segments are rows (log_id, ordinal, prefix_end, first_seq,
last_seq, n, kind), kind being 'segment' or 'fence'. Windows are partitioned by log and run over segments,
which are few next to events."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def zone_map(log: DataFrame) -> DataFrame:
    """One row a segment with the bounds of its seqs."""
    return log.groupBy("log_id", "ordinal").agg(F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"), F.count("*").alias("n"))


def list_logs(segments: DataFrame) -> DataFrame:
    return segments.select("log_id").distinct()


def first_ordinal(segments: DataFrame) -> DataFrame:
    """The lowest ordinal that retention has left of each log."""
    return segments.groupBy("log_id").agg(F.min("ordinal").alias("first_ordinal"))


def mark_prefix(segments: DataFrame) -> DataFrame:
    """Adds live: whether the segment is in its log's gap-free prefix, which starts at the lowest ordinal
    stored and ends at the first one that is missing or a fence."""
    log = W.partitionBy("log_id").orderBy("ordinal")
    off = (F.col("ordinal") - F.min("ordinal").over(W.partitionBy("log_id")) + 1 != F.row_number().over(log)) | (F.col("kind") != "segment")
    return segments.withColumn("_off", off).withColumn("live", ~F.max("_off").over(log.rowsBetween(W.unboundedPreceding, 0))).drop("_off")


def gap_free_prefix(segments: DataFrame) -> DataFrame:
    return mark_prefix(segments).filter("live").drop("live")


def first_free(segments: DataFrame) -> DataFrame:
    """log_id, first_free (the ordinal after the prefix) and fenced (whether a fence stands there)."""
    marked = mark_prefix(segments)
    per = marked.groupBy("log_id").agg(F.coalesce(F.max(F.when(F.col("live"), F.col("ordinal"))) + 1, F.min("ordinal")).alias("first_free"), F.collect_set(F.when(F.col("kind") == "fence", F.col("ordinal"))).alias("_fences"))
    return per.select("log_id", "first_free", F.array_contains("_fences", F.col("first_free")).alias("fenced"))


def seek(segments: DataFrame, after: int) -> DataFrame:
    """log_id and the first ordinal of the prefix with a seq above `after`, or else the first free one."""
    found = gap_free_prefix(segments).groupBy("log_id").agg(F.min(F.when(F.col("last_seq") > after, F.col("ordinal"))).alias("found"))
    return first_free(segments).join(found, "log_id", "left").select("log_id", F.coalesce("found", "first_free").alias("seek_ordinal"))


def events(entries: DataFrame) -> DataFrame:
    """Entries that are events: private state has an empty frame."""
    return entries.filter(F.length("frame") > 0)


def merge_logs(log: DataFrame, *by: str) -> DataFrame:
    """One row a seq (and `by`); of logs that hold the same one, the first in listing order has it, and of that log's
    rows the first by ordinal and idx, where they are known, and the other columns."""
    others = [c for c in log.columns if c not in ("seq", "log_id", *by)]
    rank = [c for c in ("ordinal", "idx") if c in others]
    rank += [c for c in others if c not in rank and not re.search("map<|variant", log.schema[c].dataType.simpleString())]
    best = F.min_by(F.struct("log_id", *others), F.struct("log_id", *rank))
    return log.groupBy(*by, "seq").agg(best.alias("_b")).select(*by, "seq", "_b.*")


def backfill(log: DataFrame, segments: DataFrame, after: int, until: int, slots: tuple[int, int] | None = None) -> DataFrame:
    """Events with after < seq <= until of the logs' gap-free prefixes, each seq once, optionally of the slots
    [lo, hi). Segments outside the window are left out by their bounds before their rows are read."""
    wanted = gap_free_prefix(segments).filter((F.col("last_seq") > after) & (F.col("first_seq") <= until)).select("log_id", "ordinal")
    rows = log.filter((F.col("seq") > after) & (F.col("seq") <= until))
    if slots:
        rows = rows.filter((F.col("slot") >= slots[0]) & (F.col("slot") < slots[1]))
    return merge_logs(rows.join(wanted, ["log_id", "ordinal"], "left_semi"))


def backfill_parts(log: DataFrame, segments: DataFrame, after: int, until: int, parts: list[tuple[int, int]]) -> DataFrame:
    """The replays of several slot ranges [lo, hi) in one pass: part (its number), seq, ... Each is backfill() of its range."""
    wanted = gap_free_prefix(segments).filter((F.col("last_seq") > after) & (F.col("first_seq") <= until)).select("log_id", "ordinal")
    rows = log.filter((F.col("seq") > after) & (F.col("seq") <= until))
    own = F.array_compact(F.array(*[F.when((F.col("slot") >= lo) & (F.col("slot") < hi), F.lit(k)) for k, (lo, hi) in enumerate(parts)]))
    rows = rows.withColumn("part", F.explode(own)).join(wanted, ["log_id", "ordinal"], "left_semi")
    return merge_logs(rows, "part")


def page_of(rows: DataFrame, max_bytes: int, size: str = "bytes", key: str = "seq", parts: int | None = None) -> DataFrame:
    """The first page of rows in key order: up to the row with which max_bytes is reached, so one row at least.
    Keys are distinct."""
    from .ranges import parts_for, running_totals

    return running_totals(rows, key, {"_before": F.col(size)}, parts or parts_for(rows)).filter(F.col("_before") < max_bytes).drop("_before")


def read_status(wanted: DataFrame, segments: DataFrame) -> DataFrame:
    """wanted (log_id, ordinal) with status: what a reader finds there. segment or fence; without an object, 'pruned'
    if retention has overtaken the reader, that is if the log's lowest object is past it or none is left, else 'missing'."""
    first = first_ordinal(segments)
    out = wanted.join(segments.select("log_id", "ordinal", "kind"), ["log_id", "ordinal"], "left").join(first, "log_id", "left")
    gone = F.coalesce(F.col("first_ordinal") > F.col("ordinal"), F.lit(True))
    return out.withColumn("status", F.coalesce("kind", F.when(gone, "pruned").otherwise("missing"))).drop("kind", "first_ordinal")


def with_tail(stored: DataFrame, tail: DataFrame, floor: int) -> DataFrame:
    """Stored events up to the floor, and above it those that are emitted but not stored yet, from their producer's
    own copy; where both have an event, it comes once."""
    return stored.filter(F.col("seq") <= floor).unionByName(tail.filter(F.col("seq") > floor))


def retained_floor(reports: DataFrame) -> DataFrame:
    """The seq below which some log may be pruned; 0 without reports."""
    return reports.agg(F.coalesce(F.max("pruned_seq"), F.lit(0)).cast("long").alias("retained_floor"))


def cursor_status(cursors: DataFrame, pruned: int, last_emitted: int, now_us: int) -> DataFrame:
    """Adds status (future, outdated, ok) and resume_at. A cursor at the floor is served in full."""
    newest = max(last_emitted, (now_us << 8) | 0xFF)
    status = F.when(F.col("cursor") > newest, "future").when(F.col("cursor") < pruned, "outdated").otherwise("ok")
    return cursors.withColumn("status", status).withColumn("resume_at", F.when(F.col("cursor") <= newest, F.greatest(F.col("cursor"), F.lit(pruned).cast("long"))))


def missing_heads(wanted: DataFrame, segments: DataFrame) -> DataFrame:
    """Ordinals asked for that no object has."""
    return wanted.join(segments, ["log_id", "ordinal"], "left_anti")


def misplaced(headers: DataFrame) -> DataFrame:
    """Headers that name another log or ordinal than the path they were read from."""
    return headers.filter((F.col("log_id") != F.col("path_log_id")) | (F.col("ordinal") != F.col("path_ordinal")))


def assign_seqs(requests: DataFrame) -> DataFrame:
    """Adds seq: at least the request's time and writer, and 256 above the writer's one before. Columns:
    writer, i (from 0, the writer's order), us. The recurrence is a running maximum of seq - 256 i."""
    base = F.shiftleft("us", 8).bitwiseOR(F.col("writer").cast("long"))
    run = W.partitionBy("writer").orderBy("i").rowsBetween(W.unboundedPreceding, 0)
    return requests.withColumn("seq", F.max(base - 256 * F.col("i")).over(run) + 256 * F.col("i"))

"""From logs to subscribers: accepting, releasing, numbering, filtering, keeping and measuring the stream."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scalars import own_seq_at_or_below, seq_floor, wire_bytes
from .asof import asof_join
from .ranges import parts_for, range_of


def accept(log: DataFrame, emitted: int = 0, start_floor: int = 0, by_segment: bool | None = None) -> DataFrame:
    """Adds outcome to rows (log_id, ordinal, idx, seq): duplicate (not above an earlier seq of its log),
    late (at most what is emitted), floor (that, and at most the start floor, which isn't counted as late)
    or accepted. A late row still makes later lower ones duplicates.

    by_segment: each segment is swept on its own, after the greatest seq of the log's segments before it, so that
    a log isn't one task's; by default where the input is more than one range's."""
    if parts_for(log) > 1 if by_segment is None else by_segment:
        earlier = W.partitionBy("log_id").orderBy("ordinal").rowsBetween(W.unboundedPreceding, -1)
        high = log.groupBy("log_id", "ordinal").agg(F.max("seq").alias("_high"))
        high = high.select("log_id", "ordinal", F.coalesce(F.max("_high").over(earlier), F.lit(0)).alias("_before"))
        rows, own = log.join(high, ["log_id", "ordinal"]), W.partitionBy("log_id", "ordinal").orderBy("idx")
    else:
        rows, own = log.withColumn("_before", F.lit(0)), W.partitionBy("log_id").orderBy("ordinal", "idx")
    high = F.greatest(F.coalesce(F.max("seq").over(own.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)), F.col("_before"))
    out = F.when(F.col("seq") <= high, "duplicate").when((F.col("seq") <= emitted) & (F.col("seq") <= start_floor), "floor").when(F.col("seq") <= emitted, "late").otherwise("accepted")
    return rows.withColumn("outcome", out).select(*log.columns, "outcome")


def min_watermark(watermarks: DataFrame) -> DataFrame:
    """The least watermark of all sources: what all of them have passed."""
    return watermarks.agg(F.min("watermark").alias("watermark"))


def release(pending: DataFrame, watermarks: DataFrame) -> DataFrame:
    """Pending rows up to the least watermark. That is one row, so it is broadcast."""
    return pending.join(F.broadcast(min_watermark(watermarks)), F.col("seq") <= F.col("watermark")).drop("watermark")


def renumber(rows: DataFrame, key: str = "seq", anchor: int = 0, parts: int | None = None) -> DataFrame:
    """Adds number = anchor + rank by key, counting from 1, without a window over all rows: rows are dealt
    by ranges of the key, counted in each and offset by the counts before. Ranges: as the input's size asks for."""
    parts = parts or parts_for(rows)
    if parts == 1:
        return rows.withColumn("number", F.row_number().over(W.partitionBy(F.lit(0)).orderBy(key)) + F.lit(anchor).cast("long"))
    dealt = rows.withColumn("_p", range_of(rows, key, parts))
    counts = dealt.groupBy("_p").agg(F.count("*").alias("_n"))
    before = counts.select("_p", (F.coalesce(F.sum("_n").over(W.orderBy("_p").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).alias("_before"))
    ranked = dealt.withColumn("_r", F.row_number().over(W.partitionBy("_p").orderBy(key)))
    return ranked.join(F.broadcast(before), "_p").withColumn("number", F.col("_before") + F.col("_r") + anchor).drop("_p", "_r", "_before")


def frame_filter(rows: DataFrame, hidden: DataFrame | None, kinds: tuple[str, ...], limit: int = 1_000_000) -> DataFrame:
    """Rows but for those of the given kinds whose did is hidden. Numbers are given before, so a skipped row
    leaves a gap. Without a filter the rows pass as they are. A short list is broadcast, a long one shuffled."""
    if hidden is None:
        return rows
    hidden = hidden.select("did").distinct().withColumn("_hidden", F.lit(True))
    hidden = F.broadcast(hidden) if hidden.limit(limit + 1).count() <= limit else hidden
    return rows.join(hidden, (rows["did"] == hidden["did"]) & rows["kind"].isin(*kinds), "left_anti")


def runs(rows: DataFrame, kept: Column, order: str = "seq", by: list[str] | None = None, parts: int | None = None) -> DataFrame:
    """Maximal runs of consecutive kept rows: first, last, n, by group.

    Runs are found in each range of the order; those that touch a range's edge are chained with what touches it
    from the other side, of which there are two a range and group at most."""
    by = by or []
    t = rows.select(*by, F.col(order).alias("_at"), F.coalesce(kept, F.lit(False)).alias("_k"))
    t = t.withColumn("_p", range_of(t, "_at", parts or parts_for(rows)))
    part = [*by, "_p"]
    t = t.withColumn("_r", F.row_number().over(W.partitionBy(*part).orderBy("_at"))).withColumn("_size", F.count("*").over(W.partitionBy(*part)))
    own = F.row_number().over(W.partitionBy(*part, "_k").orderBy("_at"))
    found = t.withColumn("_island", F.col("_r") - own).filter("_k").groupBy(*part, "_island")
    found = found.agg(F.min("_at").alias("first"), F.max("_at").alias("last"), F.count("*").alias("n"), F.min("_r").alias("_a"), F.max("_r").alias("_z"), F.first("_size").alias("_size"))
    at_start, at_end = F.col("_a") == 1, F.col("_z") == F.col("_size")
    inner = found.filter(~at_start & ~at_end).select(*by, "first", "last", "n")
    held = t.groupBy(*part).agg(F.lit(1).alias("_one")).withColumn("_rank", F.row_number().over(W.partitionBy(*(by or [F.lit(0)])).orderBy("_p"))).drop("_one")
    edge = found.filter(at_start | at_end).join(held, part)
    line = W.partitionBy(*(by or [F.lit(0)])).orderBy("first")
    goes_on = at_start & F.coalesce(F.lag(at_end).over(line) & (F.lag("_rank").over(line) == F.col("_rank") - 1), F.lit(False))
    edge = edge.withColumn("_begins", F.when(goes_on, 0).otherwise(1)).withColumn("_chain", F.sum("_begins").over(line.rowsBetween(W.unboundedPreceding, 0)))
    edge = edge.groupBy(*by, "_chain").agg(F.min("first").alias("first"), F.max("last").alias("last"), F.sum("n").alias("n")).drop("_chain")
    return inner.unionByName(edge)


#: Batches are summed by stretches of 2^12 ids, then over the stretches.
STRETCH = 12


def _end_offset(b: DataFrame) -> DataFrame:
    """b with end_offset, the bytes up to the end of each batch; no task sees all batches."""
    t = b.withColumn("_s", F.shiftright("batch_id", STRETCH))
    totals = t.groupBy("_s").agg(F.sum("bytes").alias("_t"))
    offsets = totals.select("_s", F.coalesce(F.sum("_t").over(W.orderBy("_s").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_o"))
    inside = W.partitionBy("_s").orderBy("batch_id").rowsBetween(W.unboundedPreceding, 0)
    return t.withColumn("_w", F.sum("bytes").over(inside)).join(offsets, "_s").withColumn("end_offset", F.col("_w") + F.col("_o")).select(*b.columns, "end_offset")


def batches(rows: DataFrame, batch: Column) -> DataFrame:
    """Merged batches with their wire bytes and the stream offset at their end."""
    size = wire_bytes(F.length("frame"))
    return _end_offset(rows.groupBy(batch.alias("batch_id")).agg(F.count("*").alias("n"), F.min("seq").alias("first"), F.max("seq").alias("last"), F.sum(size).cast("long").alias("bytes")))


def mark_ring(b: DataFrame, budget: int) -> DataFrame:
    """Adds in_ring: whether the batch is in the longest suffix within the budget, which has one batch at least."""
    t = b if "end_offset" in b.columns else _end_offset(b)
    head = F.broadcast(t.agg(F.max("end_offset").alias("_end"), F.max("batch_id").alias("_newest")))  # one row
    held = (F.col("_end") - F.col("end_offset") + F.col("bytes") <= budget) | (F.col("batch_id") == F.col("_newest"))
    return t.join(head).withColumn("in_ring", held).select(*b.columns, "in_ring")


def ring_floor(b: DataFrame, budget: int) -> DataFrame:
    """The last seq that the ring no longer has; 0 if it has all."""
    return mark_ring(b, budget).agg(F.coalesce(F.max(F.when(~F.col("in_ring"), F.col("last"))), F.lit(0)).alias("ring_floor"))


def ring_read(b: DataFrame, budget: int, after: int) -> DataFrame:
    """The ring's batches with a seq above `after`, and whether they are all there are."""
    floor = F.broadcast(ring_floor(b, budget))
    return mark_ring(b, budget).filter(F.col("in_ring") & (F.col("last") > after)).join(floor).select("batch_id", "first", "last", (F.lit(after) >= F.col("ring_floor")).alias("complete"))


def key_at(seqs: DataFrame, ring: DataFrame, floor_key: int) -> DataFrame:
    """For each seq asked: the key of the first ring event at or above it; the floor's key if it is older than
    the ring; null if newer. ring: seq, key."""
    low = F.broadcast(ring.agg(F.min("seq").alias("_low")))
    out = asof_join(seqs, ring, "asked", "seq", direction="forward", values=["key"])
    return out.join(low).select("asked", F.when(F.col("asked") < F.col("_low"), F.lit(floor_key).cast("long")).otherwise(F.col("match.key")).alias("key"))


def locate(cursors: DataFrame, checkpoints: DataFrame) -> DataFrame:
    """For each cursor the last checkpoint (seq, key) at or below it."""
    return asof_join(cursors, checkpoints, "cursor", "seq", direction="backward", values=["seq", "key"]).select("cursor", F.col("match.seq").alias("seq"), F.col("match.key").alias("key"))


def subscriber_lag(subs: DataFrame, head_seq: int, head_bytes: int, max_lag: int) -> DataFrame:
    """subs: sub_id, last, sent_bytes, initial_lag, live. Adds the lag in bytes (live ones), in milliseconds,
    and too_slow."""
    lag = F.lit(head_bytes) - F.col("sent_bytes")
    ms = F.greatest(F.lit(0), F.floor(F.shiftright(F.lit(head_seq).cast("long") - F.col("last"), 8) / 1000)).cast("long")
    return subs.withColumn("lag_bytes", F.when(F.col("live"), lag)).withColumn("lag_ms", ms).withColumn("too_slow", F.col("live") & (lag > F.greatest(F.lit(max_lag), F.col("initial_lag"))))


def within_ip_cap(conns: DataFrame, cap: int) -> DataFrame:
    """Adds admitted: the first `cap` connections of an address bucket; a cap of 0 is none."""
    rn = F.row_number().over(W.partitionBy("ip_key").orderBy("connected_at", "conn_id"))
    return conns.withColumn("admitted", F.lit(True) if cap == 0 else rn <= cap)


def cap_labels(conns: DataFrame, cap: int) -> DataFrame:
    """Adds label: that of the first `cap` connections that are open (disconnected_at is null), 'other' for the rest
    and null for those gone, whose slots are free again. TopK picks them, so no window over all rows is needed;
    the cap bounds what is broadcast."""
    is_open = F.col("disconnected_at").isNull()
    first = F.broadcast(conns.filter(is_open).orderBy("connected_at", "conn_id").limit(cap).select("conn_id", F.lit(True).alias("_own")))
    return conns.join(first, "conn_id", "left").withColumn("label", F.when(is_open, F.when(F.col("_own"), F.col("ua")).otherwise("other"))).drop("_own")


def announce(logs: DataFrame, now_us: int) -> DataFrame:
    """logs (writer, assigned, durable, lease_us or null) with the watermark each announces and the seq it counts as
    assigned from then on. A log with events under way announces what is durable; an idle one the clock, but
    never beyond its lease and never less than what is durable; what it announced it won't assign again."""
    idle = F.col("assigned") <= F.col("durable")
    cap = F.when(F.col("lease_us").isNull(), F.lit((1 << 63) - 1)).otherwise(F.greatest(seq_floor(F.col("lease_us")), F.col("durable")))
    mark = F.when(idle, F.least(F.greatest(F.col("durable"), seq_floor(F.lit(now_us)) - 1), cap)).otherwise(F.col("durable"))
    own = own_seq_at_or_below(mark, F.col("writer"))
    return logs.withColumn("watermark", mark).withColumn("assigned", F.when(F.col("watermark") > F.col("durable"), F.greatest("assigned", own)).otherwise(F.col("assigned")))


def recently_gone(conns: DataFrame, n: int = 50) -> DataFrame:
    return conns.filter("disconnected_at is not null").orderBy(F.desc("disconnected_at"), "conn_id").limit(n)


def queued_bytes(pending: DataFrame) -> DataFrame:
    return pending.agg(F.coalesce(F.sum(F.length("frame")), F.lit(0)).cast("long").alias("queued_bytes"))

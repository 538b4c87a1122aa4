"""What storage holds and what requests cost: effects of changes, folds, listings, rollups and metric series."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scalars import list_pages, overwrites_in_place

COUNTS = ["objects", "bytes", "uncertain"]


def fold_counts(*parts: DataFrame) -> DataFrame:
    """component, objects, bytes, uncertain summed over all parts; components at zero are left out."""
    both = reduce(DataFrame.unionByName, [p.select("component", *COUNTS) for p in parts])
    return both.groupBy("component").agg(*[F.sum(c).cast("long").alias(c) for c in COUNTS]).filter("objects <> 0 or bytes <> 0 or uncertain <> 0")


def subtract_counts(mine: DataFrame, other: DataFrame) -> DataFrame:
    """mine less other; uncertain doesn't go below zero."""
    less = other.select("component", *[(-F.col(c)).alias(c) for c in COUNTS])
    both = mine.select("component", *COUNTS).unionByName(less).groupBy("component").agg(*[F.sum(c).cast("long").alias(c) for c in COUNTS])
    return both.withColumn("uncertain", F.greatest("uncertain", F.lit(0))).filter("objects <> 0 or bytes <> 0 or uncertain <> 0")


def net_counts(changes: DataFrame, minus: Column) -> DataFrame:
    """subtract_counts() of one table's rows: the others less those marked `minus`, in one pass."""
    signed = lambda c: F.sum(F.when(minus, -F.col(c)).otherwise(F.col(c))).cast("long")
    both = changes.groupBy("component").agg(*[signed(c).alias(c) for c in COUNTS])
    return both.withColumn("uncertain", F.greatest("uncertain", F.lit(0))).filter("objects <> 0 or bytes <> 0 or uncertain <> 0")


def make_uncertain(counts: DataFrame) -> DataFrame:
    return counts.withColumn("uncertain", F.greatest("uncertain", F.lit(1).cast("long")))


def component_means(counts: DataFrame) -> DataFrame:
    return counts.filter("objects > 0").select("component", F.expr("greatest(bytes, 0L) div objects").alias("mean"))


def effects(ops: DataFrame, means: DataFrame) -> DataFrame:
    """ops (path, i, op, kind, size, component) with what each adds: objects, bytes, uncertain.

    op is put (kind create, replace or overwrite), delete, or list (a size seen, which adds nothing).
    A path's size is known from its last put or listing, until a delete. Rows of equal i come by op, kind and size.
    means has a row a component, which are the few labels of component(), so it is broadcast."""
    before = W.partitionBy("path").orderBy("i", "op", "kind", "size").rowsBetween(W.unboundedPreceding, -1)
    known = F.last(F.struct(F.when(F.col("op") != "delete", F.col("size")).alias("s"))).over(before)["s"]
    t = ops.withColumn("_old", known).join(F.broadcast(means), "component", "left").withColumn("_mean", F.coalesce("mean", F.lit(0).cast("long")))
    old, size = F.col("_old"), F.col("size")
    put, create = F.col("op") == "put", F.col("kind") == "create"
    guess = put & ~create & old.isNull() & ((F.col("kind") == "replace") | overwrites_in_place(F.col("component")))
    gone = F.col("op") == "delete"
    zero = F.lit(0).cast("long")
    objects = F.when(gone, -1).when(put & create, 1).when(put & old.isNull() & ~guess, 1).otherwise(0)
    size_change = F.when(gone, -F.coalesce(old, F.col("_mean"))).when(put & create, size).when(put & old.isNotNull(), size - old).when(put & ~guess, size).otherwise(zero)
    unsure = F.when((gone & old.isNull()) | guess, 1).otherwise(0)
    return t.withColumn("objects", objects.cast("long")).withColumn("bytes", size_change.cast("long")).withColumn("uncertain", unsure.cast("long")).drop("_old", "_mean", "mean")


def copy_effects(copies: DataFrame, means: DataFrame) -> DataFrame:
    """copies (component, src_size, dest_size, null where unknown) with what each adds."""
    t = copies.join(F.broadcast(means), "component", "left")
    s, o = F.col("src_size"), F.col("dest_size")
    objects = F.when(o.isNull(), 1).otherwise(0)
    size = F.when(o.isNotNull() & s.isNotNull(), s - o).when(o.isNotNull(), 0).when(s.isNotNull(), s).otherwise(F.coalesce("mean", F.lit(0)))
    return t.withColumn("objects", objects.cast("long")).withColumn("bytes", size.cast("long")).withColumn("uncertain", F.when(s.isNull(), 1).otherwise(0).cast("long")).drop("mean")


def window_sides(ops: DataFrame, pages: DataFrame, skew: int) -> DataFrame:
    """ops (path, start, end) with side: before (the listing has it), after or unsure, by the page that holds
    the path: the first whose last key is at or past it. Past every page is after. pages: s, r, last (null:
    to the end). An as-of join on the key, not an inequality join."""
    from .asof import asof_join

    edges = pages.select(F.coalesce(F.concat(F.lit("0"), "last"), F.lit("1")).alias("last"), "s", "r")
    keyed = ops.withColumn("_k", F.concat(F.lit("0"), "path"))
    out = asof_join(keyed, edges, "_k", "last", direction="forward", values=["s", "r"], few=True)
    side = F.when(F.col("match").isNull(), "after").when(F.col("end") + skew < F.col("match.s"), "before").when(F.col("start") > F.col("match.r") + skew, "after").otherwise("unsure")
    return out.withColumn("side", side).drop("_k", "match")


def classify_window(ops: DataFrame, pages: DataFrame, skew: int) -> DataFrame:
    """What a window's changes add by component: those before the listing don't, unsure ones are marked so."""
    t = window_sides(ops, pages, skew).filter("side <> 'before'")
    t = t.withColumn("uncertain", F.when(F.col("side") == "unsure", F.greatest("uncertain", F.lit(1).cast("long"))).otherwise(F.col("uncertain")))
    return fold_counts(t)


def observed_total(observed: DataFrame) -> DataFrame:
    """objects, bytes and n of observed listings whose prefix isn't inside another observed one. Every
    ancestor of a prefix is looked up by equality, so no pair of prefixes is compared."""
    parts = F.split(F.rtrim("prefix", F.lit("/")), "/")
    o = observed.withColumn("_parts", parts)
    ancestors = o.select("prefix", F.explode(F.transform(F.sequence(F.lit(1), F.size("_parts")), lambda k: F.array_join(F.slice("_parts", F.lit(1), k), "/"))).alias("above"))
    names = observed.select(F.rtrim("prefix", F.lit("/")).alias("above"), F.col("prefix").alias("_name"))
    nested = ancestors.join(names, "above").filter((F.col("_name") != F.col("prefix")) & F.startswith(F.col("prefix"), F.concat("above", F.lit("/")))).select("prefix").distinct()
    return o.join(nested, "prefix", "left_anti").agg(F.coalesce(F.sum("objects"), F.lit(0)).cast("long").alias("objects"), F.coalesce(F.sum("bytes"), F.lit(0)).cast("long").alias("bytes"), F.count("*").alias("n"))


def merge_observed(mine: DataFrame, other: DataFrame) -> DataFrame:
    """The later listing of each prefix; of equal times, mine."""
    own = mine.select("*", F.lit(1).alias("_first")).unionByName(other.select("*", F.lit(0).alias("_first")))
    return own.groupBy("prefix").agg(F.max_by(F.struct("objects", "bytes", "ms"), F.struct("ms", "_first")).alias("_b")).select("prefix", "_b.*")


def latest_lists(lists: DataFrame) -> DataFrame:
    return lists.groupBy("prefix").agg(F.max_by(F.struct("objects", "bytes", "ms"), F.struct("ms", "objects", "bytes")).alias("_b")).select("prefix", "_b.*")


def running(backfills: DataFrame, now_ms: int, stale_ms: int = 120_000) -> DataFrame:
    return backfills.filter((F.col("phase") == "running") & (F.greatest(F.lit(0), F.lit(now_ms) - F.col("heartbeat_at")) < stale_ms))


def crash_flag(marks: DataFrame) -> DataFrame:
    """inexact: whether some node's mark was open when its next start found it."""
    return marks.agg(F.coalesce(F.bool_or("open"), F.lit(False)).alias("inexact"))


def exit_kind(clean: Column, reason: Column, code: Column) -> Column:
    """none without a record, crash for one that wasn't closed, else its reason and code."""
    return F.when(clean.isNull(), "none").when(~clean, "crash").otherwise(F.concat(reason, F.lit(":"), code.cast("string")))


# --- requests ---


def request_rollup(requests: DataFrame) -> DataFrame:
    return requests.groupBy("op", "component", "client", "result").agg(F.count("*").alias("requests"))


def byte_rollup(requests: DataFrame) -> DataFrame:
    return requests.filter("bytes > 0").groupBy("dir", "component", "client").agg(F.sum("bytes").cast("long").alias("bytes"))


def page_rollup(listings: DataFrame) -> DataFrame:
    """Listing requests by component; listings: component, keys."""
    return listings.groupBy("component").agg(F.sum(list_pages(F.col("keys"))).cast("long").alias("pages"))


def histogram(rows: DataFrame, value: str, by: list[str], bounds: list[float]) -> DataFrame:
    """Cumulative buckets in one pass: by, le, n. All sums share one partial aggregate; rows aren't multiplied."""
    sums = rows.groupBy(*by).agg(*[F.count(F.when(F.col(value) <= b, 1)).alias(f"b{i}") for i, b in enumerate(bounds)])
    cells = F.array(*[F.struct(F.lit(i).alias("bucket"), F.lit(float(b)).alias("le"), F.col(f"b{i}").alias("n")) for i, b in enumerate(bounds)])
    return sums.select(*by, F.explode(cells).alias("_c")).select(*by, "_c.*")


def throttled(requests: DataFrame) -> DataFrame:
    """Answers that asked to slow down, by kind: 429, or 503 that says so."""
    hit = (F.col("status") == 429) | ((F.col("status") == 503) & F.contains("message", F.lit("SlowDown")))
    return requests.filter(hit).groupBy("kind").agg(F.count("*").alias("throttled"))


def format_errors(errors: DataFrame) -> DataFrame:
    """Counts by format, 0 for those without any. The labels are fixed values."""
    labels = errors.sparkSession.createDataFrame([(x,) for x in ("segment", "log_stream", "applied_marker", "cluster_version", "control_object")], "format string")
    return labels.join(errors.groupBy("format").agg(F.count("*").alias("n")), "format", "left").select("format", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


# --- metric series: updates (name, labels, handle, ts, value), closed handles ---


def gauge_shares(updates: DataFrame, closed: DataFrame) -> DataFrame:
    """A series' value: the last values of its open handles, summed. Series without open handles are gone."""
    last = updates.groupBy("name", "db", "handle").agg(F.max_by("value", F.struct("ts", "seq")).alias("value"))
    return last.join(closed.select("handle"), "handle", "left_anti").groupBy("name", "db").agg(F.sum("value").alias("value"))


def series_sum(series: DataFrame, db: str | None = None) -> DataFrame:
    s = series if db is None else series.filter(F.col("db") == db)
    return s.groupBy("name").agg(F.sum("value").alias("total"))


def cache_pivot(accesses: DataFrame) -> DataFrame:
    """hits and misses by entry kind; whatever isn't a hit is a miss."""
    hit = F.col("result") == "hit"
    return accesses.groupBy("kind").agg(F.coalesce(F.sum(F.when(hit, F.col("n"))), F.lit(0)).cast("long").alias("hits"), F.coalesce(F.sum(F.when(~F.coalesce(hit, F.lit(False)), F.col("n"))), F.lit(0)).cast("long").alias("misses"))


def lsm_totals(shapes: DataFrame) -> DataFrame:
    """shapes (db, l0 array of sizes, runs array of arrays of sizes, and maybe checkpoints, an array) to counts, bytes
    and the largest run."""
    total = lambda a: F.aggregate(a, F.lit(0).cast("long"), lambda s, x: s + x)
    by_run = F.transform("runs", lambda r: total(r))
    return shapes.select(
        "db", F.size("l0").cast("long").alias("l0_count"), total(F.col("l0")).alias("l0_bytes"), F.size("runs").cast("long").alias("runs"),
        total(F.transform("runs", lambda r: F.size(r).cast("long"))).alias("compacted_ssts"), total(by_run).alias("compacted_bytes"), F.coalesce(F.array_max(by_run), F.lit(0).cast("long")).alias("largest_run"),
        *([F.size("checkpoints").cast("long").alias("checkpoints")] if "checkpoints" in shapes.columns else []),
    )


def newest_handle(handles: DataFrame) -> DataFrame:
    return handles.groupBy("name").agg(F.max_by(F.struct("handle", "registered"), F.struct("registered", "handle")).alias("_b")).select("name", "_b.*")


def prometheus_text(series: DataFrame) -> DataFrame:
    """line: one a series, in text exposition format; labels is a map."""
    value = lambda v: F.replace(F.replace(F.replace(v, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit("\n"), F.lit("\\n"))
    pairs = F.transform(F.array_sort(F.map_entries("labels")), lambda e: F.concat(e["key"], F.lit('="'), value(e["value"]), F.lit('"')))
    labels = F.when(F.size("labels") > 0, F.concat(F.lit("{"), F.array_join(pairs, ","), F.lit("}"))).otherwise("")
    return series.select(F.concat(F.col("name"), labels, F.lit(" "), F.col("value").cast("string")).alias("line"))


def exposition(series: DataFrame, kinds: DataFrame) -> DataFrame:
    """A whole page of series: name, line, place. Each name's TYPE line (place 0) comes before its series; kinds: name, kind."""
    heads = series.select("name").distinct().join(kinds, "name").select("name", F.concat(F.lit("# TYPE "), "name", F.lit(" "), "kind").alias("line"), F.lit(0).alias("place"))
    lines = prometheus_text(series).select(F.regexp_extract("line", r"^[^{ ]+", 0).alias("name"), "line", F.lit(1).alias("place"))
    return heads.unionByName(lines)


def page_gaps(pages: DataFrame) -> DataFrame:
    """Time between the starts of a listing's pages: listing, page, gap."""
    order = W.partitionBy("listing").orderBy("page")
    return pages.withColumn("gap", F.lead("s").over(order) - F.col("s")).filter("gap is not null").select("listing", "page", "gap")


def backfill_summary(backfills: DataFrame) -> DataFrame:
    """Without the timeline and the counts by component."""
    return backfills.drop("timeline", "components")


# --- windows of a listing: changes made while everything is listed ---


def capture_window(changes: DataFrame, begin_us: int, end_us: int | None, kept: int) -> DataFrame:
    """changes (i, end, ...) with part: 'before' the window of a listing, in the 'window' (the first `kept` by i,
    which are sorted by the listing later), 'overflow' (the rest of the window) or 'after'. end_us null: it is open."""
    inside = (F.col("end") >= begin_us) & (F.lit(True) if end_us is None else F.col("end") < end_us)
    last = F.broadcast(changes.filter(inside).orderBy("i").limit(kept).agg(F.max("i").alias("_last")))  # one row
    part = F.when(F.col("end") < begin_us, "before").when(~inside, "after").when(F.col("i") <= F.col("_last"), "window").otherwise("overflow")
    return changes.join(last).withColumn("part", part).drop("_last")


def end_window(captured: DataFrame, pages: DataFrame, skew: int, done: bool) -> DataFrame:
    """What the changes add by component once the window has ended: those kept are sorted against the listing's
    pages, what overflowed is uncertain; of a listing that didn't finish the whole window is."""
    own = captured.filter("part = 'window'")
    sorted_out = classify_window(own, pages, skew) if done else make_uncertain(own)
    return fold_counts(captured.filter("part in ('before', 'after')"), make_uncertain(captured.filter("part = 'overflow'")), sorted_out)


def local_view(captured: DataFrame) -> DataFrame:
    """One node's part of the statistics: its pending counts by component (those from before the window included)
    and how many changes its window holds."""
    n = F.broadcast(captured.agg(F.count(F.when(F.col("part") == "window", 1)).alias("window_changes")))  # one row
    return fold_counts(captured.filter("part in ('before', 'after')")).join(n)

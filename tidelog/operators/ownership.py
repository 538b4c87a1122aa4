"""Slot layouts, ownership histories and topologies."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scalars import SLOTS

# --- layouts: rows (shard, lo, hi) ---


def uniform_layout(n: int) -> list[tuple[int, int, int]]:
    cut = lambda k: -(-k * SLOTS // n)
    return [(k, cut(k), cut(k + 1)) for k in range(n)]


def split_layout(layout: list[tuple[int, int, int]], shard: int, next_id: int) -> list[tuple[int, int, int]]:
    """The shard's range in two halves under new ids, in slot order. A layout is a few rows of control state."""
    out = []
    for s, lo, hi in sorted(layout, key=lambda r: r[1]):
        if s == shard:
            if hi - lo < 2:
                raise ValueError(f"shard {s} has one slot")
            mid = (lo + hi) // 2
            out += [(next_id, lo, mid), (next_id + 1, mid, hi)]
        else:
            out.append((s, lo, hi))
    return out


def merge_layout(layout: list[tuple[int, int, int]], left: int, right: int, next_id: int) -> list[tuple[int, int, int]]:
    """Two neighbouring ranges as one under a new id."""
    by = {s: (lo, hi) for s, lo, hi in layout}
    (a, b), (c, d) = by[left], by[right]
    if b != c:
        raise ValueError(f"shards {left} and {right} aren't neighbours")
    return sorted([r for r in layout if r[0] not in (left, right)] + [(next_id, a, d)], key=lambda r: r[1])


def layout_frame(spark: SparkSession, layout: list[tuple[int, int, int]]) -> DataFrame:
    return spark.createDataFrame(layout, "shard long, lo int, hi int")


def layout_faults(layout: DataFrame, next_id: int, by: list[str] | None = None) -> DataFrame:
    """What is wrong with a layout, or with each of many told apart by `by`, one row a fault: by, rule, shard."""
    by = by or []
    order = W.partitionBy(*(by or [F.lit(0)])).orderBy("lo")
    t = layout.withColumn("_prev", F.lag("hi").over(order)).withColumn("_next", F.lead("lo").over(order)).withColumn("_same", F.count("*").over(W.partitionBy(*by, "shard")))
    rules = {
        "start": F.col("_prev").isNull() & (F.col("lo") != 0),
        "gap": F.col("_prev").isNotNull() & (F.col("lo") != F.col("_prev")),
        "end": F.col("_next").isNull() & (F.col("hi") != SLOTS),
        "empty": F.col("lo") >= F.col("hi"),
        "id": F.col("shard") >= next_id,
        "twice": F.col("_same") > 1,
    }
    found = F.array_compact(F.array(*[F.when(c, F.lit(k)) for k, c in rules.items()]))
    return t.select(*by, F.explode(found).alias("rule"), "shard").distinct()


def route(rows: DataFrame, layout: DataFrame) -> DataFrame:
    """Adds shard by slot. A layout covers 65,536 slots at most, so it is expanded to one row a slot and joined
    by equality: the small side has a proven bound, and no inequality join is planned."""
    slots = layout.select("shard", F.explode(F.sequence("lo", F.col("hi") - 1)).alias("slot"))
    return rows.join(F.broadcast(slots), "slot", "left")


# --- assignments: rows (shard, epoch, floor, owner struct, replicas array, history array of spans) ---


def spans(assignments: DataFrame) -> DataFrame:
    """One row a span: shard, i, epoch, node_id, incarnation, from, until."""
    return assignments.select("shard", F.posexplode("history").alias("i", "s")).select("shard", "i", "s.*")


def authority_at(positions: DataFrame, history: DataFrame) -> DataFrame:
    """positions (shard, pos, ...) with the epoch and incarnation of the span that holds each, null if none
    does. Spans of a valid history are disjoint, so it is an as-of join on their start and a test of their end."""
    from .asof import asof_join

    out = asof_join(positions, history, "pos", "from", by=["shard"], values=["epoch", "incarnation", "until"])
    inside = F.col("match.until").isNull() | (F.col("pos") <= F.col("match.until"))
    return out.select(*positions.columns, F.when(inside, F.col("match.epoch")).alias("span_epoch"), F.when(inside, F.col("match.incarnation")).alias("span_incarnation"))


def accepts(writes: DataFrame, history: DataFrame) -> DataFrame:
    """writes (shard, epoch, incarnation, pos) with accepted: whether the span that decided the position is
    the write's. Positions that no retained span holds aren't accepted."""
    out = authority_at(writes, history)
    ok = (F.col("span_epoch") == F.col("epoch")) & (F.col("span_incarnation") == F.col("incarnation"))
    return out.withColumn("accepted", F.coalesce(ok, F.lit(False))).drop("span_epoch", "span_incarnation")


def history_faults(history: DataFrame, heads: DataFrame) -> DataFrame:
    """Violated rules: shard, i, rule. heads: shard, epoch, floor, owner (incarnation or null)."""
    order = W.partitionBy("shard").orderBy("i")
    h = history.withColumn("_epoch", F.lead("epoch").over(order)).withColumn("_from", F.lead("from").over(order))
    h = h.join(heads.select("shard", F.col("epoch").alias("_head"), F.col("floor").alias("_floor"), F.col("owner").alias("_owner")), "shard")
    last = F.col("_epoch").isNull()
    is_open = F.col("until").isNull()
    rules = {
        "epochs": F.col("_epoch") <= F.col("epoch"),
        "open_inside": ~last & is_open,
        "contiguous": F.col("until") + 1 != F.col("_from"),
        "future_epoch": F.col("epoch") > F.col("_head"),
        "empty": F.col("until") < F.col("from"),
        "past_floor": F.col("until") > F.col("_floor"),
        "open_epoch": last & is_open & (F.col("epoch") != F.col("_head")),
        "open_owner": last & is_open & (F.col("_owner").isNull() | (F.col("incarnation") != F.col("_owner"))),
        "open_start": last & is_open & (F.col("from") != F.col("_floor") + 1),
        "no_open": last & ~is_open & F.col("_owner").isNotNull(),
    }
    found = F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(k)) for k, c in rules.items()]))
    return h.select("shard", "i", F.explode(found).alias("rule"))


def owned_by(heads: DataFrame, members: DataFrame) -> DataFrame:
    """Shards whose owner is the member, by node and incarnation."""
    return heads.join(members, ["node_id", "incarnation"])


def open_span(history: Column) -> Column:
    last = F.element_at(history, -1)
    return F.when((F.size(history) > 0) & last["until"].isNull(), last)


def trim(history: DataFrame, below: int) -> DataFrame:
    """Spans that end at or above a position, and open ones."""
    return history.filter(F.col("until").isNull() | (F.col("until") >= below))


def normal_replicas(replicas: Column, owner: Column) -> Column:
    """Sorted, without the owner's node, one a node."""
    rest = F.array_sort(F.filter(replicas, lambda r: ~r["node_id"].eqNullSafe(owner)))
    first = F.transform(rest, lambda r, i: F.struct(r.alias("r"), i.alias("i")))
    one = F.filter(first, lambda x: F.array_position(F.transform(rest, lambda r: r["node_id"]), x["r"]["node_id"]) == x["i"] + 1)
    return F.transform(one, lambda x: x["r"])


HEAD = "shard long, epoch long, version long, floor long, node_id string, incarnation string, frozen long, history array<struct<epoch:long,node_id:string,incarnation:string,from:long,until:long>>"


class Fold:
    """The state of one shard under ordered operations: create, acquire, release, freeze, trim.

    Each is a conditional write: it changes nothing when its condition doesn't hold."""

    def __init__(self, floor: int = 0):
        self.epoch = self.version = 0
        self.floor = floor
        self.owner: tuple[str, str] | None = None
        self.frozen: int | None = None
        self.history: list[dict] = []

    def _close(self, end: int) -> None:
        if self.history and self.history[-1]["until"] is None:
            span = self.history[-1]
            if end < span["from"]:
                self.history.pop()
            else:
                span["until"] = end
                self.floor = max(self.floor, end)
        self.owner = None

    def _open(self, who: tuple[str, str]) -> None:
        self.epoch += 1
        self.history.append({"epoch": self.epoch, "node_id": who[0], "incarnation": who[1], "from": self.floor + 1, "until": None})
        self.owner = who

    def apply(self, op: str, who: tuple[str, str] | None, end: int | None, to: tuple[str, str] | None = None, arg: int | None = None) -> bool:
        if op == "trim":
            kept = [s for s in self.history if s["until"] is None or s["until"] >= end]
            if len(kept) == len(self.history):
                return False
            self.history = kept
        elif self.frozen is not None:
            return False
        elif op == "acquire":
            if self.owner == who:
                return False
            self._close(self.floor if end is None else end)
            self._open(who)
        elif op in ("release", "freeze"):
            if self.owner != who or who is None:
                return False
            self._close(end)
            if op == "freeze":
                self.frozen = arg
                self.epoch += 1
            elif to is None:
                self.epoch += 1
            else:
                self._open(to)
        else:
            raise ValueError(op)
        self.version += 1
        return True


def fold_assignments(ops: DataFrame) -> DataFrame:
    """The heads after an operation log: shard, i (order), op, node_id, incarnation, end, to_node,
    to_incarnation, arg. Order matters, so it is a fold per shard; a shard's rows arrive sorted and stream by."""
    none = lambda x: None if pd.isna(x) else x

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, state = None, Fold()

        def head() -> pd.DataFrame:
            o = state.owner or (None, None)
            return pd.DataFrame([(at, state.epoch, state.version, state.floor, *o, state.frozen, state.history)], columns=["shard", "epoch", "version", "floor", "node_id", "incarnation", "frozen", "history"]).astype({"frozen": "Int64"})

        for df in batches:
            for r in df.itertuples(index=False):
                if r.shard != at:
                    if at is not None:
                        yield head()
                    at, state = r.shard, Fold()
                member = lambda a, b: None if none(a) is None else (a, b)
                end, arg = none(r.end), none(r.arg)
                state.apply(r.op, member(r.node_id, r.incarnation), None if end is None else int(end), member(r.to_node, r.to_incarnation), None if arg is None else int(arg))
        if at is not None:
            yield head()

    dealt = ops.select("shard", "i", "op", "node_id", "incarnation", "end", "to_node", "to_incarnation", "arg").repartition("shard").sortWithinPartitions("shard", "i")
    return dealt.mapInPandas(run, HEAD)


# --- topologies: rows (range, epoch, version, node_id, incarnation) ---


def to_topology(heads: DataFrame) -> DataFrame:
    return heads.select(F.col("shard").alias("range"), "epoch", "version", "node_id", "incarnation")


def merge_topologies(mine: DataFrame, other: DataFrame) -> DataFrame:
    """The newer view of each range; of equal versions, mine."""
    own = mine.select("*", F.lit(1).alias("_first")).unionByName(other.select("*", F.lit(0).alias("_first")))
    cols = [c for c in mine.columns if c != "range"]
    return own.groupBy("range").agg(F.max_by(F.struct(*cols), F.struct("version", "_first")).alias("_b")).select("range", "_b.*")


def next_generation(mine: DataFrame, merged: DataFrame, generation: int) -> DataFrame:
    """One row: the generation, raised if the merge changed anything."""
    changed = merged.exceptAll(mine.select(*merged.columns)).limit(1)
    return changed.agg((F.count("*") + generation).cast("long").alias("generation"))


def readable(ranges: DataFrame, alive: DataFrame, positions: DataFrame, least: int) -> DataFrame:
    """Members a range can be read from, owner first: those not dead whose published position of the range
    is `least` at least. ranges: range, node_id, incarnation, role ('owner' or 'replica'), ord."""
    up = alive.filter("liveness <> 'dead'").select("node_id", "incarnation")
    at = positions.select("range", "node_id", "incarnation", "position").filter(F.col("position") >= least)
    out = ranges.join(up, ["node_id", "incarnation"]).join(at, ["range", "node_id", "incarnation"])
    rank = F.row_number().over(W.partitionBy("range").orderBy(F.when(F.col("role") == "owner", 0).otherwise(1), "ord", "node_id"))
    return out.withColumn("rank", rank.cast("long"))


def is_split(parents: Column) -> Column:
    """A reshard with one parent is a split, with two a merge."""
    return F.size(parents) == 1

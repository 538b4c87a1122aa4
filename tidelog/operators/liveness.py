"""Leases and heartbeats: who is live, suspect or dead."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def last_change(observations: DataFrame) -> DataFrame:
    """Per lease: the latest observation, with changed_at, when (incarnation, renewals, ended) last changed.
    observations: node_id, observed_us, incarnation, renewals, ended."""
    seen = F.struct("incarnation", "renewals", "ended")
    order = W.partitionBy("node_id").orderBy("observed_us", "renewals")
    t = observations.withColumn("_changed", F.coalesce(F.lag(seen).over(order) != seen, F.lit(True)))
    latest = F.max_by(seen, F.struct("observed_us", "renewals")).alias("_l")
    return t.groupBy("node_id").agg(latest, F.max(F.when(F.col("_changed"), F.col("observed_us"))).alias("changed_at")).select("node_id", "_l.*", "changed_at")


def classify_leases(leases: DataFrame, now_us: int, ttl_us: int, skew_us: int) -> DataFrame:
    """Adds liveness: dead if ended or quiet for more than ttl + skew, suspect above half the ttl, else live."""
    quiet = F.lit(now_us) - F.col("changed_at")
    out = F.when(F.col("ended") | (quiet > ttl_us + skew_us), "dead").when(quiet * 2 > ttl_us, "suspect").otherwise("live")
    return leases.withColumn("liveness", out)


def by_liveness(members: DataFrame, liveness: str) -> DataFrame:
    return members.filter(F.col("liveness") == liveness)


def up(members: DataFrame) -> DataFrame:
    return members.filter("liveness <> 'dead'")


def settled(members: DataFrame) -> DataFrame:
    return members.filter("liveness = 'live' and not draining")


def incarnation_liveness(asked: DataFrame, members: DataFrame) -> DataFrame:
    """asked (node_id, incarnation) with liveness: dead if another incarnation holds the lease, null if nobody."""
    m = members.select("node_id", F.col("incarnation").alias("_i"), F.col("liveness").alias("_l"))
    return asked.join(m, "node_id", "left").withColumn("liveness", F.when(F.col("_i") == F.col("incarnation"), F.col("_l")).when(F.col("_i").isNotNull(), "dead")).drop("_i", "_l")


def lease_valid(renewals: DataFrame, now_us: int, ttl_us: int, skew_us: int) -> DataFrame:
    """Adds valid (until ttl - skew after the renewal was sent) and lapsed (2 skews later)."""
    end = F.col("sent_us") + (ttl_us - skew_us)
    return renewals.withColumn("valid", F.lit(now_us) < end).withColumn("lapsed", F.lit(now_us) > end + 2 * skew_us)


def quorum(n: Column | int) -> Column:
    return F.floor((n if isinstance(n, Column) else F.lit(n)) / 2).cast("long") + 1


def latest_beats(beats: DataFrame) -> DataFrame:
    """The last beat of each viewer about each peer: viewer, peer, incarnation, heard_us."""
    best = F.max_by(F.struct("incarnation", "heard_us"), F.struct("heard_us", "incarnation"))
    return beats.groupBy("viewer", "peer").agg(best.alias("_b")).select("viewer", "peer", "_b.*")


def beat_state(beats: DataFrame) -> DataFrame:
    """What each viewer knows of each peer. beats: viewer, peer, at_us, kind, incarnation, position, of the kinds beat
    (an answer), refused (its port is closed) and report (what it says of others). Returns viewer, peer, heard_us and
    incarnation of the last answer, position, the furthest told by that incarnation, gone (refused since the last
    answer) and reported_us."""
    at = lambda kind: F.max(F.when(F.col("kind") == kind, F.col("at_us")))
    last = F.max(F.when(F.col("kind") == "beat", F.struct("at_us", "incarnation")))["incarnation"]
    per = beats.groupBy("viewer", "peer").agg(at("beat").alias("heard_us"), last.alias("incarnation"), at("refused").alias("_refused"), at("report").alias("reported_us"))
    told = beats.filter("kind = 'beat'").groupBy("viewer", "peer", "incarnation").agg(F.max("position").alias("position"))
    out = per.join(told, ["viewer", "peer", "incarnation"], "left")
    gone = F.coalesce(F.col("_refused") > F.coalesce("heard_us", F.lit(-1)), F.lit(False))
    return out.select("viewer", "peer", "heard_us", "incarnation", "position", gone.alias("gone"), "reported_us")


def has_quorum(members: DataFrame, heard: DataFrame, now_us: int, within_us: int) -> DataFrame:
    """For each viewer: heard (members heard for less than `within`, itself included), members, quorum."""
    ok = F.count(F.when((F.lit(now_us) - F.col("heard_us") < within_us) & (F.col("viewer") != F.col("peer")), 1))
    per = heard.groupBy("viewer").agg((ok + 1).alias("heard"))
    n = F.broadcast(members.agg(F.count("*").alias("members")))
    return per.join(n).withColumn("quorum", F.col("heard") >= quorum(F.col("members")))


def verdicts(votes: DataFrame, members: int, may_write: bool, timeout_us: int, dead_after_us: int) -> DataFrame:
    """Per node and incarnation asked about: dead, live or suspect. votes, one a viewer: node_id, asked
    (incarnation), seen (incarnation or null), age_us (since it was heard, or since the viewer began),
    gone, since_us (age of the viewer's report; null for the own view).

    A report counts while it is younger than the timeout, and its ages grow by its own."""
    v = votes.filter(F.col("since_us").isNull() | (F.col("since_us") < timeout_us))
    age = F.col("age_us") + F.coalesce("since_us", F.lit(0))
    ours = ~F.col("gone") & F.coalesce(F.col("seen") == F.col("asked"), F.lit(False))
    replaced = ~F.col("gone") & F.col("seen").isNotNull() & (F.col("seen") != F.col("asked")) & (age < timeout_us)
    against = F.col("gone") | replaced | (age > dead_after_us)
    per = v.groupBy("node_id", "asked").agg(F.count(F.when(against, 1)).alias("against"), F.min(F.when(ours, age)).alias("heard_age_us"))
    dead = (F.col("against") >= quorum(members)) & F.lit(may_write)
    return per.withColumn("verdict", F.when(dead, "dead").when(F.col("heard_age_us") < timeout_us, "live").otherwise("suspect"))


def newest_generation(beats: DataFrame) -> DataFrame:
    return beats.agg(F.max("generation").alias("generation"))


def epoch_holds(claims: DataFrame) -> DataFrame:
    """claims (object, i, epoch, node_id): which claim took effect, being above every earlier one of its
    object, and holder: whether it is the object's highest."""
    before = W.partitionBy("object").orderBy("i").rowsBetween(W.unboundedPreceding, -1)
    t = claims.withColumn("won", F.col("epoch") > F.coalesce(F.max("epoch").over(before), F.lit(-1)))
    return t.withColumn("holder", F.col("won") & (F.col("epoch") == F.max("epoch").over(W.partitionBy("object"))))


def heard_members(members: DataFrame, heard: DataFrame, me: str, now_us: int, within_us: int) -> DataFrame:
    """Members that a viewer heard for less than `within`, itself included, with the incarnation last heard."""
    own = heard.filter(F.col("viewer") == me).select(F.col("peer").alias("node_id"), "incarnation", "heard_us")
    fresh = (F.lit(now_us) - F.col("heard_us") < within_us) | (F.col("node_id") == me)
    return members.join(own, "node_id", "left").filter(F.coalesce(fresh, F.lit(False))).select("node_id", "incarnation")


def dead_without_ranges(members: DataFrame, heads: DataFrame) -> DataFrame:
    """Dead members that own no range any more."""
    return members.filter("liveness = 'dead'").join(heads, ["node_id", "incarnation"], "left_anti")

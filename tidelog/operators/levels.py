"""Feature levels of a cluster: which formats a level writes, and which changes of level are allowed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .asof import asof_join


def magic_of(levels: DataFrame, asked: DataFrame) -> DataFrame:
    """asked (level) with the magic of the newest level at or below it that has one. levels: level, magic."""
    known = levels.filter("magic is not null").select("level", "magic")
    return asof_join(asked, known, "level", "level", values=["level", "magic"], few=True).select("level", F.col("match.magic").alias("magic"))


def in_window(clusters: DataFrame, low: int, high: int) -> DataFrame:
    """clusters (active, target) with fault: outside (its level isn't this build's), rising (towards one past it) or null."""
    fault = F.when(~F.col("active").between(low, high), "outside").when(F.col("target") > high, "rising")
    return clusters.withColumn("fault", fault)


def lowering_faults(steps: DataFrame, levels: DataFrame) -> DataFrame:
    """steps (id, active, to) with what forbids each: not_below, unknown or persistent; none is no row.

    A step down passes the levels to + 1 ... active, of which each must be known and leave no new bytes behind."""
    above = steps.filter((F.col("to") <= 0) | (F.col("to") >= F.col("active"))).select("id", F.lit("not_below").alias("fault"))
    down = steps.filter((F.col("to") > 0) & (F.col("to") < F.col("active"))).select("id", F.explode(F.expr("sequence(to + 1, active)")).alias("level"))
    met = down.join(F.broadcast(levels.select("level", "persistent")), "level", "left")
    fault = F.when(F.col("persistent").isNull(), "unknown").when(F.col("persistent"), "persistent")
    return above.unionByName(met.withColumn("fault", fault).filter("fault is not null").select("id", "fault").distinct())

"""As-of joins, which Spark SQL has no syntax for: one sort of both sides by (key, time), no inequality join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .ranges import parts_for, range_of

#: A right side of so many rows at most can be looked up in the plan itself.
FEW = 64


def _look_up(left: DataFrame, right: DataFrame, left_on: str, right_on: str, back: bool, values: list[str]) -> DataFrame | None:
    """left with `match` from a right side of FEW rows at most, which become a sorted array: no shuffle, no second
    scan. None for larger ones."""
    best = right.filter(F.col(right_on).isNotNull()).groupBy(F.col(right_on).alias("_at")).agg(F.max(F.struct(*values)).alias("_value"))
    rows = sorted(best.limit(FEW + 1).collect(), key=lambda r: r["_at"])
    if len(rows) > FEW:
        return None
    kinds = {c: right.schema[c].dataType for c in (right_on, *values)}
    none = F.lit(None).cast(best.schema["_value"].dataType)
    if not rows:
        return left.withColumn("match", none)
    place = F.col(left_on)
    passed = [(place >= b if back else place > b).cast("int") for b in (F.lit(r["_at"]).cast(kinds[right_on]) for r in rows)]
    every = F.array(*[F.struct(*[F.lit(r["_value"][c]).cast(kinds[c]).alias(c) for c in values]) for r in rows])
    n = sum(passed[1:], passed[0])
    at = n if back else n + 1
    return left.withColumn("match", F.when((at >= 1) & (at <= len(rows)), F.element_at(every, F.greatest(F.lit(1), F.least(at, F.lit(len(rows)))))).otherwise(none))


def asof_join(left: DataFrame, right: DataFrame, left_on: str, right_on: str, by: list[str] | None = None, direction: str = "backward", values: list[str] | None = None, parts: int | None = None, few: bool = False) -> DataFrame:
    """left with, as a struct `match`, the right row nearest by right_on: at most left_on (backward) or at
    least (forward). Null where there is none or the place is null; of right rows at the same place, the greatest in `values`.

    Both sides are united and swept once. With `by` that is a window over the keys. Without, rows are dealt
    by ranges of the place (as many as the input's size asks for), swept in each, and what a range leaves open
    is what the nearest range beside it that has a right row ends with: one row a range is carried over, and no
    task sees all rows. few: the right side is control state, known to be small; if it has FEW rows at most, it
    becomes an array in the plan instead."""
    by = by or []
    values = values or [c for c in right.columns if c not in by]
    back = direction == "backward"
    if few and not by and (found := _look_up(left, right, left_on, right_on, back, values)) is not None:
        return found
    row = F.struct(*left.columns)
    none = lambda df, c: F.lit(None).cast(df.select(c).schema[0].dataType)
    one = left.select(*by, F.col(left_on).alias("_at"), F.lit(1 if back else 0).alias("_side"), row.alias("_row"), none(right, F.struct(*values)).alias("_value"))
    two = right.filter(F.col(right_on).isNotNull()).select(*by, F.col(right_on).alias("_at"), F.lit(0 if back else 1).alias("_side"), none(left, row).alias("_row"), F.struct(*values).alias("_value"))
    both = one.unionByName(two)
    # Of equals the one swept last must be the greatest, either way.
    order = [F.col("_at"), F.col("_side"), F.col("_value")] if back else [F.col("_at").desc(), F.col("_side").desc(), F.col("_value")]
    swept = lambda keys: F.last("_value", ignorenulls=True).over(W.partitionBy(*keys).orderBy(*order).rowsBetween(W.unboundedPreceding, 0))
    placed = lambda c: F.when(F.col("_at").isNotNull(), c if isinstance(c, Column) else F.col(c))
    if by:
        return both.withColumn("match", swept(by)).filter("_row is not null").select("_row.*", placed("match").alias("match"))
    parts = parts or parts_for(left, right)
    if parts == 1:
        return both.withColumn("match", swept([F.lit(0)])).filter("_row is not null").select("_row.*", placed("match").alias("match"))
    dealt = both.withColumn("_p", range_of(both.select("_at"), "_at", parts))
    ends = dealt.filter("_value is not null").groupBy("_p").agg((F.max if back else F.min)("_at").alias("_end")).alias("e")
    ends = dealt.alias("d").filter("_value is not null").join(F.broadcast(ends), (F.col("d._p") == F.col("e._p")) & (F.col("d._at") == F.col("e._end"))).groupBy(F.col("d._p").alias("_p")).agg(F.max("d._value").alias("_last"))
    every = left.sparkSession.range(parts).select(F.col("id").cast("int").alias("_p")).join(ends, "_p", "left")
    beside = W.orderBy("_p" if back else F.desc("_p")).rowsBetween(W.unboundedPreceding, -1)
    carried = every.select("_p", F.last("_last", ignorenulls=True).over(beside).alias("_carried"))
    out = dealt.withColumn("match", swept(["_p"])).filter("_row is not null").join(F.broadcast(carried), "_p")
    return out.select("_row.*", placed(F.coalesce("match", "_carried")).alias("match"))

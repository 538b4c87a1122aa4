"""Dealing rows by ranges of a key, with fixed bounds, so that every branch of a plan deals them alike."""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: A range has about so many bytes of what is read; there are so many at most.
PART_BYTES, MAX_PARTS = 16 << 20, 20_000
#: Rows that bounds are taken from, at most.
MAX_DRAWN = 100_000
#: So many bounds are compared one by one, more by halving.
FEW_BOUNDS = 64


def parts_for(*dfs: DataFrame) -> int:
    """In how many ranges rows are dealt: by the bytes of the tables that a plan reads, as Spark knows them. 1 is a
    single window's work. Sources of unknown size count as the session's shuffle partitions."""
    size, unknown = 0, False
    for df in dfs:
        leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
        for i in range(leaves.size()):
            own = int(str(leaves.apply(i).stats().sizeInBytes()))
            unknown |= own >= 1 << 60
            size += 0 if own >= 1 << 60 else own
    parts = int(dfs[0].sparkSession.conf.get("spark.sql.shuffle.partitions")) if unknown else 1
    return max(parts, min(MAX_PARTS, size // PART_BYTES + 1))


def range_of(df: DataFrame, key: str, parts: int, a_part: int = 32) -> Column:
    """The number of the row's range, rising with the key. Bounds are taken from a few random rows; they say
    only how evenly rows are dealt, never what comes out. (repartitionByRange draws its bounds anew whenever
    a plan holds it twice, so numbers of its partitions can't be joined.)"""
    if parts <= 1:
        return F.lit(0)
    some = df.select(F.col(key).alias("k")).filter("k is not null").orderBy(F.rand(7)).limit(min(MAX_DRAWN, a_part * parts)).collect()
    found = sorted(r["k"] for r in some)
    bounds = sorted({found[len(found) * i // parts] for i in range(1, parts)}) if found else []
    if len(bounds) <= FEW_BOUNDS:
        return F.coalesce(reduce(add, [(F.col(key) > F.lit(b)).cast("int") for b in bounds], F.lit(0)), F.lit(0))
    n, every = len(bounds), F.array(*[F.lit(b) for b in bounds])
    steps = F.array(*[F.lit(1 << k) for k in reversed(range(n.bit_length()))])
    further = lambda at, step: (at + step <= n) & (F.element_at(every, F.least(at + step, F.lit(n))) < F.col(key))
    return F.aggregate(steps, F.lit(0), lambda at, step: F.when(further(at, step), at + step).otherwise(at))


def running_totals(df: DataFrame, key: str, sums: dict[str, Column], parts: int) -> DataFrame:
    """df, of distinct keys, with `sums`: the totals over all rows of smaller keys (longs, so that any order of
    adding is the same). Rows are dealt by ranges of the key, summed in each and offset by the ranges before, so
    that no task sees all of them."""
    t = df.withColumns({f"_v_{c}": v.cast("long") for c, v in sums.items()}).withColumn("_p", range_of(df, key, parts))
    inside = W.partitionBy("_p").orderBy(key).rowsBetween(W.unboundedPreceding, 0)
    t = t.withColumns({c: F.sum(f"_v_{c}").over(inside) - F.col(f"_v_{c}") for c in sums})
    if parts > 1:
        earlier = W.orderBy("_p").rowsBetween(W.unboundedPreceding, -1)  # a row a range
        totals = t.groupBy("_p").agg(*[F.sum(f"_v_{c}").alias(f"_t_{c}") for c in sums])
        offsets = totals.select("_p", *[F.coalesce(F.sum(f"_t_{c}").over(earlier), F.lit(0)).alias(f"_o_{c}") for c in sums])
        t = t.join(F.broadcast(offsets), "_p").withColumns({c: F.col(c) + F.col(f"_o_{c}") for c in sums})
    return t.select(*df.columns, *sums)

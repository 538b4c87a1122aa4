"""Heap profiles: from the text of a dump to relations of stacks, libraries and totals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import unbias


def _hex(x: Column) -> Column:
    return F.conv(F.regexp_replace(x, "^0x", ""), 16, 10).cast("long")


def parse_heap(dumps: DataFrame) -> DataFrame:
    """dumps (dump, text) to stacks (dump, stack, addrs, objs, bytes), unbiased by the dump's sampling rate.
    Freed stacks, with nothing in use or no address, are left out."""
    rate = F.regexp_extract("text", r"^heap_v2/(\d+)", 1).cast("double")
    body = F.regexp_extract("text", r"(?s)^[^\n]*\n(.*?)(?:\nMAPPED_LIBRARIES:|\z)", 1)
    stacks = F.filter(F.split(body, r"(?m)^@"), lambda s: F.length(F.trim(s)) > 0)
    t = dumps.select("dump", rate.alias("_rate"), F.posexplode(stacks).alias("stack", "_s"))
    first = F.regexp_extract("_s", r"^([^\n]*)", 1)
    t = t.withColumn("addrs", F.transform(F.filter(F.split(F.trim(first), r"\s+"), lambda a: a.rlike("^0x")), _hex))
    t = t.withColumn("_o", F.regexp_extract("_s", r"\n\s*t\*:\s*(-?\d+):\s*(-?\d+)", 1).try_cast("long")).withColumn("_b", F.regexp_extract("_s", r"\n\s*t\*:\s*(-?\d+):\s*(-?\d+)", 2).try_cast("long"))
    t = t.filter((F.col("_o") > 0) & (F.col("_b") > 0) & (F.size("addrs") > 0))
    scaled = F.when(F.col("_rate") > 0, unbias_by(F.col("_o"), F.col("_b"), F.col("_rate"))).otherwise(F.struct(F.col("_o").alias("objs"), F.col("_b").alias("bytes")))
    return t.withColumn("_u", scaled).select("dump", "stack", "addrs", "_u.objs", "_u.bytes")


def unbias_by(objs: Column, size: Column, rate: Column) -> Column:
    return unbias(objs, size, rate)


def parse_maps(lines: DataFrame) -> DataFrame:
    """Lines of a process map (line) to start, end, offset, path of executable, named mappings."""
    pattern = r"^([0-9a-f]+)-([0-9a-f]+)\s+(\S+)\s+([0-9a-f]+)\s+\S+\s+\S+\s+(\S.*)$"
    part = lambda i: F.regexp_extract("line", pattern, i)
    t = lines.filter(F.col("line").rlike(pattern)).filter(part(3).contains("x") & ~part(5).startswith("["))
    number = lambda c: F.conv(c, 16, 10).cast("long")
    return t.select(number(part(1)).alias("start"), number(part(2)).alias("end"), number(part(4)).alias("offset"), part(5).alias("path"))


def locate_library(addresses: DataFrame, maps: DataFrame) -> DataFrame:
    """addresses (addr) with the path of the mapping start <= addr < end. Mappings don't overlap, so it is an
    as-of join and a test of its end."""
    from .asof import asof_join

    out = asof_join(addresses, maps, "addr", "start", values=["start", "end", "path"])
    return out.withColumn("path", F.when(F.col("addr") < F.col("match.end"), F.col("match.path"))).drop("match")


def trim_leaf(frames: Column, entry: Column, internal: Column, look: int = 24) -> Column:
    """Frames of a stack, leaf first, without the allocator's: all up to the last entry point among the first
    `look`, or else leading internal ones; never all of them. entry and internal are arrays of booleans."""
    marks = F.transform(F.slice(entry, 1, look), lambda x, i: F.when(x, i + 1).otherwise(0))
    last = F.coalesce(F.array_max(marks), F.lit(0))
    inside = F.aggregate(internal, F.struct(F.lit(0).alias("n"), F.lit(True).alias("on")), lambda s, x: F.struct((s["n"] + F.when(s["on"] & x, 1).otherwise(0)).alias("n"), (s["on"] & x).alias("on")), lambda s: s["n"])
    skip = F.when(last > 0, last).otherwise(inside)
    return F.when(skip >= F.size(frames), frames).otherwise(F.slice(frames, skip + 1, F.greatest(F.size(frames) - skip, F.lit(1))))


def in_use_by_function(stacks: DataFrame, symbols: DataFrame) -> DataFrame:
    """Totals by function over every stack it is in, once a stack."""
    frames = stacks.select("dump", "stack", "objs", "bytes", F.explode("addrs").alias("addr"))
    named = frames.join(symbols, "addr").select("dump", "stack", "objs", "bytes", "function").distinct()
    return named.groupBy("function").agg(F.sum("objs").alias("objs"), F.sum("bytes").alias("bytes"))


def dictionary(values: DataFrame, column: str) -> DataFrame:
    """Distinct values with dense ids from 0, in their order, numbered without a window over all rows."""
    from .delivery import renumber

    return renumber(values.select(column).distinct(), key=column, anchor=-1).select(column, F.col("number").alias("id"))


def pprof(stacks: DataFrame, symbols: DataFrame, rate: int) -> DataFrame:
    """stacks (dump, addrs, objs, bytes) and symbols (addr, function) to dump, profile: a dump as one pprof file. Its
    locations and then its stacks stream, sorted, into the file, so a task holds a file as it is compressed, the
    names of functions and 8 bytes an address. An address of several functions has a line for each."""
    from collections.abc import Iterator

    used = stacks.select("dump", F.explode("addrs").alias("addr")).distinct().join(symbols.select("addr", "function"), "addr", "left")
    places = used.select("dump", F.lit(0).alias("kind"), F.array(F.col("addr").cast("long")).alias("addrs"), F.lit(0).cast("long").alias("objs"), F.lit(0).cast("long").alias("bytes"), "function")
    samples = stacks.select("dump", F.lit(1).alias("kind"), F.coalesce(F.col("addrs").cast("array<bigint>"), F.array().cast("array<bigint>")).alias("addrs"), F.col("objs").cast("long").alias("objs"), F.col("bytes").cast("long").alias("bytes"), F.lit(None).cast("string").alias("function"))
    rows = places.unionByName(samples).repartition("dump").sortWithinPartitions("dump", "kind", "addrs", "objs", "bytes", "function")

    def run(batches: Iterator) -> Iterator:
        from itertools import groupby

        import numpy as np
        import pyarrow as pa

        from ..functions.pprof import Writer

        dump, file, place = None, None, None  # place: the last address and its functions; more may come
        out = lambda: pa.RecordBatch.from_arrays([pa.array([dump], kind_of), pa.array([file.finish()], pa.binary())], ["dump", "profile"])
        for batch in batches:
            kind_of, at = batch.schema.field("dump").type, 0
            kinds = batch.column(1).to_numpy()
            for own, run_of in groupby(zip(batch.column(0).to_pylist(), kinds.tolist(), strict=True)):
                part = batch.slice(at, len(list(run_of)))
                at += len(part)
                if file is None or own[0] != dump:
                    if file is not None:
                        if place:
                            file.location(*place)
                        yield out()
                    dump, file, place = own[0], Writer(rate), None
                addrs = part.column(2)
                flat = addrs.flatten().to_numpy()
                if own[1] == 0:
                    for a, f in zip(flat.tolist(), part.column(5).to_pylist(), strict=True):
                        if place and place[0] != a:
                            file.location(*place)
                            place = None
                        place = place or (a, [])
                        if f is not None:
                            place[1].append(f)
                    continue
                if place:
                    file.location(*place)
                    place = None
                sizes = addrs.value_lengths().to_numpy().astype(np.int64)
                file.samples(sizes, flat, part.column(3).to_numpy(), part.column(4).to_numpy())
        if file is not None:
            if place:
                file.location(*place)
            yield out()

    return rows.mapInArrow(run, f"dump {rows.schema['dump'].dataType.simpleString()}, profile binary")

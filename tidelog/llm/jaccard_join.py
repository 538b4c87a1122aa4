"""N-gram Jaccard join: a size-aware, heavy-light join on the exact similarity of shingle sets.

Texts with the same set are one class; links are sought between classes. All tasks order shingles alike:
by hash, after that those that many texts hold, by how many. Texts are counted for all shingles; what tasks
are told of the counts is a table of 2^CELL_BITS bytes, whatever the input: for each cell of the hashes the
greatest count in it, as a level (two to the doubling). Any common order is right; this one keeps lists
short. Overlap filters then hold as they do for any common order:

* A small set enumerates the c-subsets (c = 2) of its first n - o + c shingles, o the least overlap with a
  partner; two small sets that link share a subset.
* A large set posts its first n - o + 1 shingles to inverted lists, and so do small sets big enough for a
  large partner; two that link meet in a list, and the first time they do the shingles from there on are
  still enough for both. How often they meet, and what they didn't post, bounds the overlap from above.
* The boundary between small and large is where a set's subsets cost more than scanning its lists would,
  by the mean length of lists in the input.

Lists of more than `LONG` classes occur where near copies are many. Their classes are first compared with
a few pivots, those of the list that are in most long lists (near copies with few changes are), which joins
near copies into components; of such a list only pairs between its largest component and the rest, and
within the rest, are still compared. So no list makes all its pairs, and no pair of different components
is lost. A list whose shingles very many texts hold is dealt in salted parts from the start, so no task
reads all of it, and what is compared of a list is dealt in cells of at most CELL classes a side.

Candidates are verified on their full sets, streamed past one of the two, whose partners are salted.

Hashes have 64 bits; a class has 128. That a shingle's hash stands for it is the only thing not verified.

Defined cases: null, empty and blank texts have an empty set, link with nothing and are their own component;
very long texts are hashed in pieces and have one sorted set; sets exactly as similar as asked (ties) link;
rows with equal doc_id are separate rows; a null doc_id is never a component's smallest unless all are null;
an empty table gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import materialize, maybe_broadcast
from .components import components
from .shingles import digests, mixed, shingle_sets

WIDTH = 5
#: Jaccard similarity of at least NUM / DEN.
NUM, DEN = 80, 100
SUBSET = 2
#: A shingle of so many texts is common. Cells of the table of levels, as a power of 2.
COMMON, CELL_BITS = 50, 24
LONG = 64
#: Lists whose shingle more texts hold are dealt in parts of about so many classes; cells of compared lists have so many a side.
DEALT, CELL = 2048, 1024
#: Steps along long lists that are verified for each class.
STEPS = 4
#: Bits of a shingle's hash that are counted, and how many counts are sent on at once.
COUNT_BITS, COUNT_ROWS = 40, 2_000_000
#: Partners of one set that are verified in one task.
PARTNERS = 64


def least_overlap(n: int) -> int:
    """Of a set of n shingles with any partner: at least the similarity times n."""
    return -(-n * NUM // DEN)


def prefix_length(n: int, c: int = 1) -> int:
    return min(n, n - least_overlap(n) + c)


def compatible(n, m):
    """Sizes whose smaller set could be similar enough if it were all in the larger one."""
    return (n * DEN >= m * NUM) & (m * DEN >= n * NUM)


def level(texts):
    """Of shingles that so many texts hold: 0 below COMMON, from there on a step for each half of a doubling."""
    return np.where(texts < COMMON, 0, np.minimum(255, 1 + np.floor(2 * np.log2(np.maximum(texts, COMMON) / COMMON)))).astype(np.uint8)


def parts_of(level_of):
    """In how many parts lists of shingles of a level are dealt: a power of 2, 1 for those that can't be long."""
    texts = COMMON * 2 ** (level_of.astype(np.float64) / 2)
    return np.where(texts <= 2 * DEALT, 1, 2 ** np.ceil(np.log2(np.maximum(texts / DEALT, 1)))).astype(np.int64)


def count_common(docs: DataFrame) -> tuple[list[tuple[int, int, bytes]], float]:
    """(stretches of the table of levels that aren't all 0: first cell, cells, zstd; mean length of the other lists)."""
    parts = max(64, 2 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))

    def count(batches: Iterator) -> Iterator:
        import pyarrow as pa

        held, size = [], 0

        def packed():
            values, n = np.unique(np.concatenate(held), return_counts=True)
            bucket = (values * np.uint64(parts) >> np.uint64(COUNT_BITS)).astype(np.int64)
            cuts = np.searchsorted(bucket, np.arange(parts + 1))
            rows = [(k, np.diff(values[a:z], prepend=np.uint64(0)).astype("<u8"), n[a:z].astype("<u4")) for k, (a, z) in enumerate(zip(cuts, cuts[1:], strict=False)) if z > a]
            squeeze = lambda x: pa.compress(x.view(np.uint8).reshape(-1, x.itemsize).T.tobytes(), codec="zstd", asbytes=True)
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([len(r[1]) for r in rows], pa.int64()), pa.array([squeeze(r[1]) for r in rows], pa.binary()), pa.array([squeeze(r[2]) for r in rows], pa.binary())], ["bucket", "n", "gaps", "times"])

        for batch in batches:
            for s in shingle_sets(batch.column(0), WIDTH):
                held.append(s >> np.uint64(64 - COUNT_BITS))
                size += len(s)
                if size >= COUNT_ROWS:
                    yield packed()
                    held, size = [], 0
        if size:
            yield packed()

    def add(key, rows):
        import pandas as pd
        import pyarrow as pa

        def loose(data, n, kind):
            wide = np.dtype(kind).itemsize
            raw = pa.decompress(data, decompressed_size=n * wide, codec="zstd", asbytes=True)
            return np.frombuffer(np.frombuffer(raw, np.uint8).reshape(wide, n).T.tobytes(), kind)

        values = np.concatenate([np.cumsum(loose(g, n, "<u8"), dtype=np.uint64) for g, n in zip(rows["gaps"], rows["n"], strict=True)])
        times = np.concatenate([loose(t, n, "<u4") for t, n in zip(rows["times"], rows["n"], strict=True)])
        order = np.argsort(values, kind="stable")
        values, times = values[order], times[order]
        first = np.flatnonzero(np.append(True, values[1:] != values[:-1]))
        values, total = values[first], np.add.reduceat(times.astype(np.int64), first)
        many = total >= COMMON
        few = total[~many]
        cells = (values[many] >> np.uint64(COUNT_BITS - CELL_BITS)).astype(np.int64)
        first = int(cells[0]) if len(cells) else 0
        levels = np.zeros(int(cells[-1]) - first + 1 if len(cells) else 0, np.uint8)
        np.maximum.at(levels, cells - first, level(total[many]))
        data = pa.compress(levels.tobytes(), codec="zstd", asbytes=True) if len(cells) else b""
        return pd.DataFrame({"first": [first], "cells": [len(levels)], "data": [data], "n": [int(few.sum())], "square": [float((few * few).sum())]})

    sent = docs.select("text").mapInArrow(count, "bucket int, n long, gaps binary, times binary")
    found = materialize(sent.groupBy("bucket").applyInPandas(add, "first long, cells long, data binary, n long, square double"), "common")
    rest = found.agg(F.sum("n"), F.sum("square")).first()
    table = found.filter("cells > 0").select("first", "cells", "data").collect()  # 2^CELL_BITS bytes at most, compressed
    return [(r[0], r[1], bytes(r[2])) for r in table], (rest[1] / rest[0] if rest[0] else 1.0)


def levels_of(stretches: list[tuple[int, int, bytes]]) -> np.ndarray:
    import pyarrow as pa

    out = np.zeros(1 << CELL_BITS, np.uint8)
    for first, cells, data in stretches:
        part = out[first : first + cells]
        np.maximum(part, np.frombuffer(pa.decompress(data, decompressed_size=cells, codec="zstd", asbytes=True), np.uint8), out=part)
    return out


def boundary(mean_list: float) -> int:
    """The largest size whose subsets are fewer than what its lists would make it read."""
    n = 4
    while n < 10_000:
        p, q = prefix_length(n + 1), prefix_length(n + 1, SUBSET)
        if q * (q - 1) / 2 > p * (1 + mean_list):
            break
        n += 1
    return n


def keys(docs: DataFrame, common: list[tuple[int, int, bytes]], x: int) -> DataFrame:
    """key, node, n, pos, part: what each set posts. pos: twice the shingle's place in the set's order; for a subset,
    that before its last shingle's, and 1 more to tell it apart. part: of a list dealt in parts, else -1."""
    shared = docs.sparkSession.sparkContext.broadcast(common)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        table = levels_of(shared.value)
        met: set[tuple[int, int]] = set()
        part = lambda at, d: np.where(parts_of(at) > 1, d[1] & (parts_of(at) - 1), -1).astype(np.int32)
        for batch in batches:
            out: list[tuple] = []
            for s in shingle_sets(batch.column(0), WIDTH):
                n = len(s)
                if n < 4:  # sets of fewer shingles are equal or not similar
                    continue
                d = digests(s)
                if d in met:
                    continue
                if len(met) < 200_000:
                    met.add(d)
                at = table[(s >> np.uint64(64 - CELL_BITS)).astype(np.int64)]
                if at.any():
                    order = np.argsort(at, kind="stable")
                    s, at = s[order], at[order]
                if n <= x:
                    p = s[: prefix_length(n, SUBSET)].tolist()
                    two = [(min(a, b) * 0x9E3779B97F4A7C15 + max(a, b), 2 * i - 1, j) for i, b in enumerate(p) for j, a in enumerate(p[:i])]
                    # A subset's list is no longer than that of its rarer shingle, which comes first.
                    out.append((mixed(np.array([k & 0xFFFFFFFFFFFFFFFF for k, *_ in two], np.uint64)), d[0], n, np.array([i for _, i, _ in two], np.int32), part(at[[j for *_, j in two]], d)))
                if n > x or n * DEN >= (x + 1) * NUM:
                    p = prefix_length(n)
                    out.append((s[:p], d[0], n, 2 * np.arange(p, dtype=np.int32), part(at[:p], d)))
            if out:
                sizes = [len(o[0]) for o in out]
                cols = [np.concatenate([o[0] for o in out]).view(np.int64), *[np.repeat(np.array([o[k] for o in out], kind), sizes) for k, kind in ((1, np.int64), (2, np.int32))], *[np.concatenate([o[k] for o in out]) for k in (3, 4)]]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["key", "node", "n", "pos", "part"])

    return docs.select("text").mapInArrow(run, "key long, node long, n int, pos int, part int")


def promising(n, m, i, j, least):
    """Whether sets of n and m shingles, with i and j of them before a common one, could be similar if they
    have no common one before. least: minimum() of the types at hand."""
    return (DEN + NUM) * least(n - i, m - j) >= NUM * (n + m)


def list_pairs(posted: DataFrame) -> DataFrame:
    """The pairs of compatible sizes of lists of up to LONG classes (a, b, their sizes n, m and places i, j),
    and the rows of longer lists and of those dealt in parts (key, node as a, n, i; b null)."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        left = None  # columns of a list that may go on in the next batch
        long_key = None

        def batch_of(key, a, n, i, b=None, m=None, j=None):
            none = pa.nulls(len(key), pa.int64())
            arrays = [pa.array(key), pa.array(a), none if b is None else pa.array(b)]
            arrays += [pa.array(np.asarray(x, np.int32)) if x is not None else pa.nulls(len(key), pa.int32()) for x in (n, m, i, j)]
            return pa.RecordBatch.from_arrays(arrays, ["key", "a", "b", "n", "m", "i", "j"])

        def handle(c):
            """Complete lists: long ones as rows, others as pairs."""
            key, node, n, pos = c
            starts = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
            ends = np.append(starts[1:], len(key))
            pairs: list[tuple] = []
            size = 0
            many = ends - starts > 1
            for a, z in zip(starts[many], ends[many], strict=True):
                own, at = np.unique(node[a:z], return_index=True)
                if len(own) < 2:
                    continue
                m, p = n[a:z][at].astype(np.int64), pos[a:z][at].astype(np.int64)
                if len(own) > LONG:
                    yield batch_of(np.full(len(own), key[a]), own, m, p)
                    continue
                i, j = np.triu_indices(len(own), 1)
                ok = compatible(m[i], m[j])
                i, j = i[ok], j[ok]
                if len(i):
                    pairs.append((np.full(len(i), key[a]), own[i], m[i], p[i], own[j], m[j], p[j]))
                    size += len(i)
                if size > 20_000:
                    yield batch_of(*[np.concatenate([x[k] for x in pairs]) for k in range(7)])
                    pairs, size = [], 0
            if pairs:
                yield batch_of(*[np.concatenate([x[k] for x in pairs]) for k in range(7)])

        for batch in batches:
            c = [batch.column(k).to_numpy() for k in range(5)]
            if (dealt := c.pop() >= 0).any():
                yield batch_of(*[x[dealt] for x in c])
                c = [x[~dealt] for x in c]
            if not len(c[0]):
                continue
            if long_key is not None:
                more = c[0] == long_key
                if more.any():
                    yield batch_of(*[x[more] for x in c])
                    c = [x[~more] for x in c]
                if not len(c[0]):
                    continue
                long_key = None
            if left is not None:
                c = [np.concatenate([x, y]) for x, y in zip(left, c, strict=True)]
            cut = np.searchsorted(c[0], c[0][-1])
            yield from handle([x[:cut] for x in c])
            left = [x[cut:] for x in c]
            if len(left[0]) > 4 * LONG and len(np.unique(left[1])) > LONG:
                long_key = left[0][0]
                yield batch_of(*left)
                left = None
        if left is not None:
            yield from handle(left)

    parts = max(64, 2 * int(posted.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = posted.repartition(parts, "key", "part").sortWithinPartitions("key")
    return dealt.mapInArrow(run, "key long, a long, b long, n int, m int, i int, j int")


def verify(pairs: DataFrame, docs: DataFrame, classes: DataFrame) -> DataFrame:
    """pairs: distinct a, b (first halves of class digests). Returns the links: a, b as ids of classes.

    Each class's set is computed from one of its texts and sent once as the centre of its pairs (once a salt)
    and once for each pair in which it is the other; sorted, the centre comes first and the rest stream by."""
    heavy = pairs.groupBy("a").agg((F.floor(F.count("*") / F.lit(PARTNERS)) + 1).cast("int").alias("salts"))
    pairs = materialize(pairs.join(heavy, "a").withColumn("salt", F.pmod(F.xxhash64("b"), F.col("salts")).cast("int")), "pairs")
    targets = pairs.select(F.col("b").alias("node"), F.col("a").alias("centre"), "salt", F.lit(1).alias("kind"))
    targets = targets.unionByName(pairs.select(F.col("a").alias("node"), F.col("a").alias("centre"), "salt", F.lit(0).alias("kind")).distinct())
    nodes = targets.groupBy("node").agg(F.collect_list(F.struct("centre", "salt", "kind")).alias("targets"))
    held = classes.select(F.col("d1").alias("node"), "d2", "cid", F.col("least").alias("_held")).join(nodes, "node")
    held = F.broadcast(held) if pairs.count() <= 400_000 else held
    texts = docs.select("doc_id", "text").join(held, F.col("doc_id").eqNullSafe(F.col("_held"))).select("text", "node", "d2", "targets", "cid")

    def send(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            node, d2, cid = (batch.column(k).to_pylist() for k in (1, 2, 4))
            for i, s in enumerate(shingle_sets(batch.column(0), WIDTH)):
                if (node[i], d2[i]) != digests(s):  # another row with this doc_id
                    continue
                to = batch.column(3)[i].as_py()
                data = s.astype("<u8").tobytes()
                for a in range(0, len(to), 500):
                    part = to[a : a + 500]
                    yield pa.RecordBatch.from_arrays([pa.array([t["centre"] for t in part], pa.int64()), pa.array([t["salt"] for t in part], pa.int32()), pa.array([t["kind"] for t in part], pa.int32()), pa.array([cid[i]] * len(part), pa.int64()), pa.array([data] * len(part), pa.binary())], ["centre", "salt", "kind", "cid", "data"])

    def compare(batches: Iterator) -> Iterator:
        import pyarrow as pa

        at, centres = None, []
        for batch in batches:
            found: list[tuple[int, int]] = []
            cols = [batch.column(k) for k in range(5)]
            for centre, salt, kind, cid, data in zip(*[c.to_pylist() for c in cols[:4]], cols[4], strict=True):
                s = np.frombuffer(data.as_buffer(), "<u8")
                if at != (centre, salt):
                    at, centres = (centre, salt), []
                if kind == 0:
                    if all(cid != x for x, _ in centres):
                        centres.append((cid, s.copy()))
                    continue
                for other, c in centres:
                    if other != cid and compatible(len(s), len(c)):
                        small, large = (s, c) if len(s) <= len(c) else (c, s)
                        place = np.searchsorted(large, small)
                        place[place == len(large)] = 0
                        both = int((large[place] == small).sum())
                        if both * DEN >= NUM * (len(s) + len(c) - both):
                            found.append((other, cid))
            yield pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], pa.int64()) for k in (0, 1)], ["a", "b"])

    parts = max(64, 2 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    sent = texts.mapInArrow(send, "centre long, salt int, kind int, cid long, data binary")
    return sent.repartition(parts, "centre", "salt").sortWithinPartitions("centre", "salt", "kind").mapInArrow(compare, "a long, b long")


def set_classes(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles and the set's digest d1, d2 (null for the empty set)."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            n, d = [], []
            for s in shingle_sets(batch.column(1), WIDTH):
                n.append(len(s))
                d.append(digests(s) if len(s) else (None, None))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array([x[0] for x in d], pa.int64()), pa.array([x[1] for x in d], pa.int64())], ["doc_id", "n_shingles", "d1", "d2"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_shingles long, d1 long, d2 long")


def links_of(docs: DataFrame, classes: DataFrame) -> DataFrame:
    """Links between classes (a, b as ids): enough of them to connect all that similarity connects."""
    common, mean_list = count_common(docs)
    met = materialize(list_pairs(keys(docs, common, boundary(mean_list))), "lists")
    rows = met.filter("b is null").select("key", F.col("a").alias("node"), F.col("n").cast("long").alias("n"), F.col("i").cast("long").alias("i")).distinct()
    rows = materialize(rows, "long-lists")

    # A pivot for each quarter of a long list; of each class the STEPS that most of its lists suggest are verified.
    quarter = F.pmod(F.xxhash64("node"), F.lit(4))
    known = materialize(rows.groupBy("node").agg(F.count("*").alias("lists")), "list-counts")
    counted = rows.join(maybe_broadcast(known, 300_000), "node")
    pivots = counted.groupBy("key", quarter.alias("q")).agg(F.max(F.struct("lists", "node"))["node"].alias("other")).drop("q")
    steps = rows.select("key", "node").join(pivots, "key").filter("node <> other").groupBy("node", "other").agg(F.count("*").alias("k"))
    steps = steps.withColumn("r", F.row_number().over(W.partitionBy("node").orderBy(F.desc("k"), "other"))).filter(F.col("r") <= STEPS)
    steps = steps.select(F.least("node", "other").alias("a"), F.greatest("node", "other").alias("b")).distinct()
    near = materialize(verify(steps, docs, classes), "near-links")

    # By the first half of the digest, as lists have it; where two classes share it, the node stays on its own.
    comp = components(near).join(classes.select("d1", F.col("cid").alias("node")), "node").drop("node").withColumnRenamed("d1", "node")
    comp = comp.groupBy("node").agg(F.min("root").alias("root"), F.max("root").alias("top")).filter("root = top").drop("top")
    comp = materialize(comp, "near-components")
    own = maybe_broadcast(comp, 300_000)
    named = lambda df, node, out: df.join(own.select(F.col("node").alias(node), F.col("root").alias(out)), node, "left")
    short = met.filter("b is not null").drop("key")
    short = named(named(short, "a", "ra"), "b", "rb").filter(~F.coalesce(F.col("ra") == F.col("rb"), F.lit(False))).drop("ra", "rb")

    long = rows.join(comp, "node", "left").withColumn("root", F.coalesce(F.concat(F.lit("c"), F.col("root").cast("string")), F.concat(F.lit("n"), F.col("node").cast("string"))))
    sizes = long.groupBy("key", "root").count()
    main = sizes.groupBy("key").agg(F.max(F.struct("count", "root")).alias("main"), F.count("*").alias("roots"), F.sum("count").alias("all")).filter("roots > 1")
    cells = lambda n: F.ceil(n / CELL).cast("int")
    main = main.select("key", F.col("main.root").alias("main"), cells(F.col("all")).alias("wide"), cells(F.col("all") - F.col("main.count")).alias("high"))
    long = long.join(main, "key")
    # All of a list against those outside its largest component, in cells of CELL by CELL classes.
    cell = lambda own, of, other: [F.pmod(F.xxhash64("node"), F.col(of)).cast("int").alias(own), F.explode(F.sequence(F.lit(0), F.col(other) - 1))]
    o = long.filter("root <> main").select("*", *cell("y", "high", "wide")).withColumnRenamed("col", "x").alias("o")
    t = long.select("*", *cell("x", "wide", "high")).withColumnRenamed("col", "y").alias("t")
    c = F.col
    fits = compatible(c("o.n"), c("t.n")) & promising(c("o.n"), c("t.n"), F.shiftright("o.i", 1), F.shiftright("t.i", 1), F.least)
    once = (c("t.root") == c("t.main")) | (c("o.node") < c("t.node"))
    cross = o.join(t, (c("o.key") == c("t.key")) & (c("o.x") == c("t.x")) & (c("o.y") == c("t.y")) & (c("o.root") != c("t.root")) & fits & once)
    first = c("o.node") < c("t.node")
    side = lambda x, y: [F.when(first, c(f"{x}.{k}")).otherwise(c(f"{y}.{k}")) for k in ("node", "n", "i")]
    (a, n, i), (b, m, j) = side("o", "t"), side("t", "o")
    cross = cross.select(a.alias("a"), b.alias("b"), n.cast("int").alias("n"), m.cast("int").alias("m"), i.cast("int").alias("i"), j.cast("int").alias("j"))

    # Sets meet once a common shingle they both posted: k times, so they share at most that and what one of
    # them didn't post. Of two sets in long lists only the promising meetings are known, which come first in
    # the common order: those, and what is left after the last of them, bound what they share.
    hopeful = promising(F.col("n"), F.col("m"), F.shiftright("i", 1), F.shiftright("j", 1), F.least)
    single = F.col("i") % 2 == 0
    last = lambda x: F.max(F.when(single & hopeful, F.shiftright(x, 1))).alias(x)
    pairs = short.unionByName(cross).groupBy("a", "b").agg(
        F.count(F.when(single, 1)).alias("k"), F.count(F.when(single & hopeful, 1)).alias("first"), F.count(F.when(~single & hopeful, 1)).alias("sub"), F.max("n").alias("n"), F.max("m").alias("m"), last("i"), last("j")
    )
    listed = maybe_broadcast(known, 300_000)
    mark = lambda df, node, out: df.join(listed.select(F.col("node").alias(node), F.lit(True).alias(out)), node, "left")
    pairs = mark(mark(pairs.filter("first > 0 or sub > 0"), "a", "la"), "b", "lb")
    unposted = lambda n: F.ceil(F.col(n) * NUM / DEN) - 1
    need = (F.col("n") + F.col("m")) * NUM
    by_count = (F.col("k") + F.greatest(unposted("n"), unposted("m"))) * (DEN + NUM) >= need
    by_place = (F.col("first") + F.least(F.col("n") - F.col("i"), F.col("m") - F.col("j")) - 1) * (DEN + NUM) >= need
    enough = (F.col("sub") > 0) | F.when(F.col("la") & F.col("lb"), by_place).otherwise(by_count)
    far = verify(pairs.filter(enough).select("a", "b"), docs, classes)
    return materialize(near.unionByName(far), "links")


def jaccard_components(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest doc_id that links reach, its own included)."""
    rows = materialize(set_classes(docs), "sets")
    classes = rows.filter("d1 is not null").groupBy("d1", "d2").agg(F.min("doc_id").alias("least"), F.count("*").alias("n"))
    classes = materialize(classes.withColumn("cid", F.monotonically_increasing_id()), "classes")
    comp = components(links_of(docs, classes))
    named = classes.withColumnRenamed("cid", "node")
    linked = named.join(comp, "node")
    low = linked.groupBy("root").agg(F.min("least").alias("component"))
    label = linked.join(low, "root").select("d1", "d2", "component")
    label = label.unionByName(named.filter("n > 1").join(comp, "node", "left_anti").select("d1", "d2", F.col("least").alias("component")))
    label = maybe_broadcast(materialize(label, "labels"), 300_000)
    return rows.join(label, ["d1", "d2"], "left").select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))


def op9_jaccard_join(spark, sf_dir: str) -> DataFrame:
    from .common import table

    return jaccard_components(table(spark, sf_dir, "documents"))

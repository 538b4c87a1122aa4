"""Ownership, liveness and accounting on small cases with known answers."""

from pyspark.sql import functions as F

from tidelog.operators import accounting as C
from tidelog.operators import heap as H
from tidelog.operators import liveness as V
from tidelog.operators import ownership as O

SPAN = "shard long, i long, epoch long, node_id string, incarnation string, `from` long, until long"


def test_layout_algebra(spark):
    base = O.uniform_layout(4)
    split = O.split_layout(base, 1, 4)
    assert [r[0] for r in split] == [0, 4, 5, 2, 3]
    assert {r[0]: r[1:] for r in split if r[0] in (4, 5)} == {4: (16384, 24576), 5: (24576, 32768)}
    merged = O.merge_layout(split, 5, 2, 6)
    assert [r[0] for r in merged] == [0, 4, 6, 3]
    assert (6, 24576, 49152) in merged
    assert O.layout_faults(O.layout_frame(spark, merged), 7).count() == 0


def test_accepts(spark):
    h = spark.createDataFrame([(1, 0, 1, "a", "a1", 101, 150), (1, 1, 2, "b", "b1", 151, None)], SPAN)
    w = spark.createDataFrame([(1, 1, "a1", 150), (1, 1, "a1", 151), (1, 2, "b1", 151), (1, 2, "a1", 151), (1, 1, "a1", 100)], "shard long, epoch long, incarnation string, pos long")
    got = {(r["epoch"], r["incarnation"], r["pos"]): r["accepted"] for r in O.accepts(w, h).collect()}
    assert got == {(1, "a1", 150): True, (1, "a1", 151): False, (2, "b1", 151): True, (2, "a1", 151): False, (1, "a1", 100): False}
    heads = spark.createDataFrame([(1, 2, 150, "b1")], "shard long, epoch long, floor long, owner string")
    assert O.history_faults(h, heads).count() == 0
    assert {r["rule"] for r in O.history_faults(h.withColumn("epoch", F.lit(3).cast("long")), heads).collect()} >= {"epochs", "future_epoch"}


def test_fold_vectors():
    f = O.Fold(floor=100)
    assert f.apply("acquire", ("a", "a1"), None)
    assert f.history == [{"epoch": 1, "node_id": "a", "incarnation": "a1", "from": 101, "until": None}]
    assert f.apply("release", ("a", "a1"), 150, to=("b", "b1"))
    assert (f.epoch, f.history[-1]["from"]) == (2, 151)
    assert not f.apply("release", ("a", "a1"), 160)
    assert f.apply("release", ("b", "b1"), 150)
    assert (len(f.history), f.epoch, f.owner) == (1, 3, None)
    assert f.apply("acquire", ("a", "a2"), None)
    assert f.apply("freeze", ("a", "a2"), 200, arg=9)
    assert not f.apply("acquire", ("b", "b1"), 300)


def test_trim(spark):
    h = spark.createDataFrame([(1, k, k + 1, "a", "a", 10 * k + 1, 10 * k + 10) for k in range(6)] + [(1, 6, 7, "a", "a", 61, None)], SPAN)
    first = lambda below: O.trim(h, below).agg(F.min("from"), F.count("*")).first()
    assert tuple(first(35)) == (31, 4)
    assert tuple(first(10000)) == (61, 1)


def test_topology_merge(spark):
    t = lambda rows: spark.createDataFrame(rows, "range long, version long, node_id string")
    a, b = t([(1, 3, "a"), (2, 1, "a")]), t([(1, 2, "b"), (2, 5, "b"), (3, 1, "b")])
    once = O.merge_topologies(a, b)
    assert sorted(map(tuple, once.collect())) == [(1, 3, "a"), (2, 5, "b"), (3, 1, "b")]
    assert sorted(map(tuple, O.merge_topologies(once, b).collect())) == sorted(map(tuple, once.collect()))
    assert O.next_generation(a, once, 7).first()[0] > 7
    assert O.next_generation(once, once, 7).first()[0] == 7
    assert sorted(map(tuple, O.merge_topologies(t([(1, 2, "mine")]), t([(1, 2, "other")])).collect())) == [(1, 2, "mine")]


def test_quorum(spark):
    assert [spark.range(1).select(V.quorum(n)).first()[0] for n in range(1, 6)] == [1, 2, 2, 3, 3]


def test_lease_thresholds(spark):
    s, now = 1_000_000, 100_000_000
    rows = [(str(q), now - q, e) for q, e in ((s, False), (s + 1, False), (2 * s + 400_000, False), (2 * s + 400_001, False), (5, True))]
    t = spark.createDataFrame(rows, "node_id string, changed_at long, ended boolean")
    got = {r["node_id"]: r["liveness"] for r in V.classify_leases(t, now, 2 * s, 400_000).collect()}
    assert list(got.values()) == ["live", "suspect", "suspect", "dead", "dead"]


def test_verdicts(spark):
    rows = [("n1", "i", "i", 5, False, None), ("n1", "i", "i", 9000, False, 10), ("n2", "i", None, 9000, False, None), ("n2", "i", "j", 3, False, 10), ("n2", "i", "i", 1, False, 2000), ("n3", "i", "i", 2, True, None), ("n3", "i", "i", 3, True, 5)]
    v = spark.createDataFrame(rows, "node_id string, asked string, seen string, age_us long, gone boolean, since_us long")
    got = lambda may: {r["node_id"]: r["verdict"] for r in V.verdicts(v, 3, may, 1000, 2000).collect()}
    assert got(True) == {"n1": "live", "n2": "dead", "n3": "dead"}
    assert got(False) == {"n1": "live", "n2": "suspect", "n3": "suspect"}


def test_effects(spark):
    schema = "path string, i long, op string, kind string, size long, component string"
    ops = [("a", 1, "put", "create", 100, "blob"), ("b", 2, "put", "overwrite", 50, "blob"), ("b", 3, "put", "overwrite", 70, "blob"), ("a", 4, "delete", None, None, "blob"), ("c", 5, "put", "overwrite", 9, "ctl_lease"), ("c", 6, "put", "overwrite", 19, "ctl_lease"), ("z", 7, "delete", None, None, "blob")]
    means = spark.createDataFrame([("blob", 100)], "component string, mean long")
    got = {r["i"]: (r["objects"], r["bytes"], r["uncertain"]) for r in C.effects(spark.createDataFrame(ops, schema), means).collect()}
    assert got == {1: (1, 100, 0), 2: (1, 50, 0), 3: (0, 20, 0), 4: (-1, -100, 0), 5: (0, 0, 1), 6: (0, 10, 0), 7: (-1, -100, 1)}


def test_window_sides(spark):
    pages = spark.createDataFrame([(1000, 1100, "p/b"), (5000, 5100, "p/m"), (9000, 9100, None)], "s long, r long, last string")
    ops = spark.createDataFrame([("p/a", 700, 749), ("p/a", 700, 750), ("p/a", 1351, 1360), ("p/b", 1350, 1350), ("p/c", 4000, 4100), ("p/z", 9351, 9400), ("p/z", 100, 200), ("p/m", 5200, 5300)], "path string, start long, end long")
    got = [r["side"] for r in C.window_sides(ops, pages, 250).orderBy("path", "start", "end").collect()]
    assert got == ["before", "unsure", "after", "unsure", "before", "unsure", "before", "after"]
    cut = pages.filter("last is not null")
    assert C.window_sides(ops.filter("path = 'p/z'"), cut, 250).select("side").distinct().first()[0] == "after"


def test_nested_listings(spark):
    o = spark.createDataFrame([("a", 5, 50, 1), ("a/b", 2, 20, 1), ("ab/c/", 3, 30, 1), ("ab/c/d/e", 1, 10, 1)], "prefix string, objects long, bytes long, ms long")
    assert tuple(C.observed_total(o).first()) == (8, 80, 2)


def test_shares(spark):
    u = spark.createDataFrame([("g", "a", 1, 1, 0, 4.0), ("g", "a", 2, 1, 0, 3.0), ("g", "b", 3, 1, 0, 7.0)], "name string, db string, handle long, ts long, seq long, value double")
    closed = lambda *h: spark.createDataFrame([(x,) for x in h], "handle long")
    val = lambda c: {r["db"]: r["value"] for r in C.gauge_shares(u, c).collect()}
    assert val(closed()) == {"a": 7.0, "b": 7.0}
    assert val(closed(1)) == {"a": 3.0, "b": 7.0}
    assert val(closed(1, 2)) == {"b": 7.0}


DUMP = """heap_v2/524288
  t*: 9: 99 [0: 0]
@ 0x10 0x20 0x30
  t*: 2: 1048576 [0: 0]
  t0: 2: 1048576 [0: 0]
@ 0x10 0x40
  t*: 1: 64 [0: 0]
@ 0x50
  t*: 0: 0 [4: 400]
MAPPED_LIBRARIES:
00400000-00452000 r-xp 00000000 08:02 173521 /usr/bin/app
00452000-00453000 rw-p 00000000 08:02 173521 /usr/bin/app
7ff000-800000 r-xp 00000000 00:00 0 [vdso]
"""


def test_heap(spark):
    df = spark.createDataFrame([("d", DUMP)], "dump string, text string")
    got = sorted((r["addrs"], r["objs"], r["bytes"]) for r in H.parse_heap(df).collect())
    assert got == [([16, 32, 48], 3, 1658823), ([16, 64], 8193, 524320)]
    lines = spark.createDataFrame([(x,) for x in DUMP.splitlines()], "line string")
    assert [tuple(r) for r in H.parse_maps(lines).collect()] == [(0x400000, 0x452000, 0, "/usr/bin/app")]


def test_leaf_trimming(spark):
    t = spark.createDataFrame([([1, 2, 3, 4], [False, True, False, False], [True, False, False, False]), ([1, 2], [False, False], [True, False]), ([1, 2], [False, False], [True, True])], "f array<long>, e array<boolean>, i array<boolean>")
    assert [r[0] for r in t.select(H.trim_leaf(F.col("f"), F.col("e"), F.col("i"))).collect()] == [[3, 4], [2], [1, 2]]


def test_profiles_in_pprof(spark):
    from tidelog.functions import pprof as P

    stacks = [([10, 20, 30], 3, 900), ([10, 99], 2**40, 5)]
    names = {10: "alloc", 20: "parse", 30: "main"}
    data = P.encode(stacks, names, [(0, 25, 0, "/bin/a"), (25, 50, 8, "/lib/b")], 524288)
    assert data == P.encode(stacks, names, [(25, 50, 8, "/lib/b"), (0, 25, 0, "/bin/a")], 524288)
    assert P.decode(data) == [([10, 20, 30], ["alloc", "parse", "main"], [3, 900]), ([10, 99], ["alloc"], [2**40, 5])]
    found = dict(P.fields_of(__import__("gzip").decompress(data)))
    assert found[P.PROFILE["period"]] == 524288
    rows = spark.createDataFrame([("d", a, n, b) for a, n, b in stacks], "dump string, addrs array<long>, objs long, bytes long")
    files = H.pprof(rows, spark.createDataFrame(list(names.items()), "addr long, function string"), 524288).collect()
    assert [(r["dump"], sorted(P.decode(bytes(r["profile"])))) for r in files] == [("d", sorted(P.decode(data)))]
    assert P.decode(P.encode([], {}, [], 1)) == []


def test_profiles_are_streamed(spark):
    """Locations and samples of many stacks go into a file and out of it without being held."""
    import tracemalloc

    import numpy as np

    from tidelog.functions import pprof as P

    tracemalloc.start()
    w = P.Writer(524288)
    n = 40_000
    for a in range(n):
        w.location(5 * a - 100, [f"f{a % 7}"] if a % 3 else [])
    for k in range(0, n, 1000):
        own = np.arange(k, k + 1000)
        w.samples(np.full(1000, 2), np.stack([5 * own - 100, 5 * (n - 1 - own) - 100], 1).ravel(), own + 1, own << 30)
    data = w.finish()
    seen = 0
    for k, (addresses, names, values) in enumerate(P.samples_of(data)):
        pair = (k, n - 1 - k)
        assert (addresses, names, values) == ([5 * a - 100 for a in pair], [f"f{a % 7}" for a in pair if a % 3], [k + 1, k << 30])
        seen += 1
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert seen == n
    assert peak < 12_000_000

    rows = spark.createDataFrame([("d", [30, 10, 20], 1, 8), ("d", [10, 10], 2, 16), ("d", [10, 10], 2, 16), ("e", [99], 3, 24), (None, [10], 4, 32), ("f", [], 5, 40)], "dump string, addrs array<long>, objs long, bytes long")
    names = spark.createDataFrame([(10, "alloc"), (10, "inlined"), (30, "main"), (77, "unused")], "addr long, function string")
    got = {r["dump"]: P.decode(bytes(r["profile"])) for r in H.pprof(rows, names, 1).collect()}
    assert got == {
        "d": [([10, 10], ["alloc", "inlined", "alloc", "inlined"], [2, 16]), ([10, 10], ["alloc", "inlined", "alloc", "inlined"], [2, 16]), ([30, 10, 20], ["main", "alloc", "inlined"], [1, 8])],
        "e": [([99], [], [3, 24])], None: [([10], ["alloc", "inlined"], [4, 32])], "f": [([], [], [5, 40])],
    }


def test_window_of_a_listing(spark):
    ops = spark.createDataFrame([(i, f"p/{i}", "blob", 10 * i, 10 * i + 5, 1, i, 0) for i in range(10)], "i long, path string, component string, start long, end long, objects long, bytes long, uncertain long")
    captured = C.capture_window(ops, 25, 75, 3)
    assert [r["part"] for r in captured.orderBy("i").collect()] == ["before"] * 2 + ["window"] * 3 + ["overflow"] * 2 + ["after"] * 3
    pages = spark.createDataFrame([(1000, 1001, None)], "s long, r long, last string")
    assert tuple(C.end_window(captured, pages, 0, done=True).first()) == ("blob", 7, 0 + 1 + 5 + 6 + 7 + 8 + 9, 2)
    assert tuple(C.end_window(captured, pages, 0, done=False).first()) == ("blob", 10, 45, 5)
    assert tuple(C.local_view(captured).first()) == ("blob", 5, 0 + 1 + 7 + 8 + 9, 0, 3)
    assert {r["part"] for r in C.capture_window(ops, 25, None, 100).filter("i > 1").collect()} == {"window"}


def test_layouts_are_told_apart(spark):
    rows = [("a", 1, 0, 100), ("a", 2, 100, 65536), ("b", 1, 0, 100), ("b", 1, 101, 65536), ("c", 9, 5, 5)]
    got = {tuple(r) for r in O.layout_faults(spark.createDataFrame(rows, "name string, shard long, lo int, hi int"), 5, by=["name"]).collect()}
    assert got == {("b", "gap", 1), ("b", "twice", 1), ("c", "start", 9), ("c", "end", 9), ("c", "empty", 9), ("c", "id", 9)}


def test_exposition(spark):
    series = spark.createDataFrame([("up", {}, 1.0), ("up", {"a": 'x"y\\z\nw'}, 2.0), ("other", {"b": ""}, 3.0)], "name string, labels map<string,string>, value double")
    page = C.exposition(series, spark.createDataFrame([("up", "gauge"), ("other", "counter")], "name string, kind string"))
    assert [r["line"] for r in page.orderBy("name", "place", "line").collect()] == ["# TYPE other counter", 'other{b=""} 3.0', "# TYPE up gauge", "up 1.0", 'up{a="x\\"y\\\\z\\nw"} 2.0']


def test_changes_less_others_in_one_pass(spark):
    rows = [("a", 1, 10, 0, False), ("a", 1, 4, 2, True), ("b", 1, 1, 0, False), ("b", 1, 1, 0, True), ("c", 0, 0, 1, False)]
    t = spark.createDataFrame(rows, "component string, objects long, bytes long, uncertain long, m boolean")
    assert sorted(map(tuple, C.net_counts(t, F.col("m")).collect())) == sorted(map(tuple, C.subtract_counts(t.filter("not m"), t.filter("m")).collect())) == [("a", 0, 6, 0), ("c", 0, 0, 1)]

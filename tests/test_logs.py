"""Prefixes, seeks and merges on three logs with a hole, a fence and a duplicate."""

import random

from pyspark.sql import functions as F

from tidelog.operators import delivery as D
from tidelog.operators import logs as L
from tidelog.operators import ranges as R
from tidelog.operators.asof import asof_join


def three_logs(spark):
    seg, ev = [], []

    def add(log, ordinal, prefix_end, seqs, kind="segment"):
        seg.append((log, ordinal, prefix_end, min(seqs, default=0), max(seqs, default=0), len(seqs), kind))
        ev.extend((log, ordinal, i, s) for i, s in enumerate(seqs))

    for k in range(40):
        add("A", k, k, [10 * k, 10 * k + 3, 10 * k + 6])
    for k in [*range(10), *range(11, 20)]:
        add("B", k, min(k, 10), [10 * k + 1])
    add("C", 0, 0, [30])
    for k in range(1, 5):
        add("C", k, k, [10 * k + 102])
    add("C", 5, 5, [], "fence")
    add("C", 6, 5, [205])
    segments = spark.createDataFrame(seg, "log_id string, ordinal long, prefix_end long, first_seq long, last_seq long, n long, kind string")
    return segments, spark.createDataFrame(ev, "log_id string, ordinal long, idx long, seq long")


def seqs(df):
    return [r["seq"] for r in df.orderBy("seq").collect()]


def test_three_logs(spark):
    segments, log = three_logs(spark)
    want = sorted({s for k in range(40) for s in (10 * k, 10 * k + 3, 10 * k + 6)} | {10 * k + 1 for k in range(10)} | {10 * k + 102 for k in range(1, 5)})
    assert seqs(L.backfill(log, segments, -1, 10**9)) == want
    assert seqs(L.backfill(log, segments, 95, 250)) == [s for s in want if 95 < s <= 250]
    assert L.backfill(log, segments, 29, 30).first()["log_id"] == "A"
    free = {r["log_id"]: (r["first_free"], r["fenced"]) for r in L.first_free(segments).collect()}
    assert free == {"A": (40, False), "B": (10, False), "C": (5, True)}


def test_seek_past_a_hole_and_a_pruned_head(spark):
    rows = [("A", k, 1000 + k, "segment") for k in range(3)] + [("A", 3, 0, "fence")] + [("A", k, 1000 + k, "segment") for k in range(4, 7)]
    seg = spark.createDataFrame(rows, "log_id string, ordinal long, last_seq long, kind string")
    at = lambda s, after: L.seek(s, after).first()["seek_ordinal"]
    assert [at(seg, x) for x in (1004, 1001)] == [3, 2]
    pruned = spark.createDataFrame([("A", k, 1000 + k, "segment") for k in range(5, 12)], seg.schema)
    assert [at(pruned, x) for x in (0, 1007, 5000)] == [5, 8, 12]


def test_accept_counts_late_rows_above_the_floor(spark):
    log = spark.createDataFrame([("A", 0, i, s) for i, s in enumerate([99, 100, 101, 101, 103, 102, 104])], "log_id string, ordinal long, idx long, seq long")
    assert [r["outcome"] for r in D.accept(log, 103, 100).orderBy("idx").collect()] == ["floor", "floor", "late", "duplicate", "late", "duplicate", "accepted"]


def test_release_waits_for_the_slowest_log(spark):
    pending = spark.createDataFrame([(x,) for x in range(101, 104)], "seq long")
    marks = lambda *w: spark.createDataFrame([(i, x) for i, x in enumerate(w)], "log_id long, watermark long")
    assert seqs(D.release(pending, marks(102, 500))) == [101, 102]
    assert seqs(D.release(pending, marks(103, 500))) == [101, 102, 103]


def test_filter_leaves_gaps(spark):
    rows = spark.createDataFrame([(i, ["#commit", "#sync", "#identity", "#account"][i % 4], f"d{i // 4 % 4}") for i in range(64)], "seq long, kind string, did string")
    numbered = D.renumber(rows, anchor=10, parts=5)
    hidden = spark.createDataFrame([("d1",)], "did string")
    left = D.frame_filter(numbered, hidden, ("#commit", "#sync"))
    assert left.count() == 56
    assert {r["number"] - r["seq"] for r in left.collect()} == {11}
    assert D.frame_filter(numbered, None, ()).count() == 64


def test_runs(spark):
    rows = spark.createDataFrame([(i, i not in (3, 4, 8)) for i in range(10)], "seq long, k boolean")
    assert sorted((r["first"], r["last"], r["n"]) for r in D.runs(rows, F.col("k")).collect()) == [(0, 2, 3), (5, 7, 3), (9, 9, 1)]


def test_ring_keeps_one_batch(spark):
    b = spark.createDataFrame([(1, 10, 900), (2, 20, 300), (3, 30, 2000)], "batch_id long, last long, bytes long")
    kept = lambda n: [r["batch_id"] for r in D.mark_ring(b, n).filter("in_ring").orderBy("batch_id").collect()]
    assert (kept(100), kept(2300), kept(9999)) == ([3], [2, 3], [1, 2, 3])
    assert D.ring_floor(b, 2300).first()[0] == 10
    assert D.ring_floor(b, 9999).first()[0] == 0


def test_asof_directions_and_ties(spark):
    left = spark.createDataFrame([(0, 5), (1, 10), (2, 25)], "id long, t long")
    right = spark.createDataFrame([(5, 1), (10, 2), (10, 3), (20, 4)], "t long, v long")
    back = {r["id"]: r["match"] and r["match"]["v"] for r in asof_join(left, right, "t", "t", values=["v"]).collect()}
    ahead = {r["id"]: r["match"] and r["match"]["v"] for r in asof_join(left, right, "t", "t", direction="forward", values=["v"]).collect()}
    assert back == {0: 1, 1: 3, 2: 4}
    assert ahead == {0: 1, 1: 3, 2: None}


def test_strictly_rising_seqs(spark):
    r = spark.createDataFrame([(3, i, us) for i, us in enumerate([10, 10, 9, 50])], "writer long, i long, us long")
    assert [x["seq"] for x in L.assign_seqs(r).orderBy("i").collect()] == [10 << 8 | 3, 11 << 8 | 3, 12 << 8 | 3, 50 << 8 | 3]


def test_asof_carries_over_ranges(spark):
    """Long stretches without a right row, either way."""
    left = spark.range(0, 1000, 3).selectExpr("id", "id as t")
    right = spark.createDataFrame([(50, 1), (51, 2), (700, 3)], "t long, v long")
    back = lambda t: 3 if t >= 700 else 2 if t >= 51 else 1 if t >= 50 else None
    ahead = lambda t: 1 if t <= 50 else 2 if t <= 51 else 3 if t <= 700 else None
    for direction, want in (("backward", back), ("forward", ahead)):
        got = asof_join(left, right, "t", "t", direction=direction, values=["v"], parts=7).collect()
        assert len(got) == 334
        assert all((r["match"] and r["match"]["v"]) == want(r["t"]) for r in got)


def test_accept_by_segment_is_accept(spark):
    rng = random.Random(9)
    rows = [(f"l{i % 3}", i // 36, i // 3 % 12, i + rng.randrange(-20, 20)) for i in range(360)]
    log = spark.createDataFrame(rows, "log_id string, ordinal long, idx long, seq long")
    both = [sorted(map(tuple, D.accept(log, 150, 60, by_segment=x).collect())) for x in (False, True)]
    assert both[0] == both[1]
    assert {r[4] for r in both[0]} == {"accepted", "duplicate", "late", "floor"}


def test_runs_over_ranges(spark):
    """Runs that cross ranges, fill them, or end at their edges, by group."""
    rng = random.Random(2)
    for share in (0.2, 0.5, 0.95, 1.0):
        rows = [(g, 7 * i + g, rng.random() < share) for g in range(3) for i in range(60)]
        t = spark.createDataFrame(rows, "g long, seq long, k boolean")
        once = sorted(map(tuple, D.runs(t, F.col("k"), by=["g"], parts=1).select("g", "first", "last", "n").collect()))
        assert once == sorted(map(tuple, D.runs(t, F.col("k"), by=["g"], parts=9).select("g", "first", "last", "n").collect()))
        assert sum(r[3] for r in once) == sum(r[2] for r in rows)


def test_ranges_and_totals(spark):
    """Many bounds are found by halving; totals are the same for any number of ranges."""
    rows = [(k * 37 % 1009, k) for k in range(1000)]
    t = spark.createDataFrame(rows, "key long, v long").repartition(3)
    for parts in (1, 5, 90):
        got = {r["key"]: r["before"] for r in R.running_totals(t, "key", {"before": F.col("v")}, parts).collect()}
        low = 0
        for key, v in sorted(rows):
            assert got[key] == low
            low += v
    p = R.range_of(t, "key", 200)
    numbered = [(r["key"], r["p"]) for r in t.select("key", p.alias("p")).orderBy("key").collect()]
    assert [x for _, x in numbered] == sorted(x for _, x in numbered)
    assert len({x for _, x in numbered}) > 150


def test_parts_follow_the_input(spark, tmp_path, monkeypatch):
    spark.range(20_000).write.parquet(f"{tmp_path}/t")
    t = spark.read.parquet(f"{tmp_path}/t")
    assert R.parts_for(t) == 1
    monkeypatch.setattr(R, "PART_BYTES", 10_000)
    assert R.parts_for(t) > 5
    assert R.parts_for(spark.createDataFrame([(1,)], "a long").rdd.toDF()) >= 1


def test_small_sides_are_looked_up(spark):
    left = spark.createDataFrame([(i, None if i == 7 else i) for i in range(30)], "id long, t long")
    right = spark.createDataFrame([(5, 1, "a"), (10, 2, None), (10, 3, "b"), (20, 4, "c"), (None, 9, "d")], "t long, v long, w string")
    for direction in ("backward", "forward"):
        few, swept = ({r["id"]: r["match"] and tuple(r["match"]) for r in asof_join(left, right, "t", "t", direction=direction, values=["v", "w"], few=x).collect()} for x in (True, False))
        assert few == swept
    assert {r["match"] for r in asof_join(left, right.limit(0), "t", "t", values=["v"], few=True).collect()} == {None}
    many = spark.range(200).select(F.col("id").alias("t"), F.col("id").alias("v"))
    assert all(r["match"]["v"] == r["t"] for r in asof_join(left.filter("t is not null"), many, "t", "t", values=["v"], few=True).collect())


def test_idle_logs_announce_the_clock(spark):
    """Up to the lease and never back; what was announced isn't assigned again."""
    s = lambda us, w=3: us << 8 | w
    rows = [("busy", 3, s(90), s(50), None), ("idle", 3, s(50), s(50), None), ("leased", 3, s(50), s(50), 70), ("expired", 3, s(50), s(50), 20), ("ahead", 3, s(500), s(500), None)]
    logs = spark.createDataFrame(rows, "id string, writer long, assigned long, durable long, lease_us long")
    got = {r["id"]: (r["watermark"], r["assigned"]) for r in D.announce(logs, 100).collect()}
    assert got["busy"] == (s(50), s(90))
    assert got["idle"] == ((100 << 8) - 1, s(99))
    assert got["leased"] == (70 << 8, s(69))
    assert got["expired"] == (s(50), s(50))
    assert got["ahead"] == (s(500), s(500))


def test_labels_are_freed(spark):
    rows = [(k, f"ua{k}", k, 50 if k < 2 else None) for k in range(6)]
    conns = spark.createDataFrame(rows, "conn_id long, ua string, connected_at long, disconnected_at long")
    assert {r["conn_id"]: r["label"] for r in D.cap_labels(conns, 2).collect()} == {0: None, 1: None, 2: "ua2", 3: "ua3", 4: "other", 5: "other"}


def test_pages_end_with_their_bytes(spark):
    rows = spark.createDataFrame([(10 * k, b) for k, b in enumerate([5, 0, 3, 9, 1])], "seq long, bytes long")
    page = lambda n, parts=1: seqs(L.page_of(rows, n, parts=parts))
    assert [page(1), page(5), page(6), page(8), page(100)] == [[0], [0], [0, 10, 20], [0, 10, 20], [0, 10, 20, 30, 40]]
    assert page(9, parts=3) == [0, 10, 20, 30]


def test_replays_of_parts_in_one_pass(spark):
    segments, log = three_logs(spark)
    log = log.withColumn("slot", F.col("seq") % 100)
    parts = [(0, 40), (30, 70), (90, 100)]
    got = L.backfill_parts(log, segments, 95, 250, parts)
    for k, part in enumerate(parts):
        want = L.backfill(log, segments, 95, 250, part)
        assert sorted(map(str, got.filter(F.col("part") == k).select("seq", "log_id", "ordinal").collect())) == sorted(map(str, want.select("seq", "log_id", "ordinal").collect()))


def test_replays_of_parts_unite_to_one_row_a_seq(spark, tmp_path):
    """Events of one writer and time have the same seq, whatever parts their slots are in."""
    import duckdb

    from tidelog.plans import registry

    rows = spark.range(2400).select(F.col("id").alias("event_id"), F.timestamp_seconds(1_700_000_000 + F.floor(F.col("id") / 24) * 60).alias("ts"), (F.col("id") * 7 % 1200).alias("user_id"), F.lit("click").alias("event_type"), F.lit(0.5).alias("value"), F.lit("{}").alias("props"))
    rows.coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    duck = duckdb.connect()
    duck.execute("set TimeZone = 'UTC'")
    duck.execute(f"create view events as select * from '{tmp_path}/events.parquet/*.parquet'")
    got = [tuple(r) for r in registry.QUERIES["shard_union"](spark, str(tmp_path)).select("seq", "log_id", "event_id").collect()]
    want = duck.execute(f"select seq, log_id from ({registry.SQL['shard_union']})").fetchall()
    assert sorted(r[:2] for r in got) == sorted(want)
    least = {}
    for event, user in rows.select("event_id", "user_id").collect():
        least.setdefault((event // 24, user % 4), event)
    assert all(event == least[event // 24, log] for _, log, event in got)

"""The merger of many logs: sources that join and leave, late rows, batches that are run again, many batches."""

from tidelog.operators.logs import zone_map
from tidelog.streaming.merge import Merger, hand_off

EVENTS = "log_id long, seq long, event_id long"


def run(spark, merger, batch, *rows):
    """rows: (log, seq) of events, or (log, seq, kind)."""
    data = [(r[0], r[1], r[1], r[2] if len(r) > 2 else "event") for r in rows]
    merger(spark.createDataFrame(data, EVENTS + ", kind string"), batch)


def seqs(df):
    return sorted(r["seq"] for r in df.collect())


def test_sources_join_and_leave(spark, tmp_path):
    m = Merger(spark, str(tmp_path), [0, 1], EVENTS)
    run(spark, m, 0, (0, 10), (0, 20))
    assert seqs(m.released()) == []  # log 1 hasn't been heard
    run(spark, m, 1, (1, 15))
    assert seqs(m.released()) == [10, 15]
    assert m.position(1) == 15
    run(spark, m, 2, (2, None, "join"), (0, 30), (1, 31))
    assert (m.position(2), seqs(m.released())) == (15, [10, 15])  # log 2 owes what is above 15
    run(spark, m, 3, (2, 12), (2, 18), (1, 40))
    assert m.late(3) == 1
    assert seqs(m.released()) == [10, 15, 18]
    run(spark, m, 4, (2, 35, "watermark"))
    assert seqs(m.released()) == [10, 15, 18, 20, 30]
    run(spark, m, 5, (0, None, "leave"))
    assert m.position(5) == 35
    assert seqs(m.released()) == [10, 15, 18, 20, 30, 31]
    run(spark, m, 6, (1, None, "leave"), (2, None, "leave"))
    assert m.position(6) == 35


def test_batches_run_again_change_nothing(spark, tmp_path):
    m = Merger(spark, str(tmp_path), [0, 1], EVENTS, start_floor=5)
    for _ in range(2):
        run(spark, m, 0, (0, 3), (0, 8), (1, 9))
        assert (m.late(0), seqs(m.released())) == (1, [8])
    for _ in range(2):
        run(spark, m, 1, (0, 12), (1, 14))
        assert seqs(m.released()) == [8, 9, 12]
    assert seqs(m.released(after=0)) == [9, 12]


def test_hand_off_has_each_event_once(spark, tmp_path):
    """For cursors before, at and after the merger's position."""
    m = Merger(spark, str(tmp_path), [0, 1], EVENTS)
    log = [(k % 2, k // 8, k // 2 % 4, k, k) for k in range(1, 40)]
    stored = spark.createDataFrame(log, "log_id long, ordinal long, idx long, seq long, event_id long")
    for b in range(4):
        run(spark, m, b, *[(r[0], r[3]) for r in log if b * 10 <= r[3] < b * 10 + 10])
    zones = zone_map(stored).selectExpr("*", "'segment' as kind")
    for cursor in (0, 12, m.position(1), m.position(1) + 1, 30):
        rows = hand_off(m, stored, zones, cursor, 1).collect()
        assert sorted(r["seq"] for r in rows) == list(range(cursor + 1, 39))
        assert all((r["part"] == "backfill") == (r["seq"] <= m.position(1)) for r in rows)

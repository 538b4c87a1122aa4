import pytest

from tidelog.sources import seglog
from tidelog.sources import segments as S


def sample():
    return [S.Entry(901, 17, 4, b"first frame", [(b"a/1", b"one"), (b"a/2", None)]), S.Entry(905, 65_000, 2, b"second", []), S.Entry(977, 17, 5, b"", [(b"z", b"")])]


def test_round_trip():
    data = S.build("writer.x", 7, 7, sample())
    h = S.parse_header(data)
    assert (h.log_id, h.ordinal, h.prefix_end, h.first_seq, h.last_seq, h.count) == ("writer.x", 7, 7, 901, 977, 3)
    assert list(S.parse_entries(data)) == sample()
    assert [e.epoch for e in S.parse_entries(data, shard=17)] == [4, 5]
    assert not any(e.muts for e in S.parse_entries(data, with_muts=False))
    with pytest.raises(S.FormatError):
        S.build("writer.x", 7, 8, sample())


def test_compression():
    entries = [S.Entry(5000 + 3 * i, i % 5, 9, f"{i} says ".encode() * 12, [(f"key {i % 4}".encode(), None if i % 2 else b"value" * 9)]) for i in range(90)]
    data = S.build("writer.y", 3, 1, entries)
    packed = S.compress(data)
    assert len(packed) < len(data) / 2
    assert list(S.parse_entries(packed)) == entries
    assert sum(1 for _ in S.parse_entries(packed, shard=4)) == 18
    assert S.compress(data, 0) == data
    assert S.compress(S.fence("other")) == S.fence("other")
    h = S.parse_header(packed)
    longer = packed[: h.size - 4] + (h.body_len + 1).to_bytes(4, "big") + packed[h.size :]
    other_codec = packed[: h.size - 5] + b"\x07" + packed[h.size - 4 :]
    for bad in (packed[: h.size + 2], longer, other_codec, b"NOTALOG\n" + data[8:], data[:30], data[:-3]):
        with pytest.raises(S.FormatError):
            list(S.parse_entries(bad))
        with pytest.raises(S.FormatError):
            S.parse_columns(bad)


def test_columns_are_the_entries():
    """With mutations stored, derived and none; by shard; and built from columns."""
    entries = [*sample(), S.Entry(990, 17, 6, b"derived", [(b"d", b"x"), (b"k", b"v")], derived=1, gen=70_000)]
    data = S.compress(S.build("w", 2, 2, entries))
    for shard in (None, 17, 5):
        got = S.parse_columns(data, shard)
        want = [(i, e.seq, e.shard, e.epoch, e.frame) for i, e in enumerate(S.parse_entries(data, None, with_muts=False)) if shard in (None, e.shard)]
        assert list(zip(*got, strict=True)) == want
    plain = [S.Entry(k, k % 2, 1, bytes([k]) * k) for k in range(20)]
    assert S.build_events("w", 2, 1, *[[getattr(e, c) for e in plain] for c in ("seq", "shard", "epoch", "frame")]) == S.build("w", 2, 1, plain)
    assert S.parse_columns(S.fence("x")) is None


def test_derived_mutations():
    e = S.Entry(1, 2, 3, b"f", [(b"d", b"x"), (b"k", b"v")], derived=1, gen=300)
    data = S.build("a", 0, 0, [e])
    with pytest.raises(S.FormatError):
        list(S.parse_entries(data))
    assert list(S.parse_entries(data, derive=lambda frame, n, gen: [(b"d", b"x")] * n)) == [e]
    assert [(x.muts, x.derived) for x in S.parse_entries(data, with_muts=False)] == [([], 0)]


def test_data_source(spark, tmp_path):
    seglog.register(spark)
    rows = [("a", k, S.compress(S.build("a", k, k, [S.Entry(10 * k + i, i % 2, 1, b"f") for i in range(5)]))) for k in range(3)] + [("a", 3, S.fence("b"))]
    df = spark.createDataFrame(rows, "log_id string, ordinal long, data binary")
    df.write.format("seglog").mode("append").save(str(tmp_path))
    heads = spark.read.format("seglog").option("table", "headers").load(str(tmp_path))
    assert sorted((r["kind"], r["ordinal"], r["first_seq"]) for r in heads.select("kind", "ordinal", "first_seq").fillna(-1).collect()) == [("fence", -1, -1), ("segment", 0, 0), ("segment", 1, 10), ("segment", 2, 20)]
    entries = spark.read.format("seglog").load(str(tmp_path))
    assert entries.count() == 15
    assert entries.filter("shard = 1").count() == 6
    assert {(r["seq"] % 10, r["idx"]) for r in entries.filter("shard = 1").collect()} == {(1, 1), (3, 3)}
    assert seglog.read_entries(spark, str(tmp_path), shard=1).count() == 6
    assert seglog.read_headers(spark, str(tmp_path)).filter("kind = 'segment'").count() == 3


def test_headers_of_all_segments(spark, tmp_path):
    """Short segments too, and each is compressed exactly if that is smaller."""
    from tidelog.plans import adapters, binary_queries

    d = str(tmp_path)
    spark.read.parquet("/root/testdata/sf0.001/events.parquet").orderBy("event_id").limit(12).write.parquet(f"{d}/events.parquet")
    want = {}
    for r in adapters.log(spark, d).select("log_id", "ordinal", "seq").collect():
        want.setdefault((str(r["log_id"]), r["ordinal"]), []).append(r["seq"])
    got = {(r["log_id"], r["ordinal"]): r for r in binary_queries.all_headers(spark, d).collect()}
    assert {k: (r["first_seq"], r["last_seq"], r["n"]) for k, r in got.items()} == {k: (min(s), max(s), len(s)) for k, s in want.items()}
    assert min(r["n"] for r in got.values()) <= 8
    assert {r["packed"] for r in got.values()} <= {S.CODEC_NONE, S.CODEC_ZSTD}
    one = S.build("a", 0, 0, [S.Entry(1, 2, 3, b"f", [])])
    assert S.compress(one) == one
    assert S.parse_header(one).codec == S.CODEC_NONE

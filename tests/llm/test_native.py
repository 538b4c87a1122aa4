"""Operators 1, 3, 4, 5 and 8 against plain Python versions."""

import collections
import hashlib
import os
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from tidelog.llm import common, decontaminate, licenses, lines, mixing, quality_rules, registry

from . import brute as B

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_matches_sql(spark, name):
    con = duckdb.connect()
    for t in os.listdir(DATA):
        con.execute(f"create view {t.removesuffix('.parquet')} as select * from '{DATA}/{t}'")
    want, got = con.execute(registry.SQL[name]).fetchdf(), registry.QUERIES[name](spark, DATA).toPandas()
    cols = sorted(want.columns)
    assert sorted(got.columns) == cols
    assert sorted(map(str, got[cols].astype(object).itertuples(index=False, name=None))) == sorted(map(str, want[cols].astype(object).itertuples(index=False, name=None)))


def test_mixing(docs, corpus, clashing):
    out, slots = mixing.mix(docs, block=16)
    rows = out.collect()
    size = {i: len(B.WORD(t or "")) for i, t, *_ in corpus}
    total = collections.Counter()
    for i, _, _, s, _ in corpus:
        total[s] += size[i]
    want = B.targets(total)
    taken = collections.Counter()
    assert sorted(r["doc_id"] for r in rows) == [r[0] for r in corpus]
    for r in rows:
        s = corpus[r["doc_id"]][3]
        assert (r["size"], r["source_size"]) == (size[r["doc_id"]], total[s])
        assert B.close(r["target"], want[s])
        assert 0 <= r["taken"] <= 3 * r["size"]
        taken[s] += r["taken"]
    assert all(abs(taken[s] - want[s]) <= 1 for s in want)
    assert sum(taken.values()) == slots.agg(F.sum("words")).first()[0]
    assert sorted(mixing.mix(clashing, block=16)[0].select(*out.columns).collect(), key=str) == sorted(rows, key=str)


def test_mixing_is_spread(spark):
    """Any stretch of the schedule holds each source's share, within a few slots."""
    d = spark.createDataFrame([(i, "w " * 50, f"s{i % 3}") for i in range(600)], "doc_id long, text string, source string")
    _, slots = mixing.mix(d, block=10)
    names = [r["source"] for r in slots.orderBy("slot").collect()]
    for a in range(0, len(names) - 300, 100):
        part = collections.Counter(names[a : a + 300])
        assert abs(part["s0"] / 300 - names.count("s0") / len(names)) < 0.03


def test_mixing_follows_the_schedule(spark):
    """Each document's first and last slot, by laying its source's stream over the slots in plain Python."""
    rng = random.Random(4)
    d = [(k, " ".join(["w"] * rng.randrange(0, 60)), f"s{min(rng.randrange(9), 3)}") for k in range(300)]
    out, slots = mixing.mix(spark.createDataFrame(d, "doc_id long, text string, source string"), block=16)
    size = {i: len(t.split()) for i, t, _ in d}
    total = collections.Counter()
    for i, _, s in d:
        total[s] += size[i]
    want = B.targets(total)
    quota = {s: min(int(want[s] + 0.5), 3 * total[s]) for s in want}
    names, full, at, low = sorted(quota), sum(quota.values()), {}, 0
    for s in names:
        at[s] = (int(low / full * 2**31), int((low + quota[s]) / full * 2**31))
        low += quota[s]
    n = -(-sum(total.values()) // 16)
    line = {s: [k for k in range(n) if at[s][0] <= k * mixing.STEP % 2**31 < at[s][1]] for s in names}
    for s in names:
        line[s] = (line[s] + [n] * 10_000)[: -(-quota[s] // 16)]
    assert sorted((r["source"], r["slot"]) for r in slots.collect()) == sorted((s, k) for s in names for k in line[s])
    slot_of, place = {}, dict.fromkeys(names, 0)
    for i, _, s in sorted(d, key=lambda r: hashlib.md5(f"17:{r[0]}".encode()).hexdigest()):
        reads = [x for e in range(3) for x in range(place[s] + e * total[s], min(place[s] + e * total[s] + size[i], quota[s]))]
        slot_of[i] = (min((line[s][x // 16] for x in reads), default=-1), max((line[s][x // 16] for x in reads), default=-1), len(reads))
        place[s] += size[i]
    assert {r["doc_id"]: (r["first_slot"], r["last_slot"], r["taken"]) for r in out.collect()} == slot_of


def test_running_totals_by_ranges(spark):
    """More rows than a task is given: the same totals, whatever the ranges."""
    rows = [(f"k{(k * 7919) % 500:03d}", k) for k in range(500)]
    t = common.materialize(spark.createDataFrame(rows, "key string, v long"), "totals")
    got = {r["key"]: (r["rank"], r["before"]) for r in common.running_totals(t, "key", {"rank": F.lit(1), "before": F.col("v")}, rows_a_part=60).collect()}
    low = 0
    for k, (key, v) in enumerate(sorted(rows)):
        assert got[key] == (k, low)
        low += v


def test_mixing_edges(spark, empty):
    assert mixing.mix(empty)[0].count() == 0
    schema = "doc_id long, text string, source string"
    nothing = spark.createDataFrame([(1, None, None), (2, "", "a"), (2, "", "a")], schema)
    assert sorted((r["doc_id"], r["size"], r["target"], r["taken"]) for r in mixing.mix(nothing)[0].collect()) == [(1, 0, 0.0, 0), (2, 0, 0.0, 0), (2, 0, 0.0, 0)]
    one = spark.createDataFrame([(None, "a b c", "x"), (None, "a b c", "x"), (7, "d", None)], schema)
    got = mixing.mix(one)[0].collect()
    assert len(got) == 3
    assert sum(r["taken"] for r in got) == 7


def test_line_dedup(docs, corpus, clashing):
    want = B.lines([(i, t) for i, t, *_ in corpus])
    out = lines.dedup_lines(docs)
    got = {r["doc"]["doc_id"]: (r["n_lines"], r["n_dropped"], r["kept_text"]) for r in out.collect()}
    assert got == want
    assert sum(x[1] for x in want.values()) > 5
    assert {r["doc"]["doc_id"]: r["kept_text"] for r in lines.dedup_lines(clashing).collect()} == {i: x[2] for i, x in want.items()}


def test_line_runs_compact_and_know_what_is_new(spark):
    d = lambda *r: spark.createDataFrame(r, "doc_id long, text string")
    long = lambda k: f"{k} " + "x" * 45
    runs = lines.LineRuns(spark, fanout=2, min_docs=3)
    assert runs.add(d((1, long(1)), (2, long(2)))).count() == 2
    assert runs.add(d((3, long(1)), (4, long(3)))).count() == 1
    assert [len(x) for x in runs.levels] == [0, 1]
    assert runs.add(d((5, long(1)), (6, "short"))).count() == 0
    assert runs.add(d((7, long(2)))).count() == 0
    assert [len(x) for x in runs.levels] == [0, 0, 1]
    assert [r["last_doc"] for r in runs.verdicts().collect()] == [5]


def test_runs_hold_each_key_once_and_are_merged_unshuffled(spark, monkeypatch):
    """Keys come from anti-joins of sorted buckets: no plan of them sorts or shuffles, and no two runs share a key."""
    plans = []
    save = lines.LineRuns._save

    def seen(self, rows):
        with lines.sorted_buckets(self.spark):
            plans.append(rows._jdf.queryExecution().executedPlan().toString())
        return save(self, rows)

    monkeypatch.setattr(lines.LineRuns, "_save", seen)
    rng = random.Random(8)
    pool = [f"line {k} " + "y" * 40 for k in range(40)]
    runs, held = lines.LineRuns(spark, fanout=3, min_docs=4), collections.defaultdict(set)
    for b in range(5):
        batch = [(10 * b + i, "\n".join(rng.choices(pool, k=6))) for i in range(10)]
        before = len(held)
        for i, t in batch:
            for x in t.split("\n"):
                held[x].add(i)
        assert runs.add(spark.createDataFrame(batch, "doc_id long, text string")).count() == len(held) - before
    rows = [tuple(r) for run in runs.runs() for r in run.select("h1", "h2").collect()]
    assert len(rows) == len(set(rows)) == len(held)
    assert sorted(r["last_doc"] for r in runs.verdicts().collect()) == sorted(max(x) for x in held.values() if len(x) >= 4)
    merged = [p for p in plans if "LeftAnti" in p or "FullOuter" in p]
    assert len(merged) >= 5
    assert all("SortMergeJoin" in p and "Exchange" not in p for p in merged)
    assert all(" Sort " not in p for p in merged if "LeftAnti" in p)
    names = set(runs.names)
    runs.drop()
    assert not names & {r["tableName"] for r in spark.sql("show tables").collect()}


def test_line_dedup_on_repeated_rows_is_as_in_sql(spark, tmp_path):
    x = "This line has more than forty characters in it."
    rows = [(1, x), (1, x), (2, x + "\n" + x), (3, x), (3, "short"), (4, None), (5, x.upper() + "\t\nown")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    want = con.execute(registry.SQL["op4_line_dedup"]).fetchall()
    got = registry.QUERIES["op4_line_dedup"](spark, str(tmp_path)).collect()
    assert sorted(tuple(r) for r in got) == sorted(want)
    assert sum(r["n_dropped"] for r in got) == 5


def test_line_dedup_edges(spark, empty):
    assert lines.dedup_lines(empty).count() == 0
    x = "This line has more than forty characters in it."
    rows = spark.createDataFrame([(None, x), (1, x), (1, x), (2, x), (3, x), (4, None)], "doc_id long, text string")
    got = sorted((str(r["doc"]["doc_id"]), r["n_lines"], r["n_dropped"]) for r in lines.dedup_lines(rows).collect())
    assert got == [("1", 1, 1), ("1", 1, 1), ("2", 1, 1), ("3", 1, 0), ("4", 1, 0), ("None", 1, 1)]


def test_quality_rules(docs, corpus, empty, clashing):
    got = {r["doc_id"]: r for r in quality_rules.judge(docs).collect()}
    for i, t, *_ in corpus:
        text, r = t or "", got[i]
        w = B.WORD(text)
        ls = [x for x in text.split("\n") if B.WORD(x)]
        n = B.repeat_words(text)
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (len(w), sum(map(len, w)), sum(text.count(c) for c in "#*$%&|<>"), len(ls) - len(set(ls)), n)
        assert r["base_failed"] == (len(w) < 10 or 100 * n > 20 * len(w))
        assert not (r["base_failed"] and r["kept"])
    assert quality_rules.judge(empty).count() == 0
    assert {r["doc_id"]: r["kept"] for r in quality_rules.judge(clashing).collect()} == {i: r["kept"] for i, r in got.items()}


def test_voting_tells_rules_apart():
    """Two rules that agree with each other outweigh one that votes by chance."""
    patterns = [((1, 1, 1), 400), ((1, 1, -1), 380), ((-1, -1, 1), 60), ((-1, -1, -1), 60), ((0, 0, 0), 50)]
    good, tables = quality_rules.fit(patterns, 3)
    assert 0.7 < good < 0.98
    p = lambda *v: quality_rules.posterior(v, good, tables)
    assert p(1, 1, -1) > 0.9 > 0.1 > p(-1, -1, 1)
    assert quality_rules.fit([], 3)[0] == quality_rules.START_GOOD


def test_junk_goes_and_prose_stays(spark):
    rows = [(i, " ".join(f"word{(i * 7 + k * k) % 97}ly" for k in range(60)) + ".") for i in range(60)]
    rows += [(100 + i, " ".join(f"Wo{(i + k * k) % 89}rd***" for k in range(60))) for i in range(6)]
    rows += [(200 + i, " ".join(f"SHOUT{(i + k * k) % 89}!!" for k in range(60))) for i in range(6)]
    got = {r["doc_id"]: r["kept"] for r in quality_rules.judge(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(kept == (i < 100) for i, kept in got.items())


ITEMS = [(0, "What is the capital of the old country, and who built the long bridge there? Nobody knows."), (1, "Short item"), (2, None), (3, " ".join(f"w{k}" for k in range(45))), (4, " ".join(f"w{k}" for k in range(45))), (5, "!!")]


def test_decontamination(spark, docs, corpus, empty, clashing):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    extra = [
        (900, "before " + ITEMS[0][1].upper() + " after"), (901, ITEMS[3][1]), (902, "z " * 30 + " ".join(f"w{k}" for k in range(1, 45))), (903, " ".join("new" if k == 22 else f"w{k}" for k in range(45))), (904, " ".join(f"w{k}" for k in range(20))),
        (905, "a short, item here"), (906, None), (907, "w1 w2 w3 w4 w5"), (908, " ".join(f"w{k}" for k in range(22)) + " one " + " ".join(f"w{k}" for k in range(22, 45))), (901, ITEMS[3][1]),
    ]
    small = [(i, t) for i, t, *_ in corpus if len(t or "") < 5000]
    every = spark.createDataFrame(extra + small, "doc_id long, text string")
    rows = decontaminate.contaminated(every, items).collect()
    got = {(r["doc_id"], r["item_id"]) for r in rows}
    assert len(rows) == len(got)
    assert got == B.leaks(extra + small, [(i, t or "") for i, t in ITEMS])
    assert {(900, 0), (901, 3), (901, 4), (902, 3), (905, 1)} <= got
    assert not {i for i, _ in got} & {904, 906, 907}
    assert all(r["hamming"] <= decontaminate.RADIUS for r in rows)
    assert decontaminate.contaminated(empty, items).count() == 0
    assert decontaminate.contaminated(every, items.limit(0)).count() == 0
    assert decontaminate.contaminated(clashing, items).count() == 0


def test_index_finds_all_within_the_radius(spark):
    """Two fingerprints that differ in at most `radius` bits meet: a block of one is among the probes of the other's."""
    radius, rng = decontaminate.RADIUS, random.Random(11)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    rows = []
    for far in list(range(radius + 1)) * 3:
        p = rng.getrandbits(64)
        rows.append((signed(p), signed(p ^ sum(1 << b for b in rng.sample(range(64), far)))))
    t = spark.createDataFrame(rows, "p long, q long").select(F.monotonically_increasing_id().alias("id"), "p", "q")
    left = t.select("id", F.explode(decontaminate.blocks("p")).alias("b")).select("id", "b.k", "b.v")
    right = t.select("id", F.explode(decontaminate.blocks("q")).alias("b")).select("id", "b.k", F.explode(decontaminate.probes(F.col("b.v"), radius // decontaminate.BLOCKS)).alias("v"))
    assert left.join(right, ["id", "k", "v"]).select("id").distinct().count() == len(rows)


def test_decontamination_in_any_order(spark):
    """Items whose parts are swapped, repeated, thinned or cut off by the text's end, among others of the same length."""
    rng = random.Random(23)
    vocabulary = [f"w{k}" for k in range(30)]
    items = [(k, " ".join(rng.choice(vocabulary) + str(k % 7) for _ in range(n))) for k, n in enumerate([40, 40, 40, 12, 25, 25, 60, 5, 9, 30])]
    docs = []
    for i in range(160):
        w = items[i % len(items)][1].split()
        cut = rng.randrange(1, len(w))
        w = [w, w[cut:] + w[:cut], w + w, w[: max(5, len(w) - 3)], w[2:] + w[:2]][i % 5]
        w = [x if rng.random() > 0.01 * (i % 4) else "other" for x in w]
        before, after = ([rng.choice(vocabulary) for _ in range(rng.randrange(0, 50))] for _ in range(2))
        docs.append((None if i % 16 == 0 else i, " ".join(before + w + (after if i % 3 else []))))
    known = [(i, t) for i, t in docs if i is not None]
    rows = decontaminate.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    want = B.leaks(known, items)
    assert {(r["doc_id"], r["item_id"]) for r in rows if r["doc_id"] is not None} == want
    assert {r["item_id"] for r in rows if r["doc_id"] is None} == {j for _, j in B.leaks([(k, t) for k, (i, t) in enumerate(docs) if i is None], items)}
    swapped = [i for i, _ in known if i % 5 == 1]
    assert {i for i, _ in want} & set(swapped)


def test_licenses(spark, docs, corpus, empty, clashing):
    extra = [
        (900, "Code under the MIT License, not the mit licenses. Apache license! CC-BY 4.0"), (901, "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
        (902, "redistribution and use in SOURCE and binary forms, with or without modification, are permitted"), (903, "This file is licensed under the GNU General Public License version 3"), (904, "gnu lesser general public license as published by the free software foundation"),
        (905, "a permission to redistribute binary files is granted to the person"), (906, None), (907, "mit mit license license"),
    ]
    rows = extra + [(i, t) for i, t, *_ in corpus]
    got = {r["doc_id"]: r for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, t in rows:
        w, at, labels = B.TERM(B.lower(t)), [], set()
        for label, phrase in licenses.PHRASES.items():
            p = phrase.split()
            found = [k for k in range(len(w)) if w[k : k + len(p)] == p]
            at += found
            labels |= {label} if found else set()
        r = got[i]
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], set(r["base_labels"])) == (len(w), len(at), min(at, default=None), max(at, default=None), labels)
        assert labels <= set(r["labels"])
        assert list(r["labels"]) == sorted(set(r["labels"]))
        assert 0 <= r["score"] <= 1
    assert [got[i]["labels"] for i in (901, 902, 904, 905, 906)] == [["mit"], ["bsd"], ["lgpl"], [], []]
    assert got[901]["score"] == 1.0
    assert licenses.scan(empty).count() == 0
    assert licenses.scan(clashing).count() == len(corpus)


def test_licenses_in_long_texts(spark):
    """However many other template words a text holds, each template in it is found, where it stands."""
    index = " ".join(sorted({w for _, t, _ in licenses.TEMPLATES for w in t.split()}))
    every = " ".join(f"{t}. Next" for _, t, _ in licenses.TEMPLATES)
    rows = [(k, f"{index}. {t}.") for k, (_, t, _) in enumerate(licenses.TEMPLATES)] + [(100, every), (101, index)]
    got = {r["doc_id"]: r for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for k, (label, t, _) in enumerate(licenses.TEMPLATES):
        assert label in got[k]["labels"]
        assert (len(index.split()), label, 1.0) in {(s["start"], s["label"], s["score"]) for s in got[k]["spans"]}
    assert list(got[100]["labels"]) == sorted({label for label, *_ in licenses.TEMPLATES})
    assert len([s for s in got[100]["spans"] if s["score"] == 1.0]) == len(licenses.TEMPLATES)
    assert list(got[101]["labels"]) == []


def test_licenses_key_phrases_alone(spark):
    """A text of nothing but a key phrase, in any case, is found by it."""
    rows = [(k, key.upper()) for k, (_, _, key) in enumerate(licenses.TEMPLATES)] + [(100, "free of charge, to any person obtaining a copy of this software")]
    got = {r["doc_id"]: r["labels"] for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(label in got[k] for k, (label, *_) in enumerate(licenses.TEMPLATES))
    assert list(got[100]) == ["mit"]

"""Line dedup against levelled sorted runs of line hashes. DataFrame operations only.

LineRuns holds runs: tables of (h1, h2, n_docs, last_doc), a row a line key, bucketed by the hashes and
sorted by them in each bucket. A batch of documents is first reduced to a table of its own keys, bucketed
alike. Merge-anti-joins with the runs, bucket by bucket and without a shuffle, leave the keys that are new;
they become a run of level 0, and a merge-anti-join with that run leaves the known ones, whose counts are
booked beside the runs. So each key is in one run only, that of the batch that brought it. When a level has
`fanout` runs they are merged into one of the next level, two at a time, again bucket by bucket. verdicts()
merge-joins the runs with what was booked and keeps the keys that enough documents hold.

The lines are hashed in one pass; batches, counts and the documents that lose lines come from that table.

Defined cases: a null text is an empty text, that is one empty line; a very long text is exploded into its
lines, and only the hashes of those that are common come together again; a null doc_id ranks below all
others; rows with equal doc_id count as separate documents and get the same verdict, so ties for the largest
doc_id all keep the line; an empty table adds an empty run; other columns come back in `doc` as they were,
whatever their names.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BLANKS, ascii_lower, hash_pair, maybe_broadcast, new_path, table

KEY = ["h1", "h2"]
MIN_CHARS, MIN_DOCS = 40, 5


def line_key(line: Column) -> Column:
    """Stripped at both ends of ASCII white space, A-Z lower-cased."""
    return ascii_lower(F.trim(line, F.lit(BLANKS)))


def split_lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def keyed_lines(docs: DataFrame, min_chars: int) -> DataFrame:
    """doc_id, row (a number of the document's row), h1, h2 of each line whose key has at least min_chars code points."""
    rows = docs.select("doc_id", F.monotonically_increasing_id().alias("row"), "text")
    lines = rows.select("doc_id", "row", F.explode(split_lines(F.col("text"))).alias("line")).select("doc_id", "row", F.trim("line", F.lit(BLANKS)).alias("line"))
    long = lines.filter(F.char_length("line") >= min_chars).select("doc_id", "row", ascii_lower(F.col("line")).alias("key"))
    h1, h2 = hash_pair(F.col("key"))
    return long.select("doc_id", "row", h1.alias("h1"), h2.alias("h2"))


@contextmanager
def sorted_buckets(spark: SparkSession) -> Iterator[None]:
    """Scans of one-file buckets count as sorted, so joins planned meanwhile merge runs without sorting them."""
    name = "spark.sql.legacy.bucketedTableScan.outputOrdering"
    was = spark.conf.get(name, "false")
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, was)


class LineRuns:
    """The runs, in a folder that all executors share. Their tables are named in the session's catalog, which is
    where Spark keeps how a table is bucketed; drop() forgets the names and leaves the files."""

    def __init__(self, spark: SparkSession, root: str | None = None, fanout: int = 2, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS):
        self.spark, self.fanout, self.min_chars, self.min_docs = spark, fanout, min_chars, min_docs
        self.root = root or new_path(spark, "line-runs")
        self.buckets = min(100_000, int(spark.conf.get("spark.sql.shuffle.partitions")))
        self.levels: list[list[DataFrame]] = []
        self.known: list[str] = []
        self.names: list[str] = []

    def _save(self, rows: DataFrame) -> DataFrame:
        """rows as a table in sorted buckets; it doesn't depend on where they come from any more."""
        name = f"tidelog_lines_{uuid.uuid4().hex}"
        with sorted_buckets(self.spark):
            w = rows.write.format("parquet").option("compression", "zstd").option("path", f"{self.root}/{name}")
            w.bucketBy(self.buckets, *KEY).sortBy(*KEY).saveAsTable(name)
        self.names.append(name)
        return self.spark.table(name)

    def runs(self) -> list[DataFrame]:
        return [r for level in self.levels for r in level]

    def _merge(self, a: DataFrame, b: DataFrame) -> DataFrame:
        """Two runs as one; they share no key, so each row is one side's."""
        either = lambda c: F.coalesce(F.col(f"a.{c}"), F.col(f"b.{c}")).alias(c)
        both = a.alias("a").join(b.alias("b").hint("merge"), [F.col(f"a.{k}") == F.col(f"b.{k}") for k in KEY], "full_outer")
        return self._save(both.select(*[either(c) for c in a.columns]))

    def add(self, batch: DataFrame) -> DataFrame:
        """Adds a batch of documents. Returns its keys that no earlier batch held, as the run that they became."""
        return self.add_lines(keyed_lines(batch, self.min_chars))

    def add_lines(self, lines: DataFrame) -> DataFrame:
        """add() for a batch that is rows of keyed_lines() already."""
        # The lines of one document are next to each other, so a repeat inside it falls to the partial aggregate.
        own = fresh = self._save(lines.groupBy(*KEY).agg(F.count_distinct("row").alias("n_docs"), F.max("doc_id").alias("last_doc")))
        if runs := self.runs():
            fresh = self._save(reduce(lambda left, run: left.join(run.hint("merge"), KEY, "left_anti"), runs, own))
            # Not in buckets: they are summed over batches, and a union of bucketed scans isn't safe to sum without a shuffle.
            with sorted_buckets(self.spark):
                own.join(fresh.hint("merge"), KEY, "left_anti").write.option("compression", "zstd").parquet(at := f"{self.root}/known={len(self.known)}")
            self.known.append(at)
        level = 0
        self._level(0).append(fresh)
        while len(self.levels[level]) >= self.fanout:
            full, self.levels[level] = self.levels[level], []
            self._level(level + 1).append(reduce(self._merge, full))
            level += 1
        return fresh

    def _level(self, level: int) -> list[DataFrame]:
        while len(self.levels) <= level:
            self.levels.append([])
        return self.levels[level]

    def verdicts(self) -> DataFrame:
        """The keys that at least min_docs documents hold: h1, h2, last_doc (the only one that keeps its lines)."""
        runs, more = self.runs(), None
        if self.known:
            booked = self.spark.read.option("recursiveFileLookup", "true").parquet(*self.known).groupBy(*KEY).agg(F.sum("n_docs").alias("_n"), F.max("last_doc").alias("_last"))
            more = self._save(booked).hint("merge")
        out = []
        for run in runs:
            if more is not None:
                last = F.greatest("last_doc", "_last")
                run = run.join(more, KEY, "left").select(*KEY, (F.col("n_docs") + F.coalesce("_n", F.lit(0))).alias("n_docs"), last.alias("last_doc"))
            out.append(run.filter(F.col("n_docs") >= self.min_docs).drop("n_docs"))
        return reduce(DataFrame.unionByName, out)

    def drop(self) -> None:
        for name in self.names:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        self.names = []


def dedup_lines(docs: DataFrame, batches: int = 4, fanout: int = 2, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """doc (a struct of the input's columns, whatever their names), kept_text, n_lines, n_dropped."""
    spark = docs.sparkSession
    runs = LineRuns(spark, fanout=fanout, min_chars=min_chars, min_docs=min_docs)
    lines = keyed_lines(docs.select("doc_id", "text"), min_chars).withColumn("batch", F.pmod(F.xxhash64("row"), F.lit(batches)).cast("int"))
    lines.write.option("compression", "zstd").partitionBy("batch").parquet(at := f"{runs.root}/lines")
    lines = spark.read.schema(lines.schema).parquet(at)
    for k in range(batches):
        runs.add_lines(lines.filter(F.col("batch") == k))
    with sorted_buckets(spark):
        runs.verdicts().write.parquet(at := f"{runs.root}/verdicts")
    runs.drop()
    doomed = maybe_broadcast(spark.read.parquet(at), 200_000)
    hits = lines.join(doomed, KEY).filter(~F.col("doc_id").eqNullSafe(F.col("last_doc")))
    hits = hits.groupBy(F.col("doc_id").alias("hit")).agg(F.collect_set("h1").alias("lost"))
    d = docs.select(F.struct(*docs.columns).alias("doc")).join(hits, F.col("doc.doc_id").eqNullSafe(F.col("hit")), "left")
    d = d.select("doc", "lost", split_lines(F.col("doc.text")).alias("lines"))
    stays = F.filter("lines", lambda x: (F.char_length(F.trim(x, F.lit(BLANKS))) < min_chars) | ~F.array_contains(F.col("lost"), F.xxhash64(line_key(x))))
    d = d.withColumn("kept", F.when(F.col("lost").isNull(), F.col("lines")).otherwise(stays))
    return d.select("doc", F.array_join("kept", "\n").alias("kept_text"), F.size("lines").cast("long").alias("n_lines"), (F.size("lines") - F.size("kept")).cast("long").alias("n_dropped"))


def op4_line_dedup(spark, sf_dir: str) -> DataFrame:
    out = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc.doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents
), l AS (
  SELECT rid, doc_id, line, i, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM (SELECT rid, doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM d)
), gone AS (
  SELECT key, max(doc_id) AS last_doc FROM l WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT rid) >= 5
), j AS (
  SELECT l.*, gone.key IS NOT NULL AND l.doc_id IS DISTINCT FROM last_doc AS dropped FROM l LEFT JOIN gone USING (key)
)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (WHERE dropped)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT dropped), '')) AS kept_sha256
FROM j GROUP BY rid, doc_id
"""

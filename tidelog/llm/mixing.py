"""Mixing sources to target weights by a low-discrepancy schedule of equal-token blocks. DataFrame operations only.

Each source's documents, in a shuffled order that depends on doc_id and a seed alone, make a stream of
words that repeats as often as needed and is cut into blocks of `block` words. Slot k of the schedule has
the golden-ratio point frac(k * phi), taken through the cumulative target weights to a source; the j-th
slot of a source takes block j of its stream. Golden-ratio points leave each source within a few slots of
its share, however many there are; the last slots settle that difference: surplus ones are left out, the
last one is cut, and missing ones are appended (as slot n, after the n of the schedule), so that a source
gives its target rounded to whole words. What the schedule decides beside that, when a document is read, is
returned as the first and the last slot that take words of it (-1 if none does).

Targets are filled by levels: all sources get a share by weight, those whose cap is below theirs are capped,
and the rest is shared anew until no more are; a round is one sum over the sources. Ranks and running sums
over sources are taken by ranges of their names, so hosts may be sources.

Defined cases: a null source is a source of its own, ordered last; a null or empty text has size 0, is
taken 0 times by no slot and still returned; a very long text is as many pieces as blocks it touches;
rows with equal doc_id are separate rows, and of equal places the smaller size comes first, so ties are
settled but for equal rows; rows of null doc_id are ordered by their texts; an empty table gives an empty
result; other columns of the input are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import count_words, materialize, running_totals

#: 2^31 / golden ratio, odd: k * STEP mod 2^31 is the golden-ratio sequence in 31 bits.
STEP, BITS = 1327217885, 31
#: The unit interval has 2^12 cells at least, and four a source; slots meet the sources whose interval touches their cell.
CELL_BITS, MAX_CELL_BITS = 12, 26
#: Slots of a chunk (as a power of 2): ranks are counted inside chunks, then offset by chunk totals.
CHUNK_SHIFT = 14
#: Hex digits of the shuffling key that split a source's stream, so that no source is ordered in one task.
BUCKET_DIGITS = 3


def fill_level(t: DataFrame, total: int) -> float:
    """What a unit of weight gets: (total - caps of the capped) / weights of the others. Capping only raises it, so rounds end."""
    level, before = None, -1
    while True:
        capped = F.lit(False) if level is None else F.col("cap") <= F.lit(level) * F.col("weight")
        caps, weights, n = t.agg(F.sum(F.when(capped, F.col("cap"))), F.sum(F.when(~capped, F.col("weight"))), F.count(F.when(capped, 1))).first()
        if not weights:
            return level or 0.0
        level = (total - (caps or 0)) / weights
        if n == before:
            return level
        before = n


def target_table(sizes: DataFrame, weights: tuple[float, ...], max_repeat: int) -> DataFrame:
    """sizes (materialized): sk (sorts as the sources do), source_size. Adds weight, target, quota (whole words) and total."""
    t = running_totals(sizes, "sk", {"rank": F.lit(1)})
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    t = t.withColumn("weight", w).withColumn("cap", F.col("source_size") * max_repeat)
    t = materialize(t, "weights")
    total = t.agg(F.sum("source_size")).first()[0] or 0
    share = F.lit(fill_level(t, total)) * F.col("weight")
    t = t.withColumn("target", F.when(F.col("cap") <= share, F.col("cap").cast("double")).otherwise(share)).withColumn("total", F.lit(total).cast("long"))
    return t.withColumn("quota", F.least(F.floor(F.col("target") + 0.5).cast("long"), F.col("cap"))).select("sk", "source_size", "weight", "target", "quota", "total")


def schedule(targets: DataFrame, total: int, block: int) -> DataFrame:
    """The slots in order: slot, sk, block_no (of the source's repeated stream), words. targets: materialized."""
    spark = targets.sparkSession
    n = -(-total // block)
    edges = running_totals(targets, "sk", {"lo": F.col("quota")})
    full, sources = targets.agg(F.sum("quota"), F.count("*")).first()
    bits = min(MAX_CELL_BITS, max(CELL_BITS, (4 * sources).bit_length()))
    shift = BITS - bits
    for c, words in (("lo_u", F.col("lo")), ("hi_u", F.col("lo") + F.col("quota"))):
        edges = edges.withColumn(c, F.floor(words.cast("double") / F.lit(float(full or 1)) * F.lit(float(2**BITS))).cast("long"))
    edges = edges.withColumn("last_block", F.ceil(F.col("quota") / F.lit(block)).cast("long")).filter("quota > 0")
    cells = edges.filter("hi_u > lo_u").select("sk", "lo_u", "hi_u", F.explode(F.expr(f"sequence(shiftright(lo_u, {shift}), shiftright(hi_u - 1, {shift}))")).alias("cell"))
    slots = spark.range(n).withColumnRenamed("id", "slot").withColumn("u", (F.col("slot") % (1 << BITS)) * STEP % (1 << BITS))
    slots = slots.withColumn("cell", F.shiftright("u", shift))
    hits = slots.join(cells, "cell").filter("u >= lo_u and u < hi_u").select("slot", "sk", F.shiftright("slot", CHUNK_SHIFT).alias("chunk"))
    chunks = hits.groupBy("sk", "chunk").agg(F.count("*").alias("n"))
    given = chunks.withColumn("before", F.sum("n").over(W.partitionBy("sk").orderBy("chunk").rowsBetween(W.unboundedPreceding, 0)) - F.col("n"))
    ranked = hits.withColumn("r", F.row_number().over(W.partitionBy("sk", "chunk").orderBy("slot"))).join(given, ["sk", "chunk"])
    ranked = ranked.select("slot", "sk", (F.col("before") + F.col("r") - 1).alias("block_no"))
    had = chunks.groupBy("sk").agg(F.sum("n").alias("had"))
    tail = edges.join(had, "sk", "left").withColumn("had", F.coalesce("had", F.lit(0))).filter("had < last_block")
    tail = tail.select(F.lit(n).cast("long").alias("slot"), "sk", F.explode(F.expr("sequence(had, last_block - 1)")).alias("block_no"))
    quota = F.broadcast(edges.select("sk", "quota")) if sources <= 100_000 else edges.select("sk", "quota")
    both = ranked.unionByName(tail).join(quota, "sk").filter(F.col("block_no") * block < F.col("quota"))
    return both.select("slot", "sk", "block_no", F.least(F.lit(block).cast("long"), F.col("quota") - F.col("block_no") * block).alias("words"))


def mix(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), max_repeat: int = 3, block: int = 256, seed: int = 17) -> tuple[DataFrame, DataFrame]:
    """(per document: doc_id, size, source_size, target, taken, first_slot, last_slot, source; the schedule with its sources' names)."""
    own = F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit(":"), F.coalesce(F.col("text"), F.lit(""))))
    sized = docs.select(
        "doc_id",
        "source",
        F.coalesce(F.concat(F.lit("0"), F.col("source").cast("string")), F.lit("1")).alias("sk"),
        count_words(F.col("text")).alias("size"),
        F.md5(F.concat(F.lit(f"{seed}:"), own)).alias("h"),
    ).withColumn("bucket", F.substring("h", 1, BUCKET_DIGITS))
    sized = materialize(sized, "sizes")
    buckets = materialize(sized.groupBy("sk", "bucket").agg(F.sum("size").alias("n")), "buckets")
    sources = materialize(target_table(materialize(buckets.groupBy("sk").agg(F.sum("n").alias("source_size")), "sources"), weights, max_repeat), "targets")
    total = sources.agg(F.max("total")).first()[0] or 0
    slots = materialize(schedule(sources, total, block), "schedule")

    upto = W.partitionBy("sk").orderBy("bucket").rowsBetween(W.unboundedPreceding, 0)
    starts = buckets.withColumn("offset", F.sum("n").over(upto) - F.col("n")).join(sources.select("sk", "source_size", "target", "quota"), "sk").drop("n")
    inside = W.partitionBy("sk", "bucket").orderBy("h", "doc_id", "size").rowsBetween(W.unboundedPreceding, 0)
    placed = sized.join(starts, ["sk", "bucket"]).withColumn("a", F.col("offset") + F.sum("size").over(inside) - F.col("size"))
    # One piece for each repeat and block that a document reaches; documents that aren't reached get a piece that meets no slot.
    pieces = F.expr(f"""
        filter(flatten(transform(sequence(0, {max_repeat - 1}), e ->
            if(size > 0 and a + e * source_size < quota,
               transform(sequence(floor((a + e * source_size) / {block}), floor((least(a + e * source_size + size, quota) - 1) / {block})),
                         b -> named_struct('b', b, 'n', least(a + e * source_size + size, (b + 1) * {block}) - greatest(a + e * source_size, b * {block}), 'at', greatest(a + e * source_size, b * {block}) - b * {block})),
               array()))), x -> x.n > 0)""")
    none = F.array(F.struct((-1 - F.conv("bucket", 16, 10).cast("long")).alias("b"), F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("at")))
    cut = placed.withColumn("p", pieces).withColumn("p", F.explode(F.when(F.size("p") > 0, F.col("p")).otherwise(none)))
    cut = cut.select("doc_id", "source", "sk", "size", "source_size", "target", "a", "h", F.col("p.b").alias("block_no"), F.col("p.n").alias("n"), F.col("p.at").alias("at"))
    met = cut.join(slots.select("sk", "block_no", "words", "slot"), ["sk", "block_no"], "left")
    words = F.coalesce(F.greatest(F.lit(0), F.least(F.col("n"), F.col("words") - F.col("at"))), F.lit(0))
    at = F.when(words > 0, F.col("slot"))
    # size-0 rows share a place; a count keeps rows that are equal in every respect.
    out = met.groupBy("doc_id", "source", "sk", "size", "source_size", "target", "a", "h").agg(
        F.sum(words).cast("long").alias("taken"), F.coalesce(F.min(at), F.lit(-1)).alias("first_slot"), F.coalesce(F.max(at), F.lit(-1)).alias("last_slot"), F.count(F.when(F.col("n") == 0, 1)).alias("rows")
    )
    out = out.withColumn("rows", F.explode(F.expr("sequence(1, if(size = 0, greatest(rows, 1), 1))")))
    name = F.when(F.col("sk") == "1", None).otherwise(F.substring("sk", 2, 1 << 30))
    return out.select("doc_id", "size", "source_size", "target", "taken", "first_slot", "last_slot", "source"), slots.select("slot", name.alias("source"), "block_no", "words")


def op1_mix_sources(spark, sf_dir: str) -> DataFrame:
    from .common import table

    return mix(table(spark, sf_dir, "documents"))[0].select("doc_id", "size", "source_size", "target", "taken", "first_slot", "last_slot")


SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce('0' || source, '1') AS sk, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         md5('17:' || coalesce(doc_id::VARCHAR, ':' || coalesce(text, ''))) AS h
  FROM documents
), s AS (
  SELECT sk, sum(size)::BIGINT AS source_size FROM d GROUP BY sk
), w AS (
  SELECT *, [5.0::DOUBLE, 2.0, 1.0][((row_number() OVER (ORDER BY sk) - 1) % 3 + 1)::INT] AS weight, source_size * 3 AS cap FROM s
), l AS (
  SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / weight, sk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
            / sum(weight) OVER (ORDER BY cap / weight, sk ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM w
), c AS (
  SELECT *, cap <= level * weight AS capped FROM l
), t AS (
  SELECT sk, source_size, cap, CASE WHEN capped THEN cap::DOUBLE
    ELSE coalesce((SELECT level FROM c WHERE NOT capped ORDER BY cap / weight, sk LIMIT 1), 0) * weight END AS target
  FROM c
), q AS (
  SELECT *, least(floor(target + 0.5)::BIGINT, cap)::BIGINT AS quota FROM t
), p AS (
  SELECT d.*, row_number() OVER () AS rid, (sum(size) OVER (PARTITION BY sk ORDER BY h, doc_id, size ROWS UNBOUNDED PRECEDING) - size)::BIGINT AS a FROM d
), e AS (
  SELECT sk, quota, (quota + 255) // 256 AS last_block, floor((upto - quota)::DOUBLE / full_words * 2147483648)::BIGINT AS lo_u, floor(upto::DOUBLE / full_words * 2147483648)::BIGINT AS hi_u
  FROM (SELECT sk, quota, sum(quota) OVER (ORDER BY sk ROWS UNBOUNDED PRECEDING)::BIGINT AS upto, greatest(1, sum(quota) OVER ())::DOUBLE AS full_words FROM q) WHERE quota > 0
), n AS (
  SELECT (coalesce(sum(source_size), 0)::BIGINT + 255) // 256 AS n FROM s
), g AS (
  SELECT slot, (slot % 2147483648) * 1327217885 % 2147483648 AS u FROM (SELECT unnest(range(n)) AS slot FROM n)
), b AS (
  SELECT sk, slot, row_number() OVER (PARTITION BY sk ORDER BY slot) - 1 AS block_no FROM g JOIN e ON u >= lo_u AND u < hi_u
), taken_slots AS (
  SELECT sk, block_no, slot FROM b
  UNION ALL SELECT sk, unnest(range(coalesce(had, 0), last_block)), n FROM e LEFT JOIN (SELECT sk, count(*) AS had FROM b GROUP BY sk) USING (sk), n
), pieces AS (
  SELECT rid, sk, unnest(range((a + k * source_size) // 256, (least(a + k * source_size + size, quota) - 1) // 256 + 1)) AS block_no
  FROM p JOIN q USING (sk), (VALUES (0), (1), (2)) r(k) WHERE size > 0 AND a + k * source_size < quota
), read AS (
  SELECT rid, min(slot) AS first_slot, max(slot) AS last_slot FROM pieces JOIN taken_slots USING (sk, block_no) GROUP BY rid
)
SELECT doc_id, size, source_size, target,
       (greatest(0, least(a + size, quota) - a) + greatest(0, least(a + size, quota - source_size) - a)
        + greatest(0, least(a + size, quota - 2 * source_size) - a))::BIGINT AS taken,
       coalesce(first_slot, -1)::BIGINT AS first_slot, coalesce(last_slot, -1)::BIGINT AS last_slot
FROM p JOIN q USING (sk) LEFT JOIN read USING (rid)
"""

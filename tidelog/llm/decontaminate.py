"""Benchmark decontamination by SimHash over item-sized windows. DataFrame operations only.

Words are runs of ASCII letters (A-Z lower-cased), digits and non-ASCII characters; shingles are five of
them. A window has as many words as the item it is compared with, at any place of the text. Each window and
each item gets a 64-bit SimHash of its shingles. Fingerprints are cut into BLOCKS blocks of 16 bits: of two
within the radius some block differs in at most radius / BLOCKS bits. Items are indexed under every value of
each block with so many bits flipped, windows look up their own values, so the join by (length, block, value)
finds all within the radius, and a key holds a few in a hundred of the items of a length. Distinct
fingerprints are joined, so a passage in many documents is looked up once. Candidates within the radius are
verified by weighted Jaccard similarity, weights being how often a shingle occurs.

Not all windows need a fingerprint. Call a place a hit if a shingle of some item of the length stands there.
A window that isn't laid at a hit can slide right to the next one: it loses no hit, and no size is gained.
One laid at a hit whose place before is a hit too can slide left, if what drops out at its end is inside the
text and no hit. Neither makes the window less similar to any item of the length, so windows are laid only
where neither applies; none that is best for an item is missed, in whatever order its words come.

Defined cases: null and empty texts match nothing, nor does an item without words; an item of fewer than
five words is one shingle, matched as that sequence; windows are cut at the ends of a text; very long texts
are taken whole, their windows gathered by stretches of STRETCH words; equal items are matched each by its
own item_id; of windows as similar the nearest fingerprint, then the first, is returned; rows with equal
doc_id share result rows, and so do null ids, but their texts are compared one by one; empty tables give an
empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, materialize, maybe_broadcast, table

TERM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
SHINGLE, MIN_SIMILARITY = 5, 0.8
#: At a similarity of 0.8 fingerprints differ in 10 bits of 64 on the mean, with a standard deviation of 3.
RADIUS, FINGERPRINT, BLOCKS = 19, 64, 4
STRETCH = 16_384


def word_hashes(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(ascii_lower(F.coalesce(text, F.lit(""))), F.lit(TERM), F.lit(0)), lambda w: F.xxhash64(w))


def grams(hashes: str, width: int) -> Column:
    """Hashes of each `width` words in a row, in text order."""
    window = lambda i: F.xxhash64(F.lit(width), F.get(F.col(hashes), i), *[F.get(F.col(hashes), i + k) for k in range(1, width)])
    return F.when(F.size(hashes) >= width, F.transform(F.sequence(F.lit(0), F.size(hashes) - width), window)).otherwise(F.array().cast("array<bigint>"))


def simhash(shingles: Column) -> Column:
    """Bit b is set when it is set in more than half of the shingles; a shingle counts as often as it occurs."""
    bit = lambda b: F.aggregate(shingles, F.lit(0), lambda s, g: s + 2 * F.call_function("shiftrightunsigned", g, b).bitwiseAND(F.lit(1)).cast("int") - 1)
    return F.aggregate(F.sequence(F.lit(0), F.lit(FINGERPRINT - 1)), F.lit(0).cast("long"), lambda s, b: s.bitwiseOR(F.when(bit(b) > 0, F.call_function("shiftleft", F.lit(1).cast("long"), b)).otherwise(F.lit(0).cast("long"))))


def blocks(fingerprint: str) -> Column:
    """(number, value) of the fingerprint's blocks."""
    width = FINGERPRINT // BLOCKS
    cut = lambda k: F.shiftrightunsigned(fingerprint, k * width).bitwiseAND(F.lit((1 << width) - 1).cast("long"))
    return F.array(*[F.struct(F.lit(k).alias("k"), cut(k).alias("v")) for k in range(BLOCKS)])


def probes(value: Column, flips: int) -> Column:
    """All values of a block that differ from this one in at most `flips` bits."""
    masks = ",".join(str(m) for m in range(1 << FINGERPRINT // BLOCKS) if m.bit_count() <= flips)
    return F.transform(F.split(F.lit(masks), ",").cast("array<bigint>"), lambda m: m.bitwiseXOR(value))


def weighted_jaccard(a: Column, b: Column) -> Column:
    """Sum of the least over the sum of the greatest counts, over all shingles of either side."""
    times = lambda xs, g: F.size(F.filter(xs, lambda x: x == g))
    both = F.aggregate(F.array_distinct(a), F.lit(0), lambda s, g: s + F.least(times(a, g), times(b, g)))
    return both / (F.size(a) + F.size(b) - both)


def window_starts(hits: DataFrame) -> DataFrame:
    """hits (doc_id, th, n, m, pos, last): places of the items' shingles, m being a window's and last the text's
    last place. Returns doc_id, th, n, start of the windows that are laid."""
    told = lambda at, *flags: F.struct(at.alias("start"), *[F.lit(x).alias(c) for c, x in zip(("hit", "before", "end"), flags, strict=True)])
    marks = F.array(told(F.col("pos"), 1, 0, 0), told(F.col("pos") + 1, 0, 1, 0), told(F.col("pos") - F.col("m") + 1, 0, 0, 1))
    t = hits.select("doc_id", "th", "n", "m", "last", F.explode(marks).alias("x")).select("doc_id", "th", "n", "m", "last", "x.*")
    t = t.groupBy("doc_id", "th", "n", "m", "last", "start").agg(*[F.max(c).alias(c) for c in ("hit", "before", "end")])
    left = (F.col("before") == 1) & (F.col("end") == 0) & (F.col("start") + F.col("m") - 1 <= F.col("last"))
    return t.filter((F.col("hit") == 1) & ~left).select("doc_id", "th", "n", "start")


def contaminated(docs: DataFrame, items: DataFrame, radius: int = RADIUS, min_similarity: float = MIN_SIMILARITY) -> DataFrame:
    """doc_id, item_id, start_word, n_words, hamming, similarity of each document's best window for an item."""
    bench = items.select("item_id", word_hashes(F.col("text")).alias("hw")).withColumn("n", F.size("hw")).filter("n > 0")
    short = [r[0] for r in bench.filter(F.col("n") < SHINGLE).select("n").distinct().collect()]  # of 1 to 4
    widths = sorted({SHINGLE, *short})
    of = F.least(F.col("n"), F.lit(SHINGLE))
    by_width = lambda hashes: F.coalesce(*[F.when(F.col("g") == w, grams(hashes, w)) for w in widths])
    bench = bench.withColumn("g", of).withColumn("shingles", by_width("hw"))
    bench = materialize(bench.withColumn("print", simhash(F.col("shingles"))).drop("hw"), "items")
    places = materialize(bench.select("n", "g", F.explode("shingles").alias("gram")).distinct(), "item-places")

    # A text is known by its doc_id and a hash of it, so texts without a doc_id are told apart.
    text = docs.select("doc_id", "text").filter("text is not null").withColumn("th", F.xxhash64("text"))
    hashed = text.select("doc_id", "th", word_hashes(F.col("text")).alias("hw"))
    hits = None
    for w in widths:
        own = hashed.select("doc_id", "th", (F.size("hw") - w).alias("last"), F.posexplode(grams("hw", w)).alias("pos", "gram"))
        met = own.join(maybe_broadcast(places.filter(F.col("g") == w), 500_000), "gram")
        met = met.select("doc_id", "th", "n", (F.col("n") - w + 1).alias("m"), "pos", "last", "g")
        hits = met if hits is None else hits.unionByName(met)
    spots = materialize(window_starts(hits.drop("g")), "windows")
    of_doc = spots.groupBy(F.col("doc_id").alias("_doc"), F.col("th").alias("_th"), F.floor(F.col("start") / STRETCH)).agg(F.collect_list(F.struct("start", "n", F.least("n", F.lit(SHINGLE)).alias("g"))).alias("windows"))
    of_doc = F.broadcast(of_doc) if spots.count() <= 300_000 else of_doc
    d = text.join(of_doc, text["doc_id"].eqNullSafe(of_doc["_doc"]) & (text["th"] == of_doc["_th"])).select("doc_id", "th", "windows", word_hashes(F.col("text")).alias("hw"))
    for w in widths:
        d = d.withColumn(f"grams{w}", grams("hw", w))
    cut = lambda x: F.coalesce(*[F.when(x["g"] == w, F.slice(F.col(f"grams{w}"), x["start"] + 1, F.greatest(x["n"] - w + 1, F.lit(0)))) for w in widths])
    seen = d.select("doc_id", F.explode(F.transform("windows", lambda x: F.struct(x["start"].alias("start"), x["n"].alias("n"), cut(x).alias("shingles")))).alias("w"))
    seen = materialize(seen.select("doc_id", "w.*").withColumn("print", simhash(F.col("shingles"))), "window-prints")

    index = bench.select("item_id", "n", F.col("print").alias("item_print"), F.explode(blocks("print")).alias("b"))
    index = index.select("item_id", "n", "item_print", "b.k", F.explode(probes(F.col("b.v"), radius // BLOCKS)).alias("v"))
    asked = seen.select("n", "print").distinct()
    asked = materialize(asked.select("n", "print", F.explode(blocks("print")).alias("b")).select("n", "print", "b.k", "b.v"), "window-blocks")
    near = F.bit_count(F.col("print").bitwiseXOR(F.col("item_print")))
    pairs = index.join(maybe_broadcast(asked, 200_000), ["n", "k", "v"]).withColumn("hamming", near).filter(F.col("hamming") <= radius)
    pairs = pairs.groupBy("n", "print", "item_id").agg(F.min("hamming").alias("hamming"))
    pairs = pairs.alias("p").join(bench.select("item_id", F.col("n").alias("_n"), F.col("shingles").alias("b")).alias("i"), F.col("p.item_id").eqNullSafe(F.col("i.item_id")) & (F.col("n") == F.col("_n"))).select("p.*", "b")
    pairs = maybe_broadcast(materialize(pairs, "window-pairs"), 20_000)
    scored = seen.join(pairs, ["n", "print"]).withColumn("similarity", weighted_jaccard(F.col("shingles"), F.col("b"))).filter(F.col("similarity") >= min_similarity)
    best = F.max(F.struct("similarity", (-F.col("hamming")).alias("h"), (-F.col("start")).alias("s"), F.col("n").alias("n"))).alias("x")
    out = scored.groupBy("doc_id", "item_id").agg(best)
    return out.select("doc_id", "item_id", (-F.col("x.s")).cast("long").alias("start_word"), F.col("x.n").cast("long").alias("n_words"), (-F.col("x.h")).cast("int").alias("hamming"), F.col("x.similarity").alias("similarity"))


def op3_decontaminate(spark, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))

"""Quality rules by weak supervision. DataFrame operations only.

Each rule votes +1 (good), -1 (bad) or abstains (0) on a document. How often a rule votes which way in
good and in bad documents is unknown; expectation-maximisation estimates it, together with the share of
good documents, from the counts of vote patterns over all documents. A document is kept when the posterior
probability that it is good reaches `min_posterior`, instead of when no rule objects.

There are at most 3^8 patterns whatever the input, so their counts are the one thing sent to the driver.

Defined cases: a null or empty text has no words, all counts 0 (one empty line, which has no word), fails
the base test and isn't kept; a very long text is judged whole, from one array of its words' hashes; a
posterior of just `min_posterior` (a tie) is kept; a null doc_id passes through; repeated rows are judged
alike; an empty table gives an empty result; other columns of the input are ignored, whatever their names.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, materialize, table

#: The window whose repeats count, in words.
SPAN = 5
#: Before any data: how rules vote in bad and in good documents (bad, abstain, good), and the share of good ones.
#: A rule objects to the kind of fault it looks for and finds bad documents with others fine, hence 0.60.
START = {0: (0.30, 0.10, 0.60), 1: (0.005, 0.095, 0.90)}
START_GOOD = 0.85
#: Weight of these beside the data, as a share of the number of documents: it keeps the two classes what they are called.
ANCHOR = 0.05


def repeat_words(grams: Column) -> Column:
    """Words covered by windows that are found twice or more, from the windows' hashes in text order."""
    tagged = F.sort_array(F.transform(grams, lambda g, i: F.struct(g.alias("g"), i.alias("i"))))
    pairs = F.zip_with(tagged, F.slice(tagged, 2, F.greatest(F.size(tagged), F.lit(1))), lambda a, b: F.when(a["g"] == b["g"], F.array(a["i"], b["i"])).otherwise(F.array().cast("array<int>")))
    starts = F.sort_array(F.array_distinct(F.flatten(pairs)))
    covered = F.zip_with(starts, F.slice(starts, 2, F.greatest(F.size(starts), F.lit(1))), lambda a, b: F.least(F.lit(SPAN), F.coalesce(b - a, F.lit(SPAN))))
    return F.aggregate(covered, F.lit(0), lambda s, x: s + x)


def features(docs: DataFrame) -> DataFrame:
    """One row a document: doc_id and what the rules look at, over the whole text."""
    text = F.coalesce(F.col("text"), F.lit(""))
    d = docs.select("doc_id", text.alias("text")).withColumn("words", F.regexp_extract_all("text", F.lit(WORD), F.lit(0)))
    d = d.withColumn("n_words", F.size("words").cast("long")).withColumn("hw", F.transform("words", lambda w: F.xxhash64(w))).drop("words")
    window = lambda i: F.xxhash64(*[F.get(F.col("hw"), i + k) for k in range(SPAN)])
    d = d.withColumn("grams", F.when(F.col("n_words") >= SPAN, F.transform(F.sequence(F.lit(0), F.size("hw") - SPAN), window)).otherwise(F.array().cast("array<bigint>")))
    d = d.withColumn("lines", F.filter(F.split("text", "\n", -1), lambda x: x.rlike(WORD)))
    left = lambda pattern: F.char_length("text") - F.char_length(F.regexp_replace("text", pattern, ""))
    return d.select(
        "doc_id",
        "n_words",
        F.char_length(F.regexp_replace("text", r"[\x20\x09-\x0D]+", "")).cast("long").alias("word_chars"),
        left(r"[#*$%&|<>]+").cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.when(F.size(F.array_distinct("grams")) < F.size("grams"), repeat_words(F.col("grams"))).otherwise(F.lit(0)).cast("long").alias("n_repeat_words"),
        F.size("lines").cast("long").alias("n_lines"),
        F.size(F.array_distinct("hw")).cast("long").alias("n_distinct"),
        left(r"\p{Lu}+").cast("long").alias("n_upper"),
        left("!+").cast("long").alias("n_bang"),
    )


def votes() -> dict[str, Column]:
    """The rules. Ratios of 0/0 are null, on which a rule abstains."""
    c = F.col
    ratio = lambda a, b: c(a) / F.when(c(b) > 0, c(b))

    def rule(x: Column, bad: Column, good: Column) -> Column:
        return F.when(x.isNull(), F.lit(0)).when(bad, F.lit(-1)).when(good, F.lit(1)).otherwise(F.lit(0))

    sym_w, sym_c, bang, caps = ratio("n_symbols", "n_words"), ratio("n_symbols", "word_chars"), ratio("n_bang", "n_words"), ratio("n_upper", "word_chars")
    dup, rep, kinds, length = ratio("n_dup_lines", "n_lines"), ratio("n_repeat_words", "n_words"), ratio("n_distinct", "n_words"), ratio("word_chars", "n_words")
    return {
        "symbols_a_word": rule(sym_w, sym_w > 0.3, sym_w < 0.05),
        "symbols_a_character": rule(sym_c, sym_c > 0.06, sym_c < 0.01),
        "shouting": rule(bang, bang > 0.3, bang < 0.05),
        "capitals": rule(caps, caps > 0.35, caps < 0.15),
        "repeated_lines": rule(dup, dup > 0.35, dup < 0.1),
        "repeated_windows": rule(rep, rep > 0.15, rep < 0.05),
        "distinct_words": rule(kinds, kinds < 0.08, kinds > 0.3),
        "word_length": rule(length, (length < 2) | (length > 14), (length > 3) & (length < 10)),
    }


def fit(patterns: list[tuple[tuple[int, ...], int]], n_rules: int, rounds: int = 60) -> tuple[float, list[dict[int, tuple[float, float, float]]]]:
    """Expectation-maximisation over (votes, documents). Returns the share of good documents and, for each
    rule, by class, the probabilities of the votes -1, 0 and +1."""
    total = sum(n for _, n in patterns)
    good, tables = START_GOOD, [dict(START) for _ in range(n_rules)]
    anchor = max(1.0, ANCHOR * total)
    for _ in range(rounds if total else 0):
        mass = {0: anchor * (1 - START_GOOD), 1: anchor * START_GOOD}
        sums = [{y: [anchor * p for p in START[y]] for y in (0, 1)} for _ in range(n_rules)]
        for v, n in patterns:
            p = posterior(v, good, tables)
            for y, share in ((0, n * (1 - p)), (1, n * p)):
                mass[y] += share
                for j, x in enumerate(v):
                    sums[j][y][x + 1] += share
        before, good = good, mass[1] / (mass[0] + mass[1])
        tables = [{y: tuple(x / sum(s[y]) for x in s[y]) for y in (0, 1)} for s in sums]
        if abs(good - before) < 1e-9:
            break
    return good, tables


def posterior(v: tuple[int, ...], good: float, tables: list[dict[int, tuple[float, float, float]]]) -> float:
    x = math.log(good / (1 - good)) + sum(math.log(t[1][k + 1] / t[0][k + 1]) for t, k in zip(tables, v, strict=True))
    return 1 / (1 + math.exp(-max(-700.0, min(700.0, x))))


def judge(docs: DataFrame, min_posterior: float = 0.5) -> DataFrame:
    """features() with base_failed, posterior and kept."""
    rules = votes()
    base = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    f = materialize(features(docs).withColumns(rules).withColumn("base_failed", base), "rule-features")
    patterns = [(tuple(r[:-1]), r[-1]) for r in f.groupBy(*rules).count().collect()]
    good, tables = fit(sorted(patterns), len(rules))
    x = F.lit(math.log(good / (1 - good)))
    for name, t in zip(rules, tables, strict=True):
        odds = [math.log(t[1][k] / t[0][k]) for k in range(3)]
        x = x + F.when(F.col(name) == -1, odds[0]).when(F.col(name) == 0, odds[1]).otherwise(odds[2])
    f = f.withColumn("posterior", 1 / (1 + F.exp(-x)))
    return f.withColumn("kept", ~F.col("base_failed") & (F.col("posterior") >= min_posterior))


def op5_quality_rules(spark, sf_dir: str) -> DataFrame:
    out = judge(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "posterior")

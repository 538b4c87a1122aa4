"""License scans over a positional index of rare licence words. DataFrame operations only.

Templates are short forms of licences. The index holds, for each word that is rare among templates or part
of a mandatory key phrase, its positions. Rare is what has a high inverse document frequency over the
templates, that is, stands in few of them. All of a file's indexed words are looked up, wherever they stand;
each hit votes for (template, start) = word position - template position. A start with enough votes is
verified: every word of the template's key phrase must stand in its place. The share of indexed template
words in their places is the score.

Base phrases are counted beside it, wherever their words stand consecutively, and their labels always stay.

Defined cases: a null or empty text has no words, no labels ('') and score 0; of a very long text every
indexed word votes; templates that fit as well (ties) all give their labels; repeated rows are answered alike;
null ids pass through; an empty table gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, materialize, table

TERM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: The same words before A-Z are lower-cased.
ANY_TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
PHRASES = {"gpl": "gnu general public license", "apache": "apache license", "cc-by": "cc by", "mit": "mit license"}
#: label, words of a template, its mandatory key phrase.
TEMPLATES = [
    ("apache", "licensed under the apache license version 2 0 you may not use this file except in compliance with the license", "apache license version 2 0"),
    ("apache", "distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied", "without warranties or conditions of any kind"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "free of charge to any person obtaining a copy"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "for any purpose with or without fee"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "redistribution and use in source and binary forms"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", "gnu general public license"),
    ("gpl", "this work is licensed under the gnu general public license version 3", "gnu general public license"),
    ("lgpl", "under the terms of the gnu lesser general public license as published by the free software foundation", "gnu lesser general public license"),
    ("agpl", "under the terms of the gnu affero general public license as published by the free software foundation", "gnu affero general public license"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0", "mozilla public license"),
    ("epl", "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0", "eclipse public license"),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license", "creative commons attribution"),
    ("cc-by-nc", "this work is licensed under cc by nc 4 0", "cc by nc"),
    ("mit", "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement", "particular purpose and noninfringement"),
    ("bsd", "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software", "endorse or promote products derived"),
    ("zlib", "in no event will the authors be held liable for any damages arising from the use of this software", "authors be held liable for any damages"),
    ("bsl", "distributed under the boost software license version 1 0", "boost software license"),
    ("ofl", "this font software is licensed under the sil open font license version 1 1", "sil open font license"),
    ("cc0", "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work", "related or neighboring rights"),
    ("artistic", "under the terms of the artistic license 2 0", "artistic license"),
    ("cddl", "subject to the terms of the common development and distribution license", "common development and distribution license"),
    ("psf", "licensed under the python software foundation license version 2", "python software foundation license"),
    ("postgresql", "permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement is hereby granted", "without a written agreement"),
    ("ms-pl", "licensed under the microsoft public license", "microsoft public license"),
    ("eupl", "licensed under the eupl version 1 2 or later", "licensed under the eupl"),
    ("unlicense", "this is free and unencumbered software released into the public domain", "unencumbered software released into the public domain"),
]
#: A word of at most so many templates is rare; so many votes make a candidate (no key phrase has fewer words).
RARE_IN, MIN_VOTES = 3, 2


def build_index() -> tuple[list[tuple[str, int, int, bool]], list[tuple[int, str, int, int]]]:
    """(postings (word, template, position, of the key phrase); templates (number, label, indexed words, key words))."""
    words = [t.split() for _, t, _ in TEMPLATES]
    df = Counter(w for ws in words for w in set(ws))
    postings, heads = [], []
    for k, ((label, _, phrase), ws) in enumerate(zip(TEMPLATES, words, strict=True)):
        key = phrase.split()
        at = next(i for i in range(len(ws)) if ws[i : i + len(key)] == key)
        spots = {i for i in range(len(ws)) if df[ws[i]] <= RARE_IN} | set(range(at, at + len(key)))
        postings += [(ws[i], k, i, at <= i < at + len(key)) for i in sorted(spots)]
        heads.append((k, label, len(spots), len(key)))
    return postings, heads


def needed_words() -> list[str]:
    """Of each base phrase and key phrase its longest word; of those as long, the one that most phrases hold."""
    phrases = [p.split() for p in (*PHRASES.values(), *(key for *_, key in TEMPLATES))]
    held = Counter(w for p in phrases for w in set(p))
    return sorted({max(p, key=lambda w: (len(w), held[w], w)) for p in phrases})


def phrase_starts(words: str, places: Column, phrase: str) -> Column:
    """The places at which the phrase's words stand consecutively."""

    def starts(i: Column) -> Column:
        out = F.lit(True)
        for k, w in enumerate(phrase.split()):
            out = out & (F.get(F.col(words), i + k) == w)
        return F.coalesce(out, F.lit(False))

    return F.filter(places, starts)


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels and labels (arrays), score, spans (template, start, score)."""
    spark = docs.sparkSession
    postings, heads = build_index()
    indexed = sorted({w for w, *_ in postings})
    # Texts without any of these substrings hold no base phrase and no template's key phrase.
    needed = needed_words()
    text = F.coalesce(F.col("text"), F.lit(""))
    d = docs.select("doc_id", text.alias("text")).withColumn("low", F.lower("text"))
    may = F.lit(False)
    for w in needed:
        may = may | F.contains("low", F.lit(w))
    d = d.withColumn("n_words", F.regexp_count("text", F.lit(ANY_TERM)).cast("long"))
    d = d.withColumn("words", F.when(may, F.regexp_extract_all(ascii_lower(F.col("text")), F.lit(TERM), F.lit(0))).otherwise(F.array().cast("array<string>")))
    places = F.when(F.size("words") > 0, F.sequence(F.lit(0), F.size("words") - 1)).otherwise(F.array().cast("array<int>"))
    for label, phrase in PHRASES.items():
        d = d.withColumn(f"at_{label}", phrase_starts("words", places, phrase))
    at = F.concat(*[F.col(f"at_{k}") for k in PHRASES])
    tagged = F.transform("words", lambda w, i: F.struct(w.alias("w"), i.alias("i")))
    d = d.select(
        F.monotonically_increasing_id().alias("rid"),
        "doc_id",
        "n_words",
        F.size(at).cast("long").alias("n_base"),
        F.array_min(at).cast("long").alias("first_word"),
        F.array_max(at).cast("long").alias("last_word"),
        F.array_compact(F.array(*[F.when(F.size(f"at_{k}") > 0, F.lit(k)) for k in PHRASES])).alias("base_labels"),
        F.filter(tagged, lambda x: x["w"].isin(indexed)).alias("hits"),
    )
    d = materialize(d, "licence-words")
    hit = d.filter(F.size("hits") >= MIN_VOTES).select("rid", F.explode("hits").alias("x"))
    index = spark.createDataFrame(postings, "w string, t int, p int, key boolean")
    votes = hit.join(F.broadcast(index), F.col("x.w") == F.col("w")).withColumn("start", F.col("x.i") - F.col("p"))
    votes = votes.groupBy("rid", "t", "start").agg(F.count("*").alias("votes"), F.count(F.when(F.col("key"), 1)).alias("key_met"))
    head = spark.createDataFrame(heads, "t int, label string, indexed int, key_words int")
    found = votes.filter(F.col("votes") >= MIN_VOTES).join(F.broadcast(head), "t").filter("key_met = key_words")
    found = found.withColumn("score", F.col("votes") / F.col("indexed"))
    per = found.groupBy("rid").agg(F.collect_set("label").alias("more"), F.max("score").alias("best"), F.sort_array(F.collect_list(F.struct("start", "label", "score"))).alias("spans"))
    out = d.drop("hits").join(per, "rid", "left").withColumn("labels", F.array_sort(F.array_union("base_labels", F.coalesce("more", F.array().cast("array<string>")))))
    floor = F.when(F.size("base_labels") > 0, 0.5).otherwise(0.0)
    return out.withColumn("base_labels", F.array_sort("base_labels")).withColumn("score", F.greatest(F.coalesce("best", F.lit(0.0)), floor)).drop("rid", "more", "best")


def op8_license_scan(spark, sf_dir: str) -> DataFrame:
    out = scan(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join("base_labels", ",").alias("base_labels"), F.array_join("labels", ",").alias("labels"), "score")

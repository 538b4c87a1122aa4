"""Quality classifier by nearest-neighbour voting in a latent-semantic space.

A bounded sample of labelled documents (`sample` of them at most, by a hash of doc_id) gives terms, their
inverse document frequencies and, by singular value decomposition, a space of `rank` dimensions. Terms are
words, the shapes of words, and words that equal the one before; each is known by a hash. The sample's terms
are counted where its texts are read, the TERMS most frequent are kept, and one task decomposes the counts
(sample x TERMS numbers at most); the driver sees the result alone. Terms, projection and the labelled
vectors (bounded by sample, TERMS and rank) are broadcast; every document is projected, its cosines with all
labelled vectors are computed in blocks, and its `neighbours` nearest, with those as near as the last of
them, vote with their label, weighted by a power of the cosine.

Labels are learned only from rows whose crc32(doc_id as text) mod 4 is not 2; the others are held out.
Labels, language, source and doc_id are no inputs of a score.

Defined cases: null and empty texts, or those without a known term, get the sample's share of label 1;
without any labelled rows to learn from all scores are 0.5; labels of unknown or null doc_id and null
labels are ignored, of two labels of a document the greater counts; a very long text is counted whole, by
its distinct words; equal cosines (ties) all vote; repeated rows score alike; an empty table gives an empty
result; other columns come back in `doc` as they were, whatever their names.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import islice
from operator import eq

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, table

#: Bounds of the fit: labelled documents, terms, dimensions.
SAMPLE, TERMS, RANK = 4000, 20_000, 48
NEIGHBOURS, POWER, BLOCK = 15, 4, 256
THRESHOLD = 0.7
#: Entries of so many characters at most that a worker remembers of words it has met.
REMEMBERED, REMEMBERED_CHARS = 150_000, 64
#: Cosines that differ by less are equal: blocks of products round in their own ways.
SAME = 1e-9
#: Kinds of terms, in a key's last two bits.
IS_WORD, IS_SHAPE, IS_AGAIN = 0, 1, 2
#: Entries of the sample's matrix that are multiplied at once.
ENTRIES = 20_000


def held_out(doc_id: F.Column) -> F.Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def shape(word: str) -> str:
    """Upper- and lower-case letters and digits by a character each, runs by one: 'Word,' is 'Aa,'."""
    out = []
    for ch in word:
        x = "A" if ch.isupper() else "a" if ch.isalpha() else "0" if ch.isdigit() else ch
        if not out or out[-1] != x:
            out.append(x)
    return "".join(out)


def term_key(kind: int, text: str) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass")) >> 3 << 2 | kind


def term_counts(text: str | None) -> tuple[int, Counter]:
    """(words, counts of terms by key)."""
    words = (text or "").split()
    out: Counter = Counter()
    for w, n in Counter(words).items():
        out[term_key(IS_WORD, w.lower())] += n
        out[term_key(IS_SHAPE, shape(w))] += n
    if again := sum(map(eq, words, islice(words, 1, None))):
        out[term_key(IS_AGAIN, "")] = again
    return len(words), out


class Space:
    """Terms with weights, the projection to latent dimensions, and the labelled vectors, from what solve() gives."""

    def __init__(self, keys: bytes, weight: bytes, basis: bytes, vectors: bytes, labels: bytes, prior: float):
        import numpy as np

        read = lambda x, kind="<f4": np.frombuffer(x, kind).astype("f8" if kind == "<f4" else "i8")
        self.labels, self.weight, self.prior = read(labels), read(weight), prior
        self.index = {k: i for i, k in enumerate(read(keys, "<i8").tolist())}
        self.basis = read(basis).reshape(len(self.index), -1) if self.index else np.zeros((0, 1))
        self.vectors = read(vectors).reshape(len(self.labels), -1) if len(self.labels) else np.zeros((0, 1))
        self.again = self.index.get(term_key(IS_AGAIN, ""), -1)
        self.known: dict[str, tuple[int, int]] = {}

    def find(self, word: str) -> tuple[int, int]:
        """The numbers of a word's terms, -1 for one that isn't kept."""
        pair = (self.index.get(term_key(IS_WORD, word.lower()), -1), self.index.get(term_key(IS_SHAPE, shape(word)), -1))
        if len(word) <= REMEMBERED_CHARS:
            if len(self.known) >= REMEMBERED:
                self.known.clear()
            self.known[word] = pair
        return pair

    def row(self, text: str | None) -> tuple[int, dict[int, int]]:
        """term_counts() by the numbers of the terms kept."""
        words = (text or "").split()
        known, out = self.known, {}
        for w, n in Counter(words).items():
            for i in known.get(w) or self.find(w):
                if i >= 0:
                    out[i] = out.get(i, 0) + n
        if self.again >= 0 and (again := sum(map(eq, words, islice(words, 1, None)))):
            out[self.again] = again
        return len(words), out

    def project(self, texts):
        import numpy as np

        out = np.zeros((len(texts), self.basis.shape[1]))
        for i, t in enumerate(texts):
            n_words, counts = self.row(t)
            if counts:
                ids, n = np.fromiter(counts, "i8", len(counts)), np.fromiter(counts.values(), "f8", len(counts))
                out[i] = (np.sqrt(n / n_words) * self.weight[ids]) @ self.basis[ids]
        norm = np.linalg.norm(out, axis=1, keepdims=True)
        return np.divide(out, norm, out=np.zeros_like(out), where=norm > 1e-12)

    def score(self, texts):
        import numpy as np

        out = np.full(len(texts), self.prior)
        k = min(NEIGHBOURS, len(self.labels))
        for a in range(0, len(texts) if k else 0, BLOCK):
            cos = self.project(texts[a : a + BLOCK]) @ self.vectors.T
            last = np.partition(cos, cos.shape[1] - k, axis=1)[:, cos.shape[1] - k]
            doc, near = np.nonzero(cos >= last[:, None] - SAME)
            w = np.maximum(cos[doc, near], 0) ** POWER
            total, vote = np.bincount(doc, w, len(cos)), np.bincount(doc, w * self.labels[near], len(cos))
            some = total > 1e-9
            out[a : a + BLOCK][some] = vote[some] / total[some]
        return np.round(np.clip(out, 0.0, 1.0), 12)


def times(starts, ids, values, m):
    """The sparse matrix of rows starts[i]:starts[i + 1] of (ids, values), times m."""
    import numpy as np

    out, row = np.zeros((len(starts) - 1, m.shape[1])), 0
    while row < len(out):
        end = max(row + 1, int(np.searchsorted(starts, starts[row] + ENTRIES, "right")) - 1)
        part = m[ids[starts[row] : starts[end]]] * values[starts[row] : starts[end], None]
        some = row + np.flatnonzero(np.diff(starts[row : end + 1]))
        if len(some):
            out[some] = np.add.reduceat(part, starts[some] - starts[row])
        row = end
    return out


def solve(rows: list[tuple]) -> tuple:
    """rows: (label, words of the text, keys, counts and document frequencies of its terms). What Space() takes."""
    import numpy as np

    labels = np.array([r[0] for r in rows], "f8")
    prior = float(labels.mean()) if len(rows) else 0.5
    every = np.concatenate([np.zeros(0, "i8"), *[r[2] for r in rows]])
    keys, first, ids = np.unique(every, return_index=True, return_inverse=True)
    pack = lambda x, kind="<f4": np.ascontiguousarray(x, kind).tobytes()
    if not len(keys):
        return (b"", b"", b"", pack(np.zeros(len(rows))), pack(labels), prior)
    df = np.concatenate([r[4] for r in rows])[first]
    # Shapes say more of quality than words do, and there are few of them.
    weight = (np.log((1 + len(rows)) / df) * np.where(keys & 3 == IS_WORD, 1.0, 3.0)).astype("f4").astype("f8")
    starts = np.concatenate([[0], np.cumsum([len(r[2]) for r in rows])])
    values = np.sqrt(np.concatenate([r[3] / max(1, r[1]) for r in rows])) * weight[ids]
    by_term = np.argsort(ids, kind="stable")
    doc = np.repeat(np.arange(len(rows)), np.diff(starts))[by_term]
    term_starts = np.searchsorted(ids[by_term], np.arange(len(keys) + 1))
    of_docs = lambda m: times(starts, ids, values, m)
    of_terms = lambda m: times(term_starts, doc, values[by_term], m)

    # Randomised subspace iteration; the seed is fixed, so reruns agree.
    rank = min(RANK, len(keys), len(rows))
    q = np.linalg.qr(np.random.default_rng(7).standard_normal((len(keys), min(rank + 16, len(keys)))))[0]
    for _ in range(3):
        q = np.linalg.qr(of_terms(of_docs(q)))[0]
    basis = (q @ np.linalg.svd(of_docs(q), full_matrices=False)[2].T)[:, :rank].astype("f4").astype("f8")
    vectors = of_docs(basis)
    norm = np.linalg.norm(vectors, axis=1, keepdims=True)
    vectors = np.divide(vectors, norm, out=np.zeros_like(vectors), where=norm > 1e-12)
    return (pack(keys, "<i8"), pack(weight), pack(basis), pack(vectors), pack(labels), prior)


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> tuple:
    """What Space() takes, from the labelled rows that may be learned from."""
    usable = labels.filter(F.col("doc_id").isNotNull() & F.col("quality").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("quality").alias("_label"))
    # A top-k by hash: at most `sample` ids, whatever the number of labels.
    chosen = usable.orderBy(F.md5(F.col("doc_id").cast("string")), "doc_id").limit(sample)
    found = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "_label").agg(F.min("text").alias("text"))

    def count(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            said = [term_counts(x.as_py()) for x in batch.column(2)]
            cols = [pa.array([n for n, _ in said], pa.int64()), pa.array([list(c) for _, c in said], pa.list_(pa.int64())), pa.array([list(c.values()) for _, c in said], pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1).cast(pa.float64()), *cols], ["doc_id", "label", "n_words", "keys", "counts"])

    kind = found.schema["doc_id"].dataType.simpleString()
    said = materialize(found.mapInArrow(count, f"doc_id {kind}, label double, n_words long, keys array<long>, counts array<long>"), "fit-terms")
    each = said.select("doc_id", F.explode(F.arrays_zip("keys", "counts")).alias("t")).select("doc_id", F.col("t.keys").alias("key"), F.col("t.counts").alias("n"))
    terms = each.groupBy("key").agg(F.count("*").alias("df")).filter("df >= 2").orderBy(F.desc("df"), "key").limit(TERMS)
    kept = each.join(F.broadcast(terms), "key").groupBy("doc_id").agg(F.collect_list(F.struct("key", "n", "df")).alias("t"))
    rows = said.select("doc_id", "label", "n_words").join(kept, "doc_id", "left")

    def decompose(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        got = []
        for batch in batches:
            for label, n_words, t in zip(*[batch.column(k) for k in (1, 2, 3)], strict=True):
                parts = [t.values.field(k).to_numpy() for k in range(3)] if t.is_valid else [np.zeros(0, "i8")] * 3
                order = np.argsort(parts[0])
                got.append((label.as_py(), n_words.as_py(), *[x[order] for x in parts]))
        yield pa.RecordBatch.from_arrays([pa.array([x]) for x in solve(got)], ["keys", "weight", "basis", "vectors", "labels", "prior"])

    # Of at most `sample` rows; lost executors are no loss, the terms are in a table.
    model = rows.repartition(1).sortWithinPartitions("doc_id").mapInArrow(decompose, "keys binary, weight binary, basis binary, vectors binary, labels binary, prior double").collect()
    return tuple(bytes(x) if isinstance(x, bytearray) else x for x in model[0]) if model else solve([])


def classify(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, learn_from: DataFrame | None = None) -> DataFrame:
    """doc (a struct of the input's columns, whatever their names) and score (0 to 1).

    learn_from: documents that the labels speak of, if not docs."""
    spark = docs.sparkSession
    model = spark.sparkContext.broadcast(learn(docs if learn_from is None else learn_from, labels, sample))

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        space = Space(*model.value)
        for batch in batches:
            doc = batch.column(0)
            yield pa.RecordBatch.from_arrays([doc, pa.array(space.score(doc.field("text").to_pylist()), pa.float64())], ["doc", "score"])

    rows = docs.select(F.struct(*docs.columns).alias("doc"))
    return rows.mapInArrow(run, rows.withColumn("score", F.lit(0.0)).schema)


def op7_quality_classifier(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = classify(docs, table(spark, sf_dir, "labels"))
    return out.select("doc.doc_id", held_out(F.col("doc.doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))

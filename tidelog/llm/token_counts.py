"""Token totals by source, language and tokenizer version, kept up by signed deltas.

A batch holds inserts, deletes and revisions of documents; each becomes a signed row (a revision two: the
old counts leave the old key, the new ones enter the new key), the rows of a batch are summed by key, and the
sums are written as the batch's own folder of the ledger. Totals are the sum over the folders that count:
additive, so batches may come in any order.

A folder counts from the moment its commit file exists, which is written last, in one piece, and names the
folders that this one stands for: none for a batch, all it folds for a base that compact() writes. So a
commit or a compaction that is repeated, or repeated after a crash half-way, changes nothing, and no reader
counts a base together with what it folds.

Defined cases: a null or empty text has no tokens and counts as a document; a very long text is tokenized
whole, one text at a time; null sources and languages are keys of their own; equal keys (ties) are summed;
repeated rows count each; an empty table or batch commits nothing but its id, and totals of an empty ledger
are no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import new_path, table
from .secrets import VOCABULARY, encoding

KEYS = ["source", "lang", "tokenizer"]
SUMS = ["n_docs", "n_chars", "n_tokens"]
SCHEMA = "source string, lang string, tokenizer string, n_docs long, n_chars long, n_tokens long"
#: The file that makes a folder count; readers of Parquet skip its name.
COMMIT = "_COMMIT.json"
ESTIMATE = "bytes/4"


def version(vocabulary: str) -> str:
    """The vocabulary's name and a digest of its file: other merges are another version."""
    with open(vocabulary, "rb") as f:
        return f"{vocabulary.rsplit('/', 1)[-1].split('.')[0]}@{hashlib.file_digest(f, 'sha256').hexdigest()[:12]}"


def count_tokens(docs: DataFrame, vocabulary: str = VOCABULARY, keep: tuple[str, ...] = ()) -> DataFrame:
    """docs' doc_id, source, lang, with tokenizer, n_chars and n_tokens of the whole text, and the columns `keep` of docs."""
    tag = version(vocabulary)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        enc = encoding(vocabulary)
        for batch in batches:
            chars, tokens = [], []
            for x in batch.column(0):
                text = x.as_py() or ""
                chars.append(len(text))
                tokens.append(len(enc.encode_ordinary(text)))
            kept = [batch.column(k) for k in range(1, batch.num_columns)]
            yield pa.RecordBatch.from_arrays([*kept[:3], pa.array([tag] * len(chars), pa.string()), pa.array(chars, pa.int64()), pa.array(tokens, pa.int64()), *kept[3:]], names)

    names = ["doc_id", "source", "lang", "tokenizer", "n_chars", "n_tokens", *keep]
    rows = docs.select("text", "doc_id", F.col("source").cast("string"), F.col("lang").cast("string"), *keep)
    kinds = {"tokenizer": "string", "n_chars": "long", "n_tokens": "long"}
    return rows.mapInArrow(run, ", ".join(f"`{c}` {kinds.get(c) or rows.schema[c].dataType.simpleString()}" for c in names))


def estimate(docs: DataFrame) -> DataFrame:
    """What count_tokens() returns, but a quarter of the bytes as tokens, under a tokenizer of that name: no tokenizer runs."""
    text = F.coalesce(F.col("text"), F.lit(""))
    tokens = F.ceil(F.octet_length(text) / 4).cast("long")
    return docs.select("doc_id", F.col("source").cast("string"), F.col("lang").cast("string"), F.lit(ESTIMATE).alias("tokenizer"), F.char_length(text).cast("long").alias("n_chars"), tokens.alias("n_tokens"))


class TokenLedger:
    """Committed batches and bases in a folder that all executors share."""

    def __init__(self, spark: SparkSession, root: str | None = None):
        self.spark, self.root = spark, root or new_path(spark, "token-ledger")

    def _path(self, *parts: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path("/".join([self.root, *parts]))
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _folded(self, name: str) -> list[str] | None:
        """The folders that this one stands for; None if it isn't committed."""
        path, fs = self._path(name, COMMIT)
        if not fs.exists(path):
            return None
        data = fs.open(path)
        try:
            return json.loads(bytes(data.readAllBytes()).decode())
        except ValueError:  # cut off by a crash: the file system shows what was written so far
            return None
        finally:
            data.close()

    def _state(self) -> tuple[list[str], set[str]]:
        """(folders that count, all folders ever committed)."""
        path, fs = self._path()
        names = sorted(str(s.getPath().getName()) for s in fs.listStatus(path)) if fs.exists(path) else []
        done = {n: f for n in names if (f := self._folded(n)) is not None}
        gone = {x for f in done.values() for x in f}
        return [n for n in done if n not in gone], gone | set(done)

    def committed(self, batch_id: str) -> bool:
        return f"batch={batch_id}" in self._state()[1]

    def _write(self, rows: DataFrame, name: str, folded: list[str]) -> None:
        # What a crash left is overwritten; the commit file comes last.
        self._sum(rows).write.mode("overwrite").parquet(f"{self.root}/{name}")
        path, fs = self._path(name, COMMIT)
        out = fs.create(path, True)
        out.write(bytearray(json.dumps(folded).encode()))
        out.close()

    def commit(self, batch_id: str, inserts: DataFrame | None = None, deletes: DataFrame | None = None, revisions: DataFrame | None = None) -> bool:
        """inserts and deletes: rows of count_tokens(); revisions: the same with old_chars and old_tokens, and with
        old_source, old_lang and old_tokenizer where a revision may change these (each without: as the new one).
        Returns False, with nothing done, if the batch is committed already."""
        if self.committed(batch_id):
            return False
        rows = []
        for df, sign in ((inserts, 1), (deletes, -1)):
            if df is not None:
                rows.append(df.select(*KEYS, F.lit(sign).cast("long").alias("n_docs"), (F.col("n_chars") * sign).alias("n_chars"), (F.col("n_tokens") * sign).alias("n_tokens")))
        if revisions is not None:
            # Two rows of one, so that what counted the tokens runs once.
            side = lambda cols: F.struct(*[c.alias(k) for c, k in zip(cols, (*KEYS, *SUMS), strict=True)])
            was = [F.col(f"old_{k}" if f"old_{k}" in revisions.columns else k) for k in KEYS]
            old = side([*was, F.lit(-1).cast("long"), -F.col("old_chars"), -F.col("old_tokens")])
            new = side([*[F.col(k) for k in KEYS], F.lit(1).cast("long"), F.col("n_chars"), F.col("n_tokens")])
            rows.append(revisions.select(F.explode(F.array(old, new)).alias("x")).select("x.*"))
        delta = rows[0]
        for r in rows[1:]:
            delta = delta.unionByName(r)
        self._write(delta, f"batch={batch_id}", [])
        return True

    @staticmethod
    def _sum(df: DataFrame) -> DataFrame:
        return df.groupBy(*KEYS).agg(*[F.sum(c).cast("long").alias(c) for c in SUMS])

    def _rows(self, names: list[str]) -> DataFrame:
        """The rows of some folders, in one scan."""
        if not names:
            return self.spark.createDataFrame([], SCHEMA)
        return self.spark.read.schema(SCHEMA).option("recursiveFileLookup", "true").parquet(*[f"{self.root}/{n}" for n in names])

    def totals(self) -> DataFrame:
        """source, lang, tokenizer, n_docs, n_chars, n_tokens; keys whose documents are all gone are left out."""
        return self._sum(self._rows(self._state()[0])).filter("n_docs <> 0 or n_chars <> 0 or n_tokens <> 0")

    def compact(self, new_id: str) -> bool:
        """All that counts so far becomes one base, under a new id; the ids of batches stay known. Returns False,
        with nothing done, if a base of this id is committed already."""
        name = f"base={new_id}"
        live, known = self._state()
        if name in known or not live:
            return False
        folded = {x for n in live for x in (n, *(self._folded(n) or ()))}
        self._write(self._rows(live), name, sorted(folded))
        return True


def op2_token_counts(spark, sf_dir: str) -> DataFrame:
    """Documents are booked when they land, by an estimate; a second batch revises all of them to the tokenizer's
    counts, which moves them to its key, and deletes those without text; then the batches are folded."""
    docs = table(spark, sf_dir, "documents")
    ledger = TokenLedger(spark)
    ledger.commit("load", inserts=estimate(docs))
    text = F.coalesce(F.col("text"), F.lit(""))
    old = {"old_tokenizer": F.lit(ESTIMATE), "old_chars": F.char_length(text).cast("long"), "old_tokens": F.ceil(F.octet_length(text) / 4).cast("long")}
    none = docs.filter(F.coalesce(F.octet_length("text"), F.lit(0)) == 0).withColumns({"tokenizer": F.lit(version(VOCABULARY)), "n_chars": F.lit(0).cast("long"), "n_tokens": F.lit(0).cast("long")})
    revised = count_tokens(docs.select("doc_id", "text", "source", "lang").withColumns(old), keep=tuple(old))
    ledger.commit("recount", revisions=revised, deletes=none.select("doc_id", F.col("source").cast("string"), F.col("lang").cast("string"), "tokenizer", "n_chars", "n_tokens"))
    ledger.compact("all")
    return ledger.totals()

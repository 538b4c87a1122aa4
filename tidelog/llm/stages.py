"""The stages of corpus_pipeline.py: (name, function of (spark, docs, sf_dir)).

Each takes what its predecessor kept and, but for the last, returns the columns it got, whatever their names.

Defined cases: rows without a doc_id can't be named by the near-duplicate and decontamination stages and stay;
null and empty texts are scored as the classifier does, and stay where it keeps them; a text that line dedup
leaves empty goes, one that was empty stays; very long texts are worked on whole; of documents that link, the
smallest doc_id stays (ties can't be, but for rows of equal doc_id, of which one stays if their texts are
equal); an empty table passes every stage as one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, maybe_broadcast, table
from .decontaminate import contaminated
from .jaccard_join import jaccard_components
from .lines import dedup_lines
from .mixing import mix
from .quality_knn import THRESHOLD, classify

#: Ids that go are broadcast up to so many.
MAX_IDS = 500_000


def without(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """docs but for those of the given doc_id."""
    gone = maybe_broadcast(materialize(ids.filter("doc_id is not null").select(F.col("doc_id").alias("_gone")).distinct(), "gone"), MAX_IDS)
    return docs.join(gone, docs["doc_id"] == gone["_gone"], "left_anti")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    return classify(docs, table(spark, sf_dir, "labels")).filter(F.col("score") >= THRESHOLD).select("doc.*")


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Common lines go, n_chars follows; a document that loses all its text this way goes too."""
    out = dedup_lines(docs).filter((F.col("n_dropped") == 0) | (F.col("kept_text") != ""))
    same = F.col("n_dropped") == 0
    new = {"text": F.col("kept_text"), "n_chars": F.char_length("kept_text")}
    return out.select(*[F.when(same, F.col("doc")[c]).otherwise(new[c].cast(docs.schema[c].dataType)).alias(c) if c in new else F.col("doc")[c].alias(c) for c in docs.columns])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component the document with the smallest doc_id stays; of equal rows, one."""
    comp = materialize(jaccard_components(docs), "components")
    twice = comp.groupBy("doc_id").count().filter("count > 1 and doc_id is not null").select("doc_id")
    if twice.isEmpty():
        return without(docs, comp.filter("doc_id <> component_id"))
    twice = materialize(twice, "twice")
    rest = without(docs, comp.filter("doc_id <> component_id"))
    same = rest.join(twice, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"])
    return without(rest, twice).unionByName(same.select(*rest.columns))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return without(docs, contaminated(docs, table(spark, sf_dir, "benchmark")).select("doc_id"))


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """How many words the mix takes of each document that is left."""
    return mix(docs)[0].select("doc_id", "source", "size", "source_size", "target", "taken", "first_slot", "last_slot")


STAGES = [
    ("quality classifier", quality),
    ("line dedup", line_dedup),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("mixing sources", mix_stage),
]

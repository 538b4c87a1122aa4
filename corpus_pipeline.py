"""Documents to a training mix, in stages; each is written as Parquet and read again by the next one.

Defined cases: an empty table passes every stage; null and empty texts, null ids, repeated rows, ties and very
long texts are as each stage defines them (tidelog.llm.stages); other columns of documents are carried along to
the last stage, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidelog.llm.common import materialize
from tidelog.llm.stages import STAGES

#: SQL can't express the classifier, so tests hold the pipeline against a brute-force version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialize(docs, name.replace(" ", "-"))
    return docs

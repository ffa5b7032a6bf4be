"""Corpus pipeline: five stages over documents, each written as Parquet and reread by the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tokenloom.llm import decontam, mixing, neardup, quality, secrets
from tokenloom.llm.common import stored, table

#: (name, function of (spark, docs, sf_dir)); all but the last return the columns of documents.
STAGES = [
    ("quality_classifier", quality.keep_good),
    ("near_duplicates", neardup.one_of_each),
    ("decontamination", decontam.clean),
    ("secret_redaction", secrets.redact),
    ("target_mixing", mixing.weigh),
]

#: Learnt weights, sampled paths and fitted rates have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn, from the table documents to the weighted corpus."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs

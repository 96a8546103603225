"""The corpus pipeline: filter by quality, drop near-duplicates and benchmark leaks, redact secrets, mix sources.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame of all it keeps; all but the last return the columns of docs. Tables other than
documents are read from sf_dir. Null texts are empty documents: quality scores them like others, and they are one near-duplicate
group. Rows are never cut by number; an empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quiverlake.llm import decontam, mixing, quality, secrets, simhash
from quiverlake.llm.common import materialize, read_table, release


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects (score under 0.5) go. It learns from the given documents' training labels."""
    model = quality.train(docs, read_table(spark, sf_dir, "labels"))
    return quality.keep_good(docs, model)


def neardup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document with the smallest id stays."""
    return simhash.keep_one(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a benchmark window go."""
    return decontam.remove(docs, read_table(spark, sf_dir, "benchmark"), mode="documents")


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by [SECRET]; n_chars follows; all documents stay."""
    length = "n_chars" if "n_chars" in docs.columns else None
    return secrets.redact(docs, mark="[SECRET]", length_col=length)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the mix takes, with how often (copies) and how many words that makes (taken)."""
    return mixing.apply_mix(docs)


STAGES = [
    ("quality classifier", quality_stage),
    ("SimHash near-dedup", neardup_stage),
    ("benchmark decontamination", decontamination_stage),
    ("secret scans", secrets_stage),
    ("mixing sources", mixing_stage),
]

ORACLE_SQL = None  # boosted trees and XXH64 are beyond SQL; tests hold run() against a brute-force version


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole table documents; between stages rows are written to the checkpoint folder and reread. What a stage
    read is deleted when the next one's input is written."""
    docs, before = read_table(spark, sf_dir, "documents"), None
    for number, (_, stage) in enumerate(STAGES):
        if number:
            docs = materialize(docs)
            release(before)
            before = docs
        docs = stage(spark, docs, sf_dir)
    return docs

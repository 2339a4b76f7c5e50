"""From raw documents to packed training sequences.

Each stage takes (spark, docs, sf_dir), works on all rows that the stage before kept, and returns a DataFrame that is
written as Parquet and read again before the next stage. All stages but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sieveline.llm import neardup, packing, pii, quality
from sieveline.llm.common import table, written


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts; it is fitted on these documents and on the labels that may be learned from."""
    return quality.accepted(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, which are linked from a similarity of 0.8 on."""
    return neardup.deduplicated(docs, percent=80)


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents; what was found in a text is replaced by its kind, and n_chars follows."""
    return pii.redact(docs).withColumn("n_chars", F.coalesce(F.char_length("text"), F.lit(0)).cast(docs.schema["n_chars"].dataType))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents as pieces of sequences of at most 4096 tokens."""
    return packing.pack_documents(docs)


STAGES = [
    ("quality", good_quality),
    ("near duplicates", without_near_duplicates),
    ("personal data", without_personal_data),
    ("packing", packed),
]

#: SQL cannot express the classifier and the tokenizer; the stages are tested against brute-force versions instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, name.replace(" ", "-"))
    return docs

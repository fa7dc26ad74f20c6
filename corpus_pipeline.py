"""Raw documents to packed training sequences: quality, near duplicates, personal data, source mix, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the next
one's docs. All stages but the last return the columns of documents. Null ids, texts and sources pass through as each
operator defines; a document that is mixed in more than once is packed as often.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from rimlight.llm import jaccard, mixing, pii, quality
from rimlight.llm.common import stage
from rimlight.llm.queries import pack_documents


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules' weighed votes reject go."""
    return quality.keep(docs)


def ngram_jaccard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the row with the smallest id stays, or one without an id if none has one."""
    return jaccard.deduplicate(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data becomes the name of its kind."""
    return pii.redact(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are repeated, or left out, to their source's target."""
    return mixing.repeat(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences of fixed length."""
    return pack_documents(docs)


STAGES = [("quality_rules", quality_rules), ("ngram_jaccard", ngram_jaccard), ("personal_data", personal_data), ("source_mix", source_mix), ("packing", packed)]

#: Voting by expectation-maximisation, shingle components and token ids are beyond SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over the documents of sf_dir."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, f in STAGES:
        docs = stage(f(spark, docs, sf_dir), name)
    return docs

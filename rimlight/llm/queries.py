"""The queries of the operators, over whole tables with production parameters, and their SQL forms."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rimlight.llm import ann, jaccard, langid, mixing, packing, pii, quality, toxicity, warc, wrappers

GPT_SPECIALS = (("<|endoftext|>", 50256),)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_warc_salvage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(_table(spark, sf_dir, "pages"))


def op2_output_codes_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(_table(spark, sf_dir, "documents"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(_table(spark, sf_dir, "documents"))


def pack_documents(docs: DataFrame) -> DataFrame:
    """Packing by the public byte-level vocabulary; its folder is found where the package of vocabularies lies."""
    import public_tokenizers

    file, ranks = (str(public_tokenizers.path(f"byte_bpe_50k.{x}")) for x in ("json", "tiktoken"))
    return packing.digest(packing.pack(docs, file, ranks, public_tokenizers.PATTERN, GPT_SPECIALS))


def op4_harmonic_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(_table(spark, sf_dir, "documents"))


def op5_prefix_tree_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join(_table(spark, sf_dir, "documents"))


def op6_noisy_or_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.detect(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op7_contextual_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(_table(spark, sf_dir, "documents"))


def op8_wrapper_induction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wrappers.extract(_table(spark, sf_dir, "pages"))


def op9_block_matrix_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(_table(spark, sf_dir, "embeddings"), F.col("id") % 20 == 0)


def op10_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_warc_salvage, op2_output_codes_language, op3_quality_rules, op4_harmonic_packing, op5_prefix_tree_join, op6_noisy_or_toxicity, op7_contextual_pii, op8_wrapper_induction, op9_block_matrix_neighbours, op10_mix_sources)}
ORACLES = {"op1_warc_salvage": warc.ORACLE, "op9_block_matrix_neighbours": ann.ORACLE, "op10_mix_sources": mixing.ORACLE}

"""The operators bound to the corpus tables, one query each."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .language import identify
from .licenses import license_scan
from .lm import lm_scores
from .mixing import mix, taken
from .packing import pack
from .quality import quality
from .simhash import simhash_groups
from .spelling import spelling_variants
from .suffix_dedup import suffix_dedup
from .token_counts import token_counts
from .topk import top_k
from .vector_dedup import vector_groups
from .whitening import whiten


def tokenizer_file(name: str) -> str:
    """Where a public tokenizer file lies (the operators take any path)."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint (4-word shingles) and group (4 bits) of every document."""
    return simhash_groups(table(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id")


def op2_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mix takes of every document."""
    mixed = taken(*mix(table(spark, sf_dir, "documents")))
    return mixed.select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken")


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of every document and their place in sequences of 2048 tokens or less."""
    return pack(table(spark, sf_dir, "documents"), tokenizer_file("word_bpe_49k.json"))


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base phrases and rule labels of every document."""
    return license_scan(table(spark, sf_dir, "documents"))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Byte-level BPE token count of every document, limit 512."""
    return token_counts(table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json"))


def op6_quality_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Importance and resampling decision of every document."""
    return quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of all vectors within their labels (cosine 0.93)."""
    return vector_groups(table(spark, sf_dir, "embeddings"))


def op8_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten highest integer inner products of every 100th vector."""
    return top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op9_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unigram base and model log10 probability of every document."""
    return lm_scores(table(spark, sf_dir, "documents"))


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of every document inside 200-byte strings that occur elsewhere."""
    return suffix_dedup(table(spark, sf_dir, "documents"))


def op11_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 16 whitened components of every vector."""
    return whiten(table(spark, sf_dir, "embeddings"))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of all documents, their near words and roots."""
    return spelling_variants(table(spark, sf_dir, "documents"))


def op13_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learned from three quarters of them."""
    held_out = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) == 2
    return identify(table(spark, sf_dir, "documents"), held_out)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (
        op1_simhash_near_dedup, op2_source_mixing, op3_packing, op4_license_scan, op5_token_counts, op6_quality_resampling,
        op7_embedding_near_dedup, op8_exact_top_k, op9_lm_scores, op10_suffix_dedup, op11_embedding_whitening,
        op12_spelling_variants, op13_language_id)}

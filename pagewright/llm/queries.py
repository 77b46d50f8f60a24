"""Queries over the driver's tables that apply each operator of this subpackage, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from pagewright.llm import bpe, chat, decontam, langid, lines, pii, secrets, simhash, topk, toxicity
from pagewright.llm.common import table


def tokenizer() -> tuple[dict[bytes, int], str]:
    """Ranks and pattern of the tokenizer that the queries use."""
    import public_tokenizers

    return bpe.load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")), public_tokenizers.PATTERN


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of every document that repeat: doc_id, n_lines, n_exact, n_near, kept_sha256."""
    return lines.digests(lines.dedup_lines(table(spark, sf_dir, "documents")))


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encode and decode every document: doc_id, n_tokens, ids_sha256, decoded_sha256."""
    return bpe.encode(table(spark, sf_dir, "documents"), *tokenizer(), digests=True)


def op3_preferences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations 2 n and 2 n + 1 as pairs: pair_id, turns, hashes of prompt and completions, masks."""
    return chat.digests(chat.preferences(table(spark, sf_dir, "conversations")))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicates of every document: doc_id, fingerprint, component_id, n_class."""
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data of every document: doc_id, counts of the fixed forms, base_sha256, spans."""
    return pii.digests(pii.scan(table(spark, sf_dir, "documents")))


def op6_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 nearest codes of every row whose id is divisible by 50: query_id, rank, vec_id, distance."""
    vectors = table(spark, sf_dir, "embeddings")
    return topk.search(vectors, vectors.where("vec_id % 50 = 0"))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark words in every document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    found = decontam.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", decontam.digest(F.col("items")).alias("items_sha256"), decontam.is_contaminated().alias("contaminated"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document: doc_id, held_out, lang_pred, score."""
    return langid.identify(table(spark, sf_dir, "documents"))


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document: doc_id, counts of the fixed forms, base_sha256, spans."""
    return secrets.digests(secrets.scan(table(spark, sf_dir, "documents")))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document: doc_id, held_out, score, predicted."""
    return toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages of the corpus pipeline over ``documents``."""
    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_line_dedup": op1_line_dedup,
    "op2_byte_bpe": op2_byte_bpe,
    "op3_preferences": op3_preferences,
    "op4_simhash": op4_simhash,
    "op5_pii": op5_pii,
    "op6_topk": op6_topk,
    "op7_decontamination": op7_decontamination,
    "op8_language_id": op8_language_id,
    "op9_secrets": op9_secrets,
    "op10_toxicity": op10_toxicity,
    "pipeline": pipeline,
}

SQL: dict[str, str] = {"op1_line_dedup": lines.ORACLE_SQL, "op3_preferences": chat.ORACLE_SQL, "op6_topk": topk.ORACLE_SQL, "op7_decontamination": decontam.ORACLE_SQL}

"""A corpus pipeline: language ID, line dedup, near-duplicates, benchmark decontamination, byte-level BPE.

Each stage takes (spark, docs, sf_dir), works on all documents that the one before kept, and returns a DataFrame; all but
the last return the columns of ``documents``. Between stages a table is written and read again, so each stage lets go of
what the one before had broadcast.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.llm import bpe, decontam, langid, lines, simhash
from pagewright.llm.common import Scratch, release, sweep, table

#: Edits within which line dedup takes a line for a repeat of an earlier one.
LINE_EDITS = 2
#: Characters of a line for each edit: shorter lines have fewer edits to spend, and below this only exact repeats go.
LINE_CHARS = 4
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def as_documents(df: DataFrame) -> DataFrame:
    """The columns of ``documents``, with ``n_chars`` counted anew."""
    return df.select("doc_id", "text", "lang", "source", F.length("text").cast("bigint").alias("n_chars"))


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the documents whose language the classifier accepts, with the predicted language as ``lang``."""
    release()
    rows = docs.select(F.struct(*COLUMNS).alias("doc_id"), "text")
    found = langid.identify(rows, train_on=table(spark, sf_dir, "documents")).where("accepted")
    return found.select(*[F.col("lang_pred").alias(c) if c == "lang" else F.col(f"doc_id.{c}").alias(c) for c in COLUMNS])


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Remove lines that repeat or are within two edits of an earlier line, one for every four characters; every document stays."""
    release()
    return as_documents(lines.dedup_lines(docs, edits=LINE_EDITS, per=LINE_CHARS))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays: the one with the smallest id."""
    release()
    return simhash.keep_first(docs).select(*COLUMNS)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents of which benchmark words are 5 % or more, and cut such words from the others."""
    release()
    return as_documents(decontam.remove(docs, table(spark, sf_dir, "benchmark")))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Encode and decode: doc_id, n_tokens, ids_sha256, decoded_sha256."""
    from pagewright.llm.queries import tokenizer

    release()
    return bpe.encode(docs, *tokenizer(), digests=True)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language),
    ("line_dedup", line_dedup),
    ("simhash", near_duplicates),
    ("decontamination", decontamination),
    ("byte_bpe", tokens),
]

#: The merges of byte-level BPE, the kernel and SimHash have no SQL; tests hold the stages against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet in the shared folder and read again."""
    scratch, others = Scratch(spark, "pipeline"), [*Scratch.left.values()]  # what others wrote may still be read
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = scratch.keep(stage(spark, docs, sf_dir))
        scratch.drop(last=1)
        sweep(scratch, *others)
    return STAGES[-1][1](spark, docs, sf_dir)

"""The corpus pipeline: five stages over ``documents``, each written as Parquet and read again by the next.

quality: documents that resampling by importance leaves out go (by the labels of the test tables that is nearly all low-quality rows and 69 to 85 % of
the toxic ones; a toxic word or two in a long clean text may stay). near_duplicates: one document of each group stays. decontamination:
documents that hold a passage of the benchmark go. secrets: spans are replaced by a mark. tokens: each document's byte-level
BPE ids and what they decode to.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.llm import bpe, decontaminate, quality, secrets, simhash
from cairn.llm.shared import saved, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: SQL for the rows of run(): the stages use hashes, trees and a tokenizer that SQL doesn't have.
ORACLE_SQL = None


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that resampling by importance keeps. Null, empty and token-free texts go; repeated rows go or stay together; an empty
    table gives an empty one; columns beyond those of documents are dropped."""
    return quality.filtered(docs, table(spark, sf_dir, "labels")).select(*COLUMNS)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates, that with the smallest id. Null, empty and word-free texts are one group; of
    repeated rows one stays; an empty table gives an empty one."""
    return simhash.deduplicated(docs).select(*COLUMNS)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows without a passage of the benchmark. Null and empty texts hold none and stay; an empty benchmark drops nothing; repeated
    rows are each judged alike."""
    found = decontaminate.contaminated(docs, table(spark, sf_dir, "benchmark"), keep=tuple(COLUMNS[1:]))
    return found.where("n_items = 0").select(*COLUMNS)


def secret_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, with secrets replaced by a mark and n_chars counted anew where there was one. Null and empty texts stay as they are."""
    found = secrets.scanned(docs, keep=("lang", "source", "n_chars"))
    chars = F.when(F.col("spans") == "", F.col("n_chars")).otherwise(F.length("redacted").cast("long"))
    return found.select("doc_id", F.col("redacted").alias("text"), "lang", "source", chars.alias("n_chars"))


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids and digests of all rows; null and empty texts have no ids and the digests of nothing."""
    return bpe.encoded(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, digest=True)


STAGES = [
    ("quality", quality_stage),
    ("near_duplicates", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("secrets", secret_stage),
    ("tokens", token_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)

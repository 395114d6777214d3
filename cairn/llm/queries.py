"""The registered queries over the text operators: thin calls with production parameters on whole tables."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.llm import bpe, chat, decontaminate, language, licenses, neighbours, packing, quality, resampling, secrets, simhash, trie, warc
from cairn.llm.shared import table


def op1_quality_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's importance weight, sampling key and whether it is kept; see ``quality.resampled``."""
    return quality.resampled(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's language, learned from the rows that aren't held out; see ``language.identified``."""
    docs = table(spark, sf_dir, "documents").withColumn("held_out", F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False)))
    model = language.fitted(docs.where("not held_out"))
    return language.identified(docs, model, keep=("doc_id", "held_out"))


def op3_chat_perspectives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every turn in the rendering of every participant's perspective; see ``chat.rotated``."""
    return chat.rotated(table(spark, sf_dir, "conversations"))


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence statements of every document; see ``licenses.scanned``."""
    return licenses.scanned(table(spark, sf_dir, "documents"))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items found in every document (an item of over 250 shingles by any of its parts of that size); see ``decontaminate.contaminated``."""
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_simhash_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's fingerprint and the group that close fingerprints make; see ``simhash.grouped``."""
    return simhash.grouped(table(spark, sf_dir, "documents"))


def op7_cross_polytope(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest found of every 50th vector among all others; see ``neighbours.nearest``."""
    return neighbours.nearest(table(spark, sf_dir, "embeddings"), F.col("id") % 50 == 0)


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every document's ids and of what they decode to; see ``bpe.encoded``."""
    return bpe.encoded(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, digest=True)


def op9_warc_archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page as it is read back from archives written here; see ``warc.round_trip``."""
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document; see ``secrets.scanned``."""
    return secrets.scanned(table(spark, sf_dir, "documents")).drop("redacted")


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every distinct prefix of the rebuilt conversations; see ``trie.rebuilt`` and ``trie.prefix_trie``."""
    return trie.prefix_trie(trie.rebuilt(trie.numbered(table(spark, sf_dir, "conversations"))))


def op12_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's pieces and their places in sequences of 1,024 tokens; see ``packing.packed``."""
    return packing.packed(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN, digest=True)


def op13_target_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's weight and score towards the benchmark's words, and the ranks of those drawn; see ``resampling.resampled``."""
    return resampling.resampled(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def queries():
    found = (op1_quality_resampling, op2_language_id, op3_chat_perspectives, op4_license_scan, op5_decontamination, op6_simhash_groups, op7_cross_polytope, op8_byte_bpe, op9_warc_archives, op10_secret_scan, op11_prefix_trie, op12_best_fit_packing, op13_target_resampling)
    return {f.__name__: f for f in found}


def oracle_sql():
    return {"op3_chat_perspectives": chat.ROTATED_SQL, "op9_warc_archives": warc.ROUND_TRIP_SQL, "op11_prefix_trie": trie.TRIE_SQL, "op13_target_resampling": resampling.RESAMPLED_SQL}

"""Registered queries of this subpackage. Their DuckDB SQL, where there is any, is in ``oracles``.

Every query applies its operator with production parameters to its whole table
and returns the digest columns agreed for it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusprep.llm import best_fit_packing, chat_format, merkle_manifest, prefix_trie, source_mix
from corpusprep.llm.decontaminate import SLOP, contamination
from corpusprep.llm.language_id import identify_languages
from corpusprep.llm.license_scan import scan_licenses
from corpusprep.llm.quality_rules import apply_quality_rules
from corpusprep.llm.secret_scan import secret_digest
from corpusprep.llm.simhash_dedup import near_duplicate_groups
from corpusprep.llm.substring_dedup import remove_repeated_passages
from corpusprep.llm.suffix_array_dedup import remove_later_copies


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeated_passages(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", "kept_sha256")


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = apply_quality_rules(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_digest(_table(spark, sf_dir, "documents"))


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(_table(spark, sf_dir, "documents")).drop("found")


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), slop=SLOP)
    return out.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
        F.size("near_items").cast("bigint").alias("n_near"),
    )


def op6_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_format.format_conversations(_table(spark, sf_dir, "conversations"))


def op7_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_mix.mixed_sizes(_table(spark, sf_dir, "documents")).drop("copies")


def op8_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_later_copies(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op9_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicate_groups(_table(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id")


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify_languages(_table(spark, sf_dir, "documents"))


def op11_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers  # vocabulary files

    pieces = best_fit_packing.document_pieces(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return best_fit_packing.pack(pieces)


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.trie_digest(_table(spark, sf_dir, "conversations"))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle_manifest.audit(_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_substring_dedup": op1_substring_dedup,
    "op2_quality_rules": op2_quality_rules,
    "op3_secret_scan": op3_secret_scan,
    "op4_license_scan": op4_license_scan,
    "op5_decontamination": op5_decontamination,
    "op6_chat_format": op6_chat_format,
    "op7_source_mix": op7_source_mix,
    "op8_suffix_array_dedup": op8_suffix_array_dedup,
    "op9_simhash_dedup": op9_simhash_dedup,
    "op10_language_id": op10_language_id,
    "op11_best_fit_packing": op11_best_fit_packing,
    "op12_prefix_trie": op12_prefix_trie,
    "op13_merkle_manifest": op13_merkle_manifest,
}

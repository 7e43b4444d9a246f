"""Training-data pipeline over ``documents``: each stage's output is written as Parquet and read as the next one's input.

1. language_id: documents without a language go: those without text or without a letter, and those whose cosine with
   every language's prototype is far below what labelled documents reach;
2. near_dedup: one document of each SimHash near-duplicate group stays;
3. decontaminate: documents that hold a passage of the benchmark go;
4. secrets: secrets are masked in the text;
5. mix: documents are repeated or left out to bring sources to their target weights.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from corpusprep.llm import decontaminate, language_id, secret_scan, simhash_dedup, source_mix
from corpusprep.session import materialize, release, scratch

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def keep_identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return language_id.keep_identified(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash_dedup.keep_first(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secret_scan.mask_secrets(docs, length_col="n_chars" if "n_chars" in docs.columns else None)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return source_mix.mix(docs)


STAGES: list[tuple[str, Stage]] = [
    ("language_id", keep_identified),
    ("near_dedup", near_dedup),
    ("decontaminate", drop_contaminated),
    ("secrets", mask_secrets),
    ("mix", mix_sources),
]

#: Hyperdimensional vectors, fingerprints and components of a graph have no SQL form; the tests hold a plain version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        with scratch(spark) as tables:  # what a stage has written beside its result goes when it ends
            done, docs = docs, tables.keep(materialize(stage(spark, docs, sf_dir)))
        if done is not docs and hasattr(done, "_materialized"):
            release(done)
    return docs

"""Queries of this package, by the names that __spark_entry__.py registers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from loomset.llm.common import table


def op1_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loomset.llm import lm_score

    return lm_score.scored(table(spark, sf_dir, "documents"))


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loomset.llm import quality

    found = quality.classified(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return found.select("doc_id", "held_out", "score", "predicted")


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loomset.llm import paragraph_dedup

    return paragraph_dedup.repeats(table(spark, sf_dir, "documents"), least=1)


def op4_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loomset.llm import simhash

    return simhash.near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id")


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loomset.llm import pii

    return pii.report(pii.find(table(spark, sf_dir, "documents")))


def op6_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loomset.llm import mpeg

    return mpeg.report(mpeg.read(mpeg.store(table(spark, sf_dir, "documents"))))


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from loomset.llm import packing

    return packing.packed(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op8_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loomset.llm import decontam

    return decontam.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loomset.llm import warc

    return warc.derivatives(warc.responses(table(spark, sf_dir, "pages")))


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loomset.llm import secret_scan

    return secret_scan.report(secret_scan.scan(table(spark, sf_dir, "documents")))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: v for k, v in sorted(globals().items()) if k.startswith("op")}


def oracle_sql() -> dict[str, str]:
    """None of these methods (learned models, fingerprints, codecs, packing) can be put in SQL; tests/llm has brute-force twins."""
    return {}

"""The corpus pipeline: stages over documents, each written as Parquet and read again by the next."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from loomset.llm import common, decontam, packing, pii, quality, simhash

#: The score from which the quality classifier keeps a document.
KEEP_FROM = 0.7
#: The tokenizer's file, by name in the public tokenizers' folder.
TOKENIZER = "word_bpe_49k.json"


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored at KEEP_FROM or more by a classifier fitted on the labelled ones among them."""
    scored = quality.score(docs, quality.fit(docs, common.table(spark, sf_dir, "labels")))
    return scored.where(scored["quality_score"] >= KEEP_FROM).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest doc_id, of each group of near-duplicate fingerprints."""
    return simhash.drop_near_duplicates(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item stands, edits within the error budget included."""
    return decontam.drop_contaminated(docs, common.table(spark, sf_dir, "benchmark"))


def redact_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by its kind."""
    return pii.redact(pii.find(docs))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' token pieces and their places in sequences of at most 4096."""
    return packing.packed(docs, public_tokenizers.path(TOKENIZER))


STAGES = [
    ("quality", keep_quality),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("pii", redact_pii),
    ("packing", pack_sequences),
]

#: Learned scores, fingerprints, edit distances and packing can't be put in SQL; tests/llm has a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents. Each stage's result is a table in the shared folder."""
    docs = common.table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = common.kept(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)

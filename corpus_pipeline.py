"""A cleaning pipeline over the documents table: each stage works on all rows that the stage before kept.

Every stage takes nulls in any column, empty and very long texts, repeated rows and empty tables; what it
does with them is stated with the operator that it calls. Extra columns pass through all stages, whatever their
names; what the last stage adds gets an underscore where a name is taken.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from panelspark.llm import decontam, jaccard, langid, secret_scan, spm
from panelspark.llm.common import materialize, release, table


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the documents whose language is told; rejected ones (``und``: null text or no letters) go. Without any label, those with letters stay."""
    model = langid.fit(docs)
    if not model.languages:
        return langid.with_letters(docs)
    return langid.with_language(docs, model)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of near copies, the one of the smallest doc_id."""
    return jaccard.one_of_each(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that hold a passage of a benchmark item."""
    return decontam.remove(docs, table(spark, sf_dir, "benchmark"))


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep every document, with its secrets masked and n_chars counted again."""
    masked = secret_scan.mask_secrets(docs)
    return masked.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else masked


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Add piece_ids, and roundtrip: do the ids decode to the text?"""
    return spm.encode(docs)


STAGES = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("benchmark_decontamination", benchmark_decontamination),
    ("secret_scans", secret_scans),
    ("sentencepiece", sentencepiece),
]

#: SQL cannot express the language, secret and piece stages; tests/llm has the operators' tests and one of the whole.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after another; a stage's table is deleted when the next one's is written, the last one stays for the result."""
    docs, held = table(spark, sf_dir, "documents"), None
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = materialize(docs)
            if held is not None:
                release(held)
            held = docs
    return docs

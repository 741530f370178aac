"""The corpus pipeline: five stages over documents, each written and read again.

Every stage takes null ids and texts, empty and very long texts, repeated rows,
further columns of any name and tables without rows; all but the last return
the columns they were given.  Labels or a benchmark without rows decide nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from assayer.llm import decontam, ngram_join, packing, quality_gam, secret_scan
from assayer.llm.common import read, stage
from assayer.llm.queries import tokenizer_path


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which the additive model, fitted to the labels, gives 0.3 or more.

    A null text is scored as an empty one; without labels all scores are equal.
    """
    model = quality_gam.fit_quality(docs, read(spark, sf_dir, "labels"), F.lit(True))
    return quality_gam.drop_low_quality(docs, model, 0.3)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that shares three quarters of its 5-word shingles.

    Null texts and texts without words resemble nothing, and stay.
    """
    return ngram_join.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of the benchmark; null and empty texts hold none."""
    return decontam.drop_contaminated(docs, read(spark, sf_dir, "benchmark"), short_tolerance=True)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets replaced by a mark and n_chars counted anew; null texts stay null."""
    return secret_scan.mask_secrets(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences with their ids; a null text counts as empty."""
    return packing.pack(docs, tokenizer_path(), special_tokens=True)


STAGES = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("secrets", secrets),
    ("packing", pack),
]

#: Trained models and token ids are beyond SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)

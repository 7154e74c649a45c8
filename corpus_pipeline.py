"""A training corpus from `documents`, in stages that each write their result for the next."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from ratescale.llm import decontamination, near_copies, packing, personal_data, quality
from ratescale.llm.common import written


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{str(folder).rstrip('/')}/{name}.parquet")


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on the ratings in `labels`, takes for good and not toxic.

    Null texts are empty, ratings with a null are left out, without a usable rating all rows stay, and an empty table stays empty.
    """
    return quality.keep_good(docs, _table(spark, sf_dir, "labels"))


def distinct_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: shingles of five words, similarity 0.8 or more, by the SimHash trees and an exact check.

    The smallest id stays, null ids come last; null texts and texts without words are copies of each other; of equal rows one stays.
    """
    return near_copies.keep_one(docs)


def clean_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share no window of words with `benchmark`. Null texts and items have no words; null ids and repeated rows stay as they are."""
    return decontamination.drop_contaminated(docs, _table(spark, sf_dir, "benchmark"))


def redacted_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents, with personal data replaced; null texts stay null, no row goes."""
    return personal_data.redact(docs)


def packed_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' pieces, packed into sequences of 2048 tokens; a null text is one end id, rows of one id are documents of their own."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("quality classifier", good_documents),
    ("near duplicates", distinct_documents),
    ("benchmark decontamination", clean_documents),
    ("personal data", redacted_documents),
    ("packing", packed_documents),
]

# SQL can express neither the classifier nor the packing
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder; each stage's rows are written to the shared folder and read by the next."""
    docs = _table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = written(stage(spark, docs, sf_dir), f"stage-{i}")
    return docs

"""The registered queries of the operators, and SQL twins where SQL can express the result."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ratescale.llm import context_mixing, conversations, decontamination, neighbours, packing, personal_data, quality, sharding, simhash, spelling, suffix_dedup, token_counts, token_files


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def op1_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    return neighbours.nearest(_table(spark, folder, "embeddings"), "vec_id % 50 = 0", k=5)


def op2_interleaving(spark: SparkSession, folder: str) -> DataFrame:
    rows = sharding.interleave(_table(spark, folder, "documents"), shards=16)
    return rows.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op3_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(_table(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op4_token_files(spark: SparkSession, folder: str) -> DataFrame:
    return token_files.round_trip(_table(spark, folder, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op5_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    found = decontamination.find_contamination(_table(spark, folder, "documents"), _table(spark, folder, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


def op6_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    return token_counts.count_tokens(_table(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op7_simhash(spark: SparkSession, folder: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, folder, "documents"))


def op8_quality(spark: SparkSession, folder: str) -> DataFrame:
    return quality.score(_table(spark, folder, "documents"), _table(spark, folder, "labels"))


def op9_personal_data(spark: SparkSession, folder: str) -> DataFrame:
    found = personal_data.find_personal_data(_table(spark, folder, "documents"))
    spelled = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    kinds = F.transform("base", lambda s: s["kind"])
    counts = [F.size(F.filter(kinds, lambda k: k == kind)).cast("long").alias(f"n_{kind}") for kind in personal_data.KINDS]
    return found.select("doc_id", *counts, F.sha2(spelled("base"), 256).alias("base_sha256"), spelled("spans").alias("spans"))


def op10_suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    cut = suffix_dedup.remove_repeats(_table(spark, folder, "documents"))
    return cut.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), "kept_sha256")


def op11_conversations(spark: SparkSession, folder: str) -> DataFrame:
    return conversations.repair_report(_table(spark, folder, "conversations"), conversations.damage)


def op12_context_mixing(spark: SparkSession, folder: str) -> DataFrame:
    return context_mixing.score_texts(_table(spark, folder, "documents"))


def op13_spelling(spark: SparkSession, folder: str) -> DataFrame:
    return spelling.variants(_table(spark, folder, "documents"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_neighbours, op2_interleaving, op3_packing, op4_token_files, op5_decontamination, op6_token_counts, op7_simhash, op8_quality,
        op9_personal_data, op10_suffix_dedup, op11_conversations, op12_context_mixing, op13_spelling,
    )
}
ORACLE_SQL: dict[str, str] = {}

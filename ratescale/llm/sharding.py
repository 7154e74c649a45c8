"""Proportional stratified interleaving: every shard gets each source's share, by DataFrame functions alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ratescale.llm.common import written

BUCKET_ROWS = 20_000  # rows that one window sorts, on average
BUCKETS = 1 << 16  # at most, as one window runs over all of them


def _numbered(rows: DataFrame, within: list[str], bucket: Column, order: list[str]) -> DataFrame:
    """`_place`: the row's number from 0, and `_all`: number of rows, per `within`, by bucket and then by `order`.

    A window sorts one bucket; counts per bucket carry the number on. `within` holds no nulls.
    """
    cut = rows.withColumn("_bucket", bucket)
    totals = cut.groupBy(*within, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    per = W.partitionBy(*within)
    before = F.sum("_n").over(per.orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1))
    offsets = totals.select(*within, "_bucket", F.coalesce(before, F.lit(0)).alias("_offset"), F.sum("_n").over(per).alias("_all"))
    inside = W.partitionBy(*within, "_bucket").orderBy(*order)
    joined = cut.withColumn("_number", F.row_number().over(inside)).join(offsets, [*within, "_bucket"])
    return joined.withColumn("_place", F.col("_offset") + F.col("_number") - 1).drop("_bucket", "_offset", "_number")


def interleave(
    docs: DataFrame, shards: int = 16, seed: int = 0, id_column: str = "doc_id", text_column: str = "text", source_column: str = "source",
) -> DataFrame:
    """doc_id, source, size, text_crc32, shard and slot of all rows: shards' row counts differ by one at most.

    Rows of a source are shuffled by a seeded hash and ranked; sorted by fractional rank (rank from 0 + a hashed part of 1) / rows of the
    source, a cut at any rank holds each source in proportion, to a row; where sources of
    few rows fall is a matter of the hash. Null sources are a source of their own. Null or
    repeated ids and repeated rows are ordered by all their columns; equal rows get places of their own. A null text has size 1 and
    the checksum of the empty text. Other columns are left out; an empty table gives no rows. Texts don't pass any shuffle.
    """
    text = F.coalesce(F.col(text_column).cast("string"), F.lit(""))
    key = F.col(id_column).cast("long")
    rows = docs.select(
        key.alias("doc_id"),
        F.col(source_column).cast("string").alias("source"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
    ).withColumn("_shuffle", F.xxhash64(F.lit(seed), "doc_id", "text_crc32"))
    rows = written(rows.withColumn("_stratum", F.struct(F.col("source").isNull(), F.coalesce("source", F.lit("")))), "shard-rows")
    n = rows.count()
    buckets = min(BUCKETS, max(1, -(-n // BUCKET_ROWS)))
    order = ["_shuffle", "doc_id", "size", "text_crc32"]
    ranked = _numbered(rows, ["_stratum"], F.floor((F.shiftrightunsigned("_shuffle", 33) * buckets) / F.lit(1 << 31)), order)
    # a place inside the rank's part, so that sources of few rows, whose ranks are alike, are spread over the whole order and its buckets
    inside = F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.lit("inside"), "doc_id", "text_crc32"), 33) / F.lit(1 << 31)
    share = (F.col("_place") + inside) / F.col("_all")
    ranked = ranked.withColumn("_share", share).drop("_place", "_all")
    sorted_rows = _numbered(ranked, [], F.floor(F.col("_share") * buckets), ["_share", "_stratum", *order])
    place = F.col("_place")
    # shard s holds the places from ceil(s * n / shards) on
    shard = F.least(F.expr(f"(_place * {shards}) div {max(n, 1)}"), F.lit(shards - 1))
    first = F.expr(f"(({max(n, 1)} * _shard + {shards - 1}) div {shards})")
    return sorted_rows.withColumn("_shard", shard).select(
        "doc_id", "source", "size", "text_crc32", F.col("_shard").cast("int").alias("shard"), (place - first).cast("long").alias("slot")
    )

"""Nearest neighbours by a block matrix join: int8 products bound the cosine, what survives is computed in double precision."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

QUERY_ROWS, VECTOR_ROWS = 1024, 8192  # rows of one tile, on average
EXACT_DIMENSIONS = 1024  # up to so many products of int8 values add up exactly in float32


def in_range(vectors: np.ndarray) -> np.ndarray:
    """Rows times a power of two that brings their largest component near 1: squares neither vanish nor overflow, nothing is rounded."""
    return np.ldexp(vectors, -np.frexp(np.abs(vectors).max(axis=1))[1][:, None])


class Tile:
    """Unit vectors as int8 with a scale, and the length of what the rounding left over."""

    def __init__(self, vectors: np.ndarray):
        scaled = in_range(vectors)
        units = scaled / np.sqrt((scaled * scaled).sum(axis=1))[:, None]
        self.scale = np.abs(units).max(axis=1) / 127.0
        self.codes = np.rint(units / self.scale[:, None]).astype(np.int8)
        rounded = self.codes * self.scale[:, None]
        self.rest = np.sqrt(((units - rounded) ** 2).sum(axis=1))
        self.length = np.sqrt((rounded * rounded).sum(axis=1))

    def products(self, other: "Tile") -> np.ndarray:
        """Exact integer products of the int8 codes, in slabs of dimensions that float32 holds exactly."""
        total = np.zeros((len(self.codes), len(other.codes)))
        for i in range(0, self.codes.shape[1], EXACT_DIMENSIONS):
            total += self.codes[:, i:i + EXACT_DIMENSIONS].astype(np.float32) @ other.codes[:, i:i + EXACT_DIMENSIONS].astype(np.float32).T
        return total


def cosine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row in double precision, each row by itself, so that equal vectors have equal values."""
    a, b = in_range(a), in_range(b)
    return (a * b).sum(axis=1) / (np.sqrt((a * a).sum(axis=1)) * np.sqrt((b * b).sum(axis=1)))


def best_of(ids: list[int], scores: list[float], k: int) -> list[tuple[float, int]]:
    return heapq.nsmallest(k, zip([-s for s in scores], ids))


def search_tile(query_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, vectors: np.ndarray, k: int) -> Iterator[tuple[int, int, float]]:
    """The k nearest of one tile's vectors for each of its queries, the query itself excepted.

    u.v differs from the product of the rounded vectors by at most |rounded u| |rest of v| + |rest of u|, by the Cauchy-Schwarz
    inequality. Only vectors whose upper bound reaches the k-th largest lower bound are computed.
    """
    right = Tile(vectors)
    for start in range(0, len(queries), 128):
        block, own = queries[start:start + 128], query_ids[start:start + 128]
        left = Tile(block)
        approx = left.products(right) * left.scale[:, None] * right.scale[None, :]
        slack = left.length[:, None] * right.rest[None, :] + left.rest[:, None] + 1e-9
        same = own[:, None] == ids[None, :]
        low = np.where(same, -np.inf, approx - slack)
        if low.shape[1] > k:
            floor = np.partition(low, low.shape[1] - k, axis=1)[:, -k]
        else:
            floor = np.full(len(block), -np.inf)
        q, v = np.nonzero((approx + slack >= floor[:, None]) & ~same)
        for at in range(0, len(q), 200_000):
            scores = cosine(block[q[at:at + 200_000]], vectors[v[at:at + 200_000]])
            part = q[at:at + 200_000]
            cuts = np.flatnonzero(np.append(True, part[1:] != part[:-1]))
            for a, b in zip(cuts.tolist(), np.append(cuts[1:], len(part)).tolist()):
                for negative, vec in best_of(ids[v[at + a:at + b]].tolist(), scores[a:b].tolist(), k):
                    yield int(own[part[a]]), vec, -negative


def _joined(k: int):
    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        found: list[tuple[int, int, float]] = []
        if len(left) and len(right):
            queries, vectors = (np.array(x.tolist(), np.float64) for x in (left["query"], right["vector"]))
            found = list(search_tile(left["query_id"].to_numpy(), queries, right["vec_id"].to_numpy(), vectors, k))
        return pd.DataFrame(found, columns=["query_id", "vec_id", "score"]).astype({"query_id": "int64", "vec_id": "int64", "score": "float64"})

    return run


def _merged(k: int):
    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        best = best_of(rows["vec_id"].tolist(), rows["score"].tolist(), k)
        return pd.DataFrame([(key[0], i + 1, vec, -s) for i, (s, vec) in enumerate(best)], columns=["query_id", "rank", "vec_id", "score"])

    return run


def nearest(
    vectors: DataFrame, is_query: str, k: int = 5, id_column: str = "vec_id", vector_column: str = "embedding",
    query_rows: int = QUERY_ROWS, vector_rows: int = VECTOR_ROWS,
) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: each query's k nearest by cosine, ties to the smaller id, the query's own id left out.

    `is_query` is a condition on vec_id. Queries and vectors are dealt to blocks of bounded size; a task joins one block of each, and
    sends on k rows for each of its queries. Vectors that are null, zero, or hold a null or a value that isn't finite take no part,
    nor do null ids; vectors of different length are not compared. Rows that share an id are vectors of their own, so an id may be listed
    more than once, but never for itself; queries that share an id share one answer. Other columns are left out; an empty table gives no rows.
    """
    rows = vectors.select(F.col(id_column).cast("long").alias("vec_id"), F.col(vector_column).cast("array<double>").alias("vector"))
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    usable = rows.filter(F.col("vec_id").isNotNull() & F.coalesce(finite, F.lit(False)) & F.exists("vector", lambda x: x != 0))
    usable = usable.withColumn("size", F.size("vector"))
    queries = usable.filter(is_query)
    n, m = vectors.count(), vectors.select(F.col(id_column).cast("long").alias("vec_id")).filter(is_query).count()
    across, down = max(1, -(-n // vector_rows)), max(1, -(-m // query_rows))
    every = lambda parts: F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))
    renamed = queries.select(F.col("vec_id").alias("query_id"), F.col("vector").alias("query"), F.col("size").alias("query_size"))
    left = renamed.select("*", F.pmod(F.xxhash64("query_id"), F.lit(down)).cast("int").alias("query_down"), every(across).alias("query_across"))
    right = usable.withColumn("across", F.pmod(F.xxhash64("vec_id", F.lit(2)), F.lit(across)).cast("int")).withColumn("down", every(down))
    by_tile = left.groupBy("query_size", "query_down", "query_across")
    found = by_tile.cogroup(right.groupBy("size", "down", "across")).applyInPandas(_joined(k), "query_id long, vec_id long, score double")
    # in steps, so that no task merges more rows of a query than some hundred tiles send
    parts = across
    while parts > 256:
        parts = -(-parts // 256)
        found = found.withColumn("part", F.pmod(F.xxhash64("vec_id", F.lit(3)), F.lit(parts))).groupBy("query_id", "part").applyInPandas(
            _merged(k), "query_id long, rank int, vec_id long, score double").select("query_id", "vec_id", "score")
    return found.groupBy("query_id").applyInPandas(_merged(k), "query_id long, rank int, vec_id long, score double")

"""Bootstrap intervals from repeatable Poisson weights.

Every row gets, per replicate, a Poisson(1) weight read from md5 of seed, replicate and row key, instead of a draw of n rows out of n, so
weights need no shared state. One md5 serves four replicates. No row is copied: each task keeps, for every slice, the sums of all
replicates, which are products of the weights' matrix with the rows' moments, and hands on one row for each slice.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from math import exp, factorial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ratescale.functions.digests import md5_words
from ratescale.operators.metrics import pearson
from ratescale.operators.scale import null_safe, partitions
from ratescale.schemas import RATING_MAX, RATING_MIN

PER_HASH = 4
CENTRE = (RATING_MIN + RATING_MAX) / 2
BLOCK_ROWS = 1_024  # rows weighted together
HELD_SLICES = 1_000  # a task hands its sums on beyond this many slices
MOMENTS = 7  # weights, u, v, uu, vv, uv and squared differences


def poisson_limits(most: int = 9) -> list[str]:
    """Upper ends of the weights 0, 1, 2, ... as 8 hex digits of the unit interval."""
    cdf, out = 0.0, []
    for k in range(most):
        cdf += exp(-1.0) / factorial(k)
        out.append(f"{min(int(cdf * 2**32), 2**32 - 1):08x}")
    return out


def poisson_weights(keys: Sequence[str], n_boot: int, seed: int) -> np.ndarray:
    """Weights of the keys in all replicates, keys by replicates."""
    heads = [f"{seed}|{chunk}|".encode() for chunk in range(-(-n_boot // PER_HASH))]
    words = md5_words(heads, [key.encode() for key in keys])
    digits = words.transpose(0, 2, 1).reshape(-1, len(keys))[:n_boot]
    weights = np.zeros(digits.shape, np.uint8)
    for limit in poisson_limits():
        weights += digits >= np.uint32(int(limit, 16))
    return np.ascontiguousarray(weights.T)


def _replicate_sums(batches: Iterator[pa.RecordBatch], slices: int, n_boot: int, seed: int) -> Iterator[tuple[tuple, np.ndarray, pa.Schema]]:
    """(slice, replicates by moments, the rows' schema) over the rows of a task; a slice may come several times."""
    sums: dict[tuple, np.ndarray] = {}
    for batch in batches:
        for start in range(0, batch.num_rows, BLOCK_ROWS):
            part = batch.slice(start, BLOCK_ROWS)
            found: dict[str, int] = {}
            place = np.array([found.setdefault(key, len(found)) for key in part.column("_key").to_pylist()])
            weights = poisson_weights(list(found), n_boot, seed)
            u, v = part.column("_u").to_numpy(), part.column("_v").to_numpy()
            moments = np.stack([np.ones(len(u)), u, v, u * u, v * v, u * v, (u - v) * (u - v)], axis=1)
            of: dict[tuple, list[int]] = {}
            for i, one in enumerate(zip(*(part.column(c).to_pylist() for c in range(slices))) if slices else [()] * len(u)):
                of.setdefault(one, []).append(i)
            for one, rows in of.items():
                add = weights[place[rows]].astype(np.float64).T @ moments[rows]
                if one in sums:
                    sums[one] += add
                else:
                    sums[one] = add
            if len(sums) > HELD_SLICES:
                yield from ((one, found, batch.schema) for one, found in sums.items())
                sums = {}
    yield from ((one, found, batch.schema) for one, found in sums.items())


def replicate_statistics(pairs: DataFrame, x: str, y: str, slices: Sequence[str], key: Sequence[str], n_boot: int, seed: int) -> DataFrame:
    """Correlation and RMSE of every slice in every replicate (`rep`) that drew a row of it."""
    clean = pairs.dropna(subset=[x, y])
    named = F.concat_ws("|", *[F.coalesce(F.col(k).cast("string"), F.lit("")) for k in key])
    rows = clean.select(*slices, named.alias("_key"), (F.col(x) - CENTRE).cast("double").alias("_u"), (F.col(y) - CENTRE).cast("double").alias("_v"))
    own = T.StructType([f for f in rows.schema.fields[:len(slices)]])
    names = list(slices)

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for one, sums, schema in _replicate_sums(batches, len(names), n_boot, seed):
            columns = [pa.array([value], schema.types[c]) for c, value in enumerate(one)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array([sums.tobytes()], pa.binary())], names=[*names, "_sums"])

    def finished(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows of a slice follow each other."""
        now, total = None, None

        def statistics(schema: pa.Schema) -> pa.RecordBatch:
            reps = np.nonzero(total[:, 0] > 0)[0]
            n, u, v, uu, vv, uv, ee = total[reps].T
            du, dv, floor = n * uu - u * u, n * vv - v * v, n * n * 1e-12
            known = (du > floor) & (dv > floor)
            r = (n * uv - u * v) / np.sqrt(np.where(known, du, 1)) / np.sqrt(np.where(known, dv, 1))
            columns = [pa.array([value], schema.types[c]).take(pa.array(np.zeros(len(reps), np.int64))) for c, value in enumerate(now)]
            columns += [pa.array(reps.astype(np.int32)), pa.array(r, mask=~known), pa.array(np.sqrt(ee / n))]
            return pa.RecordBatch.from_arrays(columns, names=[*names, "rep", "r", "rmse"])

        for batch in batches:
            ones = zip(*(batch.column(c).to_pylist() for c in range(len(names)))) if names else [()] * batch.num_rows
            for one, sums in zip(ones, batch.column("_sums")):
                more = np.frombuffer(sums.as_py(), np.float64).reshape(n_boot, MOMENTS)
                if one == now:
                    total += more
                else:
                    if now is not None:
                        yield statistics(batch.schema)
                    now, total = one, more.copy()
        if now is not None:
            yield statistics(batch.schema)

    # a hash of the key deals the rows evenly however few tasks read them: the weights are the work
    parts = rows.repartition(partitions(), "_key").mapInArrow(summed, T.StructType([*own.fields, T.StructField("_sums", T.BinaryType())]))
    together = parts.repartition(*names).sortWithinPartitions(*names) if names else parts.coalesce(1)
    out = [T.StructField("rep", T.IntegerType()), T.StructField("r", T.DoubleType()), T.StructField("rmse", T.DoubleType())]
    return together.mapInArrow(finished, T.StructType([*own.fields, *out]))


def _interval(column: str, ci: float) -> list[Column]:
    a = (1.0 - ci) / 2.0
    # one value per replicate: bounded by n_boot, so the exact percentile is safe
    return [F.percentile(column, F.lit(a)).alias(f"{column}_lo"), F.percentile(column, F.lit(1.0 - a)).alias(f"{column}_hi")]


def bootstrap(pairs: DataFrame, x: str, y: str, slices: Sequence[str], key: Sequence[str], n_boot: int = 1000, ci: float = 0.95, seed: int = 42) -> DataFrame:
    """Estimate and percentile interval of correlation and RMSE per slice, both from the same replicates.

    Slices with fewer than three pairs have no interval; with a constant side the correlation is 0 without interval.
    """
    clean = pairs.dropna(subset=[x, y])
    e = F.col(x) - F.col(y)
    point = clean.groupBy(*slices).agg(F.count(F.lit(1)).alias("n"), pearson(F.col(x), F.col(y), "zero", 3).alias("r"), F.sqrt(F.avg(e * e)).alias("rmse"))
    reps = replicate_statistics(clean, x, y, slices, key, n_boot, seed)
    spans = reps.groupBy(*slices).agg(*_interval("r", ci), *_interval("rmse", ci))
    out = null_safe(point, spans, slices, "left")
    enough = F.col("n") >= 3
    return out.select(*slices, "n", "r", "rmse", *[F.when(enough, F.col(c)).alias(c) for c in ("r_lo", "r_hi", "rmse_lo", "rmse_hi")])


def bootstrap_mean_over(pairs: DataFrame, x: str, y: str, keys: Sequence[str], over: str, key: Sequence[str], n_boot: int = 1000, ci: float = 0.95, seed: int = 42) -> DataFrame:
    """Interval of the mean of the correlations over the values of `over` (say, terms) per key.

    A replicate counts only if every value has a correlation in it.
    """
    clean = pairs.dropna(subset=[x, y])
    each = clean.groupBy(*keys, over).agg(pearson(F.col(x), F.col(y), "null", 3).alias("r"))
    point = each.groupBy(*keys).agg(F.avg("r").alias("mean_r"), F.count(F.lit(1)).alias("_values"))
    reps = replicate_statistics(clean, x, y, [*keys, over], key, n_boot, seed)
    means = reps.groupBy(*keys, "rep").agg(F.avg("r").alias("mean_r"), F.count("r").alias("_got"))
    full = null_safe(means, point.select(*keys, "_values"), keys).filter("_got = _values")
    spans = full.groupBy(*keys).agg(*_interval("mean_r", ci), F.count(F.lit(1)).alias("n_reps"))
    return null_safe(point.drop("_values"), spans, keys, "left").select(*keys, "mean_r", "mean_r_lo", "mean_r_hi", F.coalesce("n_reps", F.lit(0)).alias("n_reps"))

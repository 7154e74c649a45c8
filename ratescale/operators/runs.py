"""Experiment runs: seeds, folds, learning curves and the choice of configurations.

Metrics of all runs are one long table keyed by model, config, fold and seed.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ratescale.functions.terms import normalize_category
from ratescale.operators.scale import first_per_key
from ratescale.schemas import TERMS

# 97.5 % points of Student's t for 1 to 30 degrees of freedom.
T_975 = (
    12.706205, 4.302653, 3.182446, 2.776445, 2.570582, 2.446912, 2.364624, 2.306004, 2.262157, 2.228139,
    2.200985, 2.178813, 2.160369, 2.144787, 2.131450, 2.119905, 2.109816, 2.100922, 2.093024, 2.085963,
    2.079614, 2.073873, 2.068658, 2.063899, 2.059539, 2.055529, 2.051831, 2.048407, 2.045230, 2.042272,
)
Z_975 = 1.959963984540054
CATEGORIES = ("mean", *TERMS)


def t_quantile(df: Column) -> Column:
    """97.5 % point of Student's t: the table up to 30, then the Cornish-Fisher expansion."""
    z, d = Z_975, df.cast("double")
    g1 = (z**3 + z) / 4
    g2 = (5 * z**5 + 16 * z**3 + 3 * z) / 96
    g3 = (3 * z**7 + 19 * z**5 + 17 * z**3 - 15 * z) / 384
    large = F.lit(z) + F.try_divide(F.lit(g1), d) + F.try_divide(F.lit(g2), d * d) + F.try_divide(F.lit(g3), d * d * d)
    return F.when(df <= 30, F.get(F.array(*[F.lit(v) for v in T_975]), (df - 1).cast("int"))).otherwise(large)


def unpivot_metrics(metrics: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    cells = F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value")) for c in columns])
    return metrics.select(*keys, F.explode(cells).alias("m")).select(*keys, "m.*").filter("value is not null")


def seed_statistics(metrics: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Mean, sample deviation (0 for one seed), count and 95 % t interval over seeds, per key and metric."""
    s = unpivot_metrics(metrics, keys, columns).groupBy(*keys, "metric").agg(
        F.avg("value").alias("mean"), F.coalesce(F.stddev_samp("value"), F.lit(0.0)).alias("std"), F.count(F.lit(1)).alias("n")
    )
    half = F.when(F.col("n") > 1, t_quantile(F.col("n") - 1) * F.col("std") / F.sqrt("n")).otherwise(0.0)
    return s.withColumn("ci_lower", F.col("mean") - half).withColumn("ci_upper", F.col("mean") + half)


def mean_predictions(predictions: DataFrame, keys: Sequence[str], columns: Sequence[str] = ("predicted", "true_rating")) -> DataFrame:
    return predictions.groupBy(*keys).agg(*[F.avg(c).alias(c) for c in columns], F.count(F.lit(1)).alias("n_seeds"))


def mean_curve(curves: DataFrame, columns: Sequence[str], keys: Sequence[str] = ("run",), step: str = "step") -> DataFrame:
    """Mean of every logged value per step over the seeds; empty cells do not count."""
    return curves.groupBy(*keys, step).agg(*[F.avg(c).alias(c) for c in columns], F.count(F.lit(1)).alias("n_seeds"))


def merge_log_rows(log: DataFrame, columns: Sequence[str], keys: Sequence[str] = ("run", "step"), order: str = "seq") -> DataFrame:
    """One row per step from its training and evaluation lines; the last value of each column that is not empty."""
    return log.groupBy(*keys).agg(*[F.max_by(c, F.when(F.col(c).isNotNull(), F.col(order))).alias(c) for c in columns])


def last_evaluated(curves: DataFrame, marker: str, columns: Sequence[str], keys: Sequence[str] = ("run",), step: str = "step") -> DataFrame:
    """The last step per run that has an evaluation."""
    rows = curves.filter(F.col(marker).isNotNull())
    best = rows.groupBy(*keys).agg(F.max_by(F.struct(step, *columns), step).alias("r"))
    return best.select(*keys, "r.*")


def best_step(curves: DataFrame, score: str, columns: Sequence[str], keys: Sequence[str] = ("run",), step: str = "step") -> DataFrame:
    """The evaluated step with the lowest score per run, the first on ties."""
    rows = curves.filter(F.col(score).isNotNull())
    best = rows.groupBy(*keys).agg(F.min_by(F.struct(step, *columns), F.struct(score, step)).alias("r"))
    return best.select(*keys, "r.*")


def tidy_metrics(metrics: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Categories under one name and the first of the alternative metric columns that exists; later lines win."""
    def pick(names: Sequence[str]) -> Column:
        have = [F.col(n).try_cast("double") for n in names if n in metrics.columns]
        return F.coalesce(*have) if have else F.lit(None).cast("double")

    # Alternative names of the two metrics.
    corr = pick(("corr_mean", "correlation_mean", "correlation", "corr"))
    rmse = pick(("rmse_mean", "rmse"))
    return metrics.select(*keys, normalize_category(F.col("category")).alias("category"), corr.alias("corr"), rmse.alias("rmse")).filter(
        "category is not null"
    )


def category_columns(tidy: DataFrame, keys: Sequence[str], prefix: str = "") -> DataFrame:
    """One row per key with correlation and RMSE per category; a mean that is missing is the mean of the terms."""
    def of(cat: str, c: str) -> Column:
        names = ("nonbinary person", "nonbinary") if cat == "nonbinary person" else (cat,)
        own = F.max(F.when(F.col("category").isin(*names), F.col(c)))
        return F.coalesce(own, F.avg(F.col(c))) if cat == "mean" else own

    short = {"nonbinary person": "nonbinary"}
    return tidy.groupBy(*keys).agg(*[of(cat, c).alias(f"{prefix}{c}_{short.get(cat, cat)}") for cat in CATEGORIES for c in ("corr", "rmse")])


def fold_averages(wide: DataFrame, keys: Sequence[str], columns: Sequence[str], deviation_of: str) -> DataFrame:
    """Metrics averaged over folds, the sample deviation of one of them, and the number of folds."""
    return wide.groupBy(*keys).agg(
        *[F.avg(c).alias(c) for c in columns], F.stddev_samp(deviation_of).alias(f"{deviation_of}_std"), F.count(F.lit(1)).alias("n_folds")
    )


def best_by(rows: DataFrame, keys: Sequence[str], score: str, ties: Sequence[str]) -> DataFrame:
    """The row with the highest score per key, the first by `ties` on equal scores."""
    scored = rows.filter(F.col(score).isNotNull()).withColumn("_neg", -F.round(score, 12))
    return first_per_key(scored, keys, ["_neg", *ties]).drop("_neg")


def best_config(tidy: DataFrame, score: str = "corr_mean") -> DataFrame:
    """Best configuration per model: seeds averaged within a fold, then folds."""
    per_fold = category_columns(tidy.groupBy("model", "config", "fold", "category").agg(F.avg("corr").alias("corr"), F.avg("rmse").alias("rmse")), ["model", "config", "fold"])
    cols = [c for c in per_fold.columns if c.startswith(("corr_", "rmse_"))]
    return best_by(fold_averages(per_fold, ["model", "config"], cols, score), ["model"], score, ["config"])


def best_direct(tidy: DataFrame, score: str = "corr_mean") -> DataFrame:
    """Best single run per model without folds."""
    wide = category_columns(tidy, ["model", "config", "fold", "seed"])
    return best_by(wide, ["model"], score, ["config", "fold", "seed"])


def best_single_seed(tidy: DataFrame, score: str = "corr_mean") -> DataFrame:
    """Best configuration and seed per model, folds averaged."""
    wide = category_columns(tidy, ["model", "config", "fold", "seed"])
    cols = [c for c in wide.columns if c.startswith(("corr_", "rmse_"))]
    return best_by(fold_averages(wide, ["model", "config", "seed"], cols, score), ["model"], score, ["config", "seed"])


def summary_row(statistics: DataFrame, keys: Sequence[str] = ("model",)) -> DataFrame:
    """One row per model with a column per category and metric, from seed statistics."""
    short = {"nonbinary person": "nonbinary", "correlation": "corr"}
    cells = [(cat, m) for cat in CATEGORIES for m in ("corr", "rmse")]
    cat, metric = normalize_category(F.col("category")), F.when(F.col("metric") == "correlation", "corr").otherwise(F.col("metric"))
    named = statistics.withColumn("category", cat).withColumn("metric", metric)
    return named.groupBy(*keys).agg(
        *[F.max(F.when((F.col("category") == c) & (F.col("metric") == m), F.col("mean"))).alias(f"{m}_{short.get(c, c)}") for c, m in cells]
    )

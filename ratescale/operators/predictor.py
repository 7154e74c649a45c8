"""Rating predictor on Spark ML: features, linear model on the 0-1 scale through a sigmoid, choice by folds."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Pipeline
from pyspark.ml.evaluation import RegressionEvaluator
from pyspark.ml.feature import IDF, HashingTF, RegexTokenizer, VectorAssembler
from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import LinearRegression
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ratescale.functions.terms import from_unit, to_unit
from ratescale.operators.metrics import evaluation_table
from ratescale.operators.splits import assign_splits, fold_groups
from ratescale.operators.scale import attach_table
from ratescale.schemas import TERMS
from ratescale.session import cut_lineage

EDGE = 0.01  # targets at the scale's ends are moved in by this much before the logit


def logit_target(rating: Column) -> Column:
    u = F.greatest(F.lit(EDGE), F.least(F.lit(1 - EDGE), to_unit(rating)))
    return F.ln(u / (1 - u))


def squash(linear: Column) -> Column:
    """A linear value as a rating on the scale."""
    return from_unit(1 / (1 + F.exp(-linear)))


def term_vector(rows: DataFrame, terms: Sequence[str] = TERMS) -> DataFrame:
    flags = F.array(*[(F.col("person_term") == t).cast("double") for t in terms])
    return rows.withColumn("term_vector", array_to_vector(flags))


def text_stages(size: int = 1 << 10) -> list:
    """Hashed words of the attribute weighted by rarity, next to the term."""
    return [
        RegexTokenizer(inputCol="attribute", outputCol="_words", pattern=r"\W+"),
        HashingTF(inputCol="_words", outputCol="_tf", numFeatures=size),
        IDF(inputCol="_tf", outputCol="_idf"),
        VectorAssembler(inputCols=["_idf", "term_vector"], outputCol="features"),
    ]


def regression(reg: float = 0.01) -> LinearRegression:
    """Least squares; up to 4096 features Spark solves it in one pass over the rows."""
    return LinearRegression(featuresCol="features", labelCol="target", predictionCol="linear", regParam=reg, solver="auto")


def predict(model, rows: DataFrame) -> DataFrame:
    """Predicted and true rating per row."""
    keys = [c for c in ("attribute", "person_term", "source", "split") if c in rows.columns]
    return model.transform(rows).select(*keys, squash(F.col("linear")).alias("predicted"), F.col("avg_rating").alias("true_rating"))


def own_columns(items: DataFrame, *more: str) -> DataFrame:
    """What a fit and its predictions read."""
    return items.select(*[c for c in items.columns if c in ("attribute", "person_term", "source", "avg_rating", *more)])


def train_on_text(items: DataFrame, test_size: float = 0.25, val_size: float = 0.15, seed: int = 42, reg: float = 0.01, size: int = 1 << 10) -> DataFrame:
    """Fit on the train groups and predict the test groups. Validation groups stay out of both.

    Every stage of the fit reads the rows, so they are written with their split once.
    """
    rows = term_vector(cut_lineage(assign_splits(own_columns(items), test_size, val_size, seed))).withColumn("target", logit_target(F.col("avg_rating")))
    model = Pipeline(stages=[*text_stages(size), regression(reg)]).fit(rows.filter("split = 'train'"))
    return predict(model, rows.filter("split = 'test'"))


def train_on_vectors(items: DataFrame, vector: str = "embedding", test_size: float = 0.25, val_size: float = 0.15, seed: int = 42, reg: float = 0.01) -> DataFrame:
    """The same from ready-made vectors."""
    rows = cut_lineage(assign_splits(own_columns(items, vector), test_size, val_size, seed)).withColumn("features", array_to_vector(F.col(vector).cast("array<double>")))
    rows = rows.withColumn("target", logit_target(F.col("avg_rating")))
    return predict(regression(reg).fit(rows.filter("split = 'train'")), rows.filter("split = 'test'"))


def evaluate(predictions: DataFrame) -> DataFrame:
    return evaluation_table(predictions)


def choose_regularisation(items: DataFrame, grid: Sequence[float], vector: str = "embedding", k: int = 3, seed: int = 42) -> DataFrame:
    """RMSE of every grid point averaged over grouped folds, lowest first. One line per grid point."""
    folds = cut_lineage(fold_groups(items, k, seed).withColumn("fold", (F.col("fold") - 1).cast("int")))  # read by every fit
    rows = attach_table(items, ["attribute"], folds, ["fold"], "size")
    rows = rows.withColumn("features", array_to_vector(F.col(vector).cast("array<double>"))).withColumn("target", logit_target(F.col("avg_rating")))
    lr = regression()
    points = ParamGridBuilder().addGrid(lr.regParam, list(grid)).build()
    judge = RegressionEvaluator(predictionCol="linear", labelCol="target", metricName="rmse")
    fitted = CrossValidator(estimator=lr, estimatorParamMaps=points, evaluator=judge, foldCol="fold", numFolds=k, parallelism=2).fit(rows)
    table = [(float(p[lr.regParam]), float(m)) for p, m in zip(points, fitted.avgMetrics)]
    return items.sparkSession.createDataFrame(table, "reg double, rmse double").orderBy("rmse", "reg")

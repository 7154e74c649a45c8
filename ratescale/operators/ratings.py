"""Item averages, modal labels, rating ranges and the long / wide shapes of training data."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ratescale.functions.terms import normalize_term, render_prompt
from ratescale.operators.scale import null_safe
from ratescale.schemas import TERMS

ITEM = ["attribute", "person_term"]


def item_averages(ratings: DataFrame, keys: Sequence[str] = ITEM, carry: Sequence[str] = ()) -> DataFrame:
    """Mean and sample variance per item; a single rating has variance 0. `carry` columns are constant per item."""
    return ratings.groupBy(*keys).agg(
        F.avg("rating").alias("avg_rating"),
        F.coalesce(F.var_samp("rating"), F.lit(0.0)).alias("rating_variance"),
        F.count("rating").alias("n_ratings"),
        *[F.min(c).alias(c) for c in carry],
    )


def modal_label(rows: DataFrame, keys: Sequence[str], label: str) -> DataFrame:
    """Most frequent label per group, the smallest on ties, with the number of labels seen.

    Counts per label combine on the map side, so a group's size does not matter.
    """
    counts = rows.filter(F.col(label).isNotNull()).groupBy(*keys, label).agg(F.count(F.lit(1)).alias("_c"))
    return counts.groupBy(*keys).agg(
        F.min_by(label, F.struct(-F.col("_c"), F.col(label))).alias(label),
        F.count(F.lit(1)).alias("n_labels"),
        F.max("_c").alias("n_modal"),
    )


def source_conflicts(ratings: DataFrame) -> DataFrame:
    """Attributes with more than one source, and the source that is used."""
    trimmed = ratings.select(F.trim("attribute").alias("attribute"), F.trim("source").alias("source"))
    return modal_label(trimmed, ["attribute"], "source").filter("n_labels > 1")


def attach_modal_split(items: DataFrame, rows: DataFrame, keys: Sequence[str] = ITEM) -> DataFrame:
    """Item table with the split most of its rows carry."""
    return null_safe(items.drop("split"), modal_label(rows, keys, "split").select(*keys, "split"), keys, "left")


def training_rows(items: DataFrame, template: str) -> DataFrame:
    """Long training table: prompt first, one row per item."""
    rest = [c for c in ("UUID", "attribute", "person_term", "avg_rating", "rating_variance", "split") if c in items.columns]
    return items.select(render_prompt(template, F.col("attribute"), F.col("person_term")).alias("prompt"), *rest)


def raw_rows(ratings: DataFrame) -> DataFrame:
    """Every single rating under the name averages have."""
    keep = [c for c in ("UUID", "attribute", "person_term") if c in ratings.columns]
    more = [c for c in ("split",) if c in ratings.columns]
    return ratings.select(*keep, F.col("rating").alias("avg_rating"), *more)


def pivot_terms(items: DataFrame, keys: Sequence[str] = ("attribute",), terms: Sequence[str] = TERMS) -> DataFrame:
    """One row per key with a rating and a variance column per term; keys that lack a term are dropped."""
    def of(term: str, column: str) -> Column:
        return F.min(F.when(F.col("person_term") == term, F.col(column)))

    wide = items.groupBy(*keys).agg(
        *[of(t, "avg_rating").alias(t) for t in terms],
        *[of(t, "rating_variance").alias(f"{t}_variance") for t in terms],
    )
    return wide.dropna(subset=list(terms))


def unpivot_terms(wide: DataFrame, keys: Sequence[str], value: str, terms: Sequence[str] = TERMS, prefix: str = "") -> DataFrame:
    """Long form of a table with one column per term."""
    cells = F.array(*[F.struct(F.lit(t).alias("person_term"), F.col(f"`{prefix}{t}`").alias(value)) for t in terms])
    return wide.select(*keys, F.explode(cells).alias("_cell")).select(*keys, "_cell.*")


def pivot_predictions(predictions: DataFrame, terms: Sequence[str] = TERMS) -> DataFrame:
    def of(term: str, column: Column) -> Column:
        return F.min(F.when(F.col("person_term") == term, column))

    cols = {"pred": F.col("predicted"), "true": F.col("true_rating"), "error": F.col("predicted") - F.col("true_rating")}
    return predictions.groupBy("attribute").agg(*[of(t, c).alias(f"{n}_{t}") for n, c in cols.items() for t in terms])


def term_variances(items: DataFrame) -> DataFrame:
    """Mean rating variance per normalised term; only positive ones."""
    return (
        items.filter(F.col("rating_variance").isNotNull())
        .groupBy(normalize_term(F.col("person_term")).alias("term"))
        .agg(F.avg("rating_variance").alias("mean_variance"))
        .filter("term is not null and mean_variance > 0")
    )


def term_ranges(items: DataFrame) -> DataFrame:
    """Rating range per normalised term; only positive ones."""
    return (
        items.groupBy(normalize_term(F.col("person_term")).alias("term"))
        .agg((F.max("avg_rating") - F.min("avg_rating")).alias("rating_range"))
        .filter("term is not null and rating_range > 0")
    )


def normalization_ranges(items: DataFrame) -> DataFrame:
    """Least and greatest item average per term, and over all terms as `mean`."""
    return (
        items.withColumn("term", normalize_term(F.col("person_term")))
        .filter("term is not null and avg_rating is not null")
        .rollup("term")
        .agg(F.min("avg_rating").alias("low"), F.max("avg_rating").alias("high"), F.grouping("term").alias("_g"))
        .select(F.when(F.col("_g") == 1, "mean").otherwise(F.col("term")).alias("term"), "low", "high")
    )

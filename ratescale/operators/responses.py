"""Analyses of model responses: abstention, polarization, rating distributions, families of models."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ratescale.functions import taxonomy
from ratescale.functions.parse import abstention_categories, clean_rating, composite_id, in_scale, rating_strict, rating_tolerant
from ratescale.operators.metrics import first_of_item
from ratescale.operators.scale import null_safe
from ratescale.schemas import RATING_MAX, RATING_MIN, TERMS

GRID_POINTS = 150


def parse_responses(responses: DataFrame, strict: bool = False) -> DataFrame:
    """Responses with the rating their text gives."""
    read = rating_strict if strict else rating_tolerant
    return responses.withColumn("method1_rating", read(F.col("generation")))


def flag_abstention(responses: DataFrame, predicted: str = "method1_rating", terms: Sequence[str] = TERMS) -> DataFrame:
    """Abstention flags on every human-rated response: no rating, or a text of an abstention family.

    The flags are added in place, so no join is needed to get back to the full rows.
    """
    kept = responses.filter(F.col("person_term").isin(*terms))
    if "avg_rating" in responses.columns:
        kept = kept.filter(F.col("avg_rating").isNotNull())
    found = kept.withColumn("categories", abstention_categories(F.col("generation")))
    flagged = found.withColumn("missing_rating", clean_rating(F.col(predicted)).isNull().cast("int")).withColumn(
        "text_abstention", (F.size("categories") > 0).cast("int")
    )
    return flagged.withColumn("abstention", F.greatest("missing_rating", "text_abstention"))


def labeled_records(responses: DataFrame, predicted: str = "method1_rating") -> DataFrame:
    """Flagged responses with an id and the family names joined by semicolons."""
    out = flag_abstention(responses, predicted)
    return out.withColumn("item_id", composite_id("model", "dataset", "attribute", "person_term")).withColumn(
        "abstention_categories", F.array_join("categories", ";")
    ).withColumnRenamed("abstention", "system_abstention").drop("categories")


def abstention_rates(flagged: DataFrame) -> DataFrame:
    """Counts and shares per model, dataset and term, per model and term, and per term."""
    sets = [["model", "dataset", "person_term"], ["model", "person_term"], ["person_term"]]
    flags = ["missing_rating", "text_abstention", "abstention"]
    out = flagged.groupingSets([[F.col(c) for c in s] for s in sets], "model", "dataset", "person_term").agg(
        *[F.sum(f).alias(f) for f in flags],
        F.count(F.lit(1)).alias("total"),
        *[F.avg(f).alias(f"pct_{f}") for f in flags],
        F.grouping("model").alias("_gm"),
        F.grouping("dataset").alias("_gd"),
    )
    return out.withColumn("model", F.when(F.col("_gm") == 1, "all").otherwise(F.col("model"))).withColumn(
        "dataset", F.when(F.col("_gd") == 1, "all").otherwise(F.col("dataset"))
    ).drop("_gm", "_gd")


def polarization(responses: DataFrame, predicted: str = "method1_rating") -> DataFrame:
    """Spread (population deviation) of a model's ratings over the terms of an attribute; two terms at least."""
    clean = responses.withColumn("_p", clean_rating(F.col(predicted)))
    items = first_of_item(clean, ["model", "dataset", "attribute", "person_term"], "_p")
    return _spread(items, ["model", "dataset", "attribute"], "_p")


def human_polarization(responses: DataFrame) -> DataFrame:
    """The same for the human averages, each attribute once per dataset."""
    items = first_of_item(responses, ["dataset", "attribute", "person_term"], "avg_rating")
    return _spread(items, ["dataset", "attribute"], "avg_rating")


def _spread(items: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    return items.groupBy(*keys).agg(F.stddev_pop(value).alias("polarization"), F.count(F.lit(1)).alias("_n")).filter("_n >= 2").drop("_n")


def polarization_delta(responses: DataFrame, predicted: str = "method1_rating") -> DataFrame:
    """Per model and dataset: mean distance of its polarization from the human mean, and on which side it is."""
    human = human_polarization(responses).groupBy("dataset").agg(F.avg("polarization").alias("human_mean"))
    own = polarization(responses, predicted).groupBy("model", "dataset").agg(
        F.avg("polarization").alias("model_mean"), F.stddev_pop("polarization").alias("model_std"), F.count(F.lit(1)).alias("n")
    )
    both = own.filter("n >= 2").join(human, "dataset", "left").withColumn("human_mean", F.coalesce("human_mean", F.lit(0.0)))
    delta = F.col("model_mean") - F.col("human_mean")
    return both.withColumn("mean_delta", delta).withColumn("more_polarized", delta > 0)


def rating_shares(rows: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Share of every rating 1..7 per key, ratings without rows included. One row of counts per key, then unfolded."""
    ratings = range(RATING_MIN, RATING_MAX + 1)
    ok = rows.withColumn("_v", clean_rating(F.col(value))).filter(in_scale(F.col("_v"))).withColumn("_r", F.rint("_v").cast("int"))
    counts = ok.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), *[F.count_if(F.col("_r") == r).alias(f"_{r}") for r in ratings])
    cells = F.array(*[F.struct(F.lit(r).alias("rating"), F.col(f"_{r}").alias("n")) for r in ratings])
    return counts.select(*keys, "_n", F.explode(cells).alias("c")).select(*keys, "c.rating", "c.n", (F.col("c.n") / F.col("_n")).alias("share"))


def model_and_human_shares(responses: DataFrame, predicted: str = "method1_rating") -> DataFrame:
    """Rating shares per term of all models together and of the human averages (each item once)."""
    model = rating_shares(responses, ["dataset", "person_term"], predicted).withColumn("who", F.lit("model"))
    items = first_of_item(responses, ["dataset", "attribute", "person_term"], "avg_rating")
    human = rating_shares(items, ["dataset", "person_term"], "avg_rating").withColumn("who", F.lit("human"))
    return model.unionByName(human)


def shares_without_abstention(responses: DataFrame, predicted: str = "method1_rating", group: Column | None = None) -> DataFrame:
    """Rating shares per kind of model and term, abstentions left out."""
    kind = group if group is not None else taxonomy.category(F.col("model"))
    kept = flag_abstention(responses, predicted).filter("abstention = 0").withColumn("model_kind", kind)
    return rating_shares(kept, ["model_kind", "person_term"], predicted)


def rating_density(rows: DataFrame, keys: Sequence[str], value: str, points: int = GRID_POINTS) -> DataFrame:
    """Gaussian density of the ratings on an even grid over the scale, Scott's bandwidth.

    Rows first collapse to distinct values with counts; the grid meets those, not the rows.
    """
    keys = list(keys)
    ok = rows.withColumn("_v", clean_rating(F.col(value))).filter(in_scale(F.col("_v")))
    counts = ok.groupBy(*keys, "_v").agg(F.count(F.lit(1)).alias("_w"))
    n, mean, sq = F.sum("_w"), F.sum(F.col("_w") * F.col("_v")), F.sum(F.col("_w") * F.col("_v") * F.col("_v"))
    stats = counts.groupBy(*keys).agg(n.alias("_n"), F.try_divide(sq - mean * mean / n, n - 1).alias("_var")).filter("_n >= 2 and _var > 0")
    h = F.sqrt("_var") * F.pow(F.col("_n").cast("double"), F.lit(-0.2))
    step = (RATING_MAX - RATING_MIN) / (points - 1)
    spread = null_safe(counts, stats.select(*keys, "_n", h.alias("_h")), keys).withColumn("point", F.explode(F.sequence(F.lit(0), F.lit(points - 1))))
    x = F.lit(float(RATING_MIN)) + F.col("point") * step
    z = (x - F.col("_v")) / F.col("_h")
    weight = F.col("_w") * F.exp(-z * z / 2) / (F.col("_n") * F.col("_h") * F.sqrt(F.lit(2.0) * F.pi()))
    return spread.groupBy(*keys, "point").agg(F.sum(weight).alias("density")).withColumn("x", F.lit(float(RATING_MIN)) + F.col("point") * step)


def correlation_boxes(term_metrics: DataFrame) -> DataFrame:
    """Quartiles and whiskers (within 1.5 interquartile ranges) of the models' correlations per dataset and term.

    One value per model: the exact percentile is over the number of models.
    """
    keys = ["dataset", "person_term"]
    r = term_metrics.filter(F.col("pearson_r").isNotNull()).select(*keys, "pearson_r")
    q = r.groupBy(*keys).agg(*[F.percentile("pearson_r", F.lit(p)).alias(n) for n, p in (("q1", 0.25), ("median", 0.5), ("q3", 0.75))], F.count(F.lit(1)).alias("n"))
    reach = 1.5 * (F.col("q3") - F.col("q1"))
    inside = null_safe(r, q, keys).filter((F.col("pearson_r") >= F.col("q1") - reach) & (F.col("pearson_r") <= F.col("q3") + reach))
    return inside.groupBy(*keys, "q1", "median", "q3", "n").agg(F.min("pearson_r").alias("low"), F.max("pearson_r").alias("high"))


def with_taxonomy(metrics: DataFrame) -> DataFrame:
    m = F.col("model")
    return metrics.withColumns({"kind": taxonomy.category(m), "family": taxonomy.family(m)})


def base_instruct(metrics: DataFrame, value: str, keys: Sequence[str]) -> DataFrame:
    """Per family and key: base value, mean, least and greatest value of the tuned variants, and their difference."""
    kinds = taxonomy.CATEGORY_NAMES
    base = F.when(F.col("kind") == kinds["base"], F.col(value))
    tuned = F.when(F.col("kind") == kinds["instruct"], F.col(value))
    out = with_taxonomy(metrics).groupBy("family", *keys).agg(
        F.max(base).alias("base_val"), F.avg(tuned).alias("instruct_val"), F.min(tuned).alias("instruct_min"), F.max(tuned).alias("instruct_max")
    )
    both = out.dropna(subset=["base_val", "instruct_val"])
    return both.withColumn("delta", F.col("instruct_val") - F.col("base_val")).withColumn("family_display", taxonomy.family_display(F.col("family")))


def category_means(metrics: DataFrame, value: str, keys: Sequence[str] = ("dataset",)) -> DataFrame:
    return with_taxonomy(metrics).filter(F.col(value).isNotNull()).groupBy(F.col("kind").alias("category"), *keys).agg(
        F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"), F.count(F.lit(1)).alias("n")
    )


def attribution_shares(term_metrics: DataFrame, value: str = "rmse", terms: Sequence[str] = TERMS) -> DataFrame:
    """Each term's share of the summed absolute base-to-tuned change; families lacking a term are left out."""
    deltas = base_instruct(term_metrics.filter(F.col("person_term").isin(*terms)), value, ["dataset", "person_term"])
    per = W.partitionBy("family", "dataset")  # at most one row per term
    out = deltas.withColumn("_n", F.count(F.lit(1)).over(per)).withColumn("_sum", F.sum(F.abs("delta")).over(per)).filter(F.col("_n") == len(terms))
    return out.select("family", "family_display", "dataset", "person_term", "delta", F.try_divide(F.abs("delta"), "_sum").alias("abs_share"))


def display_ranks(models: DataFrame) -> DataFrame:
    """Distinct models with their place in tables: open by family, base first, then closed."""
    one = models.select("model").distinct()
    m = F.col("model")
    order = W.orderBy(*[F.asc_nulls_last(c) for c in taxonomy.display_order(m)])  # one row per model
    return one.select(
        "model", taxonomy.category(m).alias("kind"), taxonomy.family(m).alias("family"), taxonomy.family_display(taxonomy.family(m)).alias("family_display"),
        taxonomy.short_name(m).alias("short_name"), F.row_number().over(order).alias("place"),
    )


def matrix(cells: DataFrame, rows: Sequence[str], column: str, values: Sequence[str], value: str) -> DataFrame:
    """One row per `rows` with a column for each of `values`; the cells are unique."""
    def name(v: str) -> str:
        return v.replace(" ", "_")

    return cells.groupBy(*rows).agg(*[F.min(F.when(F.col(column) == v, F.col(value))).alias(name(v)) for v in values])

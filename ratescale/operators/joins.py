"""Joins and set operations between rating, response, phrase and key tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ratescale.operators.scale import attach_table, null_safe
from ratescale.schemas import DATASET_OF_SOURCE, TERMS

ITEM = ["attribute", "person_term"]


def attach_human_average(responses: DataFrame, human: DataFrame) -> DataFrame:
    """Responses with the human average of their item; items no human rated get null.

    Many responses share an item, so the hottest items are spread as in `attach_table`.
    """
    sizes = responses.groupBy(*ITEM).agg(F.count(F.lit(1)).alias("_n"))
    table = human.select(*ITEM, "avg_rating").join(sizes, ITEM, "inner")
    return attach_table(responses.drop("avg_rating"), ITEM, table, ["avg_rating"], "_n")


def restrict_to_items(ratings: DataFrame, items: DataFrame) -> DataFrame:
    """Ratings of the given items only."""
    sizes = ratings.groupBy(*ITEM).agg(F.count(F.lit(1)).alias("_n"))
    table = sizes.join(items.select(*ITEM).distinct(), ITEM, "left_semi").withColumn("_kept", F.lit(True))
    return attach_table(ratings, ITEM, table, ["_kept"], "_n").filter("_kept").drop("_kept")


def attach_source(predictions: DataFrame, sources: DataFrame, strict: bool = True) -> DataFrame:
    """Source of each attribute; with `strict` an attribute without source fails the job."""
    sizes = predictions.groupBy("attribute").agg(F.count(F.lit(1)).alias("_n"))
    lookup = sources.select("attribute", "source").join(sizes, "attribute")
    out = attach_table(predictions.drop("source"), ["attribute"], lookup, ["source"], "_n")
    if not strict:
        return out
    fail = F.raise_error(F.concat(F.lit("no source for attribute "), F.coalesce("attribute", F.lit("<missing>")))).cast("string")
    return out.withColumn("source", F.coalesce("source", fail))


def rules_table(spark: SparkSession, rules: Sequence[tuple[str, str, str]]) -> DataFrame:
    rows = [(i, *r) for i, r in enumerate(rules)]
    return spark.createDataFrame(rows, "rule_idx int, prefix string, source string, author_gender string")


def match_prefix(df: DataFrame, stem: Column, rules: Sequence[tuple[str, str, str]], strict: bool = False) -> DataFrame:
    """Source and author gender of the first rule whose prefix starts the stem.

    The rules are an ordered list of constants, so the first match is one expression per row: no join. The stem is bound once, as
    the element of a one-value array; otherwise it is worked out again for every rule.
    """
    low = F.lower(stem)
    table = F.array(*[F.struct(F.lit(p).alias("prefix"), F.lit(s).alias("source"), F.lit(g).alias("author_gender")) for p, s, g in rules])
    found = F.transform(F.array(low), lambda s: F.get(F.filter(table, lambda r: F.startswith(s, r["prefix"])), F.lit(0)))
    hit = F.get(found, F.lit(0))
    out = df.withColumn("_rule", hit)
    source = F.col("_rule.source")
    if strict:
        source = F.coalesce(source, F.raise_error(F.concat(F.lit("no source rule for "), stem)).cast("string"))
    return out.withColumn("source", source).withColumn("author_gender", F.col("_rule.author_gender")).drop("_rule")


def replicate_terms(df: DataFrame, terms: Sequence[str] = TERMS) -> DataFrame:
    """Every row once per person term."""
    return df.withColumn("person_term", F.explode(F.array(*[F.lit(t) for t in terms])))


def attach_scores(rows: DataFrame, scores: DataFrame, column: str = "predicted_rating") -> DataFrame:
    """Scores of the distinct pairs put back on all rows of the pair."""
    sizes = rows.groupBy(*ITEM).agg(F.count(F.lit(1)).alias("_n"))
    table = scores.select(*ITEM, column).join(sizes, ITEM, "inner")
    out = attach_table(rows.drop(column), ITEM, table, [column], "_n")
    return out.select(*rows.columns) if column in rows.columns else out


def backend_keys(with_submission: DataFrame, with_key: DataFrame, key: str = "parent_key") -> DataFrame:
    """Backend key to submission id, by way of the prolific id; unresolved keys keep a null submission.

    Where a prolific id or a key leads to several values the greatest counts, so the map has one row per key.
    """
    people = with_submission.select("prolific_id", "submission_id").dropna().groupBy("prolific_id").agg(F.max("submission_id").alias("submission_id"))
    links = with_key.select(key, "prolific_id").filter(F.col(key).isNotNull()).distinct()
    return links.join(people, "prolific_id", "left").groupBy(key).agg(F.max("submission_id").alias("submission_id"))


def unresolved_keys(keys: DataFrame) -> DataFrame:
    return keys.filter(F.col("submission_id").isNull())


def align(original: DataFrame, annotated: DataFrame, key: Sequence[str]) -> DataFrame:
    """Keys of both tables with a status: `ok`, `missing` in the annotations or `extra` in them."""
    sides = original.select(*key, F.lit(1).alias("_side")).unionByName(annotated.select(*key, F.lit(2).alias("_side")))
    in_original, in_annotated = F.bool_or(F.col("_side") == 1), F.bool_or(F.col("_side") == 2)
    status = F.when(~in_original, "extra").when(~in_annotated, "missing").otherwise("ok")
    return sides.groupBy(*key).agg(status.alias("status"))  # null keys are one key


def align_lenient(original: DataFrame, annotated: DataFrame, key: Sequence[str]) -> DataFrame:
    """All originals with their annotations; extra annotations are left out."""
    return original.join(annotated, list(key), "left")


def pending(wanted: DataFrame, finished: DataFrame, done: Column | None = None, key: Sequence[str] = ITEM) -> DataFrame:
    """Wanted keys that have no finished result yet."""
    ready = finished.filter(done) if done is not None else finished
    return null_safe(wanted, ready.select(*key).distinct(), list(key), "left_anti")


def ceiling_lookup(ceilings: DataFrame, labels: Mapping[str, str] = DATASET_OF_SOURCE, extra: Sequence[str] = ()) -> DataFrame:
    """Ceilings under dataset labels, with an `all` row: the stored one, or else the mean of the datasets."""
    label = F.when(F.col("dataset") == "all", "all")
    for name, shown in labels.items():
        label = label.when(F.col("dataset").isin(name, shown), F.lit(shown))
    named = ceilings.withColumn("dataset", label).filter(F.col("dataset").isNotNull()).select("dataset", *extra, "loo", "sqrt_icc")
    mean = named.filter("dataset <> 'all'").groupBy(*extra).agg(F.avg("loo").alias("loo"), F.avg("sqrt_icc").alias("sqrt_icc"))
    stored = named.filter("dataset = 'all'").select("dataset", *extra)
    fill = mean.select(F.lit("all").alias("dataset"), *extra, "loo", "sqrt_icc").join(stored, ["dataset", *extra], "left_anti")
    return named.unionByName(fill)


def attach_ceiling(metrics: DataFrame, lookup: DataFrame, key: Sequence[str] = ("dataset",)) -> DataFrame:
    """Metrics with the ceiling of their dataset. The lookup has one row per dataset (and term)."""
    return metrics.join(lookup, list(key), "left")


def union_all(*tables: DataFrame) -> DataFrame:
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t, allowMissingColumns=True)
    return out


def pooled(rows: DataFrame, column: str = "dataset", label: str = "all") -> DataFrame:
    """Rows counted under their own dataset and under the pooled one."""
    return rows.withColumn(column, F.explode(F.array(F.col(column), F.lit(label))))


def column_drift(tables: Mapping[str, DataFrame]) -> DataFrame:
    """In how many tables each column occurs and how many values it holds; `common` ones are in all tables."""
    def cells(table: DataFrame) -> DataFrame:
        one = table.agg(*[F.count(c).alias(c) for c in table.columns])
        lines = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).alias("n")) for c in table.columns])
        return one.select(F.explode(lines).alias("cell")).select("cell.*")

    listed = union_all(*[cells(t) for t in tables.values()])
    return listed.groupBy("column_name").agg(F.count(F.lit(1)).alias("n_tables"), F.sum("n").alias("n_values")).withColumn(
        "common", F.col("n_tables") == len(tables)
    )


def append_distinct(prior: DataFrame, new: DataFrame) -> DataFrame:
    return prior.unionByName(new).distinct()


def difference(left: DataFrame, right: DataFrame, key: Sequence[str]) -> DataFrame:
    """Distinct keys of the left table that the right one lacks."""
    return left.select(*key).distinct().join(right.select(*key).distinct(), list(key), "left_anti")

"""Filters, key normalisation, dedupe and data checks."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ratescale.functions.parse import clean_rating, in_scale
from ratescale.operators.scale import attach_group_stats, first_per_key
from ratescale.schemas import ATTENTION_CHECKS, SPLIT_TOLERANCE, TERMS


def _all(flags: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a & b, flags)


def mark_coverage(ratings: DataFrame, terms: Sequence[str] = TERMS) -> DataFrame:
    """`covered`: the row's attribute has ratings for every term."""
    flags = [F.coalesce(F.bool_or(F.col("person_term") == t), F.lit(False)) for t in terms]
    return attach_group_stats(ratings, ["attribute"], {"covered": _all(flags)})


def complete_attributes(ratings: DataFrame, terms: Sequence[str] = TERMS) -> DataFrame:
    """Rows whose attribute covers every term. Rows without attribute stay, as they belong to no incomplete one."""
    return mark_coverage(ratings, terms).filter(F.coalesce("covered", F.lit(True))).drop("covered")


def drop_denied(ratings: DataFrame, denied: Sequence[str] = ATTENTION_CHECKS) -> DataFrame:
    return ratings.filter(~F.coalesce(F.col("attribute").isin(*denied), F.lit(False)))


def clean_ratings(ratings: DataFrame, denied: Sequence[str] = ATTENTION_CHECKS) -> DataFrame:
    return drop_denied(complete_attributes(ratings), denied)


def removal_counts(ratings: DataFrame, denied: Sequence[str] = ATTENTION_CHECKS) -> DataFrame:
    """Rows dropped per rule, in one pass over the marked rows; the deny list counts covered rows only."""
    marked = mark_coverage(ratings).select(
        F.coalesce("covered", F.lit(True)).alias("covered"),
        F.coalesce(F.col("attribute").isin(*denied), F.lit(False)).alias("denied"),
    )
    kept = F.col("covered") & ~F.col("denied")
    return marked.agg(
        F.count(F.lit(1)).alias("rows_in"),
        F.count_if(~F.col("covered")).alias("incomplete"),
        F.count_if(F.col("covered") & F.col("denied")).alias("denied"),
        F.count_if(~kept).alias("removed"),
        F.count_if(kept).alias("rows_out"),
    )


def mask_invalid(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: clean_rating(F.col(c)) for c in columns})


def valid_pairs(df: DataFrame, predicted: str, human: str = "avg_rating") -> DataFrame:
    return mask_invalid(df, predicted, human).dropna(subset=[predicted, human])


def rows_in_scale(df: DataFrame, column: str = "rating") -> DataFrame:
    return df.filter(in_scale(F.col(column)))


def valid_attribute(column: Column) -> Column:
    return F.coalesce(~F.trim(column).isin("", "nan"), F.lit(False))


def front_columns(df: DataFrame, front: Sequence[str], drop: Sequence[str] = (), rename: Mapping[str, str] | None = None) -> DataFrame:
    """Drop and rename columns, then put the named ones that exist first."""
    shaped = df.drop(*drop).withColumnsRenamed(dict(rename or {}))
    first = [c for c in front if c in shaped.columns]
    return shaped.select(*first, *[c for c in shaped.columns if c not in first])


def normalize_key(column: Column) -> Column:
    """Lower case without surrounding whitespace."""
    return F.regexp_replace(F.lower(column), r"^\s+|\s+$", "")


def first_per_book(phrases: DataFrame, book: str = "source_novel", order: Sequence[str] = ("text_id",)) -> DataFrame:
    """One row per book and normalised phrase, the first by `order`."""
    keyed = phrases.filter(F.col("attribute").isNotNull()).withColumn("attribute_normalized", normalize_key(F.col("attribute")))
    rest = [c for c in keyed.columns if c not in (*order, book, "attribute_normalized")]
    return first_per_key(keyed, [book, "attribute_normalized"], [*order, *rest])


def studied_keys(*tables: DataFrame) -> DataFrame:
    """Distinct normalised attributes of all study tables."""
    keys = [t.filter(F.col("attribute").isNotNull()).select(normalize_key(F.col("attribute")).alias("attribute_normalized")) for t in tables]
    return reduce(DataFrame.unionByName, keys).distinct()


def exclude_studied(phrases: DataFrame, studied: DataFrame) -> DataFrame:
    return phrases.join(studied, "attribute_normalized", "left_anti")


def sample_problems(sample: DataFrame, studied: DataFrame) -> DataFrame:
    """Attributes of a sample that were studied before or occur twice in it."""
    keys = sample.filter(F.col("attribute").isNotNull()).groupBy(normalize_key(F.col("attribute")).alias("attribute_normalized")).agg(
        F.count(F.lit(1)).alias("n")
    )
    overlap = keys.join(studied, "attribute_normalized", "left_semi").withColumn("problem", F.lit("already_studied"))
    twice = keys.filter("n > 1").withColumn("problem", F.lit("duplicate"))
    return overlap.unionByName(twice).select("problem", "attribute_normalized", "n")


def straddling_groups(rows: DataFrame, group: str = "attribute") -> DataFrame:
    """Groups with rows in more than one split."""
    return (
        rows.groupBy(group)
        .agg(F.min("split").alias("first_split"), F.max("split").alias("last_split"), F.count_distinct("split").alias("n_splits"))
        .filter("n_splits > 1")
    )


def split_shares(rows: DataFrame, val_size: float, test_size: float, tolerance: float = SPLIT_TOLERANCE) -> DataFrame:
    """Share of rows per split against the wanted share. Splits without rows are listed with share 0."""
    wanted = {"train": 1.0 - val_size - test_size, "val": val_size, "test": test_size}
    counts = rows.agg(
        F.count(F.lit(1)).alias("total"), *[F.count_if(F.col("split") == s).alias(s) for s in wanted]
    )
    lines = F.explode(
        F.array(*[F.struct(F.lit(s).alias("split"), F.lit(w).alias("wanted"), F.col(s).alias("n")) for s, w in wanted.items()])
    )
    share = F.try_divide(F.col("n").cast("double"), F.col("total"))
    return counts.select("total", lines.alias("line")).select("line.*", "total").select(
        "split", "n", share.alias("share"), "wanted", (F.abs(share - F.col("wanted")) <= tolerance).alias("ok")
    )


def rows_outside_split(rows: DataFrame, expected: str) -> DataFrame:
    return rows.agg(
        F.count(F.lit(1)).alias("n"), F.count_if(~F.col("split").eqNullSafe(F.lit(expected))).alias("n_other")
    ).select("n", "n_other", (F.col("n_other") == 0).alias("ok"))


def missing_terms(rows: DataFrame, terms: Sequence[str] = TERMS) -> DataFrame:
    """Attributes that lack a term, with the missing terms sorted. The set per attribute has at most the domain's size."""
    seen = F.collect_set(F.when(F.col("person_term").isin(*terms), F.col("person_term")))
    lacking = F.array_sort(F.array_except(F.array(*[F.lit(t) for t in terms]), seen))
    return rows.groupBy("attribute").agg(lacking.alias("missing")).filter(F.size("missing") > 0)


def verify_training(rows: DataFrame, val_size: float, test_size: float) -> DataFrame:
    """One line per check: leakage, missing terms, shares."""
    leak = straddling_groups(rows).agg(F.lit("leakage").alias("check"), F.count(F.lit(1)).alias("problems"))
    lack = missing_terms(rows).agg(F.lit("missing_terms").alias("check"), F.count(F.lit(1)).alias("problems"))
    share = split_shares(rows, val_size, test_size).agg(F.lit("proportions").alias("check"), F.count_if(~F.col("ok")).alias("problems"))
    return leak.unionByName(lack).unionByName(share).withColumn("ok", F.col("problems") == 0)


def split_inventory(rows: DataFrame) -> DataFrame:
    """Rows, attributes and usable rating rows per split: tells whether a table can be evaluated."""
    return rows.groupBy("split").agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_distinct("attribute").alias("n_attributes"),
        F.count("avg_rating").alias("n_rated"),
    )


def column_profile(df: DataFrame, sentence: str | None = None) -> DataFrame:
    """Per column: type, nulls and share of nulls; rows and distinct sentences of the table. One pass."""
    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    aggs = [F.count(F.lit(1)).alias("_rows"), *[F.count_if(F.col(c).isNull()).alias(f"_null_{c}") for c in df.columns]]
    distinct = F.count_distinct(sentence) if sentence else F.lit(0)
    lines = F.explode(
        F.array(
            *[
                F.struct(F.lit(c).alias("column_name"), F.lit(kinds[c]).alias("kind"), F.col(f"_null_{c}").alias("null_count"))
                for c in df.columns
            ]
        )
    )
    one = df.agg(*aggs, distinct.alias("n_sentences"))
    return one.select("_rows", "n_sentences", lines.alias("line")).select(
        "line.column_name",
        "line.kind",
        F.col("_rows").alias("n_rows"),
        "n_sentences",
        "line.null_count",
        F.coalesce(F.try_divide(F.col("line.null_count") * 100.0, F.col("_rows")), F.lit(0.0)).alias("null_pct"),
    )


def read_binary(label: Column, blank: int | None = None) -> Column:
    """0 or 1; blank gives `blank`; anything else gives -1, for `invalid_labels` to find."""
    text = F.trim(label.cast("string"))
    number = text.try_cast("double")
    return F.when(text.isNull() | (text == ""), F.lit(blank).cast("int")).when(
        number.isin(0.0, 1.0), number.cast("int")
    ).otherwise(-1)


def read_gender(label: Column) -> Column:
    """One of four genders, whatever punctuation stuck to it; blank gives null, other words give `invalid`."""
    bare = F.nullif(F.regexp_replace(F.lower(label), "[^a-z]", ""), F.lit(""))
    return F.when(bare.isNull() | bare.isin("male", "female", "nonbinary", "unknown"), bare).otherwise("invalid")


def invalid_labels(df: DataFrame, binary: Sequence[str] = (), gender: Sequence[str] = ()) -> DataFrame:
    """Values of label columns that are neither blank nor allowed, with their counts."""
    checks = [(c, read_binary(F.col(c)) == -1) for c in binary] + [(c, read_gender(F.col(c)) == "invalid") for c in gender]
    cells = F.array(*[F.struct(F.lit(c).alias("label_name"), F.col(c).cast("string").alias("value"), F.coalesce(bad, F.lit(False)).alias("bad")) for c, bad in checks])
    return df.select(F.explode(cells).alias("cell")).filter("cell.bad").groupBy("cell.label_name", "cell.value").agg(F.count(F.lit(1)).alias("n"))


def key_candidates(df: DataFrame, candidates: Sequence[Sequence[str]]) -> DataFrame:
    """For each candidate whose columns exist: rows, distinct keys and whether it is unique, in the given order."""
    usable = [(i, list(c)) for i, c in enumerate(candidates) if set(c) <= set(df.columns)]
    one = df.agg(
        F.count(F.lit(1)).alias("_rows"),
        *[F.count_distinct(F.struct(*c)).alias(f"_c{i}") for i, c in usable],
    )
    lines = F.explode(
        F.array(*[F.struct(F.lit(i).alias("priority"), F.lit(",".join(c)).alias("key"), F.col(f"_c{i}").alias("n_keys")) for i, c in usable])
    )
    return one.select("_rows", lines.alias("line")).select(
        "line.priority", "line.key", F.col("_rows").alias("n_rows"), "line.n_keys", (F.col("_rows") == F.col("line.n_keys")).alias("is_unique")
    )


def unknown_values(df: DataFrame, column: str, allowed: Sequence[str]) -> DataFrame:
    """Values outside the allowed set with their counts; a missing value counts as outside."""
    ok = F.coalesce(F.col(column).isin(*allowed), F.lit(False))
    return df.filter(~ok).groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("n"))


def refuse_unknown(df: DataFrame, column: str, allowed: Sequence[str]) -> DataFrame:
    """The rows as they are; the job fails on the first value outside the allowed set."""
    ok = F.coalesce(F.col(column).isin(*allowed), F.lit(False))
    fail = F.raise_error(F.concat(F.lit(f"unexpected {column}: "), F.coalesce(F.col(column), F.lit("<missing>"))))
    return df.withColumn(column, F.when(ok, F.col(column)).otherwise(fail.cast("string")))


def test_items(rows: DataFrame) -> DataFrame:
    """Human averages of the test rows."""
    return rows.filter(F.col("split") == "test").select("attribute", "person_term", "avg_rating")


def test_attributes(rows: DataFrame) -> DataFrame:
    return rows.filter(F.col("split") == "test").select("attribute").distinct()

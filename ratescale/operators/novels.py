"""Statistics of extracted phrases per novel and over all novels. Null phrases mark sentences without one."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ratescale.functions.text import genders_match
from ratescale.functions.terms import file_stem, numeric_prefix
from ratescale.operators.clean import front_columns, valid_attribute
from ratescale.operators.joins import match_prefix, replicate_terms
from ratescale.operators.scale import attach_table, null_safe, top_per_group

BOOK = "source_novel"
# Label domains of the two gender columns.
LLM_GENDERS = ("female", "male", "unknown", "non-binary")
INTEXT_GENDERS = ("female", "male", "unknown", "evidence for both")


def with_phrase(phrases: DataFrame) -> DataFrame:
    return phrases.filter(F.col("attribute").isNotNull()).withColumn("attribute", F.trim("attribute"))


def gender_distribution(phrases: DataFrame, columns: Sequence[str] = ("intext_gender", "llm_gender")) -> DataFrame:
    """Count and percentage of each label of each gender column per novel, over rows that have a phrase."""
    cells = F.array(*[F.struct(F.lit(c).alias("label_source"), F.col(c).alias("label")) for c in columns])
    rows = with_phrase(phrases)
    counts = rows.select(BOOK, F.explode(cells).alias("c")).groupBy(BOOK, "c.label_source", "c.label").agg(F.count(F.lit(1)).alias("n"))
    totals = rows.groupBy(BOOK).agg(F.count(F.lit(1)).alias("_total"))
    return null_safe(counts.filter(F.col("label").isNotNull()), totals, [BOOK]).withColumn("pct", F.col("n") * 100.0 / F.col("_total")).drop("_total")


def gender_match_rate(phrases: DataFrame) -> DataFrame:
    ok = genders_match(F.col("intext_gender"), F.col("llm_gender"))
    return with_phrase(phrases).groupBy(BOOK).agg(
        F.count_if(ok).alias("n_match"), F.count(F.lit(1)).alias("n"), (F.count_if(ok) * 100.0 / F.count(F.lit(1))).alias("pct_match")
    )


def attribute_frequency(phrases: DataFrame) -> DataFrame:
    """Count of each phrase per novel and its percentage of the novel's phrases."""
    counts = with_phrase(phrases).groupBy(BOOK, "attribute").agg(F.count(F.lit(1)).alias("n"))
    totals = counts.groupBy(BOOK).agg(F.sum("n").alias("_total"), F.count(F.lit(1)).alias("_rows"))
    joined = attach_table(counts, [BOOK], totals, ["_total"], "_rows")
    return joined.withColumn("pct", F.col("n") * 100.0 / F.col("_total")).drop("_total")


def top_attributes(phrases: DataFrame, k: int = 10) -> DataFrame:
    return top_per_group(attribute_frequency(phrases), [BOOK], [F.desc("n"), F.asc("attribute")], k)


def _features() -> list[Column]:
    has = F.col("attribute").isNotNull()
    sentences, having = F.count_distinct("text_id"), F.count_distinct(F.when(has, F.col("text_id")))
    total = F.count("attribute")
    in_domain = F.count_if(has & F.col("indomain_strct"))
    return [
        sentences.alias("total_sentences"),
        having.alias("sentences_with"),
        (sentences - having).alias("sentences_without"),
        F.coalesce(F.try_divide(having * 100.0, sentences), F.lit(0.0)).alias("pct_with"),
        total.alias("total_attributes"),
        F.count_distinct(F.trim("attribute")).alias("unique_attributes"),
        F.coalesce(F.try_divide(total.cast("double"), having), F.lit(0.0)).alias("per_sentence"),
        in_domain.alias("indomain"),
        F.count_if(has & ~F.col("indomain_strct")).alias("outdomain"),
        F.coalesce(F.try_divide(in_domain * 100.0, total), F.lit(0.0)).alias("pct_indomain"),
    ]


def novel_features(phrases: DataFrame) -> DataFrame:
    """Sentences with and without phrases, phrase counts, distinct phrases and the in-domain share per novel."""
    return phrases.groupBy(BOOK).agg(*_features())


def attributes_by_gender(phrases: DataFrame, columns: Sequence[str] = ("llm_gender", "intext_gender")) -> DataFrame:
    cells = F.array(*[F.struct(F.lit(c).alias("label_source"), F.col(c).alias("label")) for c in columns])
    rows = with_phrase(phrases).select(BOOK, "attribute", F.explode(cells).alias("c")).filter("c.label is not null")
    return rows.groupBy(BOOK, "c.label_source", "c.label").agg(F.count(F.lit(1)).alias("total"), F.count_distinct("attribute").alias("n_unique"))


def _label_columns() -> list[Column]:
    has = F.col("attribute").isNotNull()
    name = lambda s: s.replace(" ", "_").replace("-", "_")
    return [F.count_if(has & (F.col("llm_gender") == g)).alias(f"llm_{name(g)}") for g in LLM_GENDERS] + [
        F.count_if(has & (F.col("intext_gender") == g)).alias(f"intext_{name(g)}") for g in INTEXT_GENDERS
    ]


def wide_statistics(phrases: DataFrame) -> DataFrame:
    """One row per novel: features and a count column per label of the fixed domains."""
    return phrases.groupBy(BOOK).agg(*_features(), *_label_columns())


def corpus_summary(phrases: DataFrame) -> DataFrame:
    """One row over all novels; sentences count per novel, distinct phrases across novels.

    All counts are taken per sentence first and added up per novel, so the distinct sentences need no copies of the rows; the distinct
    phrases are a scan of their own.
    """
    has = F.col("attribute").isNotNull()
    ok = genders_match(F.col("intext_gender"), F.col("llm_gender"))
    counts = {
        "total_attributes": F.count("attribute"),
        "indomain": F.count_if(has & F.col("indomain_strct")),
        "outdomain": F.count_if(has & ~F.col("indomain_strct")),
        "total_matches": F.count_if(has & ok),
        "total_comparisons": F.count_if(has),
    }
    named = phrases.groupBy(BOOK, "text_id").agg(*[c.alias(n) for n, c in counts.items()], *_label_columns(), F.bool_or(has).alias("_with"))
    labels = [c for c in named.columns if c.startswith(("llm_", "intext_"))]
    novels = named.groupBy(BOOK).agg(
        F.count("text_id").alias("total_sentences"),
        F.count_if(F.col("text_id").isNotNull() & F.col("_with")).alias("sentences_with"),
        *[F.sum(c).alias(c) for c in (*counts, *labels)],
    )
    unique = phrases.select(F.trim("attribute").alias("_phrase")).distinct().agg(F.count("_phrase")).scalar()
    sums = novels.agg(
        F.count(F.lit(1)).alias("total_novels"),
        *[F.sum(c).alias(c) for c in ("total_sentences", "sentences_with", "total_attributes", "indomain", "outdomain", *labels)],
        F.avg("total_sentences").alias("avg_sentences"),
        F.avg("total_attributes").alias("avg_attributes"),
        F.coalesce(F.try_divide(F.sum("indomain") * 100.0, F.sum("total_attributes")), F.lit(0.0)).alias("pct_indomain"),
        F.sum("total_matches").alias("total_matches"),
        F.sum("total_comparisons").alias("total_comparisons"),
    )
    front = [c for c in sums.columns if c not in ("total_matches", "total_comparisons")]
    sums = sums.select(*front, unique.alias("unique_attributes"), "total_matches", "total_comparisons")
    return sums.withColumn("pct_match", F.coalesce(F.try_divide(F.col("total_matches") * 100.0, F.col("total_comparisons")), F.lit(0.0)))


# Columns of the merged fact table.
MERGED_FRONT = ("attribute", "person_term", "predicted_rating", "source", "gutenberg_id", "author_gender", "llm_gender")
MERGED_DROP = ("llm_response", "attribute_original", "attribute", "intext_gender")


def merge_extracted(phrases: DataFrame, rules: Sequence[tuple[str, str, str]], path: str = "path") -> DataFrame:
    """Extracted phrases of all novels as a table to be scored: source and author by file name, one row per term."""
    stem = file_stem(F.col(path))
    named = match_prefix(phrases, stem, rules, strict=True).withColumn("gutenberg_id", numeric_prefix(stem))
    valid = named.filter(valid_attribute(F.col("attribute_normalized")))
    shaped = valid.drop(*MERGED_DROP, path).withColumnRenamed("attribute_normalized", "attribute")
    rows = replicate_terms(shaped, ("man", "woman", "nonbinary person")).withColumn("predicted_rating", F.lit(None).cast("double"))
    return front_columns(rows, MERGED_FRONT)

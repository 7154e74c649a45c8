"""Whole jobs: ratings to training table, responses to summary, documents to scored facts, ratings to ceilings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ratescale.functions.novel_rules import NOVEL_RULES
from ratescale.functions.text import Lexicon
from ratescale.operators import clean, extraction, joins, metrics, novels, ratings, reliability, resample, responses, scoring, splits
from ratescale.schemas import DATASET_OF_SOURCE


def training_table(rows: DataFrame, template: str, test_size: float = 0.3, val_size: float = 0.0, seed: int = 123, wide: bool = False) -> DataFrame:
    """Clean ratings, split by attribute, averaged per item, with prompts; or one row per attribute.

    The split belongs to the attribute, so it is put on the averaged items, not on every rating; sizes still
    count ratings.
    """
    kept = clean.clean_ratings(rows)
    groups = splits.split_groups(kept, test_size, val_size, seed).select("attribute", "split")
    items = ratings.item_averages(kept).join(groups, "attribute", "left")
    if wide:
        return ratings.pivot_terms(items, ["attribute", "split"])
    return ratings.training_rows(items, template)


def response_summary(rows: DataFrame, n_boot: int = 0, ceilings: DataFrame | None = None) -> dict[str, DataFrame]:
    """Metrics, abstention, agreement and validity of stored responses, with reliability ceilings if given."""
    parsed = responses.parse_responses(rows) if "method1_rating" not in rows.columns else rows
    table = metrics.response_metrics(parsed)
    out = {
        "metrics": joins.attach_ceiling(table, ceilings) if ceilings is not None else table,
        "abstention": responses.abstention_rates(responses.flag_abstention(parsed)),
        "agreement": metrics.method_agreement(parsed, ["model", "dataset"]),
        "invalid": metrics.invalid_counts(parsed, ["model", "dataset"]),
        "ranking": metrics.mean_term_correlation(metrics.term_correlations(parsed)),
    }
    if n_boot:
        own = parsed.select("model", "dataset", "attribute", "person_term", F.col("method1_rating").cast("double").alias("predicted"), "avg_rating")
        out["intervals"] = resample.bootstrap(own, "predicted", "avg_rating", ["model", "dataset"], ["attribute", "person_term"], n_boot)
    return out


def scored_facts(
    documents: DataFrame,
    lexicon: Lexicon,
    scorer: scoring.Scorer | Column,
    extractor: extraction.Extractor | None = None,
    rules: Sequence[tuple[str, str, str]] = NOVEL_RULES,
    finished: DataFrame | None = None,
    key: str = "doc_id",
) -> DataFrame:
    """Documents (key = file stem) to one scored row per phrase and term."""
    phrases = extraction.extract_phrases(documents, lexicon, extractor, key)["phrases"]
    merged = novels.merge_extracted(phrases.withColumn("path", F.concat(F.col(key), F.lit(".csv"))), rules)
    return scoring.score_distinct(merged, scorer, finished)


def ceilings(rows: DataFrame, test_only: bool = False, **split) -> DataFrame:
    """Leave-one-out and intraclass ceilings per dataset and term, on all ratings or on the test rows."""
    kept = splits.rebuild_test_rows(rows, **{"test_size": 0.25, "val_size": 0.15, "seed": 42, **split}) if test_only else rows
    return reliability.ceiling_table(kept)


def ceiling_for_metrics(table: DataFrame) -> DataFrame:
    """The `ALL` rows of a ceiling table under dataset labels, with the pooled row."""
    whole = table.filter("person_term = 'ALL'").select("dataset", F.col("mean").alias("loo"), F.col("icc_1_k_sqrt").alias("sqrt_icc"))
    return joins.ceiling_lookup(whole, DATASET_OF_SOURCE)

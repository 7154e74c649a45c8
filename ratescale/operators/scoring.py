"""Batch scoring of distinct items with a pluggable scorer, resume and join back.

A scorer is a function from a pandas frame of one Arrow batch to a frame with the columns of `SCORES`, or a
Column expression. Spark partitions the work; a failing batch is halved until the failing rows are alone, and a
failing row becomes a row with an error text, so one bad input never fails the job and no answered row is asked again.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ratescale.functions.parse import rating_tolerant
from ratescale.functions.terms import term_index
from ratescale.operators.joins import ITEM, attach_scores, pending, replicate_terms
from ratescale.schemas import TERMS
from ratescale.session import cut_lineage

Scorer = Callable[[pd.DataFrame], pd.DataFrame]
SCORES = "predicted_rating double, generation string"
ERROR_PREFIX = "ERROR"


def lexical_score(attribute: Column, term: Column) -> Column:
    """A repeatable score in 1..7 from the text alone; stands in for a model in tests and examples."""
    digits = F.substring(F.md5(F.concat_ws("|", attribute, term)), 1, 4)
    return F.lit(1.0) + F.pmod(F.conv(digits, 16, 10).cast("long"), F.lit(7)).cast("double")


def score_batches(pairs: DataFrame, scorer: Scorer, retries: int = 1, tasks: int | None = None) -> DataFrame:
    """Pairs with predicted_rating, generation and error.

    `tasks` sets how many tasks call the scorer; without it, small data may end up in one.
    """
    if tasks:
        pairs = pairs.repartition(tasks)
    names = list(pairs.columns)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pairs.schema.fields) + f", {SCORES}, error string"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            ratings, texts, errors = [None] * len(batch), [None] * len(batch), [None] * len(batch)
            parts = [(0, len(batch))]
            while parts:
                start, end = parts.pop()
                one = end - start == 1
                for _ in range(retries + 1 if one else 1):
                    try:
                        out = scorer(batch.iloc[start:end])
                        if len(out) != end - start:
                            raise ValueError(f"{len(out)} answers to {end - start} rows")
                        ratings[start:end], texts[start:end], errors[start:end] = out["predicted_rating"].tolist(), out["generation"].tolist(), [None] * len(out)
                        break
                    except Exception as e:  # noqa: BLE001 - any scorer failure is isolated
                        error = f"{type(e).__name__}: {e}"
                        if one:
                            texts[start], errors[start] = f"{ERROR_PREFIX}: {error}", error
                else:
                    if not one:  # none of these rows has an answer yet
                        middle = (start + end) // 2
                        parts += [(middle, end), (start, middle)]
            values = {"predicted_rating": (ratings, "float64"), "generation": (texts, object), "error": (errors, object)}
            yield batch.assign(**{name: pd.Series(v, index=batch.index, dtype=kind) for name, (v, kind) in values.items()})

    return pairs.mapInPandas(run, schema).select(*names, "predicted_rating", "generation", "error")


def score_column(pairs: DataFrame, expression: Column) -> DataFrame:
    return pairs.withColumn("predicted_rating", expression.cast("double")).withColumn("generation", F.lit(None).cast("string")).withColumn(
        "error", F.lit(None).cast("string")
    )


def _score(pairs: DataFrame, scorer: Scorer | Column, tasks: int | None) -> DataFrame:
    """Answers of a plug-in are written to the checkpoint folder, so that no pair is asked twice."""
    return score_column(pairs, scorer) if isinstance(scorer, Column) else cut_lineage(score_batches(pairs, scorer, tasks=tasks))


def finished_pairs(results: DataFrame) -> Column:
    """A result counts as finished if it has a rating and its text is no error."""
    done = F.col("predicted_rating").isNotNull()
    return done & ~F.coalesce(F.startswith("generation", F.lit(ERROR_PREFIX)), F.lit(False)) if "generation" in results.columns else done


def score_distinct(rows: DataFrame, scorer: Scorer | Column, finished: DataFrame | None = None, limit: int | None = None, tasks: int | None = None) -> DataFrame:
    """Every distinct attribute and term scored once, results of an earlier run reused, scores put on all rows."""
    pairs = rows.select(*ITEM).distinct()
    if finished is not None:
        done = finished.filter(finished_pairs(finished)).groupBy(*ITEM).agg(F.max("predicted_rating").alias("predicted_rating"))
        todo = pending(pairs, done)
    else:
        done, todo = None, pairs
    if limit is not None:  # the caller asked for the first pairs only
        todo = todo.orderBy(*ITEM).limit(limit)
    scores = _score(todo, scorer, tasks).select(*ITEM, "predicted_rating")
    if done is not None:
        scores = scores.unionByName(done)
    return attach_scores(rows, scores)


def score_attributes(attributes: DataFrame, scorer: Scorer | Column, finished: DataFrame | None = None, terms: Sequence[str] = TERMS, tasks: int | None = None) -> DataFrame:
    """All attributes with all terms, minus finished pairs, scored; finished results are kept as they are."""
    wanted = replicate_terms(attributes.select("attribute").distinct(), terms)
    if finished is None:
        return _score(wanted, scorer, tasks)
    kept = finished.filter(finished_pairs(finished)).select(*ITEM, "predicted_rating", "generation").withColumn("error", F.lit(None).cast("string"))
    return kept.unionByName(_score(pending(wanted, kept), scorer, tasks))


def failed_rows(scored: DataFrame) -> DataFrame:
    return scored.filter(F.col("error").isNotNull())


def pick_term_output(scored: DataFrame, outputs: str = "outputs") -> DataFrame:
    """From three outputs per row, the one of the row's term."""
    return scored.withColumn("predicted_rating", F.get(F.col(outputs), term_index(F.col("person_term"))))


def parse_generations(scored: DataFrame) -> DataFrame:
    """Ratings read from the generated text where the scorer gave only text."""
    return scored.withColumn("predicted_rating", F.coalesce("predicted_rating", rating_tolerant(F.col("generation")).cast("double")))


def first_attributes(rows: DataFrame, n: int) -> DataFrame:
    """The first n attributes by name."""
    return rows.select("attribute").distinct().orderBy("attribute").limit(n)

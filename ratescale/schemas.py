"""Table schemas, the term domain and the edge check on columns."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import types as T

# The three person terms, the rating scale and the six attention-check items.
TERMS = ("woman", "man", "nonbinary person")
RATING_MIN, RATING_MAX = 1, 7
ATTENTION_CHECKS = (
    "a balding crown",
    "a bushy beard",
    "a muscular neck",
    "an androgynous build",
    "an hourglass figure",
    "curled eyelashes",
)

# Dataset keys and the split names with their tolerance.
DATASET_OF_SOURCE = {"llm": "combined_llm", "human": "eval_human", "novel": "eval_novel"}
SOURCES = ("llm", "human", "novel")
HELD_OUT_SOURCES = ("human", "novel")
SPLITS = ("train", "val", "test")
SPLIT_TOLERANCE = 0.05


def _of(kind: T.DataType, *names: str) -> list[T.StructField]:
    return [T.StructField(n, kind) for n in names]


TEXT, NUMBER, WHOLE, FLAG = T.StringType(), T.DoubleType(), T.LongType(), T.BooleanType()

RATINGS = T.StructType([
    *_of(TEXT, "submission_id", "prolific_id", "attribute", "person_term"),
    *_of(NUMBER, "rating"),
    *_of(TEXT, "source"),
])
TRAINING = T.StructType([
    *_of(TEXT, "prompt", "attribute", "person_term"),
    *_of(NUMBER, "avg_rating", "rating_variance"),
    *_of(TEXT, "split"),
])
RESPONSES = T.StructType([
    *_of(TEXT, "attribute", "person_term", "generation"),
    *_of(NUMBER, "method1_rating", "method2_rating"),
    *_of(TEXT, "topk_tokens", "model"),
    *_of(NUMBER, *[f"logit_{i}" for i in range(RATING_MIN, RATING_MAX + 1)], "avg_rating"),
])
PHRASES = T.StructType([
    *_of(WHOLE, "text_id", "attribute_text_id"),
    *_of(TEXT, "text", "attribute", "intext_gender", "llm_gender", "llm_reasoning"),
    *_of(FLAG, "gender_match", "indomain_strct"),
    *_of(TEXT, "llm_response", "attribute_original", "attribute_normalized"),
])
SKIPPED = T.StructType([
    *_of(WHOLE, "sentence_idx"),
    *_of(TEXT, "text", "error"),
])
PREDICTIONS = T.StructType([
    *_of(TEXT, "attribute", "person_term"),
    *_of(NUMBER, "predicted", "true", "error"),
])
EVAL_METRICS = T.StructType([
    *_of(TEXT, "category"),
    *_of(NUMBER, "mse", "rmse", "mae", "correlation"),
])
EXTRACTION = T.StructType(
    [
        T.StructField("original_sentence", T.StringType()),
        T.StructField(
            "physical_attributes",
            T.ArrayType(
                T.StructType(
                    [
                        T.StructField("attribute", T.StringType()),
                        T.StructField("gender", T.StringType()),
                        T.StructField("reasoning", T.StringType()),
                    ]
                )
            ),
        ),
    ]
)


def require_columns(df: DataFrame, names: Iterable[str]) -> DataFrame:
    """Refuse a table that lacks a needed column."""
    missing = sorted(set(names) - set(df.columns))
    if missing:
        raise ValueError(f"missing columns {missing}; got {df.columns}")
    return df

"""Person terms, scale conversion, prompts, experiment names and ids in file names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ratescale.schemas import RATING_MAX, RATING_MIN

# Name formats of experiments, runs and seed folders.
FOLD_SUFFIX = r"^(.+)_fold(\d+)of(\d+)$"
RUN_NAME = r"run_(\d{8}_\d{6})"
SEED_NAME = r"seed(\d+)"
OVERALL_NAMES = ("mean", "overall", "avg", "average")


def blank_to_null(text: Column) -> Column:
    return F.nullif(F.trim(text), F.lit(""))


def normalize_term(term: Column) -> Column:
    """woman is tested before man, since "woman" contains "man"; other names stay, in lower case."""
    t = F.lower(blank_to_null(term))
    return (
        F.when(F.contains(t, F.lit("woman")), "woman")
        .when((t == "male") | F.contains(t, F.lit("man")), "man")
        .when(F.contains(t, F.lit("nonbinary")), "nonbinary")
        .otherwise(t)
    )


def term_index(term: Column) -> Column:
    t = normalize_term(term)
    return F.when(t == "woman", 0).when(t == "man", 1).when(F.contains(t, F.lit("nonbinary")) | F.contains(t, F.lit("non-binary")), 2)


def term_slug(term: Column) -> Column:
    return F.when(term == "nonbinary person", "nonbinary").otherwise(F.replace(term, F.lit(" "), F.lit("_")))


def normalize_category(value: Column) -> Column:
    """Categories of a metrics file: the overall row is `mean`; names that are no category give null."""
    v = F.lower(blank_to_null(value))
    return (
        F.when(v.isin(*OVERALL_NAMES), "mean")
        .when(F.contains(v, F.lit("woman")), "woman")
        .when(F.contains(v, F.lit("man")), "man")
        .when(F.contains(v, F.lit("nonbinary")) & F.contains(v, F.lit("person")), "nonbinary person")
        .when(F.contains(v, F.lit("nonbinary")), "nonbinary")
    )


def to_unit(rating: Column) -> Column:
    return (rating - RATING_MIN) / (RATING_MAX - RATING_MIN)


def from_unit(value: Column) -> Column:
    return value * (RATING_MAX - RATING_MIN) + RATING_MIN


def render_prompt(template: str, attribute: Column, term: Column | None = None) -> Column:
    """Fill `{attribute}` and `{person_term}`; a template that names the term needs one."""
    if "{person_term}" in template and term is None:
        raise ValueError("the template asks for a person term")
    out = F.replace(F.lit(template), F.lit("{attribute}"), attribute)
    return F.replace(out, F.lit("{person_term}"), term) if term is not None else out


def question(attribute: Column) -> Column:
    """The question shown to annotators."""
    # The wording of the question.
    return F.concat(F.lit("How likely is it for someone to say a woman/man/non-binary person has "), attribute, F.lit("?"))


def _group(text: Column, pattern: str, i: int = 1) -> Column:
    return F.nullif(F.regexp_extract(text, pattern, i), F.lit(""))


def hyperparameter_suffix(values: dict[str, Column | None]) -> Column:
    """`alias+value` for every hyperparameter, in key order; floats as 1e-4."""
    # Short names of hyperparameters.
    alias = {"learning_rate": "lr", "batch_size": "bs", "lora_r": "r", "lora_alpha": "alpha"}
    parts = []
    for key in sorted(values):
        number = values[key]
        shown = F.replace(F.replace(F.format_string("%.0e", number.cast("double")), F.lit("+0"), F.lit("")), F.lit("-0"), F.lit("-"))
        whole = number.cast("double") == F.floor(number.cast("double"))
        parts.append(F.concat(F.lit(alias.get(key, key.replace("_", ""))), F.when(whole, number.cast("long").cast("string")).otherwise(shown)))
    return F.concat_ws("_", *parts)


def experiment_name(data: Column, model: Column, prompt: Column, values: dict[str, Column] | None = None) -> Column:
    parts = [data, model, prompt] + ([hyperparameter_suffix(values)] if values else [])
    return F.concat_ws("_", *parts)


def base_config(exp: Column) -> Column:
    return F.coalesce(_group(exp, FOLD_SUFFIX), exp)


def fold_number(exp: Column) -> Column:
    return _group(exp, FOLD_SUFFIX, 2).cast("int")


def seed_number(name: Column) -> Column:
    return _group(name, SEED_NAME).cast("int")


def run_time(name: Column) -> Column:
    return F.try_to_timestamp(_group(name, RUN_NAME), F.lit("yyyyMMdd_HHmmss"))


def numeric_prefix(stem: Column) -> Column:
    return _group(stem, r"^(\d+)_")


def file_stem(path: Column) -> Column:
    return F.regexp_replace(F.regexp_extract(path, r"([^/]+)$", 1), r"\.[^.]*$", "")

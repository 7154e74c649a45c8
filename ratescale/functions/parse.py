"""Ratings and abstentions read out of free text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ratescale.schemas import RATING_MAX, RATING_MIN

# The patterns and words that decide what counts as a rating.
BARE_DIGIT = r"\b([1-7])(?:\.0?|[\s.,;:)!?\]]|$)"
ORDINAL = r"(?i)\b([1-7])(?:st|nd|rd|th)\b"
ISOLATED_DIGIT = r"\b([1-7])\b"
RATING_WORDS = ("one", "two", "three", "four", "five", "six", "seven")
WORDS = r"\b(" + "|".join(RATING_WORDS) + r")\b"

# The phrases of the five abstention families.
ABSTENTION_FAMILIES = {
    "cannot_judge": r"cannot|can not|can't|cant|unable to|cannot determine|can't determine|cannot say|can't say|"
    r"cannot answer|can't answer|no way to know|unknown|insufficient (?:information|context|data)|"
    r"not enough (?:information|context|data)",
    "depends_subjective": r"matter of opinion|personal preference",
    "unrelated_irrelevant": r"unrelated|irrelevant|not related|does(?:n't| not) relate|off[- ]topic",
    "any_person_no_difference": r"like any person|like anyone|either gender|both genders|regardless of gender|"
    r"same for (?:all )?(?:genders|people)|like anyone else|like any one|like any person|like all people|"
    r"no (?:gender )?difference|equally likely",
    "refusal_or_policy": r"i (?:won't|will not|can't|cannot) (?:answer|provide)|as an ai|i do not have enough",
}


def strip(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def _first(text: Column, pattern: str) -> Column:
    return F.nullif(F.regexp_extract(text, pattern, 1), F.lit("")).cast("int")


def rating_tolerant(text: Column) -> Column:
    """Digit, then number word, then ordinal, then any lone digit 1-7.

    A digit followed by a point already counts, so "4.5" gives 4. The stripped text is bound once, as the
    element of a one-value array, to keep the expression small.
    """

    def read(s: Column) -> Column:
        found = F.regexp_extract_all(F.lower(s), F.lit(WORDS), F.lit(1))
        word = F.array_min(F.transform(found, lambda w: F.array_position(F.array(*[F.lit(x) for x in RATING_WORDS]), w))).cast("int")
        return F.coalesce(_first(s, BARE_DIGIT), word, _first(s, ORDINAL), _first(s, ISOLATED_DIGIT))

    return F.get(F.transform(F.array(strip(text)), read), F.lit(0))


def rating_strict(text: Column) -> Column:
    """The first lone digit 1-7."""
    return _first(text, ISOLATED_DIGIT)


def rating_from_ranked(tokens: Column) -> Column:
    """The first token of a ranked list that reads as a rating. A JSON text is read as a list."""
    return F.get(F.filter(F.transform(tokens, rating_tolerant), lambda r: r.isNotNull()), F.lit(0))


def tokens_from_json(text: Column) -> Column:
    return F.from_json(text, "array<string>")


def rating_from_scores(prefix: str = "logit_") -> Column:
    """The rating with the highest score among the columns `logit_1` to `logit_7`; the lower rating on ties."""
    scored = F.array(
        *[
            F.struct(F.nanvl(F.col(f"{prefix}{i}").cast("double"), F.lit(None).cast("double")).alias("score"), F.lit(-i).alias("neg"))
            for i in range(RATING_MIN, RATING_MAX + 1)
        ]
    )
    best = F.array_max(F.filter(scored, lambda s: s["score"].isNotNull()))
    return -best["neg"]


def clean_rating(value: Column) -> Column:
    """A rating as a double; -1, NaN and texts that are no number count as missing."""
    return F.nullif(F.nanvl(value.try_cast("double"), F.lit(None).cast("double")), F.lit(-1.0))


def in_scale(value: Column) -> Column:
    return value.between(RATING_MIN, RATING_MAX)


def abstention_categories(text: Column) -> Column:
    """Names of the families whose phrases occur in the text, in the order they are listed."""
    hits = [F.when(F.regexp_like(text, F.lit(rf"(?i)\b({p})\b")), F.lit(n)) for n, p in ABSTENTION_FAMILIES.items()]
    return F.coalesce(F.array_compact(F.array(*hits)), F.array().cast("array<string>"))


def escape_newlines(text: Column) -> Column:
    return F.replace(text, F.lit("\n"), F.lit("\\n"))


def composite_id(*parts: Column | str) -> Column:
    """Parts joined by a double pipe; a missing part is empty, so ids of different parts stay apart."""
    cols = [F.col(p) if isinstance(p, str) else p for p in parts]
    return F.concat_ws("||", *[F.coalesce(c.cast("string"), F.lit("")) for c in cols])

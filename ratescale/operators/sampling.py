"""Repeatable samples: per book, balanced, stratified; quotas, reports and annotation sheets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ratescale.functions.terms import question
from ratescale.operators.scale import first_per_key, hash_order, null_safe, take_by_hash, value_prefix
from ratescale.session import cut_lineage

RESPONSE = ["model", "attribute", "person_term", "generation"]
SHEET_COLUMNS = ["item_id", "attribute", "person_term", "generation"]
SHEET_BLANKS = ["abstention", "caveat", "remarks (optional)"]
PHRASE_BLANKS = ["physical attribute", "contextually well-formed", "character gender", "remarks (optional)"]


def balanced_quotas(rows: DataFrame, flag: str, n: int, within: Sequence[str] = ()) -> DataFrame:
    """How many rows to take with and without the flag (null: without): half each, a shortage made up from the other side."""
    marked = F.coalesce(F.col(flag), F.lit(False))
    counts = rows.groupBy(*within).agg(F.count_if(marked).alias("_in"), F.count_if(~marked).alias("_out"), F.count(F.lit(1)).alias("_all"))
    have_in, have_out = F.col("_in"), F.col("_out")
    want_in, want_out = n // 2, n - n // 2
    take_in = F.when(F.col("_all") <= n, have_in).when(have_in < want_in, have_in).when(
        have_out < want_out, F.least(n - have_out, have_in)
    ).otherwise(want_in)
    take_out = F.when(F.col("_all") <= n, have_out).when(have_in < want_in, F.least(n - have_in, have_out)).when(
        have_out < want_out, have_out
    ).otherwise(want_out)
    both = F.array(
        F.struct(F.lit(True).alias(flag), take_in.cast("long").alias("_quota")), F.struct(F.lit(False).alias(flag), take_out.cast("long").alias("_quota"))
    )
    return counts.select(*within, F.explode(both).alias("q")).select(*within, "q.*")


def balanced_sample(rows: DataFrame, flag: str, n: int, key: Sequence[str], within: Sequence[str] = (), seed: int = 42) -> DataFrame:
    """n rows per group, half with the flag and half without as far as there are enough."""
    hashed = rows.withColumn("_h", hash_order(seed, *key)).withColumn("_side", F.coalesce(F.col(flag), F.lit(False)))
    quotas = balanced_quotas(rows, flag, n, within).withColumnRenamed(flag, "_side")
    return take_by_hash(hashed, "_h", list(key), quotas, [*within, "_side"]).drop("_h", "_side")


def uniform_sample(rows: DataFrame, n: int, key: Sequence[str], within: Sequence[str] = (), seed: int = 42) -> DataFrame:
    return take_by_hash(rows.withColumn("_h", hash_order(seed, *key)), "_h", list(key), n, within).drop("_h")


def sample_per_book(
    phrases: DataFrame, n: int, book: str = "source_novel", key: str = "attribute_normalized", balanced: str | None = None, seed: int = 42
) -> DataFrame:
    """n phrases per book and no phrase in two books; the earlier book (by name) has first choice.

    Choosing book after book is the same as letting all books choose at once and giving a phrase wanted by
    several to the earliest, until nobody loses a phrase: the losers go on without it. Each round is a few
    joins over all books. The pool is written once; a round writes its choice and the phrases lost so far, a few for each book.
    One row per book and phrase goes in.
    """
    fixed = cut_lineage(phrases.withColumn("_h", hash_order(seed, book, key)))
    pool, gone = fixed, None
    while True:  # every round takes a phrase from a book for good, so the rounds end
        if balanced:
            sides = balanced_quotas(pool, balanced, n, [book]).withColumnRenamed(balanced, "_side")
            marked = pool.withColumn("_side", F.coalesce(F.col(balanced), F.lit(False)))
            chosen = take_by_hash(marked, "_h", [key], sides, [book, "_side"]).drop("_side")
        else:
            chosen = take_by_hash(pool, "_h", [key], n, [book])
        chosen = cut_lineage(chosen)
        winners = chosen.groupBy(key).agg(F.min(book).alias("_winner"))
        lost = chosen.join(winners, key).filter(F.col(book) != F.col("_winner")).select(book, key)
        if lost.isEmpty():
            return chosen.drop("_h")
        gone = cut_lineage(lost if gone is None else gone.unionByName(lost))
        pool = fixed.join(gone, [book, key], "left_anti")


def stratum_quotas(rows: DataFrame, n: int, strata: Sequence[str]) -> DataFrame:
    """Shares of n per stratum, whole numbers by largest remainder (the smaller stratum key wins ties).

    If there are no more than n rows, each stratum keeps all of its rows. The strata are ranked by cuts of their remainders, so that
    no window holds all of them; their counts are written once, as the totals and the ranks read them.
    """
    counts = cut_lineage(rows.groupBy(*strata).agg(F.count(F.lit(1)).alias("size")))
    total = counts.agg(F.sum("size")).scalar()
    exact = F.col("size") * F.lit(float(n)) / total
    rest = F.round(exact - F.floor(exact), 9)
    shared = counts.withColumn("_floor", F.floor(exact)).withColumn("_order", F.struct((-rest).alias("_rest"), *strata)).withColumn("_one", F.lit(1))
    short = F.lit(n) - shared.agg(F.sum("_floor")).scalar()
    ranked = value_prefix(shared, "_order", "_one")
    quota = F.when(total <= n, F.col("size")).otherwise(F.least("size", F.col("_floor") + (F.col("_before") < short).cast("long")))
    return ranked.select(*strata, "size", quota.alias("quota"))


def stratified_sample(rows: DataFrame, n: int, strata: Sequence[str], key: Sequence[str], seed: int = 42) -> DataFrame:
    """n rows with the strata in proportion; rows within a stratum by hash. Null strata are strata too."""
    quotas = stratum_quotas(rows, n, strata).select(*strata, F.col("quota").alias("_quota"))
    return take_by_hash(rows.withColumn("_h", hash_order(seed, *key)), "_h", list(key), quotas, strata).drop("_h")


def composition(population: DataFrame, sample: DataFrame, strata: Sequence[str]) -> DataFrame:
    """Counts and shares per stratum in the population and in the sample."""
    def side(df: DataFrame, name: str) -> DataFrame:
        total = df.agg(F.count(F.lit(1))).scalar()
        return df.groupBy(*strata).agg(F.count(F.lit(1)).alias(f"{name}_n")).withColumn(f"{name}_pct", F.try_divide(F.col(f"{name}_n").cast("double"), total))

    # the sample is part of the population, so the population has every stratum
    both = null_safe(side(population, "population"), side(sample, "sample"), strata, "left")
    filled = both.fillna(0, ["sample_n"]).fillna(0.0, ["sample_pct"])
    return filled.withColumn("pct_diff", F.col("sample_pct") - F.col("population_pct"))


def unique_responses(rows: DataFrame, order: Sequence[str] = ("dataset", "item_id")) -> DataFrame:
    """One row per model, attribute, term and text, the first by `order`."""
    return first_per_key(rows, RESPONSE, order)


def abstention_pool(records: DataFrame) -> DataFrame:
    return unique_responses(records.filter("system_abstention = 1"))


def rated_abstention_pool(records: DataFrame) -> DataFrame:
    return unique_responses(records.filter("text_abstention = 1 and missing_rating = 0"))


def non_abstention_pool(records: DataFrame) -> DataFrame:
    return records.filter("system_abstention = 0")


def sample_share(rows: DataFrame, share: float, strata: Sequence[str], key: Sequence[str], seed: int = 42) -> DataFrame:
    """A share of the rows, stratified. The number to take is counted first."""
    return stratified_sample(rows, round(share * rows.count()), strata, key, seed)


def positives_and_controls(records: DataFrame, share: float, strata: Sequence[str], seed: int = 42) -> DataFrame:
    """A share of the flagged responses and as many unflagged ones.

    Sampling reads its pool several times, so each pool is written to the checkpoint folder first.
    """
    flagged, unflagged = cut_lineage(abstention_pool(records)), cut_lineage(non_abstention_pool(records))
    positives = cut_lineage(sample_share(flagged, share, strata, ["item_id"], seed))
    controls = stratified_sample(unflagged, positives.count(), strata, ["item_id"], seed)
    return positives.unionByName(controls.select(*positives.columns))


def annotation_bundle(sample: DataFrame, seed: int = 42) -> dict[str, DataFrame]:
    """Ground truth in blind order, an empty sheet in the same order, and the counts. `position` keeps the order."""
    shuffled = sample.withColumn("position", hash_order(seed, "item_id"))
    sheet = shuffled.select("position", *SHEET_COLUMNS, *[F.lit("").alias(c) for c in SHEET_BLANKS])
    positives = F.count_if(F.col("system_abstention") == 1)
    meta = sample.agg(
        positives.alias("n_abstention"),
        F.count_if(F.col("system_abstention") == 0).alias("n_non_abstention"),
        F.count(F.lit(1)).alias("n_total"),
        F.try_divide(positives.cast("double"), F.count(F.lit(1))).alias("positive_rate"),
    )
    return {"groundtruth": shuffled, "sheet": sheet, "meta": meta}


def phrase_sheet(sample: DataFrame) -> DataFrame:
    """Annotation sheet of sampled phrases: the question after the text, then empty label columns."""
    out = []
    for c in sample.columns:
        out.append(F.col(c))
        if c == "text":
            out.append(question(F.col("attribute")).alias("question_context"))
    return sample.select(*out, *[F.lit("").alias(c) for c in PHRASE_BLANKS])

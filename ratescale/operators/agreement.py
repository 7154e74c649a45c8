"""Agreement of annotators with each other and with a reference label.

Annotations are long: item, annotator, label_name, label. Statistics start from counts per item and label, so
the number of annotators per item is free; a null label is missing.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ratescale.operators.scale import null_safe


def label_counts(labels: DataFrame, item: Sequence[str], by: Sequence[str]) -> DataFrame:
    """How often each label was given to each item."""
    return labels.filter(F.col("label").isNotNull()).groupBy(*by, *item, "label").agg(F.count(F.lit(1)).alias("c"))


def pairwise_agreement(labels: DataFrame, item: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Share of agreeing annotator pairs per item, averaged over the items with at least two labels."""
    items = label_counts(labels, item, by).groupBy(*by, *item).agg(
        F.sum("c").alias("m"), F.sum(F.col("c") * (F.col("c") - 1)).alias("agree")
    ).filter("m >= 2")
    return items.groupBy(*by).agg(F.avg(F.col("agree") / (F.col("m") * (F.col("m") - 1))).alias("pairwise_agreement"), F.count(F.lit(1)).alias("n_items"))


def krippendorff_alpha(labels: DataFrame, item: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Nominal alpha. Ordered pairs of an item all weigh the same and chance agreement is the sum of squared
    label shares, without the small-sample term; published figures use this form. Items with one label are left out."""
    counts = label_counts(labels, item, by)
    sizes = counts.groupBy(*by, *item).agg(F.sum("c").alias("m"))
    pairs = null_safe(counts, sizes, [*by, *item]).filter("m >= 2")
    per_label = pairs.groupBy(*by, "label").agg(
        F.sum(F.col("c") * (F.col("c") - 1)).alias("diag"), F.sum(F.col("c") * (F.col("m") - 1)).alias("margin")
    )
    total = per_label.groupBy(*by).agg(F.sum("diag").alias("diag"), F.sum("margin").alias("total"), F.sum(F.col("margin") * 1.0 * F.col("margin")).alias("sq"))
    observed = 1 - F.col("diag") / F.col("total")
    expected = 1 - F.col("sq") / (F.col("total") * 1.0 * F.col("total"))
    alpha = F.when(expected == 0, 1.0).otherwise(1 - F.try_divide(observed, expected))
    return total.filter("total > 0").select(*by, alpha.alias("alpha"))


def cohen_kappa(labels: DataFrame, item: Sequence[str], raters: tuple[str, str], by: Sequence[str] = ()) -> DataFrame:
    """Kappa of two annotators over the items both labelled; 1 if chance agreement is certain."""
    a, b = raters
    wide = labels.filter(F.col("annotator").isin(a, b)).groupBy(*by, *item).agg(
        F.min(F.when(F.col("annotator") == a, F.col("label"))).alias("a"), F.min(F.when(F.col("annotator") == b, F.col("label"))).alias("b")
    ).dropna(subset=["a", "b"])
    cells = wide.groupBy(*by, "a", "b").agg(F.count(F.lit(1)).alias("c"))
    sides = cells.select(*by, "a", "b", "c", F.explode(F.array(F.struct(F.lit(0).alias("side"), F.col("a").alias("label")), F.struct(F.lit(1).alias("side"), F.col("b").alias("label")))).alias("s"))
    margins = sides.groupBy(*by, F.col("s.label").alias("label")).agg(
        F.sum(F.when(F.col("s.side") == 0, F.col("c")).otherwise(0)).alias("ma"), F.sum(F.when(F.col("s.side") == 1, F.col("c")).otherwise(0)).alias("mb")
    )
    chance = margins.groupBy(*by).agg(F.sum(F.col("ma") * 1.0 * F.col("mb")).alias("cross"))
    seen = cells.groupBy(*by).agg(F.sum("c").alias("n"), F.sum(F.when(F.col("a") == F.col("b"), F.col("c")).otherwise(0)).alias("same"))
    both = null_safe(seen, chance, by) if by else seen.withColumn("cross", chance.select("cross").scalar())
    po, pe = F.col("same") / F.col("n"), F.col("cross") / (F.col("n") * 1.0 * F.col("n"))
    return both.select(*by, "n", F.when(pe == 1, 1.0).otherwise(F.try_divide(po - pe, 1 - pe)).alias("kappa"))


def confusion_metrics(labels: DataFrame, truth: str, by: Sequence[str] = ("annotator",)) -> DataFrame:
    """Accuracy, precision, recall and F1 of binary labels against `truth`; null on empty denominators."""
    t, p = F.col(truth), F.col("label")
    tp, tn = F.count_if((t == 1) & (p == 1)), F.count_if((t == 0) & (p == 0))
    fp, fn = F.count_if((t == 0) & (p == 1)), F.count_if((t == 1) & (p == 0))
    c = labels.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), tp.alias("tp"), tn.alias("tn"), fp.alias("fp"), fn.alias("fn"))
    prec = F.try_divide(F.col("tp").cast("double"), F.col("tp") + F.col("fp"))
    rec = F.try_divide(F.col("tp").cast("double"), F.col("tp") + F.col("fn"))
    out = c.withColumns({"accuracy": F.try_divide((F.col("tp") + F.col("tn")).cast("double"), F.col("n")), "precision": prec, "recall": rec})
    return out.withColumn("f1", F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def label_composition(sheets: DataFrame, a: str = "abstention", b: str = "caveat", by: Sequence[str] = ("annotator",)) -> DataFrame:
    """How often only one, both or none of two labels were given."""
    x, y = F.col(a) == 1, F.col(b) == 1
    c = sheets.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_if(x & ~y).alias(f"{a}_only"), F.count_if(~x & y).alias(f"{b}_only"),
        F.count_if(x & y).alias("both"), F.count_if(~x & ~y).alias("neither"), F.count_if(x).alias(f"n_{a}"), F.count_if(y).alias(f"n_{b}"),
        F.count_if(x | y).alias("n_combined"),
    )
    return c.withColumn("ratio", F.try_divide(F.col(f"n_{b}").cast("double"), F.col(f"n_{a}")))


def coverage(labels: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Share of filled labels and mean label, per key."""
    return labels.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), (F.count("label") / F.count(F.lit(1))).alias("coverage"), F.avg(F.col("label").try_cast("double")).alias("mean_score")
    )


def consistency(labels: DataFrame, reference: str, by: Sequence[str] = ("annotator",)) -> DataFrame:
    """Share of an annotator's labels that equal the reference."""
    return labels.filter(F.col("label").isNotNull()).groupBy(*by).agg(
        F.avg(F.col("label").eqNullSafe(F.col(reference)).cast("double")).alias("consistency"), F.count(F.lit(1)).alias("n")
    )


def mean_consistency(labels: DataFrame, reference: str) -> DataFrame:
    """Mean over annotators, each counting the same."""
    return consistency(labels, reference).agg(F.avg("consistency").alias("consistency"), F.count(F.lit(1)).alias("n_annotators"))


def majority_vote(labels: DataFrame, item: Sequence[str], reference: str) -> DataFrame:
    """Agreement of the majority label with the reference, ties skipped, and the share of ties among all items."""
    n_items = labels.select(*item).distinct().agg(F.count(F.lit(1))).scalar()
    counts = labels.filter(F.col("label").isNotNull()).groupBy(*item, "label").agg(F.count(F.lit(1)).alias("c"), F.min(reference).alias("ref"))
    votes = counts.groupBy(*item).agg(
        F.max("c").alias("top"), F.max_by("label", "c").alias("label"), F.min("ref").alias("ref"),
        # how many labels reach the top count: counts of an item's labels, at most one per annotator
        F.collect_list("c").alias("cs"),
    ).withColumn("tied", F.size(F.filter("cs", lambda c: c == F.col("top"))) > 1)
    clear = ~F.col("tied")
    return votes.agg(
        F.count_if(clear).alias("n_clear"),
        F.avg(F.when(clear, (F.col("label") == F.col("ref")).cast("double"))).alias("accuracy"),
        F.count_if(F.col("tied")).alias("n_tied"),
    ).withColumn("tie_rate", F.col("n_tied") / n_items)


def label_types(sheets: DataFrame, keep: Sequence[str]) -> DataFrame:
    """Abstention, caveat and either of them, as long labels; blanks count as 0."""
    a, c = F.coalesce("abstention", F.lit(0)), F.coalesce("caveat", F.lit(0))
    cells = F.array(*[F.struct(F.lit(n).alias("label_name"), v.cast("int").alias("label")) for n, v in (("abstention", a), ("caveat", c), ("combined", F.greatest(a, c)))])
    return sheets.select(*keep, F.explode(cells).alias("l")).select(*keep, "l.*")


def evaluate_label_types(sheets: DataFrame, item: Sequence[str], truth: str, raters: tuple[str, str]) -> DataFrame:
    """All agreement statistics per label type and, per annotator, accuracy against the system flag."""
    long = label_types(sheets, [*item, "annotator", truth])
    by = ["label_name"]
    inter = pairwise_agreement(long, item, by).join(krippendorff_alpha(long, item, by), by, "left").join(
        cohen_kappa(long, item, raters, by).select("label_name", "kappa"), by, "left"
    )
    own = confusion_metrics(long, truth, ["label_name", "annotator"])
    return own.join(inter, by, "left")

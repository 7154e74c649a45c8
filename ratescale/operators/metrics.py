"""Error and correlation metrics per slice, ranked cases and calibration.

A pair table has a predicted and a human column. Slices are grouping sets of one aggregate, so all of them
come from one scan with map-side combine.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from math import pi

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ratescale.functions.parse import clean_rating
from ratescale.functions.terms import normalize_term, term_slug
from ratescale.operators.scale import first_per_key, join_small, null_safe, partitions, range_ranks, top_per_group, value_prefix
from ratescale.schemas import RATING_MAX, RATING_MIN, TERMS
from ratescale.session import cut_lineage

TASK_CELLS = 500_000  # value cells of many small slices that one task ranks
METHODS = {"method1": "method1_rating", "method2": "method2_rating"}
CENTRE = (RATING_MIN + RATING_MAX) / 2


def pearson(x: Column, y: Column, on_degenerate: str = "null", least: int = 2) -> Column:
    """Correlation of complete pairs. With fewer than `least` pairs null; if a side is constant, 0 or null."""
    both = x.isNotNull() & y.isNotNull()
    cx, cy = F.when(both, x), F.when(both, y)
    varies = (F.min(cx) < F.max(cx)) & (F.min(cy) < F.max(cy))
    flat = F.lit(0.0) if on_degenerate == "zero" else F.lit(None).cast("double")
    r = F.try_divide(F.covar_pop(cx, cy), F.stddev_pop(cx) * F.stddev_pop(cy))
    return F.when(F.count(cx) < least, None).when(varies, F.greatest(F.lit(-1.0), F.least(F.lit(1.0), r))).otherwise(flat)


def error_columns(x: Column, y: Column) -> list[Column]:
    e = x - y
    return [
        F.count(e).alias("n"),
        F.avg(e * e).alias("mse"),
        F.sqrt(F.avg(e * e)).alias("rmse"),
        F.avg(F.abs(e)).alias("mae"),
    ]


def metrics_by(
    pairs: DataFrame,
    predicted: str,
    human: str,
    sets: Sequence[Sequence[str]],
    keys: Sequence[str],
    on_degenerate: str = "null",
    least: int = 2,
    label: str = "all",
) -> DataFrame:
    """Metrics for every grouping set; a key outside the set shows `label`."""
    x, y = F.col(predicted), F.col(human)
    grouped = pairs.groupingSets([[F.col(k) for k in s] for s in sets], *keys).agg(
        *error_columns(x, y),
        pearson(x, y, on_degenerate, least).alias("pearson_r"),
        *[F.grouping(k).alias(f"_g_{k}") for k in keys],
    )
    shown = [F.when(F.col(f"_g_{k}") == 1, label).otherwise(F.col(k)).alias(k) for k in keys]
    return grouped.select(*shown, "n", "mse", "rmse", "mae", "pearson_r")


def stratified_metrics(predictions: DataFrame, on_degenerate: str = "null") -> DataFrame:
    """Metrics overall, per term, per source and per term and source."""
    sets = [[], ["person_term"], ["source"], ["person_term", "source"]]
    return metrics_by(predictions, "predicted", "true_rating", sets, ["person_term", "source"], on_degenerate)


def evaluation_table(predictions: DataFrame) -> DataFrame:
    """One row per term and one named `mean` over all rows."""
    out = metrics_by(predictions, "predicted", "true_rating", [[], ["person_term"]], ["person_term"], "zero", label="mean")
    return out.withColumnsRenamed({"person_term": "category", "pearson_r": "correlation"}).drop("n")


def evaluation_table_wide(wide: DataFrame, terms: Sequence[str] = TERMS) -> DataFrame:
    """The same from one column per term; `mean` is then the mean of the terms' metrics."""
    cells = F.array(
        *[F.struct(F.lit(t).alias("category"), F.col(f"`pred_{t}`").alias("p"), F.col(f"`true_{t}`").alias("y")) for t in terms]
    )
    long = wide.select(F.explode(cells).alias("c")).select("c.*")
    each = long.groupBy("category").agg(*error_columns(F.col("p"), F.col("y")), pearson(F.col("p"), F.col("y"), "zero").alias("correlation")).drop("n")
    return with_mean_row(each, "category", ["mse", "rmse", "mae", "correlation"])


def with_mean_row(metrics: DataFrame, category: str, columns: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """Add a `mean` row, the mean of the categories, to every group that has none."""
    mean = metrics.groupBy(*keys).agg(
        *[F.avg(F.when(F.col(category) != "mean", F.col(c))).alias(c) for c in columns],
        F.bool_or(F.col(category) == "mean").alias("_has"),
    )
    fill = mean.filter("not _has").select(*keys, F.lit("mean").alias(category), *columns)
    return metrics.select(*keys, category, *columns).unionByName(fill)


def unpivot_methods(responses: DataFrame, keys: Sequence[str], methods: Mapping[str, str] = METHODS) -> DataFrame:
    """One row per response and method with a clean rating; the human average stays."""
    cells = F.array(*[F.struct(F.lit(m).alias("method"), clean_rating(F.col(c)).alias("predicted")) for m, c in methods.items()])
    return responses.select(*keys, "avg_rating", F.explode(cells).alias("_m")).select(*keys, "avg_rating", "_m.*")


def response_metrics(responses: DataFrame) -> DataFrame:
    """Metrics per model, dataset (and pooled), method and term (and all terms)."""
    keys = ["model", "dataset", "person_term"]
    long = unpivot_methods(responses, keys).dropna(subset=["predicted", "avg_rating"])
    sets = [["model", "method", *s] for s in ([], ["dataset"], ["person_term"], ["dataset", "person_term"])]
    out = metrics_by(long, "predicted", "avg_rating", sets, ["model", "dataset", "method", "person_term"], "zero", least=3)
    return out


def nested_summary(responses: DataFrame, keys: Sequence[str] = ("model", "dataset"), methods: Mapping[str, str] = METHODS, digits: int = 3) -> DataFrame:
    """One JSON text (`value`) per key: counts, each method's success rate, mean and deviation, how far the methods agree, and the methods per term.

    The key and its terms come from one aggregate; the terms of a key are few and stand in the order of their names.
    """
    names, rated = list(methods), {m: clean_rating(F.col(c)) for m, c in methods.items()}
    shown = lambda c: F.round(c, digits)
    one = lambda m: F.struct(
        shown(F.count(m) / F.count(F.lit(1))).alias("success_rate"), shown(F.avg(m)).alias("mean_rating"), shown(F.stddev_samp(m)).alias("std_rating")
    ).alias(m)
    first, second = (F.col(m) for m in names[:2])
    rows = responses.select(*keys, "person_term", "attribute", *[c.alias(m) for m, c in rated.items()])
    own = [F.col(k) for k in keys]
    found = rows.groupingSets([own, [*own, F.col("person_term")]], *keys, "person_term").agg(
        F.count(F.lit(1)).alias("total"), F.count_distinct("attribute").alias("attributes"), *[one(m) for m in names],
        shown(F.avg((first == second).cast("double"))).alias("agreement_rate"), shown(F.avg(F.abs(first - second))).alias("mean_absolute_difference"),
        F.grouping("person_term").alias("_whole"),
    )
    whole = F.max(F.when(F.col("_whole") == 1, F.struct("total", "attributes", F.struct(*names).alias("methods"), "agreement_rate", "mean_absolute_difference"))).alias("_all")
    term = F.when(F.col("_whole") == 0, F.struct("person_term", "total", *names))
    both = found.groupBy(*keys).agg(whole, F.array_sort(F.collect_list(term)).alias("terms"))
    return both.select(*keys, "_all.*", "terms").select(*keys, F.to_json(F.struct(*[F.col(k) for k in keys], "total", "attributes", "methods", "agreement_rate", "mean_absolute_difference", "terms"), {"ignoreNullFields": "false"}).alias("value"))


def method_columns(metrics: DataFrame, keys: Sequence[str], columns: Sequence[str], methods: Mapping[str, str] = METHODS) -> DataFrame:
    """One row per key with the columns of both methods side by side, prefixed m1_, m2_."""
    aggs = [
        F.min(F.when(F.col("method") == m, F.col(c))).alias(f"m{i}_{c}") for i, m in enumerate(methods, 1) for c in columns
    ]
    return metrics.groupBy(*keys).agg(*aggs)


def value_cells(pairs: DataFrame, x: str, y: str, slices: Sequence[str]) -> DataFrame:
    """Distinct value pairs per slice with their count `_w`. Rows without slice or value are left out."""
    return pairs.dropna(subset=[x, y, *slices]).groupBy(*slices, F.col(x).alias("_x"), F.col(y).alias("_y")).agg(F.count(F.lit(1)).alias("_w"))


def rank_cells(cells: DataFrame, slices: Sequence[str], most: int) -> DataFrame:
    """Average ranks of both values, for slices with few distinct values: one window per value.

    `most` is a bound on the cells' number; their slices are dealt over so many tasks that the sorts of a task stay small however
    large the table is.
    """
    cells = cells.repartition(max(partitions(), -(-most // TASK_CELLS)), *slices)

    def rank(value: str) -> Column:
        spec = W.partitionBy(*slices).orderBy(value)
        upto = F.sum("_w").over(spec.rangeBetween(W.unboundedPreceding, W.currentRow))
        ties = F.sum("_w").over(spec.rangeBetween(W.currentRow, W.currentRow))
        return upto - (ties - 1) / 2

    return cells.withColumn("_x_rank", rank("_x")).withColumn("_y_rank", rank("_y"))


def rank_correlation() -> Column:
    """Of average ranks, whose mean is (rows + 1) / 2."""
    w, rx, ry, n = F.col("_w"), F.col("_x_rank"), F.col("_y_rank"), F.sum("_w")
    mean = n * (n + 1) / 2 * (n + 1) / 2
    spread = lambda r: F.greatest(F.sum(w * r * r) - mean, F.lit(0.0))
    varies = (F.min(rx) < F.max(rx)) & (F.min(ry) < F.max(ry))
    return F.when(varies, F.try_divide(F.sum(w * rx * ry) - mean, F.sqrt(spread(rx)) * F.sqrt(spread(ry))))


def spearman(pairs: DataFrame, x: str, y: str, slices: Sequence[str], many_small: bool = False) -> DataFrame:
    """Rank correlation per slice, average ranks on ties.

    Pairs collapse to distinct values with counts first. `many_small` is for slices with few distinct values
    each, such as the ratings of one attribute.
    """
    cells = value_cells(pairs, x, y, slices)
    if many_small:
        ranked = rank_cells(cells, slices, pairs.count())
    else:
        ranked = range_ranks(range_ranks(cells, "_x", "_w", slices, ["_y"], "_x_rank"), "_y", "_w", slices, ["_x"], "_y_rank")
    return ranked.groupBy(*slices).agg(F.sum("_w").alias("n"), rank_correlation().alias("spearman_r"))


PANELS = 256  # of the integral below, an even number
WIDTH = 10.0  # standard deviations


def _cosine_integral(low: Column, power: Column) -> Column:
    """Integral of cos^power from `low` to pi/2 by Simpson's rule, on the part that counts: cos^power falls like a normal curve of deviation 1/sqrt(power)."""
    step = F.least(F.lit(pi / 2) - low, F.lit(WIDTH) / F.sqrt(F.greatest(power, F.lit(1.0)))) / PANELS

    def term(i: Column) -> Column:
        sine = F.sin(low + i * step)
        weight = F.when((i == 0) | (i == PANELS), 1.0).when(i % 2 == 1, 4.0).otherwise(2.0)
        return weight * F.exp(power / 2 * F.log1p(-F.least(sine * sine, F.lit(1 - 1e-16))))

    return step / 3 * F.aggregate(F.sequence(F.lit(0), F.lit(PANELS)), F.lit(0.0), lambda total, i: total + term(i))


def correlation_p(r: str, n: str) -> Column:
    """Two-sided p-value of a correlation of n pairs by the t distribution; null below three pairs.

    It is the regularised incomplete beta function I_{1 - r^2}((n - 2) / 2, 1 / 2), which with r = sin(a) is the share of the integral
    of cos^(n - 3) that lies beyond a.
    """
    size = F.abs(F.col(r).cast("double"))
    known = F.col(r).isNotNull() & ~F.isnan(F.col(r).cast("double")) & (F.col(n) > 2)
    power = F.greatest(F.col(n).cast("double") - 3, F.lit(0.0))
    share = _cosine_integral(F.asin(F.least(size, F.lit(1.0))), power) / _cosine_integral(F.lit(0.0), power)
    return F.when(known, F.when(size >= 1, 0.0).otherwise(F.least(F.lit(1.0), share)))


def term_correlations(responses: DataFrame, predicted: str = "method1_rating", sets: Sequence[Sequence[str]] = ((), ("dataset",))) -> DataFrame:
    """Correlation per model, dataset (and pooled) and term; null unless three pairs vary on both sides."""
    pairs = responses.withColumn("predicted", clean_rating(F.col(predicted))).dropna(subset=["predicted", "avg_rating"])
    full = [["model", "person_term", *s] for s in sets]
    return metrics_by(pairs, "predicted", "avg_rating", full, ["model", "dataset", "person_term"], "null", least=3)


def mean_term_correlation(term_metrics: DataFrame, terms: Sequence[str] = TERMS) -> DataFrame:
    """Mean of the terms' correlations per model and dataset with one column per term, best first."""
    out = term_metrics.groupBy("model", "dataset").agg(
        F.avg("pearson_r").alias("mean_r"),
        *[F.min(F.when(F.col("person_term") == t, F.col("pearson_r"))).alias(f"r_{'nonbinary' if t == 'nonbinary person' else t}") for t in terms],
    )
    order = W.partitionBy("dataset").orderBy(F.desc_nulls_last("mean_r"), "model")
    return out.withColumn("place", F.row_number().over(order))


def correlation_wide(long: DataFrame, slices: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """One row per model and dataset with `columns` for every slice."""
    return long.groupBy("model", "dataset").agg(
        *[F.min(F.when(F.col("slice") == s, F.col(c))).alias(f"{c}_{s}") for s in slices for c in columns]
    )


def slice_name(term: Column) -> Column:
    return F.when(term == "all", "overall").otherwise(term_slug(term))


def method_agreement(responses: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Share of equal ratings and mean absolute difference where both methods gave one."""
    a, b = F.col("_a"), F.col("_b")
    both = responses.withColumns({"_a": clean_rating(F.col("method1_rating")), "_b": clean_rating(F.col("method2_rating"))})
    return both.groupBy(*keys).agg(
        F.count(a - b).alias("n_both"),
        F.avg((a == b).cast("double")).alias("agreement"),
        F.avg(F.abs(a - b)).alias("mean_abs_diff"),
    )


def invalid_counts(responses: DataFrame, keys: Sequence[str], predicted: str = "method1_rating") -> DataFrame:
    """Responses without a rating among those a human rated."""
    rated = responses.filter(F.col("avg_rating").isNotNull())
    n_bad = F.count_if(clean_rating(F.col(predicted)).isNull())
    return rated.groupBy(*keys).agg(F.count(F.lit(1)).alias("total"), n_bad.alias("n_invalid"), (n_bad / F.count(F.lit(1))).alias("pct_invalid"))


def response_summary(responses: DataFrame, terms: Sequence[str] = TERMS, methods: Mapping[str, str] = METHODS) -> DataFrame:
    """Success rate, mean and sample deviation of both methods, overall and per term, in one pass per model.

    Distinct attributes and terms are counted apart: next to the other aggregates they would keep all of those for every attribute.
    """
    clean = responses.select("model", "dataset", "attribute", "person_term", *[clean_rating(F.col(c)).alias(c) for c in methods.values()])
    aggs = [F.count(F.lit(1)).alias("n")]
    for i, c in enumerate(methods.values(), 1):
        v = F.col(c)
        for suffix, rows in [("", F.lit(True))] + [(f"_{t.replace(' ', '_')}", F.col("person_term") == t) for t in terms]:
            w = F.when(rows, v)
            aggs += [
                F.try_divide(F.count(w).cast("double"), F.count_if(rows)).alias(f"m{i}_success{suffix}"),
                F.avg(w).alias(f"m{i}_mean{suffix}"),
                F.stddev_samp(w).alias(f"m{i}_std{suffix}"),
            ]
    names = F.array(*[F.struct(F.lit(c).alias("of"), F.col(c).cast("string").alias("name")) for c in ("attribute", "person_term")])
    distinct = responses.select("model", "dataset", F.explode(names).alias("_d")).select("model", "dataset", "_d.*").distinct()
    known = F.col("name").isNotNull()
    counts = distinct.groupBy("model", "dataset").agg(F.count_if(known & (F.col("of") == "attribute")).alias("n_attributes"), F.count_if(known & (F.col("of") == "person_term")).alias("n_terms"))
    out = null_safe(clean.groupBy("model", "dataset").agg(*aggs), counts, ["model", "dataset"])
    front = ["model", "dataset", "n", "n_attributes", "n_terms"]
    return out.select(*front, *[c for c in out.columns if c not in front])


def attribute_metrics(responses: DataFrame) -> DataFrame:
    """Per attribute: correlation, rank correlation and RMSE of each method, all from counted value pairs."""
    keys = ["model", "dataset", "method", "attribute"]
    long = unpivot_methods(responses, ["model", "dataset", "attribute"])
    cells = rank_cells(value_cells(long, "predicted", "avg_rating", keys), keys, len(METHODS) * responses.count())
    w, x, y = F.col("_w"), F.col("_x") - CENTRE, F.col("_y") - CENTRE
    sums = cells.groupBy(*keys).agg(
        F.sum("_w").alias("n"), F.sum(w * x).alias("_sx"), F.sum(w * y).alias("_sy"), F.sum(w * x * x).alias("_xx"), F.sum(w * y * y).alias("_yy"),
        F.sum(w * x * y).alias("_xy"), F.sum(w * (x - y) * (x - y)).alias("_ee"), ((F.min("_x") < F.max("_x")) & (F.min("_y") < F.max("_y"))).alias("_varies"),
        rank_correlation().alias("_rho"),
    )
    n, sx, sy = F.col("n"), F.col("_sx"), F.col("_sy")
    r = F.try_divide(n * F.col("_xy") - sx * sy, F.sqrt(n * F.col("_xx") - sx * sx) * F.sqrt(n * F.col("_yy") - sy * sy))
    enough = lambda c: F.when(n > 2, F.when(F.col("_varies"), c).otherwise(0.0))
    return sums.select(*keys, "n", F.sqrt(F.col("_ee") / n).alias("rmse"), enough(r).alias("pearson_r"), enough(F.col("_rho")).alias("spearman_r"))


def attribute_metric_spread(per_attribute: DataFrame) -> DataFrame:
    """Mean and population deviation of the attribute metrics per model, dataset and method."""
    cols = ["pearson_r", "spearman_r", "rmse"]
    return per_attribute.groupBy("model", "dataset", "method").agg(
        *[F.avg(c).alias(f"{c}_mean") for c in cols], *[F.stddev_pop(c).alias(f"{c}_std") for c in cols], F.count(F.lit(1)).alias("n_attributes")
    )


def error_case_columns(predictions: DataFrame) -> DataFrame:
    e = F.col("predicted") - F.col("true_rating")
    return predictions.withColumns({"error": e, "abs_error": F.abs(e), "squared_error": e * e, "rmse": F.sqrt(e * e)})


def best_and_worst(predictions: DataFrame, k: int = 10) -> DataFrame:
    """The k smallest and k largest RMSE per term, and per attribute as category `mean`."""
    rows = error_case_columns(predictions)
    single = rows.select(normalize_term(F.col("person_term")).alias("category"), "attribute", "rmse", "predicted", "true_rating")
    mean = rows.groupBy("attribute").agg(
        F.sqrt(F.avg("squared_error")).alias("rmse"), F.avg("predicted").alias("predicted"), F.avg("true_rating").alias("true_rating")
    ).select(F.lit("mean").alias("category"), "attribute", "rmse", "predicted", "true_rating")
    both = single.unionByName(mean).withColumn("rmse", F.round("rmse", 9))
    best = top_per_group(both, ["category"], [F.asc("rmse"), F.asc("attribute")], k).withColumn("case_type", F.lit("best"))
    worst = top_per_group(both, ["category"], [F.desc("rmse"), F.asc("attribute")], k).withColumn("case_type", F.lit("worst"))
    return best.unionByName(worst)


def largest_errors(predictions: DataFrame, k: int = 4) -> DataFrame:
    rows = error_case_columns(predictions).withColumn("abs_error", F.round("abs_error", 9))
    return top_per_group(rows, ["person_term"], [F.desc("abs_error"), F.asc("attribute")], k).select("person_term", "attribute", "error", "abs_error", "rank")


def calibration(predictions: DataFrame) -> DataFrame:
    """Slope and intercept of predicted on true ratings, per term and overall."""
    both = F.col("predicted").isNotNull() & F.col("true_rating").isNotNull()
    p, y = F.when(both, F.col("predicted")), F.when(both, F.col("true_rating"))
    slope = F.try_divide(F.covar_pop(p, y), F.var_pop(y))
    grouped = predictions.rollup("person_term").agg(
        slope.alias("slope"),
        (F.avg(p) - slope * F.avg(y)).alias("intercept"),
        F.count(F.lit(1)).alias("n"),
        F.grouping("person_term").alias("_g"),
    )
    return grouped.select(F.when(F.col("_g") == 1, "all").otherwise(F.col("person_term")).alias("person_term"), "slope", "intercept", "n")


def weighted_quantiles(values: DataFrame, value: str, within: Sequence[str], parts: int) -> DataFrame:
    """The parts+1 equal-count edges per group, linear between neighbours, as one sorted array per group.

    Works on value counts and prefix sums: no group is gathered in one place.
    """
    within = list(within)
    counts = values.dropna(subset=[*within, value]).groupBy(*within, value).agg(F.count(F.lit(1)).alias("_c"))
    placed = value_prefix(counts, value, "_c", within)
    # position p = (n-1) q/parts lies between the sorted values number floor(p) and floor(p)+1
    marks = F.filter(
        F.flatten(
            F.transform(
                F.sequence(F.lit(0), F.lit(parts)),
                lambda q: F.array(
                    F.struct(q.alias("q"), F.floor((F.col("_all") - 1) * q / parts).alias("pos"), F.lit(0).alias("side")),
                    F.struct(q.alias("q"), F.ceil((F.col("_all") - 1) * q / parts).alias("pos"), F.lit(1).alias("side")),
                ),
            )
        ),
        lambda m: (m["pos"] >= F.col("_before")) & (m["pos"] < F.col("_before") + F.col("_c")),
    )
    hits = placed.select(*within, value, "_all", F.explode(marks).alias("m"))
    frac = (F.col("_all") - 1) * F.col("m.q") / parts
    edge = hits.groupBy(*within, F.col("m.q").alias("q")).agg(
        F.min(F.when(F.col("m.side") == 0, F.col(value))).alias("lo"),
        F.min(F.when(F.col("m.side") == 1, F.col(value))).alias("hi"),
        F.min(frac - F.floor(frac)).alias("f"),
    )
    pos = F.col("lo") + (F.col("hi") - F.col("lo")) * F.col("f")
    return edge.groupBy(*within).agg(F.sort_array(F.collect_set(pos)).alias("edges"))


def residual_bins(predictions: DataFrame, parts: int = 6, group: str = "person_term") -> DataFrame:
    """Equal-count bins of the true rating (right-closed, equal edges merged) with mean error and its standard error."""
    edges = weighted_quantiles(predictions, "true_rating", [group], parts)
    e = F.col("predicted") - F.col("true_rating")
    # one row of at most parts+1 numbers per group
    binned = join_small(predictions, edges, [group]).withColumn(
        "bin", F.greatest(F.lit(1), F.size(F.filter("edges", lambda x: x < F.col("true_rating"))))
    )
    return binned.groupBy(group, "bin").agg(
        F.count(F.lit(1)).alias("n"),
        F.avg("true_rating").alias("mean_true"),
        F.avg(e).alias("mean_error"),
        (F.stddev_samp(e) / F.sqrt(F.count(F.lit(1)))).alias("se"),
    )


def first_of_item(responses: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """First value per key, repeatable: the smallest non-null value of the key."""
    return first_per_key(responses.filter(F.col(value).isNotNull()).select(*keys, value), keys, [value])

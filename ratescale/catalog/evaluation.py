"""Response parsing, metrics per slice, rankings and bootstrap intervals."""

from pyspark.sql import functions as F

from ratescale.catalog.registry import query
from ratescale.catalog.snippets import LONG, PARSED, STRICT, corr_sql, errors_sql, rank_corr_cte, tolerant
from ratescale.functions import parse, terms
from ratescale.operators import metrics, ratings, resample


def parsed(t):
    return t.responses.withColumn("method1_rating", parse.rating_tolerant(F.col("generation")))


@query("t10_rating_tolerant", "responses", f"SELECT model, attribute, person_term, generation, {tolerant()} AS rating FROM responses", ints="rating")
def _(t):
    return t.responses.select("model", "attribute", "person_term", "generation", parse.rating_tolerant(F.col("generation")).alias("rating"))


@query("t11_rating_strict", "responses", f"SELECT generation, {STRICT} AS rating, count(*) AS n FROM responses GROUP BY 1, 2", ints="rating n")
def _(t):
    return t.responses.groupBy("generation", parse.rating_strict(F.col("generation")).alias("rating")).agg(F.count(F.lit(1)).alias("n"))


@query("t12_ranked_tokens", "responses", f"""WITH p AS (SELECT model, attribute, person_term, generation, {tolerant()} AS r FROM responses)
SELECT model, attribute, person_term, coalesce(r, 3) AS rating FROM p""", ints="rating")
def _(t):
    tokens = F.to_json(F.array(F.lit("none"), F.col("generation"), F.lit("the"), F.lit("3rd"), F.lit("4")))
    ranked = t.responses.withColumn("topk_tokens", tokens)
    return ranked.select("model", "attribute", "person_term", parse.rating_from_ranked(parse.tokens_from_json(F.col("topk_tokens"))).alias("rating"))


SCORES = ", ".join(f"(l_partkey * {i} + l_suppkey * {8 - i}) % 11 AS logit_{i}" for i in range(1, 8))


@query("t13_best_score", "", f"""WITH s AS (SELECT l_orderkey, l_linenumber, {SCORES.replace(' AS logit_5', ' + 0 * NULL AS logit_5')} FROM lineitem)
SELECT l_orderkey, l_linenumber, CASE greatest(logit_1, logit_2, logit_3, logit_4, logit_6, logit_7) WHEN logit_1 THEN 1 WHEN logit_2 THEN 2 WHEN logit_3 THEN 3 WHEN logit_4 THEN 4 WHEN logit_6 THEN 6 ELSE 7 END AS rating FROM s""",
       ints="l_orderkey l_linenumber rating")
def _(t):
    s = t.lineitem.selectExpr("l_orderkey", "l_linenumber", *SCORES.split(", ")).withColumn("logit_5", F.lit(None).cast("double"))
    return s.select("l_orderkey", "l_linenumber", parse.rating_from_scores().alias("rating"))


METRIC_NUM = "mse rmse mae pearson_r"


@query("a4_error_metrics", "predictions", f"SELECT person_term, {errors_sql('predicted', 'true_rating')}, {corr_sql('predicted', 'true_rating')} AS pearson_r FROM predictions GROUP BY 1", num=METRIC_NUM, ints="n")
def _(t):
    return metrics.metrics_by(t.predictions, "predicted", "true_rating", [["person_term"]], ["person_term"])


CONST = "CASE WHEN source = 'human' THEN 4.0 ELSE predicted END"


@query("a5_degenerate_pearson", "predictions", f"SELECT source, {corr_sql('p', 'true_rating', '0.0::DOUBLE', 3)} AS r_zero, {corr_sql('p', 'true_rating', 'NULL', 3)} AS r_null FROM (SELECT source, {CONST} AS p, true_rating FROM predictions) q GROUP BY 1", num="r_zero r_null")
def _(t):
    p = t.predictions.withColumn("p", F.expr(CONST).cast("double"))
    x, y = F.col("p"), F.col("true_rating")
    return p.groupBy("source").agg(metrics.pearson(x, y, "zero", 3).alias("r_zero"), metrics.pearson(x, y, "null", 3).alias("r_null"))


# Simpson's rule over the whole range, in 4,000 panels
A6 = """c AS (SELECT coalesce(person_term, 'all') AS person_term, count(*) AS n, avg((predicted - true_rating) * (predicted - true_rating)) AS mse, sqrt(avg((predicted - true_rating) * (predicted - true_rating))) AS rmse,
  avg(abs(predicted - true_rating)) AS mae, corr(predicted, true_rating) AS pearson_r FROM predictions GROUP BY GROUPING SETS ((person_term), ())),
 panels AS (SELECT i, CASE WHEN i = 0 OR i = 4000 THEN 1.0::DOUBLE WHEN i % 2 = 1 THEN 4.0::DOUBLE ELSE 2.0::DOUBLE END AS w FROM range(0, 4001) q(i)),
 tails AS (SELECT person_term, (pi() / 2 - asin(abs(pearson_r))) * sum(w * pow(greatest(cos(asin(abs(pearson_r)) + (pi() / 2 - asin(abs(pearson_r))) * i / 4000), 0), n - 3)) AS tail,
  pi() / 2 * sum(w * pow(greatest(cos(pi() / 2 * i / 4000), 0), n - 3)) AS whole FROM c, panels GROUP BY person_term, n, pearson_r)"""


@query("a6_correlation_p", "predictions", f"WITH {A6} SELECT c.*, tail / whole AS p_value FROM c JOIN tails USING (person_term)", num="mse rmse mae pearson_r p_value", ints="n")
def _(t):
    m = metrics.metrics_by(t.predictions, "predicted", "true_rating", [["person_term"], []], ["person_term"])
    return m.withColumn("p_value", metrics.correlation_p("pearson_r", "n"))


@query("a6_correlation_p_short", "predictions", f"""WITH few AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY attribute, person_term ORDER BY source) AS rn FROM predictions) q WHERE rn = 1),
 {A6.replace("FROM predictions GROUP BY GROUPING SETS ((person_term), ())", "FROM (SELECT attribute AS person_term, predicted + CASE WHEN person_term = 'man' THEN 1 ELSE 0 END AS predicted, true_rating FROM few) f GROUP BY person_term HAVING count(*) > 2 AND min(predicted) < max(predicted) AND min(true_rating) < max(true_rating)")}
SELECT c.person_term AS attribute, n, pearson_r, round(tail / whole, 5) AS p_value FROM c JOIN tails USING (person_term)""", num="pearson_r p_value", ints="n")
def _(t):
    shifted = F.col("predicted") + F.when(F.col("person_term") == "man", 1).otherwise(0)
    few = t.predictions.groupBy("attribute", "person_term").agg(F.min_by(F.struct("predicted", "true_rating"), "source").alias("p")).select("attribute", "person_term", "p.*")
    m = few.withColumn("predicted", shifted).groupBy("attribute").agg(F.count(F.lit(1)).alias("n"), metrics.pearson(F.col("predicted"), F.col("true_rating"), least=3).alias("pearson_r"))
    return m.filter("pearson_r IS NOT NULL").withColumn("p_value", F.round(metrics.correlation_p("pearson_r", "n"), 5))


@query("a7_spearman", "predictions", f"WITH {rank_corr_cte('predictions', 'person_term', 'predicted', 'true_rating')} SELECT * FROM rho", num="spearman_r", ints="n")
def _(t):
    return metrics.spearman(t.predictions, "predicted", "true_rating", ["person_term"])


@query("a7_spearman_models", "responses", f"WITH {PARSED}, {LONG}, {rank_corr_cte('long', 'model, dataset, method', 'p', 'y')} SELECT * FROM rho", num="spearman_r", ints="n")
def _(t):
    long = metrics.unpivot_methods(parsed(t), ["model", "dataset"])
    return metrics.spearman(long, "predicted", "avg_rating", ["model", "dataset", "method"])


def sets_sql(source, x, y, keys, sets, flat="NULL", least=2, label="all"):
    shown = ", ".join(f"CASE WHEN grouping({k}) = 1 THEN '{label}' ELSE {k} END AS {k}" for k in keys)
    gs = ", ".join("(" + ", ".join(s) + ")" for s in sets)
    return f"SELECT {shown}, {errors_sql(x, y)}, {corr_sql(x, y, flat, least)} AS pearson_r FROM {source} GROUP BY GROUPING SETS ({gs})"


@query("a8_metrics_by_slice", "predictions", sets_sql("predictions", "predicted", "true_rating", ["person_term", "source"], [[], ["person_term"], ["source"], ["person_term", "source"]]), num=METRIC_NUM, ints="n")
def _(t):
    return metrics.stratified_metrics(t.predictions)


A9 = sets_sql("long", "p", "y", ["model", "dataset", "method", "person_term"], [["model", "method", *s] for s in ([], ["dataset"], ["person_term"], ["dataset", "person_term"])], "0.0::DOUBLE", 3)


@query("a9_response_metrics", "responses", f"WITH {PARSED}, {LONG} {A9}", num=METRIC_NUM, ints="n")
def _(t):
    return metrics.response_metrics(parsed(t))


@query("a9_method_columns", "responses", f"""WITH {PARSED}, {LONG}, m AS ({A9}) SELECT model, dataset, max(CASE WHEN method = 'method1' THEN rmse END) AS m1_rmse, max(CASE WHEN method = 'method1' THEN pearson_r END) AS m1_pearson_r,
 max(CASE WHEN method = 'method2' THEN rmse END) AS m2_rmse, max(CASE WHEN method = 'method2' THEN pearson_r END) AS m2_pearson_r FROM m WHERE person_term = 'all' GROUP BY 1, 2""", num="m1_rmse m1_pearson_r m2_rmse m2_pearson_r")
def _(t):
    m = metrics.response_metrics(parsed(t)).filter("person_term = 'all'")
    return metrics.method_columns(m, ["model", "dataset"], ["rmse", "pearson_r"])


TERM_R = f"""tr AS (SELECT model, CASE WHEN grouping(dataset) = 1 THEN 'all' ELSE dataset END AS dataset, person_term, {errors_sql('p', 'y')}, {corr_sql('p', 'y', 'NULL', 3)} AS r
 FROM long WHERE method = 'method1' GROUP BY GROUPING SETS ((model, person_term), (model, dataset, person_term)))"""


@query("a10_mean_term_r", "responses", f"""WITH {PARSED}, {LONG}, {TERM_R}, m AS (SELECT model, dataset, avg(r) AS mean_r, max(CASE WHEN person_term = 'woman' THEN r END) AS r_woman, max(CASE WHEN person_term = 'man' THEN r END) AS r_man,
 max(CASE WHEN person_term = 'nonbinary person' THEN r END) AS r_nonbinary FROM tr GROUP BY 1, 2)
SELECT *, row_number() OVER (PARTITION BY dataset ORDER BY mean_r DESC NULLS LAST, model) AS place FROM m""", num="mean_r r_woman r_man r_nonbinary", ints="place")
def _(t):
    return metrics.mean_term_correlation(metrics.term_correlations(parsed(t)))


@query("a12_method_agreement", "responses", f"""WITH {PARSED}, c AS (SELECT model, method1_rating AS a, CASE WHEN method2_rating <> -1 THEN method2_rating END AS b FROM parsed)
SELECT model, count(a - b) AS n_both, avg(CASE WHEN a IS NOT NULL AND b IS NOT NULL THEN CAST(a = b AS INT) END) AS agreement, avg(abs(a - b)) AS mean_abs_diff FROM c GROUP BY 1""", num="agreement mean_abs_diff", ints="n_both")
def _(t):
    return metrics.method_agreement(parsed(t), ["model"])


@query("a13_invalid_counts", "responses", f"""WITH {PARSED} SELECT model, dataset, count(*) AS total, count_if(method2_rating IS NULL OR method2_rating = -1) AS n_invalid,
 count_if(method2_rating IS NULL OR method2_rating = -1) / count(*)::DOUBLE AS pct_invalid FROM parsed GROUP BY 1, 2""", num="pct_invalid", ints="total n_invalid")
def _(t):
    return metrics.invalid_counts(parsed(t), ["model", "dataset"], "method2_rating")


def _summary_cols():
    out, names = [], []
    for i, c in ((1, "method1_rating"), (2, "CASE WHEN method2_rating <> -1 THEN method2_rating END")):
        for s, cond in (("", "TRUE"), ("_woman", "person_term = 'woman'"), ("_man", "person_term = 'man'"), ("_nonbinary_person", "person_term = 'nonbinary person'")):
            f = f"FILTER (WHERE {cond})"
            out += [f"count({c}) {f} / (count(*) {f})::DOUBLE AS m{i}_success{s}", f"avg({c}) {f} AS m{i}_mean{s}", f"stddev_samp({c}) {f} AS m{i}_std{s}"]
            names += [f"m{i}_success{s}", f"m{i}_mean{s}", f"m{i}_std{s}"]
    return ", ".join(out), " ".join(names)


@query("a14_response_summary", "responses", f"WITH {PARSED} SELECT model, dataset, count(*) AS n, count(DISTINCT attribute) AS n_attributes, count(DISTINCT person_term) AS n_terms, {_summary_cols()[0]} FROM parsed GROUP BY 1, 2",
       num=_summary_cols()[1], ints="n n_attributes n_terms")
def _(t):
    return metrics.response_summary(parsed(t))


A15 = f"""{PARSED}, {LONG}, {rank_corr_cte('long', 'model, dataset, method, attribute', 'p', 'y')},
 pa AS (SELECT model, dataset, method, attribute, count(*) AS n, sqrt(avg((p-y)*(p-y))) AS rmse, {corr_sql('p', 'y', '0.0::DOUBLE', 3)} AS pearson_r FROM long GROUP BY 1, 2, 3, 4),
 pr AS (SELECT pa.*, CASE WHEN pa.n > 2 THEN coalesce(CASE WHEN abs(spearman_r) > 2 THEN NULL ELSE spearman_r END, 0) END AS spearman_r FROM pa JOIN rho USING (model, dataset, method, attribute))"""


@query("a15_attribute_metrics", "responses", f"""WITH {A15} SELECT model, dataset, method, avg(pearson_r) AS pearson_r_mean, avg(spearman_r) AS spearman_r_mean, avg(rmse) AS rmse_mean,
 stddev_pop(pearson_r) AS pearson_r_std, stddev_pop(spearman_r) AS spearman_r_std, stddev_pop(rmse) AS rmse_std, count(*) AS n_attributes FROM pr GROUP BY 1, 2, 3""",
       num="pearson_r_mean spearman_r_mean rmse_mean pearson_r_std spearman_r_std rmse_std", ints="n_attributes")
def _(t):
    return metrics.attribute_metric_spread(metrics.attribute_metrics(parsed(t)))


@query("a60_evaluation_table", "predictions", f"""SELECT CASE WHEN grouping(person_term) = 1 THEN 'mean' ELSE person_term END AS category, avg((predicted-true_rating)*(predicted-true_rating)) AS mse, sqrt(avg((predicted-true_rating)*(predicted-true_rating))) AS rmse,
 avg(abs(predicted-true_rating)) AS mae, corr(predicted, true_rating) AS correlation FROM predictions GROUP BY ROLLUP (person_term)""", num="mse rmse mae correlation")
def _(t):
    return metrics.evaluation_table(t.predictions)


EACH = """e AS (SELECT person_term AS category, avg((predicted-true_rating)*(predicted-true_rating)) AS mse, sqrt(avg((predicted-true_rating)*(predicted-true_rating))) AS rmse,
 avg(abs(predicted-true_rating)) AS mae, corr(predicted, true_rating) AS correlation FROM predictions GROUP BY 1)"""


@query("a60_evaluation_wide", "predictions", f"WITH {EACH} SELECT * FROM e UNION ALL SELECT 'mean', avg(mse), avg(rmse), avg(mae), avg(correlation) FROM e", num="mse rmse mae correlation")
def _(t):
    return metrics.evaluation_table_wide(ratings.pivot_predictions(t.predictions))


@query("a59_mean_row", "predictions", f"WITH {EACH} SELECT category, rmse, correlation FROM e UNION ALL SELECT 'mean', avg(rmse), avg(correlation) FROM e", num="rmse correlation")
def _(t):
    table = metrics.evaluation_table(t.predictions).filter("category <> 'mean'")
    return metrics.with_mean_row(table, "category", ["rmse", "correlation"])


@query("r5_error_columns", "predictions", "SELECT attribute, person_term, predicted - true_rating AS error, abs(predicted - true_rating) AS abs_error, (predicted - true_rating) * (predicted - true_rating) AS squared_error FROM predictions", num="error abs_error squared_error")
def _(t):
    return metrics.error_case_columns(t.predictions).select("attribute", "person_term", "error", "abs_error", "squared_error")


@query("k2_best_and_worst", "predictions", """WITH b AS (SELECT CASE person_term WHEN 'nonbinary person' THEN 'nonbinary' ELSE person_term END AS category, attribute, round(abs(predicted - true_rating), 9) AS rmse, predicted, true_rating FROM predictions
 UNION ALL SELECT 'mean', attribute, round(sqrt(avg((predicted-true_rating)*(predicted-true_rating))), 9), avg(predicted), avg(true_rating) FROM predictions GROUP BY attribute),
 r AS (SELECT *, 'best' AS case_type, row_number() OVER (PARTITION BY category ORDER BY rmse, attribute) AS rank FROM b UNION ALL SELECT *, 'worst', row_number() OVER (PARTITION BY category ORDER BY rmse DESC, attribute) FROM b)
SELECT * FROM r WHERE rank <= 10""", num="rmse predicted true_rating", ints="rank")
def _(t):
    return metrics.best_and_worst(t.predictions)


@query("k3_largest_errors", "predictions", """WITH r AS (SELECT person_term, attribute, predicted - true_rating AS error, round(abs(predicted - true_rating), 9) AS abs_error,
 row_number() OVER (PARTITION BY person_term ORDER BY round(abs(predicted - true_rating), 9) DESC, attribute) AS rank FROM predictions) SELECT * FROM r WHERE rank <= 4""", num="error abs_error", ints="rank")
def _(t):
    return metrics.largest_errors(t.predictions)


@query("a29_calibration", "predictions", """SELECT CASE WHEN grouping(person_term) = 1 THEN 'all' ELSE person_term END AS person_term, regr_slope(predicted, true_rating) AS slope,
 regr_intercept(predicted, true_rating) AS intercept, count(*) AS n FROM predictions GROUP BY ROLLUP (person_term)""", num="slope intercept", ints="n")
def _(t):
    return metrics.calibration(t.predictions)


@query("a30_residual_bins", "predictions", """WITH q AS (SELECT person_term, list_sort(list_distinct(quantile_cont(true_rating, [0.0, 1/6.0::DOUBLE, 2/6.0::DOUBLE, 3/6.0::DOUBLE, 4/6.0::DOUBLE, 5/6.0::DOUBLE, 1.0]))) AS edges FROM predictions GROUP BY 1),
 b AS (SELECT p.*, predicted - true_rating AS e, greatest(1, len(list_filter(edges, lambda x: x < true_rating - 1e-9))) AS bin FROM predictions p JOIN q USING (person_term))
SELECT person_term, bin, count(*) AS n, avg(true_rating) AS mean_true, avg(e) AS mean_error, stddev_samp(e) / sqrt(count(*)) AS se FROM b GROUP BY 1, 2""", num="mean_true mean_error se", ints="bin n")
def _(t):
    return metrics.residual_bins(t.predictions)


@query("w7_equal_count_edges", "predictions", """SELECT person_term, quantile_cont(true_rating, 0.25) AS q1, quantile_cont(true_rating, 0.5) AS q2, quantile_cont(true_rating, 0.75) AS q3 FROM predictions GROUP BY 1""", num="q1 q2 q3")
def _(t):
    e = metrics.weighted_quantiles(t.predictions, "true_rating", ["person_term"], 4)
    return e.select("person_term", *[F.get("edges", F.lit(i)).alias(f"q{i}") for i in (1, 2, 3)])


# the distribution function of Poisson(1) at 0, 1, 2, ... in units of 2^-32
POISSON = ("5e2d58d8", "bc5ab1b1", "eb715e1d", "fb239797", "ff1025f5", "ffd90f3b", "fffa8b71", "ffff540c", "ffffed1f")


def weight_sql(digits):
    return "CASE " + " ".join(f"WHEN {digits} < '{h}' THEN {k}" for k, h in enumerate(POISSON)) + " ELSE 9 END"


def boot_sql(source, slices, key, x, y, n, seed=42):
    """CTEs up to table `st` with r and rmse per slice and replicate."""
    base = " || '|' || ".join(f"CAST({k} AS VARCHAR)" for k in key)
    cut = "substr(h, CAST(1 + 8*j AS INT), 8)"
    sl = ", ".join(slices)
    return f"""bh AS (SELECT *, md5('{seed}|' || chunk || '|' || {base}) AS h FROM {source}, range(0, {(n - 1) // 4 + 1}) c(chunk)),
 bw AS (SELECT {sl}, chunk*4 + j AS rep, {weight_sql(cut)} AS w, {x} - 4.0::DOUBLE AS u, {y} - 4.0::DOUBLE AS v FROM bh, range(0, 4) jj(j)),
 bs AS (SELECT {sl}, rep, sum(w)::DOUBLE AS n, sum(w*u) AS u, sum(w*v) AS v, sum(w*u*u) AS uu, sum(w*v*v) AS vv, sum(w*u*v) AS uv, sum(w*(u-v)*(u-v)) AS ee FROM bw WHERE w > 0 AND rep < {n} GROUP BY {sl}, rep),
 st AS (SELECT {sl}, rep, CASE WHEN n*uu - u*u > n*n*1e-12 AND n*vv - v*v > n*n*1e-12 THEN (n*uv - u*v) / sqrt(n*uu - u*u) / sqrt(n*vv - v*v) END AS r, sqrt(ee/n) AS rmse FROM bs)"""


KEY = ["attribute", "person_term"]
REPLICATES = 1000


@query("b1_pearson_bootstrap", "predictions", f"""WITH {boot_sql('predictions', ['source'], KEY, 'predicted', 'true_rating', REPLICATES)},
 pt AS (SELECT source, count(*) AS n, corr(predicted, true_rating) AS r FROM predictions GROUP BY 1)
SELECT pt.*, r_lo, r_hi FROM pt JOIN (SELECT source, quantile_cont(r, 0.025) AS r_lo, quantile_cont(r, 0.975) AS r_hi FROM st GROUP BY 1) USING (source)""", num="r r_lo r_hi", ints="n")
def _(t):
    return resample.bootstrap(t.predictions, "predicted", "true_rating", ["source"], KEY, REPLICATES).select("source", "n", "r", "r_lo", "r_hi")


@query("b2_joint_bootstrap", "predictions", f"""WITH {boot_sql('predictions', ['person_term', 'source'], KEY, 'predicted', 'true_rating', REPLICATES)},
 pt AS (SELECT person_term, source, count(*) AS n, corr(predicted, true_rating) AS r, sqrt(avg((predicted-true_rating)*(predicted-true_rating))) AS rmse FROM predictions GROUP BY 1, 2)
SELECT pt.*, r_lo, r_hi, rmse_lo, rmse_hi FROM pt JOIN (SELECT person_term, source, quantile_cont(r, 0.025) AS r_lo, quantile_cont(r, 0.975) AS r_hi, quantile_cont(rmse, 0.025) AS rmse_lo, quantile_cont(rmse, 0.975) AS rmse_hi FROM st GROUP BY 1, 2) USING (person_term, source)""",
       num="r rmse r_lo r_hi rmse_lo rmse_hi", ints="n")
def _(t):
    return resample.bootstrap(t.predictions, "predicted", "true_rating", ["person_term", "source"], KEY, REPLICATES)


@query("b3_mean_term_bootstrap", "predictions", f"""WITH {boot_sql('predictions', ['source', 'person_term'], KEY, 'predicted', 'true_rating', REPLICATES)},
 pt AS (SELECT source, avg(r) AS mean_r, count(r) AS v FROM (SELECT source, person_term, corr(predicted, true_rating) AS r FROM predictions GROUP BY 1, 2) q GROUP BY 1),
 mr AS (SELECT source, rep, avg(r) AS m, count(r) AS got FROM st GROUP BY 1, 2), ok AS (SELECT mr.* FROM mr JOIN pt USING (source) WHERE got = v)
SELECT source, mean_r, quantile_cont(m, 0.025) AS mean_r_lo, quantile_cont(m, 0.975) AS mean_r_hi, count(*) AS n_reps FROM pt JOIN ok USING (source) GROUP BY 1, 2""", num="mean_r mean_r_lo mean_r_hi", ints="n_reps")
def _(t):
    return resample.bootstrap_mean_over(t.predictions, "predicted", "true_rating", ["source"], "person_term", KEY, REPLICATES)


CI_LONG = f"""{PARSED}, {LONG}, m1 AS (SELECT * FROM long WHERE method = 'method1'), sl AS (SELECT model, dataset, attribute, person_term, p, y, 'overall' AS slice FROM m1
 UNION ALL SELECT model, dataset, attribute, person_term, p, y, CASE person_term WHEN 'nonbinary person' THEN 'nonbinary' ELSE person_term END FROM m1),
 {boot_sql('sl', ['model', 'dataset', 'slice'], ['model', 'attribute', 'person_term'], 'p', 'y', REPLICATES)},
 pt AS (SELECT model, dataset, slice, count(*) AS n, {corr_sql('p', 'y', '0.0::DOUBLE', 3)} AS pearson_r FROM sl GROUP BY 1, 2, 3),
 ci AS (SELECT pt.*, pearson_r_lo, pearson_r_hi FROM pt JOIN (SELECT model, dataset, slice, quantile_cont(r, 0.025) AS pearson_r_lo, quantile_cont(r, 0.975) AS pearson_r_hi FROM st GROUP BY 1, 2, 3) USING (model, dataset, slice))"""


def correlation_ci(t, n_boot=REPLICATES):
    one = parsed(t).withColumn("predicted", parse.clean_rating(F.col("method1_rating"))).dropna(subset=["predicted", "avg_rating"])
    sl = one.withColumn("slice", F.explode(F.array(F.lit("overall"), terms.term_slug(F.col("person_term")))))
    out = resample.bootstrap(sl, "predicted", "avg_rating", ["model", "dataset", "slice"], ["model", "attribute", "person_term"], n_boot)
    return out.select("model", "dataset", "slice", "n", F.col("r").alias("pearson_r"), F.col("r_lo").alias("pearson_r_lo"), F.col("r_hi").alias("pearson_r_hi"))


@query("a11_correlation_ci_long", "responses", f"WITH {CI_LONG} SELECT * FROM ci", num="pearson_r pearson_r_lo pearson_r_hi", ints="n")
def _(t):
    return correlation_ci(t)


SLICES = ["overall", "woman", "man", "nonbinary"]


@query("a11_correlation_ci_wide", "responses", f"WITH {CI_LONG} SELECT model, dataset, " + ", ".join(
    f"max(CASE WHEN slice = '{s}' THEN {c} END) AS {c}_{s}" for s in SLICES for c in ("pearson_r", "pearson_r_lo", "pearson_r_hi")) + " FROM ci GROUP BY 1, 2",
       num=" ".join(f"{c}_{s}" for s in SLICES for c in ("pearson_r", "pearson_r_lo", "pearson_r_hi")))
def _(t):
    return metrics.correlation_wide(correlation_ci(t), SLICES, ["pearson_r", "pearson_r_lo", "pearson_r_hi"])

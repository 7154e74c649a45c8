"""Experiment runs over the runs view, and learning curves over orders and line items."""

from pyspark.sql import functions as F

from ratescale.catalog.registry import query
from ratescale.functions import terms
from ratescale.operators import runs

# upper 2.5 % points of the t distribution for 1, 2, 3, ... degrees of freedom
T_975 = (12.706205, 4.302653, 3.182446, 2.776445, 2.570582, 2.446912, 2.364624, 2.306004, 2.262157, 2.228139, 2.200985, 2.178813, 2.160369, 2.144787, 2.13145, 2.119905, 2.109816, 2.100922, 2.093024, 2.085963, 2.079614, 2.073873, 2.068658, 2.063899, 2.059539, 2.055529, 2.051831, 2.048407, 2.04523, 2.042272)
TQ = "CASE " + " ".join(f"WHEN df = {i} THEN {v}" for i, v in enumerate(T_975, 1)) + " END"
UNP = "u AS (SELECT model, config, fold, category, seed, 'rmse' AS metric, rmse AS value FROM runs UNION ALL SELECT model, config, fold, category, seed, 'corr', corr FROM runs)"
STATS = f"""{UNP}, s AS (SELECT model, config, category, metric, avg(value) AS mean, coalesce(stddev_samp(value), 0) AS std, count(*) AS n, count(*) - 1 AS df FROM u GROUP BY 1, 2, 3, 4),
 st AS (SELECT model, config, category, metric, mean, std, n, mean - coalesce({TQ} * std / sqrt(n), 0) AS ci_lower, mean + coalesce({TQ} * std / sqrt(n), 0) AS ci_upper FROM s)"""


@query("a36_seed_statistics", "runs", f"WITH {STATS} SELECT * FROM st", num="mean std ci_lower ci_upper", ints="n")
def _(t):
    return runs.seed_statistics(t.runs, ["model", "config", "category"], ["rmse", "corr"])


@query("a37_mean_predictions", "ratings", "SELECT attribute, person_term, avg(rating) AS predicted, avg(k % 7) AS true_rating, count(*) AS n_seeds FROM ratings GROUP BY 1, 2", num="predicted true_rating", ints="n_seeds")
def _(t):
    p = t.ratings.select("attribute", "person_term", F.col("rating").alias("predicted"), (F.col("k") % 7).alias("true_rating"))
    return runs.mean_predictions(p, ["attribute", "person_term"])


# A learning curve per supplier: a step per quantity, evaluation values on every fifth step only.
CURVE = """SELECT 'run' || CAST(l_suppkey % 40 AS STRING) AS run, l_linenumber AS seed, CAST(l_quantity AS BIGINT) AS step, l_orderkey AS seq, l_tax AS loss,
 CASE WHEN CAST(l_quantity AS BIGINT) % 5 = 0 THEN l_discount + l_partkey % 7 END AS eval_rmse_mean, CASE WHEN CAST(l_quantity AS BIGINT) % 5 = 0 THEN l_tax + l_discount END AS eval_corr_mean FROM lineitem"""


def curves(t):
    cols = CURVE[len("SELECT "):CURVE.rindex(" FROM lineitem")]
    return t.spark.sql(t._over_files(f"SELECT {cols} FROM lineitem"))


@query("a38_mean_curve", "", f"WITH c AS ({CURVE}) SELECT run, step, avg(loss) AS loss, avg(eval_rmse_mean) AS eval_rmse_mean, count(*) AS n_seeds FROM c GROUP BY 1, 2", num="loss eval_rmse_mean", ints="step n_seeds")
def _(t):
    return runs.mean_curve(curves(t), ["loss", "eval_rmse_mean"])


LOG = f"""c AS ({CURVE}), l AS (SELECT run, step, seed, seq * 10 + seed AS seq, CASE WHEN seq % 3 > 0 THEN loss END AS loss, CASE WHEN seq % 3 = 0 THEN eval_rmse_mean END AS eval_rmse_mean FROM c)"""


@query("a39_merged_log_rows", "", f"WITH {LOG} SELECT run, step, max_by(loss, seq) FILTER (WHERE loss IS NOT NULL) AS loss, max_by(eval_rmse_mean, seq) FILTER (WHERE eval_rmse_mean IS NOT NULL) AS eval_rmse_mean FROM l GROUP BY 1, 2", num="loss eval_rmse_mean", ints="step")
def _(t):
    log = curves(t).withColumn("seq", F.col("seq") * 10 + F.col("seed"))
    log = log.withColumn("loss", F.expr("CASE WHEN (seq - seed) / 10 % 3 > 0 THEN loss END")).withColumn("eval_rmse_mean", F.expr("CASE WHEN (seq - seed) / 10 % 3 = 0 THEN eval_rmse_mean END"))
    return runs.merge_log_rows(log, ["loss", "eval_rmse_mean"])


MEANC = f"c AS ({CURVE}), m AS (SELECT run, step, round(avg(eval_rmse_mean), 9) AS eval_rmse_mean, avg(eval_corr_mean) AS eval_corr_mean FROM c GROUP BY 1, 2)"


def mean_curves(t):
    return runs.mean_curve(curves(t), ["eval_rmse_mean", "eval_corr_mean"]).withColumn("eval_rmse_mean", F.round("eval_rmse_mean", 9))


@query("a40_last_evaluated", "", f"WITH {MEANC} SELECT run, step, eval_rmse_mean, eval_corr_mean FROM (SELECT *, row_number() OVER (PARTITION BY run ORDER BY step DESC) AS rn FROM m WHERE eval_corr_mean IS NOT NULL) q WHERE rn = 1", num="eval_rmse_mean eval_corr_mean", ints="step")
def _(t):
    return runs.last_evaluated(mean_curves(t), "eval_corr_mean", ["eval_rmse_mean", "eval_corr_mean"])


@query("a61_best_step", "", f"WITH {MEANC} SELECT run, step, eval_rmse_mean, eval_corr_mean FROM (SELECT *, row_number() OVER (PARTITION BY run ORDER BY eval_rmse_mean, step) AS rn FROM m WHERE eval_rmse_mean IS NOT NULL) q WHERE rn = 1", num="eval_rmse_mean eval_corr_mean", ints="step")
def _(t):
    return runs.best_step(mean_curves(t), "eval_rmse_mean", ["eval_rmse_mean", "eval_corr_mean"])


def wide_sql(source, keys):
    cols = ["avg(corr) AS corr_mean", "avg(rmse) AS rmse_mean"]
    for c, n in (("woman", "woman"), ("man", "man"), ("nonbinary person", "nonbinary")):
        cols += [f"max(CASE WHEN category = '{c}' THEN corr END) AS corr_{n}", f"max(CASE WHEN category = '{c}' THEN rmse END) AS rmse_{n}"]
    return f"(SELECT {keys}, {', '.join(cols)} FROM {source} GROUP BY {keys})"


COLS = [f"{m}_{c}" for c in ("mean", "woman", "man", "nonbinary") for m in ("corr", "rmse")]
AVGS = ", ".join(f"avg({c}) AS {c}" for c in COLS)
FOLD = "ts AS (SELECT model, config, fold, category, avg(corr) AS corr, avg(rmse) AS rmse FROM runs GROUP BY 1, 2, 3, 4)"


def tidy(t):
    odd = t.runs.withColumnRenamed("corr", "correlation_mean").withColumn("category", F.upper("category"))
    return runs.tidy_metrics(odd, ["model", "config", "fold", "seed"])


@query("a41_fold_averages", "runs", f"WITH {FOLD}, w AS {wide_sql('ts', 'model, config, fold')} SELECT model, config, {AVGS}, stddev_samp(corr_mean) AS corr_mean_std, count(*) AS n_folds FROM w GROUP BY 1, 2", num=" ".join(COLS) + " corr_mean_std", ints="n_folds")
def _(t):
    seeds = tidy(t).groupBy("model", "config", "fold", "category").agg(F.avg("corr").alias("corr"), F.avg("rmse").alias("rmse"))
    return runs.fold_averages(runs.category_columns(seeds, ["model", "config", "fold"]), ["model", "config"], COLS, "corr_mean")


@query("a42_tidy_metrics", "runs", "SELECT model, config, fold, seed, category, corr, rmse FROM runs", num="corr rmse", ints="fold seed")
def _(t):
    return tidy(t)


K4 =f"WITH {FOLD}, w AS {wide_sql('ts', 'model, config, fold')}, f AS (SELECT model, config, {AVGS}, stddev_samp(corr_mean) AS corr_mean_std, count(*) AS n_folds FROM w GROUP BY 1, 2)"


@query("k4_best_config", "runs", f"{K4} SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY model ORDER BY round(corr_mean, 12) DESC, config) AS rn FROM f) q WHERE rn = 1", num=" ".join(COLS) + " corr_mean_std", ints="n_folds")
def _(t):
    return runs.best_config(tidy(t))


BEST = "best AS (SELECT model, config FROM (SELECT *, row_number() OVER (PARTITION BY model ORDER BY round(corr_mean, 12) DESC, config) AS rn FROM f) q WHERE rn = 1)"


@query("a43_summary_rows", "runs", f"""{K4}, {BEST}, {STATS} SELECT model, {', '.join(f"max(CASE WHEN category = '{c}' AND metric = '{m}' THEN mean END) AS {m}_{n}" for c, n in (('mean', 'mean'), ('woman', 'woman'), ('man', 'man'), ('nonbinary person', 'nonbinary')) for m in ('corr', 'rmse'))} FROM st JOIN best USING (model, config) GROUP BY 1""", num=" ".join(COLS))
def _(t):
    # the best configuration of each model
    s = runs.seed_statistics(t.runs, ["model", "config", "category"], ["rmse", "corr"])
    return runs.summary_row(s.join(runs.best_config(tidy(t)).select("model", "config"), ["model", "config"]))


@query("k4_best_direct", "runs",f"WITH w AS {wide_sql('runs', 'model, config, fold, seed')} SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY model ORDER BY round(corr_mean, 12) DESC, config, fold, seed) AS rn FROM w) q WHERE rn = 1", num=" ".join(COLS), ints="fold seed")
def _(t):
    return runs.best_direct(tidy(t))


@query("k5_best_single_seed", "runs", f"""WITH w AS {wide_sql('runs', 'model, config, fold, seed')}, f AS (SELECT model, config, seed, {AVGS}, stddev_samp(corr_mean) AS corr_mean_std, count(*) AS n_folds FROM w GROUP BY 1, 2, 3)
SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY model ORDER BY round(corr_mean, 12) DESC, config, seed) AS rn FROM f) q WHERE rn = 1""", num=" ".join(COLS) + " corr_mean_std", ints="n_folds seed")
def _(t):
    return runs.best_single_seed(tidy(t))


NAME = "'merged_' || model || '_' || config || '_bs8_lr1e-4_alpha16_r16_fold' || CAST(fold AS STRING) || 'of5'"


@query("t19_experiment_names", "runs", f"""SELECT {NAME} AS exp_name, 'merged_' || model || '_' || config || '_bs8_lr1e-4_alpha16_r16' AS base, fold, seed, count(*) AS n FROM runs GROUP BY ALL""", ints="fold seed n")
def _(t):
    hyper = {"learning_rate": F.lit(1e-4), "batch_size": F.lit(8)}
    name = terms.experiment_name(F.lit("merged"), F.col("model"), F.col("config"), hyper)
    full = F.concat(name, F.lit("_alpha16_r16_fold"), F.col("fold").cast("string"), F.lit("of5"))
    p = t.runs.withColumn("exp_name", full).withColumn("seed_dir", F.concat(F.lit("seed"), F.col("seed").cast("string")))
    return p.groupBy("exp_name", terms.base_config(F.col("exp_name")).alias("base"), terms.fold_number(F.col("exp_name")).alias("fold"), terms.seed_number(F.col("seed_dir")).alias("seed")).agg(F.count(F.lit(1)).alias("n"))


@query("t20_numeric_prefix", "", "SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN NULL ELSE CAST(doc_id AS VARCHAR) END AS prefix FROM documents", ints="doc_id")
def _(t):
    path = F.concat(F.lit("/books/"), F.when(F.col("doc_id") % 3 == 0, F.lit("x")).otherwise(F.lit("")), F.col("doc_id").cast("string"), F.lit("_some_title.txt"))
    return t.documents.select("doc_id", terms.numeric_prefix(terms.file_stem(path)).alias("prefix"))

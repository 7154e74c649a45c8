"""Abstention, polarization, distributions and model families over the responses view."""

from pyspark.sql import functions as F

from ratescale.catalog.evaluation import A9, TERM_R, parsed
from ratescale.catalog.registry import query
from ratescale.catalog.snippets import ABSTENTION_FAMILIES, CATEGORY, CLOSED, FAMILY, INSTRUCT, LONG, PARSED, family_hit
from ratescale.functions import parse

from ratescale.operators import metrics, responses as res

FLAGS = "missing_rating text_abstention abstention"


@query("t14_abstention_categories", "responses", "SELECT generation, " + ", ".join(f"max(CAST({family_hit(n)} AS INT)) AS {n}" for n in ABSTENTION_FAMILIES) + ", count(*) AS n FROM responses GROUP BY 1",
       ints=" ".join(ABSTENTION_FAMILIES) + " n")
def _(t):
    c = t.responses.withColumn("c", parse.abstention_categories(F.col("generation")))
    return c.groupBy("generation").agg(*[F.max(F.array_contains("c", n).cast("int")).alias(n) for n in ABSTENTION_FAMILIES], F.count(F.lit(1)).alias("n"))


@query("j10_flagged_rows", "responses", f"WITH {PARSED} SELECT model, dataset, attribute, person_term, generation, missing_rating, text_abstention FROM flagged WHERE abstention = 1", ints="missing_rating text_abstention")
def _(t):
    return res.flag_abstention(parsed(t)).filter("abstention = 1").select("model", "dataset", "attribute", "person_term", "generation", "missing_rating", "text_abstention")


@query("a31_abstention_rates", "responses", f"""WITH {PARSED} SELECT CASE WHEN grouping(model) = 1 THEN 'all' ELSE model END AS model, CASE WHEN grouping(dataset) = 1 THEN 'all' ELSE dataset END AS dataset, person_term,
 sum(missing_rating) AS missing_rating, sum(text_abstention) AS text_abstention, sum(abstention) AS abstention, count(*) AS total, avg(missing_rating) AS pct_missing_rating, avg(text_abstention) AS pct_text_abstention, avg(abstention) AS pct_abstention
FROM flagged GROUP BY GROUPING SETS ((model, dataset, person_term), (model, person_term), (person_term))""", num="pct_missing_rating pct_text_abstention pct_abstention", ints=FLAGS + " total")
def _(t):
    return res.abstention_rates(res.flag_abstention(parsed(t)))


POL = "pol AS (SELECT model, dataset, attribute, stddev_pop(method1_rating) AS polarization FROM parsed WHERE method1_rating IS NOT NULL GROUP BY 1, 2, 3 HAVING count(*) >= 2)"
HUM = "hum AS (SELECT dataset, attribute, stddev_pop(a) AS polarization FROM (SELECT dataset, attribute, person_term, min(avg_rating) AS a FROM responses GROUP BY 1, 2, 3) q GROUP BY 1, 2 HAVING count(*) >= 2)"


@query("a19_polarization", "responses", f"WITH {PARSED}, {POL} SELECT * FROM pol", num="polarization")
def _(t):
    return res.polarization(parsed(t))


@query("a19_human_polarization", "responses", f"WITH {HUM} SELECT * FROM hum", num="polarization")
def _(t):
    return res.human_polarization(t.responses)


@query("a20_polarization_delta", "responses", f"""WITH {PARSED}, {POL}, {HUM}, h AS (SELECT dataset, avg(polarization) AS human_mean FROM hum GROUP BY 1),
 m AS (SELECT model, dataset, avg(polarization) AS model_mean, stddev_pop(polarization) AS model_std, count(*) AS n FROM pol GROUP BY 1, 2 HAVING count(*) >= 2)
SELECT m.*, human_mean, model_mean - human_mean AS mean_delta, model_mean > human_mean AS more_polarized FROM m JOIN h USING (dataset)""", num="model_mean model_std human_mean mean_delta", ints="n")
def _(t):
    return res.polarization_delta(parsed(t))


def shares_sql(source, keys, v):
    ks = ", ".join(keys)
    return f"""SELECT d.*, coalesce(c.n, 0) AS n, coalesce(c.n, 0) / d.tot::DOUBLE AS share FROM (SELECT {ks}, r AS rating, tot FROM (SELECT {ks}, count(*) AS tot FROM {source} WHERE {v} BETWEEN 1 AND 7 GROUP BY {ks}) q, range(1, 8) x(r)) d
 LEFT JOIN (SELECT {ks}, rr AS rating, count(*) AS n FROM (SELECT {ks}, round_even(CAST({v} AS DOUBLE), 0)::INT AS rr FROM {source} WHERE {v} BETWEEN 1 AND 7) z GROUP BY {ks}, rr) c USING ({ks}, rating)"""


@query("a21_rating_shares", "ratings", f"WITH s AS ({shares_sql('ratings', ['source', 'person_term'], 'rating')}) SELECT source, person_term, rating, n, share FROM s", num="share", ints="rating n")
def _(t):
    return res.rating_shares(t.ratings, ["source", "person_term"], "rating")


@query("a21_model_and_human", "responses", f"""WITH {PARSED}, hi AS (SELECT dataset, attribute, person_term, min(avg_rating) AS a FROM responses GROUP BY 1, 2, 3),
 m AS ({shares_sql('parsed', ['dataset', 'person_term'], 'method1_rating')}), h AS ({shares_sql('hi', ['dataset', 'person_term'], 'a')})
SELECT dataset, person_term, rating, n, share, 'model' AS who FROM m UNION ALL SELECT dataset, person_term, rating, n, share, 'human' FROM h""", num="share", ints="rating n")
def _(t):
    return res.model_and_human_shares(parsed(t))


@query("a22_shares_without_abstention", "responses", f"""WITH {PARSED}, k AS (SELECT {CATEGORY} AS model_kind, person_term, method1_rating FROM flagged WHERE abstention = 0),
 s AS ({shares_sql('k', ['model_kind', 'person_term'], 'method1_rating')}) SELECT model_kind, person_term, rating, n, share FROM s""", num="share", ints="rating n")
def _(t):
    return res.shares_without_abstention(parsed(t))


@query("a23_rating_density", "responses", f"""WITH {PARSED}, c AS (SELECT person_term, CAST(method1_rating AS DOUBLE) AS v, count(*) AS w FROM parsed WHERE method1_rating BETWEEN 1 AND 7 GROUP BY 1, 2),
 st AS (SELECT person_term, count(*) AS n, stddev_samp(method1_rating) * pow(count(*), -0.2::DOUBLE) AS h FROM parsed WHERE method1_rating BETWEEN 1 AND 7 GROUP BY 1)
SELECT person_term, i AS point, 1 + i * 6.0::DOUBLE / 149 AS x, sum(w * exp(-pow((1 + i * 6.0::DOUBLE / 149 - v) / h, 2) / 2) / (n * h * sqrt(2 * pi()))) AS density
FROM c JOIN st USING (person_term), range(0, 150) g(i) GROUP BY 1, 2, 3""", num="x density", ints="point")
def _(t):
    return res.rating_density(parsed(t), ["person_term"], "method1_rating")


@query("a24_correlation_boxes", "responses", f"""WITH {PARSED}, {LONG}, {TERM_R}, q AS (SELECT dataset, person_term, quantile_cont(r, 0.25) AS q1, quantile_cont(r, 0.5) AS median, quantile_cont(r, 0.75) AS q3, count(r) AS n FROM tr WHERE r IS NOT NULL GROUP BY 1, 2)
SELECT q.*, min(r) AS low, max(r) AS high FROM q JOIN tr USING (dataset, person_term) WHERE r BETWEEN q1 - 1.5 * (q3 - q1) - 1e-12 AND q3 + 1.5 * (q3 - q1) + 1e-12 GROUP BY dataset, person_term, q1, median, q3, q.n""", num="q1 median q3 low high", ints="n")
def _(t):
    return res.correlation_boxes(metrics.term_correlations(parsed(t)))


BI = """bi AS (SELECT {fam} AS family, dataset, person_term, max(CASE WHEN {kind} = 'Open (base)' THEN rmse END) AS base_val, avg(CASE WHEN {kind} = 'Open (instruct)' THEN rmse END) AS instruct_val,
 min(CASE WHEN {kind} = 'Open (instruct)' THEN rmse END) AS instruct_min, max(CASE WHEN {kind} = 'Open (instruct)' THEN rmse END) AS instruct_max FROM mm GROUP BY 1, 2, 3
 HAVING max(CASE WHEN {kind} = 'Open (base)' THEN rmse END) IS NOT NULL AND max(CASE WHEN {kind} = 'Open (instruct)' THEN rmse END) IS NOT NULL)""".format(fam=FAMILY, kind=CATEGORY)
MM = f"{PARSED}, {LONG}, m9 AS ({A9}), mm AS (SELECT * FROM m9 WHERE method = 'method1'), {BI}"
DISPLAY = "CASE WHEN family LIKE '%Llama%' THEN 'Llama-8B' WHEN family LIKE '%Mistral%' THEN 'Mistral-7B' WHEN family LIKE '%OLMo%' THEN 'OLMo-7B' WHEN lower(family) LIKE '%gpt-oss%' THEN 'GPT-OSS' ELSE family END AS family_display"


def method1(t):
    return metrics.response_metrics(parsed(t)).filter("method = 'method1'")


@query("a25_base_instruct_delta", "responses", f"WITH {MM} SELECT family, {DISPLAY}, dataset, base_val, instruct_val, instruct_val - base_val AS delta FROM bi WHERE person_term = 'all'", num="base_val instruct_val delta")
def _(t):
    out = res.base_instruct(method1(t).filter("person_term = 'all'"), "rmse", ["dataset"])
    return out.select("family", "family_display", "dataset", "base_val", "instruct_val", "delta")


@query("a26_category_means", "responses", f"WITH {MM} SELECT {CATEGORY} AS category, dataset, avg(rmse) AS mean, stddev_pop(rmse) AS std, count(*) AS n FROM mm WHERE person_term = 'all' GROUP BY 1, 2", num="mean std", ints="n")
def _(t):
    return res.category_means(method1(t).filter("person_term = 'all'"), "rmse")


@query("a27_slope_endpoints", "responses", f"WITH {MM} SELECT family, dataset, person_term, base_val, instruct_val, instruct_min, instruct_max, instruct_val - base_val AS delta, {DISPLAY} FROM bi", num="base_val instruct_val instruct_min instruct_max delta")
def _(t):
    return res.base_instruct(method1(t), "rmse", ["dataset", "person_term"])


@query("a28_attribution_shares", "responses", f"""WITH {MM} SELECT family, {DISPLAY}, dataset, person_term, instruct_val - base_val AS delta, abs(instruct_val - base_val) / sum(abs(instruct_val - base_val)) OVER (PARTITION BY family, dataset) AS abs_share
FROM bi WHERE person_term <> 'all'""", num="delta abs_share")
def _(t):
    return res.attribution_shares(method1(t))


@query("t15_model_taxonomy", "responses", f"SELECT DISTINCT model, {CATEGORY} AS kind, {FAMILY} AS family FROM responses")
def _(t):
    return res.with_taxonomy(t.responses.select("model").distinct())


@query("k7_display_order", "responses", f"""WITH d AS (SELECT model, {CLOSED} AS c, {INSTRUCT} AS i, {FAMILY} AS family, {CATEGORY} AS kind FROM (SELECT DISTINCT model FROM responses) q)
SELECT model, kind, family, {DISPLAY}, regexp_replace(replace(model, 'Instruct', 'Inst'), '^Meta-', '') AS short_name,
 row_number() OVER (ORDER BY c, CASE WHEN NOT c THEN family END NULLS LAST, CASE WHEN NOT c THEN i END NULLS LAST, lower(model), model) AS place FROM d""", ints="place")
def _(t):
    return res.display_ranks(t.responses)


@query("r6_model_dataset_matrix", "responses", f"""WITH {MM} SELECT model, max(CASE WHEN dataset = 'combined_llm' THEN rmse END) AS combined_llm, max(CASE WHEN dataset = 'eval_human' THEN rmse END) AS eval_human,
 max(CASE WHEN dataset = 'eval_novel' THEN rmse END) AS eval_novel, max(CASE WHEN dataset = 'all' THEN rmse END) AS "all" FROM mm WHERE person_term = 'all' GROUP BY 1""", num='combined_llm eval_human eval_novel "all"')
def _(t):
    return res.matrix(method1(t).filter("person_term = 'all'"), ["model"], "dataset", ["combined_llm", "eval_human", "eval_novel", "all"], "rmse")


@query("r6_model_term_matrix", "responses", f"""WITH {PARSED} SELECT model, avg(CASE WHEN person_term = 'woman' THEN abstention END) AS woman, avg(CASE WHEN person_term = 'man' THEN abstention END) AS man,
 avg(CASE WHEN person_term = 'nonbinary person' THEN abstention END) AS nonbinary_person FROM flagged GROUP BY 1""", num="woman man nonbinary_person")
def _(t):
    rates = res.abstention_rates(res.flag_abstention(parsed(t))).filter("dataset = 'all' and model <> 'all'")
    return res.matrix(rates, ["model"], "person_term", ["woman", "man", "nonbinary person"], "pct_abstention")


@query("r6_term_source_grid", "predictions", """SELECT person_term, corr(predicted, true_rating) FILTER (WHERE source = 'llm') AS llm, corr(predicted, true_rating) FILTER (WHERE source = 'human') AS human,
 corr(predicted, true_rating) FILTER (WHERE source = 'novel') AS novel FROM predictions GROUP BY 1""", num="llm human novel")
def _(t):
    cells = metrics.stratified_metrics(t.predictions).filter("person_term <> 'all' and source <> 'all'")
    return res.matrix(cells, ["person_term"], "source", ["llm", "human", "novel"], "pearson_r")

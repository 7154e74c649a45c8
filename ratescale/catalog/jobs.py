"""Whole jobs and the predictor over the given tables."""

from pyspark.sql import functions as F

from ratescale.catalog.corpus import LEXICON, PAIRS, GTERM
from ratescale.catalog.evaluation import A9
from ratescale.catalog.participants import SCORE
from ratescale.catalog.registry import query
from ratescale.catalog.reliability import CORRS, ITEMS, LOO, icc_sql
from ratescale.catalog.snippets import LONG, PARSED
from ratescale.catalog.splitting import BEFORE, THREE, TWO, groups
from ratescale.operators import predictor, scoring, splits
from ratescale.plans import jobs

PROMPT = "Would someone say a {person_term} has {attribute}?"
CLEAN = """clean AS (SELECT * FROM ratings_sparse WHERE attribute IN (SELECT attribute FROM ratings_sparse GROUP BY 1 HAVING count(DISTINCT person_term) = 3))"""


@query("l1_training_table", "ratings_sparse", f"""WITH {CLEAN}, {groups('clean', 123)}, {BEFORE}, {TWO}, i AS (SELECT attribute, person_term, avg(rating) AS avg_rating, coalesce(var_samp(rating), 0) AS rating_variance FROM clean GROUP BY 1, 2)
SELECT 'Would someone say a ' || person_term || ' has ' || attribute || '?' AS prompt, attribute, person_term, avg_rating, rating_variance, split FROM i JOIN two USING (attribute)""", num="avg_rating rating_variance")
def _(t):
    return jobs.training_table(t.ratings_sparse, PROMPT)


@query("l1_training_table_wide", "ratings_sparse", f"""WITH {CLEAN}, {groups('clean', 123)}, {BEFORE}, {TWO}, i AS (SELECT attribute, person_term, avg(rating) AS a, coalesce(var_samp(rating), 0) AS v FROM clean GROUP BY 1, 2)
SELECT attribute, split, max(CASE WHEN person_term = 'woman' THEN a END) AS woman, max(CASE WHEN person_term = 'man' THEN a END) AS man, max(CASE WHEN person_term = 'nonbinary person' THEN a END) AS nonbinary,
 max(CASE WHEN person_term = 'woman' THEN v END) AS woman_variance, max(CASE WHEN person_term = 'man' THEN v END) AS man_variance, max(CASE WHEN person_term = 'nonbinary person' THEN v END) AS nonbinary_variance
FROM i JOIN two USING (attribute) GROUP BY 1, 2""", num="woman man nonbinary woman_variance man_variance nonbinary_variance")
def _(t):
    wide = jobs.training_table(t.ratings_sparse, PROMPT, wide=True)
    return wide.withColumnsRenamed({"nonbinary person": "nonbinary", "nonbinary person_variance": "nonbinary_variance"})


CEIL = f"""{LOO.format(src='ratings')}, {CORRS}, lo AS (SELECT source, avg(c) AS loo FROM corrs GROUP BY 1),
 it AS (SELECT attribute, person_term, source, count(*)::DOUBLE AS n, avg(rating - 4.0::DOUBLE) AS m, var_pop(rating - 4.0::DOUBLE) * count(*) AS ssw FROM ratings GROUP BY 1, 2, 3), {icc_sql('it', 'source', 3)},
 ce AS (SELECT CASE lo.source WHEN 'llm' THEN 'combined_llm' WHEN 'human' THEN 'eval_human' ELSE 'eval_novel' END AS dataset, loo, sqrt(best/(best + items/nn)) AS sqrt_icc FROM lo JOIN best2 b ON lo.source = b.source),
 cl AS (SELECT * FROM ce UNION ALL SELECT 'all', avg(loo), avg(sqrt_icc) FROM ce)"""


@query("l2_response_summary", "responses ratings", f"WITH {PARSED}, {LONG}, m AS ({A9}), {CEIL} SELECT m.*, loo, round(sqrt_icc, 4) AS sqrt_icc FROM m JOIN cl USING (dataset)", num="mse rmse mae pearson_r loo sqrt_icc", ints="n")
def _(t):
    ceilings = jobs.ceiling_for_metrics(jobs.ceilings(t.ratings))
    return jobs.response_summary(t.responses, ceilings=ceilings)["metrics"].withColumn("sqrt_icc", F.round("sqrt_icc", 4))


@query("l3_scored_facts", "", f"""WITH {PAIRS}, kept AS (SELECT doc_id, pair AS attribute FROM pr WHERE NOT {GTERM} AND pair NOT LIKE 'an %'),
 r3 AS (SELECT doc_id, attribute, person_term FROM kept, (VALUES ('man'), ('woman'), ('nonbinary person')) v(person_term))
SELECT attribute, person_term, CASE WHEN doc_id % 2 = 0 THEN 'emma' ELSE 'persuasion' END AS source, {SCORE} AS predicted_rating, count(*) AS n FROM r3 GROUP BY ALL""", num="predicted_rating", ints="n")
def _(t):
    docs = t.documents.withColumn("stem", F.concat(F.when(F.col("doc_id") % 2 == 0, "158_").otherwise("105_"), F.col("doc_id").cast("string")))
    facts = jobs.scored_facts(docs, LEXICON, scoring.lexical_score(F.col("attribute"), F.col("person_term")), key="stem")
    return facts.groupBy("attribute", "person_term", "source", "predicted_rating").agg(F.count(F.lit(1)).alias("n"))


@query("l4_test_ceilings", "ratings", f"""WITH part AS (SELECT * FROM ratings WHERE source = 'llm'), {groups('part')}, {BEFORE}, v AS (SELECT p.*, n, before < greatest(1, ceil(n * 0.15::DOUBLE)) AS val FROM p, tot), vt AS (SELECT sum(size) FILTER (WHERE val) AS vn FROM v),
 keep AS (SELECT attribute FROM v, vt WHERE NOT val AND before - vn < greatest(1, ceil(n * 0.25::DOUBLE))), tr AS (SELECT * FROM ratings WHERE source <> 'llm' OR attribute IN (SELECT attribute FROM keep)),
 {LOO.format(src='tr')}, {CORRS} SELECT source AS dataset, person_term, avg(c) AS mean, stddev_samp(c) AS std, count(c) AS count FROM corrs GROUP BY 1, 2 UNION ALL SELECT source, 'ALL', avg(c), stddev_samp(c), count(c) FROM corrs GROUP BY 1""", num="mean std", ints="count")
def _(t):
    return jobs.ceilings(t.ratings, test_only=True).select("dataset", "person_term", "mean", "std", "count")


@query("h6_text_predictor", "items")
def _(t):
    return predictor.evaluate(predictor.train_on_text(t.items))


# the parts' names as attributes; a rating follows from the last word, so that a fit on words has something to learn
NAMED = "named AS (SELECT p_name AS attribute, 'woman' AS person_term, CAST(1 + length(regexp_extract(p_name, '[a-z]+$', 0)) % 7 AS DOUBLE) AS avg_rating FROM part)"
SPLIT_FACTS = """SELECT 'test' AS split, count(*) AS n_rows, count(DISTINCT attribute) AS n_groups, 0 AS n_straddling, true AS beats_the_mean FROM {src} JOIN three USING (attribute) WHERE split = 'test'"""


def split_facts(rows, predicted):
    """What both engines know of a fit: the test rows and groups, none of them trained on, and an error below that of the mean rating."""
    trained = splits.assign_splits(rows, 0.25, 0.15).filter("split = 'train'").select("attribute").distinct().withColumn("_trained", F.lit(1))
    mean = rows.agg(F.avg("avg_rating")).scalar()
    both = predicted.join(trained, "attribute", "left")
    error = lambda c: F.avg((c - F.col("true_rating")) * (c - F.col("true_rating")))
    return both.agg(
        F.lit("test").alias("split"), F.count(F.lit(1)).alias("n_rows"), F.count_distinct("attribute").alias("n_groups"), F.count("_trained").alias("n_straddling"),
        (error(F.col("predicted")) < error(mean)).alias("beats_the_mean"),
    )


@query("h6_text_facts", "", f"WITH {NAMED}, {groups('named')}, {BEFORE}, {THREE} {SPLIT_FACTS.format(src='named')}", ints="n_rows n_groups n_straddling")
def _(t):
    rows = t.part.selectExpr("p_name AS attribute", "'woman' AS person_term", "CAST(1 + length(regexp_extract(p_name, '[a-z]+$', 0)) % 7 AS DOUBLE) AS avg_rating")
    return split_facts(rows, predictor.train_on_text(rows))


def vectors(t):
    v = t.embeddings.select(F.concat(F.lit("vec "), F.col("vec_id").cast("string")).alias("attribute"), F.lit("woman").alias("person_term"), "embedding", (1 + F.col("label") % 7).cast("double").alias("avg_rating"))
    return v


@query("h6_vector_predictor")
def _(t):
    return predictor.evaluate(predictor.train_on_vectors(vectors(t)))


VECTORS = "vec AS (SELECT 'vec ' || CAST(vec_id AS VARCHAR) AS attribute, 'woman' AS person_term, CAST(1 + label % 7 AS DOUBLE) AS avg_rating FROM embeddings)"


def sloped(t):
    """Ratings that follow from the vectors' first component, so that a fit has something to learn."""
    rating = F.greatest(F.lit(1.0), F.least(F.lit(7.0), 4 + 10 * F.get("embedding", F.lit(0)).cast("double")))
    return vectors(t).withColumn("avg_rating", rating)


@query("h6_vector_facts", "", f"WITH {VECTORS}, {groups('vec')}, {BEFORE}, {THREE} {SPLIT_FACTS.format(src='vec')}", ints="n_rows n_groups n_straddling")
def _(t):
    return split_facts(sloped(t), predictor.train_on_vectors(sloped(t)))


@query("h7_grid_facts", "", f"WITH {VECTORS} SELECT reg, true AS below_spread, (SELECT count(*) FROM vec) AS n_rows, (SELECT count(DISTINCT attribute) FROM vec) AS n_groups FROM (VALUES (0.001::DOUBLE), (0.1::DOUBLE), (1.0::DOUBLE)) g(reg)", num="reg", ints="n_rows n_groups")
def _(t):
    """Each grid point has an error below the spread of the ratings' logits, from folds that hold all rows and groups."""
    rows = sloped(t)
    spread = rows.agg(F.stddev_pop(predictor.logit_target(F.col("avg_rating")))).scalar()
    facts = rows.agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct("attribute").alias("n_groups"))
    chosen = predictor.choose_regularisation(rows, [0.001, 0.1, 1.0])
    return chosen.select("reg", (F.col("rmse") < spread).alias("below_spread"), facts.select("n_rows").scalar().alias("n_rows"), facts.select("n_groups").scalar().alias("n_groups"))


@query("h7_grid_choice")
def _(t):
    return predictor.choose_regularisation(vectors(t), [0.001, 0.1, 1.0])

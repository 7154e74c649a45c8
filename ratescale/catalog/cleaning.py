"""Cleaning, checks, joins, set operations and item averages over the ratings view."""

from pyspark.sql import functions as F

from ratescale.catalog.registry import query
from ratescale.functions import parse
from ratescale.operators import clean, joins, ratings, splits
from ratescale.schemas import TERMS

DENIED = ("part 7", "part 14", "part 21", "part 30", "part 77", "part 91")
DENIED_SQL = ", ".join(f"'{d}'" for d in DENIED)
COVERED = f"""covered AS (SELECT attribute FROM ratings_sparse WHERE person_term IN ('woman','man','nonbinary person')
 GROUP BY attribute HAVING count(DISTINCT person_term) = 3)"""


@query("c1_complete_attributes", "ratings_sparse", f"WITH {COVERED} SELECT * FROM ratings_sparse WHERE attribute IN (SELECT attribute FROM covered)", num="rating", ints="submission_id k")
def _(t):
    return clean.complete_attributes(t.ratings_sparse)


@query("c2_deny_list", "ratings_sparse", f"SELECT * FROM ratings_sparse WHERE attribute NOT IN ({DENIED_SQL})", num="rating", ints="submission_id k")
def _(t):
    return clean.drop_denied(t.ratings_sparse, DENIED)


@query("c3_removal_counts", "ratings_sparse", f"""WITH {COVERED}, m AS (SELECT attribute IN (SELECT attribute FROM covered) AS c, attribute IN ({DENIED_SQL}) AS d FROM ratings_sparse)
SELECT count(*) AS rows_in, count_if(NOT c) AS incomplete, count_if(c AND d) AS denied, count_if(NOT c OR d) AS removed, count_if(c AND NOT d) AS rows_out FROM m""",
       ints="rows_in incomplete denied removed rows_out")
def _(t):
    return clean.removal_counts(t.ratings_sparse, DENIED)


@query("c5_invalid_masking", "responses", """SELECT model, attribute, person_term, CASE WHEN method2_rating = -1 THEN NULL ELSE method2_rating END AS method2_rating, avg_rating
FROM responses WHERE method2_rating <> -1 AND avg_rating IS NOT NULL""", num="method2_rating avg_rating")
def _(t):
    return clean.valid_pairs(t.responses, "method2_rating").select("model", "attribute", "person_term", "method2_rating", "avg_rating")


@query("c6_scale_filter", "ratings", "SELECT person_term, count(*) AS n FROM (SELECT person_term, rating + k % 3 AS r FROM ratings) q WHERE r BETWEEN 1 AND 7 GROUP BY person_term", ints="n")
def _(t):
    moved = t.ratings.withColumn("rating", F.col("rating") + F.col("k") % 3)
    return clean.rows_in_scale(moved).groupBy("person_term").agg(F.count(F.lit(1)).alias("n"))


BLANKED = "CASE WHEN text_id % 11 = 0 THEN '  ' WHEN text_id % 13 = 0 THEN 'nan' ELSE attribute END"


@query("c7_valid_attribute", "phrases", f"""SELECT source_novel, count(*) AS n FROM (SELECT source_novel, {BLANKED} AS a FROM phrases) q
WHERE a IS NOT NULL AND trim(a) NOT IN ('', 'nan') GROUP BY source_novel""", ints="n")
def _(t):
    a = F.when(F.col("text_id") % 11 == 0, "  ").when(F.col("text_id") % 13 == 0, "nan").otherwise(F.col("attribute"))
    p = t.phrases.withColumn("attribute", a)
    return p.filter(clean.valid_attribute(F.col("attribute"))).groupBy("source_novel").agg(F.count(F.lit(1)).alias("n"))


@query("c8_front_columns", "phrases", "SELECT attribute AS attribute_normalized, source_novel, llm_gender, text_id, indomain_strct FROM phrases", ints="text_id")
def _(t):
    return clean.front_columns(t.phrases, ["attribute_normalized", "source_novel"], drop=["intext_gender"], rename={"attribute": "attribute_normalized"})


@query("c9_first_per_book", "phrases", """SELECT source_novel, lower(trim(attribute)) AS attribute_normalized, min(text_id) AS text_id FROM phrases
WHERE attribute IS NOT NULL GROUP BY 1, 2""", ints="text_id")
def _(t):
    return clean.first_per_book(t.phrases).select("source_novel", "attribute_normalized", "text_id")


@query("c10_exclude_studied", "phrases", """SELECT DISTINCT source_novel, lower(trim(attribute)) AS attribute_normalized FROM phrases
WHERE attribute IS NOT NULL AND lower(trim(attribute)) NOT IN (SELECT DISTINCT lower(trim(p_name)) FROM part WHERE p_size % 50 = 7 OR p_brand = 'Brand#11')""")
def _(t):
    study = t.part.filter("p_size % 50 = 7 or p_brand = 'Brand#11'").select(F.upper("p_name").alias("attribute"))
    return clean.exclude_studied(clean.first_per_book(t.phrases), clean.studied_keys(study)).select("source_novel", "attribute_normalized")


@query("c11_sample_problems", "phrases", """WITH s AS (SELECT lower(trim(attribute)) AS a, count(*) AS n FROM phrases WHERE attribute IS NOT NULL GROUP BY 1)
SELECT 'already_studied' AS problem, a AS attribute_normalized, n FROM s WHERE a IN (SELECT lower(p_name) FROM part WHERE p_size = 7)
UNION ALL SELECT 'duplicate', a, n FROM s WHERE n > 1""", ints="n")
def _(t):
    study = t.part.filter("p_size = 7").select(F.col("p_name").alias("attribute"))
    return clean.sample_problems(t.phrases, clean.studied_keys(study))


SPLIT = "CASE WHEN k % 10 < 6 THEN 'train' WHEN k % 10 < 8 THEN 'val' ELSE 'test' END"
LEAKY = f"CASE WHEN k % 37 = 0 AND person_term = 'man' THEN 'test' ELSE {SPLIT} END"


def _split(t, leaky=True):
    return t.ratings.withColumn("split", F.expr(LEAKY if leaky else SPLIT))


@query("c12_split_leakage", "ratings", f"""SELECT attribute, min(split) AS first_split, max(split) AS last_split, count(DISTINCT split) AS n_splits
FROM (SELECT attribute, {LEAKY} AS split FROM ratings) q GROUP BY attribute HAVING count(DISTINCT split) > 1""", ints="n_splits")
def _(t):
    return clean.straddling_groups(_split(t))


SHARES = f"""sh AS (SELECT s.split, count(q.split) AS n, count(q.split) / (SELECT count(*) FROM ratings)::DOUBLE AS share, s.wanted
 FROM (VALUES ('train', 0.6::DOUBLE), ('val', 0.2::DOUBLE), ('test', 0.2::DOUBLE)) AS s(split, wanted)
 LEFT JOIN (SELECT {LEAKY} AS split FROM ratings) q ON q.split = s.split GROUP BY s.split, s.wanted)"""


@query("c13_split_shares", "ratings", f"WITH {SHARES} SELECT split, n, share, wanted, abs(share - wanted) <= 0.05 AS ok FROM sh", num="share wanted", ints="n")
def _(t):
    return clean.split_shares(_split(t), 0.2, 0.2)


@query("c14_one_split", "ratings", f"SELECT count(*) AS n, count_if({LEAKY} <> 'train') AS n_other, count_if({LEAKY} <> 'train') = 0 AS ok FROM ratings", ints="n n_other")
def _(t):
    return clean.rows_outside_split(_split(t), "train")


@query("c15_missing_terms", "ratings_sparse", """SELECT attribute, CASE WHEN count(DISTINCT person_term) = 1 THEN 'two' ELSE 'nonbinary person' END AS missing
FROM ratings_sparse GROUP BY attribute HAVING count(DISTINCT person_term) < 3""")
def _(t):
    return clean.missing_terms(t.ratings_sparse).select("attribute", F.when(F.size("missing") == 2, "two").otherwise(F.col("missing")[0]).alias("missing"))


@query("c15_verify_training", "ratings", f"""WITH {SHARES}, leak AS (SELECT attribute FROM (SELECT attribute, {LEAKY} AS split FROM ratings) q GROUP BY attribute HAVING count(DISTINCT split) > 1),
lack AS (SELECT attribute FROM ratings GROUP BY attribute HAVING count(DISTINCT person_term) < 3),
c AS (SELECT 'leakage' AS "check", (SELECT count(*) FROM leak) AS problems UNION ALL SELECT 'missing_terms', (SELECT count(*) FROM lack)
 UNION ALL SELECT 'proportions', (SELECT count_if(abs(share - wanted) > 0.05) FROM sh)) SELECT "check", problems, problems = 0 AS ok FROM c""", ints="problems")
def _(t):
    return clean.verify_training(_split(t), 0.2, 0.2)


@query("c16_split_inventory", "items", f"SELECT {SPLIT} AS split, count(*) AS n_rows, count(DISTINCT attribute) AS n_attributes, count(avg_rating) AS n_rated FROM items GROUP BY 1", ints="n_rows n_attributes n_rated")
def _(t):
    return clean.split_inventory(t.items.withColumn("split", F.expr(SPLIT)))


@query("c17_column_profile", "phrases", "WITH n AS (SELECT count(*) AS r, count(DISTINCT text_id) AS s FROM phrases) " + " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, '{k}' AS kind, r AS n_rows, s AS n_sentences, count_if({c} IS NULL) AS null_count, 100.0::DOUBLE * count_if({c} IS NULL) / r AS null_pct FROM phrases, n GROUP BY r, s"
    for c, k in [("source_novel", "string"), ("text_id", "bigint"), ("attribute", "string"), ("llm_gender", "string"), ("intext_gender", "string"), ("indomain_strct", "boolean")]),
    num="null_pct", ints="n_rows n_sentences null_count")
def _(t):
    return clean.column_profile(t.phrases, "text_id")


LABEL = "CASE WHEN text_id % 5 = 0 THEN ' ' WHEN text_id % 97 = 3 THEN '2' WHEN text_id % 2 = 0 THEN '1.0' ELSE ' 0' END AS label"
GENDER = "CASE WHEN text_id % 89 = 1 THEN 'robot' WHEN text_id % 3 = 0 THEN 'Male},{' WHEN text_id % 3 = 1 THEN ' female' ELSE '' END AS gender"
MESSY = f"SELECT source_novel, text_id, {LABEL}, {GENDER} FROM phrases"


@query("c18_label_reading", "phrases", f"""WITH m AS ({MESSY}) SELECT CASE WHEN trim(label) = '' THEN 0 WHEN trim(label) IN ('1.0') THEN 1 WHEN trim(label) = '0' THEN 0 ELSE -1 END AS label,
 CASE regexp_replace(lower(gender), '[^a-z]', '', 'g') WHEN '' THEN NULL WHEN 'male' THEN 'male' WHEN 'female' THEN 'female' ELSE 'invalid' END AS gender, count(*) AS n FROM m GROUP BY 1, 2""", ints="label n")
def _(t):
    m = t.phrases.selectExpr("source_novel", "text_id", LABEL, GENDER)
    read = m.select(clean.read_binary(F.col("label"), blank=0).alias("label"), clean.read_gender(F.col("gender")).alias("gender"))
    return read.groupBy("label", "gender").agg(F.count(F.lit(1)).alias("n"))


@query("c18_invalid_labels", "phrases", f"""WITH m AS ({MESSY}) SELECT 'label' AS label_name, label AS value, count(*) AS n FROM m WHERE label = '2' GROUP BY label
UNION ALL SELECT 'gender', gender, count(*) FROM m WHERE gender = 'robot' GROUP BY gender""", ints="n")
def _(t):
    m = t.phrases.selectExpr("source_novel", "text_id", LABEL, GENDER)
    return clean.invalid_labels(m, binary=["label"], gender=["gender"])


@query("c19_key_candidates", "", """SELECT 0 AS priority, 'l_orderkey,l_linenumber' AS key, count(*) AS n_rows, count(DISTINCT (l_orderkey, l_linenumber)) AS n_keys,
 count(*) = count(DISTINCT (l_orderkey, l_linenumber)) AS is_unique FROM lineitem UNION ALL SELECT 1, 'l_orderkey', count(*), count(DISTINCT l_orderkey), count(*) = count(DISTINCT l_orderkey) FROM lineitem""",
       ints="priority n_rows n_keys")
def _(t):
    return clean.key_candidates(t.lineitem, [["l_orderkey", "l_linenumber"], ["l_orderkey"], ["absent"]])


@query("c20_unknown_values", "phrases", "SELECT intext_gender AS value, count(*) AS n FROM phrases WHERE intext_gender NOT IN ('male', 'female') GROUP BY 1", ints="n")
def _(t):
    return clean.unknown_values(t.phrases, "intext_gender", ["male", "female"])


@query("c21_test_items", "items", f"SELECT attribute, person_term, avg_rating FROM items WHERE {SPLIT} = 'test'", num="avg_rating")
def _(t):
    return clean.test_items(t.items.withColumn("split", F.expr(SPLIT)))


@query("c21_test_attributes", "items", f"SELECT DISTINCT attribute FROM items WHERE {SPLIT} = 'test'")
def _(t):
    return clean.test_attributes(t.items.withColumn("split", F.expr(SPLIT)))


@query("a1_item_averages", "ratings", """SELECT attribute, person_term, avg(rating) AS avg_rating, coalesce(var_samp(rating), 0) AS rating_variance, count(rating) AS n_ratings
FROM ratings GROUP BY 1, 2""", num="avg_rating rating_variance", ints="n_ratings")
def _(t):
    return ratings.item_averages(t.ratings)


MODE = """c AS (SELECT attribute, person_term, split, count(*) AS n FROM (SELECT attribute, person_term, CASE WHEN submission_id % 3 = 0 THEN 'test' ELSE 'train' END AS split FROM ratings) q GROUP BY 1, 2, 3),
 m AS (SELECT attribute, person_term, split, n, row_number() OVER (PARTITION BY attribute, person_term ORDER BY n DESC, split) AS rn, count(*) OVER (PARTITION BY attribute, person_term) AS n_labels FROM c)"""


@query("a2_modal_label", "ratings", f"WITH {MODE} SELECT attribute, person_term, split, n_labels, n AS n_modal FROM m WHERE rn = 1", ints="n_labels n_modal")
def _(t):
    return ratings.modal_label(t.ratings.withColumn("split", F.expr("CASE WHEN submission_id % 3 = 0 THEN 'test' ELSE 'train' END")), ["attribute", "person_term"], "split")


@query("a3_source_conflicts", "ratings", """WITH c AS (SELECT attribute, source, count(*) AS n FROM (SELECT attribute, CASE WHEN submission_id % 50 = 0 THEN 'human' ELSE source END AS source FROM ratings) q GROUP BY 1, 2),
 m AS (SELECT *, row_number() OVER (PARTITION BY attribute ORDER BY n DESC, source) AS rn, count(*) OVER (PARTITION BY attribute) AS n_labels FROM c)
SELECT attribute, source, n_labels, n AS n_modal FROM m WHERE rn = 1 AND n_labels > 1""", ints="n_labels n_modal")
def _(t):
    return ratings.source_conflicts(t.ratings.withColumn("source", F.expr("CASE WHEN submission_id % 50 = 0 THEN 'human' ELSE source END")))


@query("j2_modal_split_join", "ratings items", f"WITH {MODE} SELECT i.attribute, i.person_term, avg_rating, split FROM items i LEFT JOIN m ON i.attribute = m.attribute AND i.person_term = m.person_term AND rn = 1", num="avg_rating")
def _(t):
    rows = t.ratings.withColumn("split", F.expr("CASE WHEN submission_id % 3 = 0 THEN 'test' ELSE 'train' END"))
    return ratings.attach_modal_split(t.items.select("attribute", "person_term", "avg_rating"), rows)


WIDE = ", ".join(f"min(CASE WHEN person_term = '{x}' THEN avg_rating END) AS \"{x}\"" for x in TERMS) + ", " + ", ".join(
    f"min(CASE WHEN person_term = '{x}' THEN v END) AS \"{x}_variance\"" for x in TERMS)
WIDE_NUM = " ".join(TERMS[:2]) + " " + " ".join(f"{x}_variance" for x in TERMS[:2]) + " nonbinary nonbinary_variance"


@query("r1_pivot_terms", "ratings_sparse", f"""WITH i AS (SELECT attribute, person_term, avg(rating) AS avg_rating, coalesce(var_samp(rating), 0) AS v FROM ratings_sparse GROUP BY 1, 2),
w AS (SELECT attribute, {WIDE} FROM i GROUP BY attribute) SELECT attribute, woman, man, "nonbinary person" AS nonbinary, woman_variance, man_variance, "nonbinary person_variance" AS nonbinary_variance
FROM w WHERE woman IS NOT NULL AND man IS NOT NULL AND "nonbinary person" IS NOT NULL""", num=WIDE_NUM)
def _(t):
    wide = ratings.pivot_terms(ratings.item_averages(t.ratings_sparse))
    return wide.withColumnsRenamed({"nonbinary person": "nonbinary", "nonbinary person_variance": "nonbinary_variance"})


@query("r2_unpivot_terms", "ratings_sparse", """WITH i AS (SELECT attribute, person_term, avg(rating) AS avg_rating FROM ratings_sparse GROUP BY 1, 2),
full_ones AS (SELECT attribute FROM i GROUP BY attribute HAVING count(*) = 3) SELECT * FROM i WHERE attribute IN (SELECT attribute FROM full_ones)""", num="avg_rating")
def _(t):
    return ratings.unpivot_terms(ratings.pivot_terms(ratings.item_averages(t.ratings_sparse)), ["attribute"], "avg_rating")


@query("r3_raw_rows", "ratings", "SELECT attribute, person_term, rating AS avg_rating FROM ratings", num="avg_rating")
def _(t):
    return ratings.raw_rows(t.ratings)


@query("a16_term_variances", "ratings", """SELECT term, avg(v) AS mean_variance FROM (SELECT CASE person_term WHEN 'nonbinary person' THEN 'nonbinary' ELSE person_term END AS term,
 coalesce(var_samp(rating), 0) AS v FROM ratings GROUP BY attribute, person_term) q GROUP BY term HAVING avg(v) > 0""", num="mean_variance")
def _(t):
    return ratings.term_variances(ratings.item_averages(t.ratings))


@query("a17_term_ranges", "items", """SELECT CASE person_term WHEN 'nonbinary person' THEN 'nonbinary' ELSE person_term END AS term, max(avg_rating) - min(avg_rating) AS rating_range
FROM items GROUP BY 1 HAVING max(avg_rating) > min(avg_rating)""", num="rating_range")
def _(t):
    return ratings.term_ranges(t.items)


@query("a18_normalization_ranges", "items", """SELECT CASE person_term WHEN 'nonbinary person' THEN 'nonbinary' ELSE person_term END AS term, min(avg_rating) AS low, max(avg_rating) AS high FROM items GROUP BY 1
UNION ALL SELECT 'mean', min(avg_rating), max(avg_rating) FROM items""", num="low high")
def _(t):
    return ratings.normalization_ranges(t.items)


PROMPT = "How likely is it that a {person_term} has {attribute}?"


@query("t16_training_prompts", "items", "SELECT 'How likely is it that a ' || person_term || ' has ' || attribute || '?' AS prompt, attribute, person_term, avg_rating FROM items", num="avg_rating")
def _(t):
    return ratings.training_rows(t.items, PROMPT)


@query("j1_human_average", "responses items", """SELECT r.model, r.attribute, r.person_term, i.avg_rating FROM responses r LEFT JOIN (SELECT * FROM items WHERE k % 4 <> 0) i
ON r.attribute = i.attribute AND r.person_term = i.person_term""", num="avg_rating")
def _(t):
    return joins.attach_human_average(t.responses, t.items.filter("k % 4 <> 0")).select("model", "attribute", "person_term", "avg_rating")


@query("j3_test_item_ratings", "ratings", "SELECT person_term, count(*) AS n, sum(rating) AS total FROM ratings WHERE k % 10 >= 8 GROUP BY 1", num="total", ints="n")
def _(t):
    kept = joins.restrict_to_items(t.ratings, t.items.filter("k % 10 >= 8"))
    return kept.groupBy("person_term").agg(F.count(F.lit(1)).alias("n"), F.sum("rating").alias("total"))


@query("j4_attach_source", "predictions", "SELECT attribute, person_term, predicted, source FROM predictions", num="predicted")
def _(t):
    lookup = ratings.modal_label(t.ratings, ["attribute"], "source")
    return joins.attach_source(t.predictions.select("attribute", "person_term", "predicted"), lookup)


RULES = (("novel1", "first shelf", "female"), ("novel19", "never reached", "male"), ("novel", "second shelf", "male"))


@query("j5_prefix_rules", "phrases", """SELECT source_novel, CASE WHEN starts_with(source_novel, 'novel1') THEN 'first shelf' ELSE 'second shelf' END AS source,
 CASE WHEN starts_with(source_novel, 'novel1') THEN 'female' ELSE 'male' END AS author_gender, count(*) AS n FROM phrases GROUP BY 1, 2, 3""", ints="n")
def _(t):
    return joins.match_prefix(t.phrases, F.upper("source_novel"), RULES).groupBy("source_novel", "source", "author_gender").agg(F.count(F.lit(1)).alias("n"))


@query("j6_replicate_terms", "phrases", """SELECT attribute, term AS person_term, count(*) AS n FROM phrases, (VALUES ('woman'), ('man'), ('nonbinary person')) v(term)
WHERE attribute IS NOT NULL GROUP BY 1, 2""", ints="n")
def _(t):
    return joins.replicate_terms(t.phrases.filter("attribute is not null")).groupBy("attribute", "person_term").agg(F.count(F.lit(1)).alias("n"))


@query("j9_alignment", "", """SELECT coalesce(d.doc_id, l.doc_id) AS doc_id, CASE WHEN d.doc_id IS NULL THEN 'extra' WHEN l.doc_id IS NULL THEN 'missing' ELSE 'ok' END AS status
FROM (SELECT doc_id FROM documents WHERE doc_id % 7 <> 0) d FULL JOIN (SELECT doc_id FROM labels) l ON d.doc_id = l.doc_id""", ints="doc_id")
def _(t):
    return joins.align(t.documents.filter("doc_id % 7 <> 0"), t.labels, ["doc_id"])


@query("j9_alignment_lenient", "", "SELECT d.doc_id, d.lang, l.quality FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id", ints="doc_id quality")
def _(t):
    return joins.align_lenient(t.documents.select("doc_id", "lang"), t.labels.select("doc_id", "quality"), ["doc_id"])


@query("j11_pending_pairs", "items", """SELECT attribute, person_term FROM items WHERE NOT (k % 3 = 0 AND k % 2 = 0)""")
def _(t):
    done = t.items.filter("k % 3 = 0").select("attribute", "person_term", F.when(F.col("k") % 2 == 0, 1.0).alias("predicted_rating"))
    return joins.pending(t.items.select("attribute", "person_term"), done, F.col("predicted_rating").isNotNull())


@query("j12_ceiling_lookup", "ratings", """WITH c AS (SELECT CASE source WHEN 'llm' THEN 'combined_llm' WHEN 'human' THEN 'eval_human' ELSE 'eval_novel' END AS dataset, person_term, avg(rating) AS loo, stddev_samp(rating) AS sqrt_icc FROM ratings GROUP BY 1, 2)
SELECT dataset, person_term, loo, sqrt_icc FROM c UNION ALL SELECT 'all', person_term, avg(loo), avg(sqrt_icc) FROM c GROUP BY person_term""", num="loo sqrt_icc")
def _(t):
    c = t.ratings.groupBy(F.col("source").alias("dataset"), "person_term").agg(F.avg("rating").alias("loo"), F.stddev_samp("rating").alias("sqrt_icc"))
    return joins.ceiling_lookup(c, extra=["person_term"])


@query("u1_union_shards", "ratings", "SELECT source, count(*) AS n FROM ratings GROUP BY 1", ints="n")
def _(t):
    shards = [t.ratings.filter(F.col("source") == s) for s in ("llm", "human", "novel")]
    return joins.union_all(*shards).groupBy("source").agg(F.count(F.lit(1)).alias("n"))


@query("u2_pooled_dataset", "responses", """SELECT model, dataset, count(*) AS n FROM responses GROUP BY 1, 2 UNION ALL SELECT model, 'all', count(*) FROM responses GROUP BY 1""", ints="n")
def _(t):
    return joins.pooled(t.responses).groupBy("model", "dataset").agg(F.count(F.lit(1)).alias("n"))


DRIFT = " UNION ALL ".join(
    f"SELECT '{t}' AS table_name, '{c}' AS column_name, count({c}) AS n FROM {t}"
    for t, cols in [("documents", "doc_id text lang source n_chars"), ("labels", "doc_id quality toxic"), ("benchmark", "item_id text")] for c in cols.split())


@query("u3_column_drift", "", f"""SELECT column_name, count(*) AS n_tables, sum(n) AS n_values, count(*) = 3 AS common FROM ({DRIFT}) q GROUP BY 1""", ints="n_tables n_values")
def _(t):
    return joins.column_drift({"documents": t.documents, "labels": t.labels, "benchmark": t.benchmark})


@query("u4_distinct_attributes", "phrases", "SELECT count(DISTINCT attribute) AS n_attributes FROM phrases", ints="n_attributes")
def _(t):
    return t.phrases.agg(F.count_distinct("attribute").alias("n_attributes"))


@query("u5_append_distinct", "participants_a", """SELECT DISTINCT prolific_id, submission_id FROM participants_a""")
def _(t):
    pairs = t.participants_a.select("prolific_id", "submission_id")
    return joins.append_distinct(pairs.filter("rating > 50"), pairs)


@query("u6_key_difference", "items", "SELECT attribute FROM items GROUP BY attribute HAVING count_if(k % 5 = 0) = 0")
def _(t):
    return joins.difference(t.items, t.items.filter("k % 5 = 0"), ["attribute"])


@query("t18_term_names", "items", """SELECT person_term, CASE person_term WHEN 'nonbinary person' THEN 'nonbinary' ELSE person_term END AS term,
 CASE person_term WHEN 'woman' THEN 0 WHEN 'man' THEN 1 ELSE 2 END AS term_index, CASE person_term WHEN 'nonbinary person' THEN 'nonbinary' ELSE person_term END AS slug, count(*) AS n FROM items GROUP BY 1, 2, 3, 4""",
       ints="term_index n")
def _(t):
    from ratescale.functions import terms

    c = F.col("person_term")
    return t.items.groupBy("person_term", terms.normalize_term(F.concat(F.lit(" a "), F.initcap(c))).alias("term"), terms.term_index(c).alias("term_index"), terms.term_slug(c).alias("slug")).agg(F.count(F.lit(1)).alias("n"))


@query("t17_unit_scale", "items", "SELECT attribute, person_term, (avg_rating - 1) / 6 AS unit, avg_rating AS back FROM items", num="unit back")
def _(t):
    from ratescale.functions import terms

    unit = terms.to_unit(F.col("avg_rating"))
    return t.items.select("attribute", "person_term", unit.alias("unit"), terms.from_unit(unit).alias("back"))


@query("t22_composite_ids", "responses", "SELECT model || '||' || dataset || '||' || attribute || '||' || person_term AS item_id, replace(generation, chr(10), '\\n') AS generation FROM responses")
def _(t):
    return t.responses.select(parse.composite_id("model", "dataset", "attribute", "person_term").alias("item_id"), parse.escape_newlines(F.col("generation")).alias("generation"))

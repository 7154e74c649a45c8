"""Grouped splits, folds and samples over the ratings, responses and phrases views."""

from pyspark.sql import functions as F

from ratescale.catalog.registry import query
from ratescale.catalog.snippets import PARSED
from ratescale.functions import parse
from ratescale.operators import clean, responses as res, sampling, splits

GROUPS = "g AS (SELECT attribute, count(*) AS size, md5('{seed}|' || attribute) AS h FROM {src} GROUP BY 1)"
BEFORE = "p AS (SELECT *, coalesce(sum(size) OVER (ORDER BY h, attribute ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM g), tot AS (SELECT sum(size) AS n FROM g)"
TWO = "two AS (SELECT attribute, size, h, CASE WHEN before < greatest(1, ceil(n * 0.3::DOUBLE)) THEN 'test' ELSE 'train' END AS split FROM p, tot)"
THREE = """v AS (SELECT p.*, n, before < greatest(1, ceil(n * 0.15::DOUBLE)) AS val FROM p, tot), vt AS (SELECT sum(size) FILTER (WHERE val) AS vn FROM v),
 three AS (SELECT attribute, size, h, CASE WHEN val THEN 'val' WHEN before - vn < greatest(1, ceil(n * 0.25::DOUBLE)) THEN 'test' ELSE 'train' END AS split FROM v, vt)"""


def groups(src, seed=42):
    return GROUPS.format(src=src, seed=seed)


@query("p1_two_way_split", "ratings", f"WITH {groups('ratings', 123)}, {BEFORE}, {TWO} SELECT attribute, size, split FROM two", ints="size")
def _(t):
    return splits.split_groups(t.ratings, 0.3, seed=123).select("attribute", "size", "split")


@query("p2_three_way_split", "ratings", f"WITH {groups('ratings')}, {BEFORE}, {THREE} SELECT attribute, size, split FROM three", ints="size")
def _(t):
    return splits.split_groups(t.ratings, 0.25, 0.15).select("attribute", "size", "split")


@query("w3_prefix_sizes", "ratings", f"WITH {groups('ratings', 7)}, {BEFORE} SELECT attribute, size, before FROM p", ints="size before")
def _(t):
    from ratescale.operators.scale import hash_prefix

    return hash_prefix(splits.group_sizes(t.ratings, "attribute", 7), "size", "h", ["attribute"]).select("attribute", "size", F.col("_before").alias("before"))


@query("p5_assigned_splits", "ratings", f"WITH {groups('ratings')}, {BEFORE}, {THREE} SELECT split, person_term, count(*) AS n, sum(rating) AS total FROM ratings JOIN three USING (attribute) GROUP BY 1, 2", num="total", ints="n")
def _(t):
    return splits.assign_splits(t.ratings, 0.25, 0.15).groupBy("split", "person_term").agg(F.count(F.lit(1)).alias("n"), F.sum("rating").alias("total"))


@query("p5_forced_split", "ratings", "SELECT 'test' AS split, source, count(*) AS n FROM ratings GROUP BY 1, 2", ints="n")
def _(t):
    return splits.force_split(t.ratings, "test").groupBy("split", "source").agg(F.count(F.lit(1)).alias("n"))


@query("p4_rebuilt_test_rows", "ratings", f"""WITH part AS (SELECT * FROM ratings WHERE source = 'llm'), {groups('part')}, {BEFORE}, {THREE},
 kept AS (SELECT part.* FROM part JOIN three USING (attribute) WHERE split = 'test' UNION ALL SELECT * FROM ratings WHERE source <> 'llm')
SELECT source, attribute, count(*) AS n FROM kept GROUP BY 1, 2""", ints="n")
def _(t):
    return splits.rebuild_test_rows(t.ratings, 0.25, 0.15).groupBy("source", "attribute").agg(F.count(F.lit(1)).alias("n"))


@query("c22_evaluation_rows", "ratings", f"""WITH {groups('ratings')}, {BEFORE}, {THREE} SELECT attribute, count(*) AS n FROM ratings JOIN three USING (attribute) WHERE split = 'test' GROUP BY 1""", ints="n")
def _(t):
    # the stored column has no test rows, so the split is rebuilt
    stored = t.ratings.withColumn("split", F.lit("train"))
    return splits.evaluation_rows(stored, 0.25, 0.15).groupBy("attribute").agg(F.count(F.lit(1)).alias("n"))


@query("c22_stored_rows", "ratings", "SELECT attribute, count(*) AS n FROM ratings WHERE k % 9 = 0 GROUP BY 1", ints="n")
def _(t):
    stored = t.ratings.withColumn("split", F.when(F.col("k") % 9 == 0, "test").otherwise("train"))
    return splits.evaluation_rows(stored, 0.25, 0.15).groupBy("attribute").agg(F.count(F.lit(1)).alias("n"))


SMALLEST = "CASE " + " ".join(
    f"WHEN l{i} <= least({', '.join(f'l{j}' for j in range(1, 6))}) THEN {i}" for i in range(1, 6)) + " END"
P6 = f"""WITH RECURSIVE s AS (SELECT size, row_number() OVER (ORDER BY size DESC) AS i FROM (SELECT attribute, count(*) AS size FROM ratings GROUP BY 1) q),
 f(i, fold, size, l1, l2, l3, l4, l5) AS (SELECT 0::BIGINT, 0, 0::BIGINT, 0::BIGINT, 0::BIGINT, 0::BIGINT, 0::BIGINT, 0::BIGINT
  UNION ALL SELECT i, fold, size, {', '.join(f'l{j} + CASE WHEN fold = {j} THEN size ELSE 0 END' for j in range(1, 6))}
  FROM (SELECT s.i, s.size, {SMALLEST} AS fold, l1, l2, l3, l4, l5 FROM f JOIN s ON s.i = f.i + 1) q)
SELECT fold, count(*) AS n_groups, sum(size) AS n_rows FROM f WHERE i > 0 GROUP BY 1"""


@query("p6_fold_balance", "ratings", P6, ints="fold n_groups n_rows")
def _(t):
    return splits.fold_groups(t.ratings, 5).groupBy("fold").agg(F.count(F.lit(1)).alias("n_groups"), F.sum("size").alias("n_rows"))


@query("p6_kfold_rows", "items", """WITH f AS (SELECT k, unnest(range(1, 4)) AS fold FROM items) SELECT fold, CASE WHEN k % 10 >= 8 THEN 'test' ELSE 'pool' END AS part, count(*) AS n, true AS whole FROM f GROUP BY 1, 2""", ints="fold n")
def _(t):
    rows = t.items.withColumn("split", F.expr("CASE WHEN k % 10 >= 8 THEN 'test' WHEN k % 10 >= 6 THEN 'val' ELSE 'train' END"))
    folds = splits.kfold_rows(rows, 3)
    straddling = clean.straddling_groups(folds.select(F.concat_ws("|", "attribute", F.col("fold").cast("string")).alias("attribute"), "split")).agg(F.count(F.lit(1))).scalar()
    part = F.when(F.col("split") == "test", "test").otherwise("pool")
    return folds.groupBy("fold", part.alias("part")).agg(F.count(F.lit(1)).alias("n")).withColumn("whole", straddling == 0)


KEYED = "kp AS (SELECT source_novel, lower(trim(attribute)) AS a, min(text_id) AS text_id, bool_or(indomain_strct) AS f FROM phrases WHERE attribute IS NOT NULL GROUP BY 1, 2)"


def keyed(t):
    p = t.phrases.filter("attribute is not null").groupBy("source_novel", clean.normalize_key(F.col("attribute")).alias("attribute_normalized"))
    return p.agg(F.min("text_id").alias("text_id"), (F.bool_or(F.col("indomain_strct"))).alias("indomain_strct"))


SEQUENTIAL = f"""WITH RECURSIVE {KEYED}, r AS (SELECT a, md5('42|' || source_novel || '|' || a) AS h, dense_rank() OVER (ORDER BY source_novel) AS b FROM kp),
 walk(b, taken, got) AS (SELECT 0::BIGINT, []::VARCHAR[], []::VARCHAR[] UNION ALL
  SELECT b, list_concat(taken, new), new FROM (SELECT w.b + 1 AS b, w.taken, (SELECT list(a ORDER BY h) FROM r WHERE r.b = w.b + 1 AND NOT list_contains(w.taken, r.a))[1:2] AS new
   FROM walk w WHERE w.b < (SELECT max(b) FROM r)) z)
SELECT source_novel, attribute_normalized FROM (SELECT b, unnest(got) AS attribute_normalized FROM walk) u JOIN (SELECT DISTINCT source_novel, dense_rank() OVER (ORDER BY source_novel) AS b FROM kp) USING (b)"""


@query("p7_sample_per_book", "phrases", SEQUENTIAL)
def _(t):
    return sampling.sample_per_book(keyed(t), 2).select("source_novel", "attribute_normalized")


@query("p8_balanced_sample", "phrases", f"""WITH {KEYED}, c AS (SELECT source_novel, count_if(f) AS i, count_if(NOT f) AS o, count(*) AS n FROM kp GROUP BY 1),
 q AS (SELECT *, CASE WHEN n <= 9 THEN i WHEN i < 4 THEN i WHEN o < 5 THEN least(9 - o, i) ELSE 4 END AS qi, CASE WHEN n <= 9 THEN o WHEN i < 4 THEN least(9 - i, o) WHEN o < 5 THEN o ELSE 5 END AS qo FROM c),
 r AS (SELECT kp.*, row_number() OVER (PARTITION BY source_novel, f ORDER BY md5('42|' || a)) AS rn FROM kp)
SELECT source_novel, a AS attribute_normalized, f AS indomain_strct FROM r JOIN q USING (source_novel) WHERE rn <= CASE WHEN f THEN qi ELSE qo END""")
def _(t):
    return sampling.balanced_sample(keyed(t), "indomain_strct", 9, ["attribute_normalized"], ["source_novel"]).select("source_novel", "attribute_normalized", "indomain_strct")


QUOTA = """c AS (SELECT {strata}, count(*) AS size FROM {src} GROUP BY {strata}), x AS (SELECT *, size * {n}::DOUBLE / sum(size) OVER () AS e, sum(size) OVER () AS tot FROM c),
 y AS (SELECT *, floor(e) AS fl, row_number() OVER (ORDER BY round(e - floor(e), 9) DESC, {strata}) AS rn, {n} - sum(floor(e)) OVER () AS short FROM x),
 quota AS (SELECT {strata}, size, CASE WHEN tot <= {n} THEN size ELSE least(size, fl + CASE WHEN rn <= short THEN 1 ELSE 0 END) END AS quota FROM y)"""


@query("w8_stratum_quotas", "responses", f"WITH {QUOTA.format(strata='model, dataset, person_term', src='responses', n=1000)} SELECT * FROM quota", ints="size quota")
def _(t):
    return sampling.stratum_quotas(t.responses, 1000, ["model", "dataset", "person_term"])


RID = "model || '||' || dataset || '||' || attribute || '||' || person_term"
P9 = f"""{QUOTA.format(strata='model, person_term', src='responses', n=500)}, ranked AS (SELECT r.*, {RID} AS item_id, row_number() OVER (PARTITION BY model, person_term ORDER BY md5('42|' || {RID})) AS rk FROM responses r),
 sam AS (SELECT ranked.* FROM ranked JOIN quota USING (model, person_term) WHERE rk <= quota)"""


def with_id(rows):
    return rows.withColumn("item_id", parse.composite_id("model", "dataset", "attribute", "person_term"))


def stratified(t):
    return sampling.stratified_sample(with_id(t.responses), 500, ["model", "person_term"], ["item_id"])


@query("p9_stratified_sample", "responses", f"WITH {P9} SELECT item_id, model, person_term FROM sam")
def _(t):
    return stratified(t).select("item_id", "model", "person_term")


@query("p10_composition", "responses", f"""WITH {P9}, a AS (SELECT model, person_term, count(*) AS population_n, count(*) / (SELECT count(*) FROM responses)::DOUBLE AS population_pct FROM responses GROUP BY 1, 2),
 b AS (SELECT model, person_term, count(*) AS sample_n, count(*) / (SELECT count(*) FROM sam)::DOUBLE AS sample_pct FROM sam GROUP BY 1, 2)
SELECT a.*, coalesce(sample_n, 0) AS sample_n, coalesce(sample_pct, 0) AS sample_pct, coalesce(sample_pct, 0) - population_pct AS pct_diff FROM a LEFT JOIN b USING (model, person_term)""", num="population_pct sample_pct pct_diff", ints="population_n sample_n")
def _(t):
    return sampling.composition(t.responses, stratified(t), ["model", "person_term"])


def records(t):
    return res.labeled_records(res.parse_responses(t.responses))


REC = f"{PARSED}, rec AS MATERIALIZED (SELECT *, {RID} AS item_id FROM flagged)"
POOL = "{name} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY model, attribute, person_term, generation ORDER BY dataset, item_id) AS rn FROM rec WHERE {cond}) q WHERE rn = 1)"


@query("p11_pools", "responses", f"""WITH {REC}, {POOL.format(name='pa', cond='abstention = 1')}, {POOL.format(name='pb', cond='text_abstention = 1 AND missing_rating = 0')}
SELECT 'flagged' AS pool, item_id FROM pa UNION ALL SELECT 'rated', item_id FROM pb UNION ALL SELECT 'unflagged', item_id FROM rec WHERE abstention = 0""")
def _(t):
    r = records(t)
    named = [(sampling.abstention_pool(r), "flagged"), (sampling.rated_abstention_pool(r), "rated"), (sampling.non_abstention_pool(r), "unflagged")]
    parts = [p.select(F.lit(n).alias("pool"), "item_id") for p, n in named]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def _pool(name, condition, pool):
    """One pool per query: its twin reads the responses once."""

    @query(name, "responses", f"""WITH {PARSED}, rec AS (SELECT model, attribute, person_term, generation, dataset, {RID} AS item_id FROM flagged WHERE {condition})
SELECT model, attribute, person_term, md5(generation) AS digest, min(item_id) AS item_id FROM (SELECT *, min(dataset) OVER (PARTITION BY model, attribute, person_term, generation) AS first FROM rec) q WHERE dataset = first GROUP BY ALL""")
    def _(t):
        return pool(records(t)).select("model", "attribute", "person_term", F.md5("generation").alias("digest"), "item_id")


_pool("p11_flagged_pool", "abstention = 1", sampling.abstention_pool)
_pool("p11_rated_pool", "text_abstention = 1 AND missing_rating = 0", sampling.rated_abstention_pool)


@query("p11_unflagged_pool", "responses", f"""WITH {PARSED} SELECT {RID} AS item_id FROM flagged WHERE abstention = 0""")
def _(t):
    return sampling.non_abstention_pool(records(t)).select("item_id")


@query("w6_first_response", "responses", f"WITH {REC}, {POOL.format(name='pa', cond='TRUE')} SELECT item_id, generation FROM pa")
def _(t):
    return sampling.unique_responses(records(t)).select("item_id", "generation")


def _positives(n):
    q = QUOTA.format(strata="model, person_term", src="{src}", n="(SELECT nn FROM {cnt})")
    a = q.format(src="pa", cnt="na").replace("c AS", "ca AS", 1).replace(" FROM c)", " FROM ca)").replace("x AS", "xa AS", 1).replace("FROM x)", "FROM xa)").replace(" y AS", " ya AS", 1).replace("FROM y)", "FROM ya)").replace("quota AS (", "qa AS (")
    b = q.format(src="nb", cnt="np").replace("c AS", "cb AS", 1).replace(" FROM c)", " FROM cb)").replace("x AS", "xb AS", 1).replace("FROM x)", "FROM xb)").replace(" y AS", " yb AS", 1).replace("FROM y)", "FROM yb)").replace("quota AS (", "qb AS (")
    rk = "row_number() OVER (PARTITION BY model, person_term ORDER BY md5('42|' || item_id)) AS rk"
    return f"""{REC}, {POOL.format(name='pa', cond='abstention = 1')}, na AS (SELECT round_even({n}::DOUBLE * count(*), 0) AS nn FROM pa), {a},
 sa AS (SELECT z.* FROM (SELECT *, {rk} FROM pa) z JOIN qa USING (model, person_term) WHERE rk <= quota), np AS (SELECT count(*) AS nn FROM sa),
 nb AS (SELECT * FROM rec WHERE abstention = 0), {b}, sb AS (SELECT z.* FROM (SELECT *, {rk} FROM nb) z JOIN qb USING (model, person_term) WHERE rk <= quota)"""


@query("p12_positives_and_controls", "responses", f"WITH {_positives(0.1)} SELECT item_id, 1 AS system_abstention FROM sa UNION ALL SELECT item_id, 0 FROM sb", ints="system_abstention")
def _(t):
    return sampling.positives_and_controls(records(t), 0.1, ["model", "person_term"]).select("item_id", "system_abstention")


@query("p13_blind_sheet", "responses", f"""WITH {_positives(0.1)}, s AS (SELECT * FROM sa UNION ALL BY NAME SELECT * FROM sb)
SELECT md5('42|' || item_id) AS position, item_id, attribute, person_term, generation, '' AS abstention, '' AS caveat, '' AS remarks FROM s""")
def _(t):
    bundle = sampling.annotation_bundle(sampling.positives_and_controls(records(t), 0.1, ["model", "person_term"]))
    return bundle["sheet"].withColumnRenamed("remarks (optional)", "remarks")


@query("t21_phrase_questions", "phrases", """SELECT attribute, 'How likely is it for someone to say a woman/man/non-binary person has ' || attribute || '?' AS question_context, count(*) AS n FROM phrases WHERE attribute IS NOT NULL GROUP BY 1, 2""", ints="n")
def _(t):
    sheet = sampling.phrase_sheet(t.phrases.filter("attribute is not null").withColumn("text", F.col("attribute")))
    return sheet.groupBy("attribute", "question_context").agg(F.count(F.lit(1)).alias("n"))


@query("k6_first_attributes", "items", "SELECT attribute FROM (SELECT DISTINCT attribute FROM items) q ORDER BY attribute LIMIT 25")
def _(t):
    from ratescale.operators.scoring import first_attributes

    return first_attributes(t.items, 25)

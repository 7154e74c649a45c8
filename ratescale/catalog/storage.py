"""Ingest checks, JSON records and report strings over the given tables. File readers and writers are unit tested."""

from pyspark.sql import functions as F

from ratescale.catalog.evaluation import CI_LONG, correlation_ci, parsed
from ratescale.catalog.registry import query
from ratescale.catalog.snippets import PARSED
from ratescale.operators import metrics, novels
from ratescale.schemas import EVAL_METRICS, PHRASES, RESPONSES
from ratescale.session import shared_folder
from ratescale.sources import sinks, tables


@query("s1_csv_round_trip", "responses", """SELECT model, dataset, attribute, person_term, CASE WHEN generation = '' THEN NULL ELSE generation || chr(10) || '"quoted", ' END AS generation, avg_rating FROM responses""", num="avg_rating")
def _(t):
    cols = ["model", "dataset", "attribute", "person_term", "generation", "avg_rating"]
    messy = F.when(F.col("generation") != "", F.concat("generation", F.lit('\n"quoted", ')))
    table = t.responses.withColumn("generation", messy).select(*cols)
    path = shared_folder(t.spark, "csv")
    sinks.write_csv(table, path)
    return tables.read_table(t.spark, path, table.schema)


@query("s2_extracted_files", "phrases", "SELECT source_novel, text_id, attribute, llm_gender, CASE source_novel WHEN 'novel1' THEN 'first' ELSE 'other' END AS source FROM phrases", ints="text_id")
def _(t):
    path = shared_folder(t.spark, "extracted")
    sinks.write_csv_tree(t.phrases.select("source_novel", "text_id", "attribute", "llm_gender"), path, ["source_novel"])
    rules = [("novel1_", "never", "male"), ("novel10", "other", "male"), ("novel11", "other", "male"), ("novel12", "other", "male"), ("novel13", "other", "male"), ("novel14", "other", "male"),
             ("novel15", "other", "male"), ("novel16", "other", "male"), ("novel17", "other", "male"), ("novel18", "other", "male"), ("novel19", "other", "male"), ("novel1", "first", "female"), ("novel", "other", "male")]
    got = tables.read_extracted(t.spark, f"{path}/*", PHRASES, rules)
    return got.select("source_novel", "text_id", "attribute", "llm_gender", "source")


@query("s7_results_tree", "responses", "SELECT model, dataset, count(*) AS n, sum(avg_rating) AS total FROM responses GROUP BY 1, 2", num="total", ints="n")
def _(t):
    path = shared_folder(t.spark, "results")
    sinks.write_csv_tree(t.responses.select("model", "dataset", "attribute", "person_term", "generation", "avg_rating"), path, ["model", "dataset"])
    return tables.read_results(t.spark, path, RESPONSES).groupBy("model", "dataset").agg(F.count(F.lit(1)).alias("n"), F.sum("avg_rating").alias("total"))


# experiment, run and seed folder of a supplier's row; the runs of every fourth nation are not finished
RUN_KEYS = (
    "'cfg' || CAST(s_nationkey % 3 AS STRING) || '_fold' || CAST(1 + s_nationkey % 2 AS STRING) || 'of2' AS exp",
    "'run_2025010' || CAST(1 + s_nationkey % 5 AS STRING) || '_000000' AS run",
    "'seed' || CAST(40 + s_nationkey % 4 AS STRING) AS seed_dir",
)


@query("s8_run_tree", "", f"""WITH r AS (SELECT {', '.join(RUN_KEYS)}, s_nationkey % 4 <> 0 AS done, s_acctbal FROM supplier), f AS (SELECT exp, run, seed_dir, bool_or(done) AS complete FROM r GROUP BY 1, 2, 3),
 newest AS (SELECT exp, max(run) AS run FROM f WHERE complete GROUP BY 1)
SELECT r.exp, r.run, r.seed_dir, substr(r.exp, 1, 4) AS config, CAST(substr(r.exp, 10, 1) AS BIGINT) AS fold, CAST(substr(r.seed_dir, 5) AS BIGINT) AS seed, count(*) AS n, sum(round(CAST(s_acctbal AS DOUBLE), 2)) AS total
FROM r JOIN newest ON r.exp = newest.exp AND r.run = newest.run WHERE done GROUP BY 1, 2, 3, 4, 5, 6""", num="total", ints="fold seed n")
def _(t):
    root = shared_folder(t.spark, "runs")
    rows = t.supplier.selectExpr(*RUN_KEYS, "s_nationkey % 4 <> 0 AS done", "round(CAST(s_acctbal AS DOUBLE), 2) AS rmse")
    folders = ["exp", "run", "seed_dir", "file"]
    config = rows.select(*folders[:3], F.lit("config.json").alias("file"), F.lit("{}").alias("value")).distinct()
    logged = rows.select(*folders[:3], F.lit("metrics.csv").alias("file"), F.lit(1).alias("step"), "rmse")
    scores = rows.filter("done").select(*folders[:3], F.lit("eval_results/eval_metrics.csv").alias("file"), F.lit("mean").alias("category"), F.lit(1.0).alias("mse"), "rmse")
    for table in (config, logged, scores):
        sinks.write_csv_tree(table, root, folders, mode="append")
    latest = tables.latest_runs(tables.run_status(tables.run_files(t.spark, root)))
    found = tables.read_run_tables(t.spark, root, "eval_results/eval_metrics.csv", EVAL_METRICS, latest)
    return found.groupBy("exp", "run", "seed_dir", "config", "fold", "seed").agg(F.count(F.lit(1)).alias("n"), F.sum("rmse").alias("total"))


@query("s3_decoded_documents", "", "SELECT doc_id, md5(replace(replace(text, chr(13) || chr(10), ' '), chr(10), ' ')) AS digest FROM documents", ints="doc_id")
def _(t):
    from ratescale.functions.text import decode_text

    as_bytes = F.encode("text", "UTF-8")
    return t.documents.select("doc_id", F.md5(decode_text(as_bytes)).alias("digest"))


@query("s4_merged_shards", "ratings", "SELECT source, count(*) AS n, count(DISTINCT attribute) AS n_attributes FROM ratings GROUP BY 1", ints="n n_attributes")
def _(t):
    shards = {s: t.ratings.filter(F.col("source") == s).drop("source") for s in ("llm", "human", "novel")}
    merged = tables.merge_shards(shards, ["llm", "human", "novel"])
    return merged.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("attribute").alias("n_attributes"))


EXPECTED = "e AS (SELECT source, CASE WHEN source = 'llm' THEN count(*) ELSE count(*) - 1 END AS expected FROM ratings WHERE source <> 'novel' GROUP BY 1 UNION ALL SELECT 'pilot', 10)"


@query("s5_count_status", "ratings", f"""WITH {EXPECTED}, a AS (SELECT source, count(*) AS n FROM ratings GROUP BY 1)
SELECT coalesce(e.source, a.source) AS source, expected, coalesce(n, 0) AS n, CASE WHEN n IS NULL THEN 'missing' WHEN expected IS NULL THEN 'unexpected' WHEN n = expected THEN 'ok' ELSE 'wrong' END AS status FROM e FULL JOIN a ON e.source = a.source""", ints="expected n")
def _(t):
    own = t.ratings.filter("source <> 'novel'").groupBy("source").agg(F.count(F.lit(1)).alias("_n"))
    expected = own.select("source", F.when(F.col("source") == "llm", F.col("_n")).otherwise(F.col("_n") - 1).alias("expected"))
    pilot = own.limit(1).select(F.lit("pilot").alias("source"), F.lit(10).cast("long").alias("expected"))
    return tables.count_status(t.ratings, expected.unionByName(pilot), ["source"])


@query("s6_checksum_status", "", """SELECT CAST(doc_id AS VARCHAR) AS name, CASE WHEN doc_id % 7 = 3 THEN 'missing' WHEN doc_id % 5 = 2 THEN 'corrupt' ELSE 'ok' END AS status FROM documents""")
def _(t):
    named = t.documents.select(F.col("doc_id").cast("string").alias("name"), "doc_id", F.encode("text", "UTF-8").alias("content"))
    manifest = named.select("name", F.when(F.col("doc_id") % 5 == 2, F.sha2(F.lit("other"), 256)).otherwise(F.sha2("content", 256)).alias("digest"))
    return tables.checksum_status(named.filter("doc_id % 7 <> 3"), manifest)


@query("s13_json_summary", "responses", f"""WITH {PARSED}, c AS (SELECT model, dataset, count(*) AS total, count_if(method1_rating IS NULL) AS n_invalid, CAST(NULL AS DOUBLE) AS pearson_r FROM parsed GROUP BY 1, 2)
SELECT model, dataset, CAST(to_json({{'model': model, 'dataset': dataset, 'total': total, 'n_invalid': n_invalid, 'pearson_r': pearson_r}}) AS VARCHAR) AS value FROM c""")
def _(t):
    c = metrics.invalid_counts(parsed(t), ["model", "dataset"]).select("model", "dataset", "total", "n_invalid", F.lit(float("nan")).alias("pearson_r"))
    return sinks.json_summary(c, ["model", "dataset"])


# a method's success rate, mean and deviation
ONE = "{{'success_rate': round(count({m}) / count(*)::DOUBLE, 3), 'mean_rating': round(avg({m}), 3), 'std_rating': round(stddev_samp({m}), 3)}}"
METHOD1, METHOD2 = ONE.format(m="m1"), ONE.format(m="m2")


@query("s13_nested_summary", "responses", f"""WITH {PARSED}, r AS (SELECT model, dataset, attribute, person_term, CAST(method1_rating AS DOUBLE) AS m1, CASE WHEN method2_rating <> -1 THEN CAST(method2_rating AS DOUBLE) END AS m2 FROM parsed),
 w AS (SELECT model, dataset, count(*) AS total, count(DISTINCT attribute) AS attributes, {{'method1': {METHOD1}, 'method2': {METHOD2}}} AS methods, round(avg(CAST(m1 = m2 AS INT)), 3) AS agreement_rate, round(avg(abs(m1 - m2)), 3) AS mean_absolute_difference FROM r GROUP BY 1, 2),
 pt AS (SELECT model, dataset, person_term, count(*) AS total, {METHOD1} AS method1, {METHOD2} AS method2 FROM r GROUP BY 1, 2, 3),
 te AS (SELECT model, dataset, list({{'person_term': person_term, 'total': total, 'method1': method1, 'method2': method2}} ORDER BY person_term) AS terms FROM pt GROUP BY 1, 2)
SELECT model, dataset, CAST(to_json({{'model': model, 'dataset': dataset, 'total': total, 'attributes': attributes, 'methods': methods, 'agreement_rate': agreement_rate, 'mean_absolute_difference': mean_absolute_difference, 'terms': terms}}) AS VARCHAR) AS value
FROM w JOIN te USING (model, dataset)""")
def _(t):
    return metrics.nested_summary(parsed(t))


@query("s14_tagged_records", "phrases", """WITH g AS (SELECT source_novel, llm_gender AS label, count(*) AS n FROM phrases WHERE attribute IS NOT NULL GROUP BY 1, 2), f AS (SELECT source_novel, attribute, count(*) AS n FROM phrases WHERE attribute IS NOT NULL GROUP BY 1, 2)
SELECT CAST(to_json({'type': 'gender', 'data': {'source_novel': source_novel, 'label': label, 'n': n}}) AS VARCHAR) AS value FROM g UNION ALL SELECT CAST(to_json({'type': 'attribute', 'data': {'source_novel': source_novel, 'attribute': attribute, 'n': n}}) AS VARCHAR) FROM f""")
def _(t):
    g = novels.gender_distribution(t.phrases, ["llm_gender"]).select("source_novel", "label", "n")
    f = novels.attribute_frequency(t.phrases).select("source_novel", "attribute", "n")
    return sinks.tagged_records({"gender": g, "attribute": f})


@query("s15_report_lines", "responses", f"""WITH {CI_LONG} SELECT '| ' || model || ' | ' || dataset || ' | ' || printf('%.3f', pearson_r) || ' [' || printf('%.3f', pearson_r_lo) || ', ' || printf('%.3f', pearson_r_hi) || ']' || ' | ' || printf('%.3f', n / 7.0::DOUBLE) || ' |' AS value FROM ci""")
def _(t):
    c = correlation_ci(t)
    shown = c.select("model", "dataset", sinks.with_interval(F.col("pearson_r"), F.col("pearson_r_lo"), F.col("pearson_r_hi")).alias("r"), sinks.decimals(F.col("n") / 7).alias("share"))
    return sinks.markdown_rows(shown, ["model", "dataset", "r", "share"])

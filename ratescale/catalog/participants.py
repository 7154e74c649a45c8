"""Pseudonyms over the participant views, and scoring over the phrases view."""

import pandas as pd
from pyspark.sql import functions as F

from ratescale.catalog.registry import query
from ratescale.operators import deid, joins, scoring
from ratescale.session import cut_lineage

MAP = """m AS (SELECT id_column, original, prefix || lpad(CAST(n AS VARCHAR), greatest(3, length(CAST(tot AS VARCHAR)))::INT, '0') AS pseudonym FROM (
 SELECT id_column, original, prefix, row_number() OVER (PARTITION BY id_column ORDER BY original) AS n, count(*) OVER (PARTITION BY id_column) AS tot FROM (
  SELECT DISTINCT 'prolific_id' AS id_column, prolific_id AS original, 'P' AS prefix FROM (SELECT prolific_id FROM participants_a UNION ALL SELECT prolific_id FROM participants_b) x
  UNION SELECT DISTINCT 'submission_id', submission_id, 'S' FROM participants_a) y) z)"""


@query("d1_id_mappings", "participants_a participants_b", f"WITH {MAP} SELECT * FROM m")
def _(t):
    return deid.id_mappings([t.participants_a, t.participants_b])


@query("w4_dense_numbers", "", "SELECT DISTINCT c_custkey_text AS id, dense_rank() OVER (ORDER BY c_custkey_text) AS number FROM (SELECT CAST(o_custkey AS VARCHAR) AS c_custkey_text FROM orders) q", ints="number")
def _(t):
    ids = t.orders.select(F.col("o_custkey").cast("string").alias("id"))
    return deid.dense_numbers(ids, "id").select("id", "number")


@query("d2_already_done", "participants_a", """SELECT rating, false AS raw_ids, true AS done_ids, count(*) AS n FROM participants_a GROUP BY 1""", num="rating", ints="n")
def _(t):
    a = t.participants_a
    done = a.withColumn("prolific_id", F.concat(F.lit("P"), F.abs(F.hash("prolific_id")).cast("string")))
    counted = a.groupBy("rating").agg(F.count(F.lit(1)).alias("n"))
    return counted.withColumn("raw_ids", deid.already_pseudonymous([a], "prolific_id", "P")).withColumn("done_ids", deid.already_pseudonymous([done], "prolific_id", "P"))


KEYS = """k AS (SELECT parent_key, max(submission_id) AS submission_id FROM (SELECT DISTINCT parent_key, prolific_id FROM participants_b) b LEFT JOIN (SELECT DISTINCT prolific_id, submission_id FROM participants_a) a USING (prolific_id) GROUP BY 1)"""


@query("j8_backend_keys", "participants_a participants_b", f"WITH {KEYS} SELECT * FROM k")
def _(t):
    return joins.backend_keys(t.participants_a, t.participants_b)


@query("j8_unresolved_keys", "participants_a participants_b", """SELECT DISTINCT parent_key FROM participants_b WHERE prolific_id NOT IN (SELECT prolific_id FROM participants_a WHERE prolific_id < '8')""")
def _(t):
    return joins.unresolved_keys(joins.backend_keys(t.participants_a.filter("prolific_id < '8'"), t.participants_b)).select("parent_key")


@query("d3_pseudonymous_a", "participants_a participants_b", f"""WITH {MAP} SELECT p.pseudonym AS prolific_id, s.pseudonym AS submission_id, rating FROM participants_a a JOIN m p ON p.id_column = 'prolific_id' AND p.original = a.prolific_id
JOIN m s ON s.id_column = 'submission_id' AND s.original = a.submission_id""", num="rating")
def _(t):
    return deid.deidentify({"a": t.participants_a, "b": t.participants_b})[0]["a"]


@query("d3_pseudonymous_b", "participants_a participants_b", f"""WITH {MAP}, {KEYS}SELECT p.pseudonym AS prolific_id, s.pseudonym AS submission_id FROM participants_b b JOIN k USING (parent_key) JOIN m p ON p.id_column = 'prolific_id' AND p.original = b.prolific_id
JOIN m s ON s.id_column = 'submission_id' AND s.original = k.submission_id""")
def _(t):
    return deid.deidentify({"a": t.participants_a, "b": t.participants_b})[0]["b"].select("prolific_id", "submission_id")


@query("d3_change_report", "participants_a participants_b", """SELECT 'a' AS table_name, 'prolific_id' AS column_name, 'pseudonymise' AS action, count(DISTINCT prolific_id) AS n FROM participants_a UNION ALL SELECT 'a', 'submission_id', 'pseudonymise', count(DISTINCT submission_id) FROM participants_a
UNION ALL SELECT 'a', 'comments', 'drop', count(comments) FROM participants_a UNION ALL SELECT 'b', 'prolific_id', 'pseudonymise', count(DISTINCT prolific_id) FROM participants_b UNION ALL SELECT 'b', 'comments', 'drop', count(comments) FROM participants_b""", ints="n")
def _(t):
    return deid.change_report({"a": t.participants_a, "b": t.participants_b})


@query("d4_relink_table", "participants_a participants_b", f"WITH {MAP} SELECT * FROM m UNION SELECT 'prolific_id', 'gone', 'P000'")
def _(t):
    new = cut_lineage(deid.id_mappings([t.participants_a, t.participants_b]))
    prior = new.filter("pseudonym < 'P020'").unionByName(new.limit(1).select(F.lit("prolific_id").alias("id_column"), F.lit("gone").alias("original"), F.lit("P000").alias("pseudonym")))
    return deid.update_relink(prior, new)


SCORE = "1.0::DOUBLE + ('0x' || substr(md5(attribute || '|' || person_term), 1, 4))::BIGINT % 7"
REP = "rows3 AS (SELECT source_novel, text_id, attribute, person_term FROM phrases, (VALUES ('man'), ('woman'), ('nonbinary person')) v(person_term) WHERE attribute IS NOT NULL)"


def tripled(t):
    return joins.replicate_terms(t.phrases.filter("attribute is not null").select("source_novel", "text_id", "attribute"))


def model(batch: pd.DataFrame) -> pd.DataFrame:
    """A scorer plug-in: same numbers as `lexical_score`, with a row it cannot do."""
    import hashlib

    if (batch["attribute"] == "old anvil").any():
        raise ValueError("no such thing")
    keys = batch["attribute"] + "|" + batch["person_term"]
    scores = [1.0 + int(hashlib.md5(k.encode()).hexdigest()[:4], 16) % 7 for k in keys]
    return pd.DataFrame({"predicted_rating": scores, "generation": [f"I say {int(s)}." for s in scores]})


@query("h1_score_distinct", "phrases", f"WITH {REP} SELECT source_novel, attribute, person_term, {SCORE} AS predicted_rating, count(*) AS n FROM rows3 GROUP BY ALL", num="predicted_rating", ints="n")
def _(t):
    scored = scoring.score_distinct(tripled(t), scoring.lexical_score(F.col("attribute"), F.col("person_term")))
    return scored.groupBy("source_novel", "attribute", "person_term", "predicted_rating").agg(F.count(F.lit(1)).alias("n"))


@query("j7_resumed_scores", "phrases", f"""WITH {REP} SELECT attribute, person_term, CASE WHEN attribute LIKE 'blue%' THEN 9.5 ELSE {SCORE} END AS predicted_rating, count(*) AS n FROM rows3 GROUP BY ALL""", num="predicted_rating", ints="n")
def _(t):
    done = joins.replicate_terms(t.part.select(F.col("p_name").alias("attribute")).distinct())
    done = done.withColumn("predicted_rating", F.when(F.startswith("attribute", F.lit("blue")), 9.5))
    scored = scoring.score_distinct(tripled(t), scoring.lexical_score(F.col("attribute"), F.col("person_term")), done)
    return scored.groupBy("attribute", "person_term", "predicted_rating").agg(F.count(F.lit(1)).alias("n"))


@query("h2_score_attributes", "phrases", f"""WITH {REP}, d AS (SELECT DISTINCT attribute, person_term FROM rows3) SELECT attribute, person_term, CASE WHEN attribute = 'old anvil' THEN NULL ELSE {SCORE} END AS predicted_rating FROM d""", num="predicted_rating")
def _(t):
    return scoring.score_attributes(t.phrases.filter("attribute is not null"), model).select("attribute", "person_term", "predicted_rating")


@query("h3_failed_rows", "phrases", f"WITH {REP} SELECT DISTINCT attribute, person_term, 'ValueError: no such thing' AS error, 'ERROR: ValueError: no such thing' AS generation FROM rows3 WHERE attribute = 'old anvil'")
def _(t):
    return scoring.failed_rows(scoring.score_attributes(t.phrases.filter("attribute is not null"), model)).select("attribute", "person_term", "error", "generation")


@query("h4_term_output", "items", "SELECT attribute, person_term, CASE person_term WHEN 'woman' THEN avg_rating WHEN 'man' THEN 2 * avg_rating ELSE 3 * avg_rating END AS predicted_rating FROM items", num="predicted_rating")
def _(t):
    a = F.col("avg_rating")
    return scoring.pick_term_output(t.items.withColumn("outputs", F.array(a, 2 * a, 3 * a))).select("attribute", "person_term", "predicted_rating")

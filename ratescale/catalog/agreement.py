"""Agreement statistics over the annotations view."""

from pyspark.sql import functions as F

from ratescale.catalog.registry import query
from ratescale.operators import agreement as ag

# Three annotators with missing labels: the third is made of both, some labels of the second are blank.
THREE = """three AS (SELECT doc_id, annotator, CASE WHEN annotator = 'annotator2' AND doc_id % 5 = 0 THEN NULL ELSE label END AS label, system_label FROM annotations
 UNION ALL SELECT doc_id, 'annotator3', CASE WHEN doc_id % 3 = 0 THEN NULL WHEN doc_id % 4 = 0 THEN 1 - label ELSE label END, system_label FROM annotations WHERE annotator = 'annotator1')"""


def three(t):
    a = t.annotations
    first = a.withColumn("label", F.expr("CASE WHEN annotator = 'annotator2' AND doc_id % 5 = 0 THEN NULL ELSE label END"))
    third = a.filter("annotator = 'annotator1'").withColumn("label", F.expr("CASE WHEN doc_id % 3 = 0 THEN NULL WHEN doc_id % 4 = 0 THEN 1 - label ELSE label END"))
    return first.unionByName(third.withColumn("annotator", F.lit("annotator3")))


COUNTS = "cnt AS (SELECT {by}doc_id, label, count(*) AS c FROM {src} WHERE label IS NOT NULL GROUP BY ALL), itm AS (SELECT {by}doc_id, sum(c) AS m, sum(c*(c-1)) AS agree FROM cnt GROUP BY ALL)"


@query("a50_pairwise_agreement", "annotations", f"WITH {THREE}, {COUNTS.format(by='', src='three')} SELECT avg(agree / (m*(m-1))::DOUBLE) AS pairwise_agreement, count(*) AS n_items FROM itm WHERE m >= 2", num="pairwise_agreement", ints="n_items")
def _(t):
    return ag.pairwise_agreement(three(t), ["doc_id"])


KAPPA = """w AS (SELECT {by}doc_id, max(CASE WHEN annotator = 'annotator1' THEN label END) AS a, max(CASE WHEN annotator = 'annotator2' THEN label END) AS b FROM {src} GROUP BY ALL),
 kk AS (SELECT {by}count(*) AS n, avg(CAST(a = b AS INT)) AS po, avg(a)*avg(b) + (1-avg(a))*(1-avg(b)) AS pe FROM w WHERE a IS NOT NULL AND b IS NOT NULL GROUP BY ALL)"""


@query("a51_cohen_kappa", "annotations", f"WITH {KAPPA.format(by='', src='annotations')} SELECT n, CASE WHEN pe = 1 THEN 1 ELSE (po - pe) / (1 - pe) END AS kappa FROM kk", num="kappa", ints="n")
def _(t):
    return ag.cohen_kappa(t.annotations, ["doc_id"], ("annotator1", "annotator2"))


ALPHA = """pl AS (SELECT {by}label, sum(c*(c-1)) AS diag, sum(c*(m-1)) AS margin FROM cnt JOIN itm USING ({by}doc_id) WHERE m >= 2 GROUP BY ALL),
 al AS (SELECT {by}sum(diag) AS diag, sum(margin)::DOUBLE AS total, sum(margin::DOUBLE * margin) AS sq FROM pl GROUP BY ALL)"""
ALPHA_OUT = "CASE WHEN 1 - sq/(total*total) = 0 THEN 1 ELSE 1 - (1 - diag/total) / (1 - sq/(total*total)) END AS alpha"


@query("a52_krippendorff_alpha", "annotations", f"WITH {THREE}, {COUNTS.format(by='', src='three')}, {ALPHA.format(by='')} SELECT {ALPHA_OUT} FROM al", num="alpha")
def _(t):
    return ag.krippendorff_alpha(three(t), ["doc_id"])


CONF = """cm AS (SELECT {by}annotator, count(*) AS n, count_if(system_label = 1 AND label = 1) AS tp, count_if(system_label = 0 AND label = 0) AS tn, count_if(system_label = 0 AND label = 1) AS fp, count_if(system_label = 1 AND label = 0) AS fn FROM {src} GROUP BY ALL),
 cf AS (SELECT *, (tp+tn)/n::DOUBLE AS accuracy, tp/nullif(tp+fp, 0)::DOUBLE AS precision, tp/nullif(tp+fn, 0)::DOUBLE AS recall FROM cm)"""
CONF_OUT = "2*precision*recall/nullif(precision+recall, 0) AS f1"


@query("a53_confusion_metrics", "annotations", f"WITH {CONF.format(by='', src='annotations')} SELECT *, {CONF_OUT} FROM cf", num="accuracy precision recall f1", ints="n tp tn fp fn")
def _(t):
    return ag.confusion_metrics(t.annotations, "system_label")


SHEETS = "sheets AS (SELECT doc_id, annotator, system_label, label AS abstention, CASE WHEN doc_id % 6 = 0 THEN NULL WHEN doc_id % 4 = 1 THEN 1 ELSE 0 END AS caveat FROM annotations)"


def sheets(t):
    return t.annotations.withColumnRenamed("label", "abstention").withColumn("caveat", F.expr("CASE WHEN doc_id % 6 = 0 THEN NULL WHEN doc_id % 4 = 1 THEN 1 ELSE 0 END"))


@query("a54_label_composition", "annotations", f"""WITH {SHEETS}, z AS (SELECT annotator, abstention AS a, coalesce(caveat, 0) AS c FROM sheets)
SELECT annotator, count(*) AS n_rows, count_if(a=1 AND c=0) AS abstention_only, count_if(a=0 AND c=1) AS caveat_only, count_if(a=1 AND c=1) AS "both", count_if(a=0 AND c=0) AS neither, count_if(a=1) AS n_abstention,
 count_if(c=1) AS n_caveat, count_if(a=1 OR c=1) AS n_combined, count_if(c=1) / nullif(count_if(a=1), 0)::DOUBLE AS ratio FROM z GROUP BY 1""", num="ratio", ints="n_rows abstention_only caveat_only \"both\" neither n_abstention n_caveat n_combined")
def _(t):
    return ag.label_composition(sheets(t).fillna(0, ["abstention", "caveat"]))


@query("a55_coverage", "annotations", f"WITH {THREE} SELECT annotator, count(*) AS n, count(label)/count(*)::DOUBLE AS coverage, avg(label) AS mean_score FROM three GROUP BY 1", num="coverage mean_score", ints="n")
def _(t):
    return ag.coverage(three(t), ["annotator"])


@query("a56_majority_vote", "annotations", f"""WITH {THREE}, c AS (SELECT doc_id, label, count(*) AS c, min(system_label) AS ref FROM three WHERE label IS NOT NULL GROUP BY 1, 2),
 r AS (SELECT *, rank() OVER (PARTITION BY doc_id ORDER BY c DESC) AS rk FROM c), v AS (SELECT doc_id, count(*) > 1 AS tied, min(label) AS label, min(ref) AS ref FROM r WHERE rk = 1 GROUP BY 1)
SELECT count_if(NOT tied) AS n_clear, avg(CASE WHEN NOT tied THEN CAST(label = ref AS INT) END) AS accuracy, count_if(tied) AS n_tied, count_if(tied) / (SELECT count(DISTINCT doc_id) FROM three)::DOUBLE AS tie_rate FROM v""", num="accuracy tie_rate", ints="n_clear n_tied")
def _(t):
    return ag.majority_vote(three(t), ["doc_id"], "system_label")


@query("a57_mean_consistency", "annotations", f"""WITH {THREE} SELECT avg(c) AS consistency, count(*) AS n_annotators FROM (SELECT annotator, avg(CAST(label = system_label AS INT)) AS c FROM three WHERE label IS NOT NULL GROUP BY 1) q""", num="consistency", ints="n_annotators")
def _(t):
    return ag.mean_consistency(three(t), "system_label")


LONG3 = """lt AS (SELECT doc_id, annotator, system_label, 'abstention' AS label_name, coalesce(abstention, 0) AS label FROM sheets UNION ALL SELECT doc_id, annotator, system_label, 'caveat', coalesce(caveat, 0) FROM sheets
 UNION ALL SELECT doc_id, annotator, system_label, 'combined', greatest(coalesce(abstention, 0), coalesce(caveat, 0)) FROM sheets)"""


@query("a58_label_types", "annotations", f"""WITH {SHEETS}, {LONG3}, {COUNTS.format(by='label_name, ', src='lt')}, {ALPHA.format(by='label_name, ')}, {KAPPA.format(by='label_name, ', src='lt')}, {CONF.format(by='label_name, ', src='lt')},
 pw AS (SELECT label_name, avg(agree / (m*(m-1))::DOUBLE) AS pairwise_agreement, count(*) AS n_items FROM itm WHERE m >= 2 GROUP BY 1)
SELECT cf.*, {CONF_OUT}, pairwise_agreement, n_items, {ALPHA_OUT}, CASE WHEN pe = 1 THEN 1 ELSE (po - pe) / (1 - pe) END AS kappa FROM cf JOIN pw USING (label_name) JOIN al USING (label_name)
JOIN (SELECT label_name, po, pe FROM kk) k2 USING (label_name)""", num="accuracy precision recall f1 pairwise_agreement alpha kappa", ints="n tp tn fp fn n_items")
def _(t):
    return ag.evaluate_label_types(sheets(t), ["doc_id"], "system_label", ("annotator1", "annotator2"))

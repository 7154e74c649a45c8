"""Views over the driver's tables that stand in for rating, response, phrase and run tables.

The text is valid as written in Spark SQL and in DuckDB; `FIXTURES.md` describes each view.
"""

from __future__ import annotations

from collections.abc import Iterable

VIEWS: dict[str, tuple[tuple[str, ...], str]] = {
    "ratings": (
        (),
        """SELECT CAST(l_suppkey AS BIGINT) AS submission_id, 'part ' || CAST(l_partkey AS STRING) AS attribute,
 CASE l_returnflag WHEN 'A' THEN 'woman' WHEN 'N' THEN 'man' ELSE 'nonbinary person' END AS person_term,
 CAST(floor((3*(l_partkey % 7) + 2*((CAST(l_quantity AS BIGINT)-1) % 7)) / 5.0) + 1 AS DOUBLE) AS rating,
 CASE l_partkey % 3 WHEN 0 THEN 'llm' WHEN 1 THEN 'human' ELSE 'novel' END AS source,
 CAST(l_partkey AS BIGINT) AS k FROM lineitem""",
    ),
    "ratings_sparse": (("ratings",), "SELECT * FROM ratings WHERE NOT (k % 10 = 0 AND person_term = 'nonbinary person')"),
    "models": (
        (),
        """SELECT * FROM (VALUES (0,'Qwen2.5-7B'),(1,'Qwen2.5-7B-Instruct'),(2,'Mistral-7B-v0.3'),
 (3,'Mistral-7B-Instruct-v0.3'),(4,'gpt-4o'),(5,'gpt-oss-20b')) AS t(model_idx, model)""",
    ),
    "items": (
        ("ratings",),
        """SELECT attribute, person_term, source, k, avg(rating) AS avg_rating, count(*) AS n_raters
 FROM ratings GROUP BY attribute, person_term, source, k""",
    ),
    "responses": (
        ("items", "models"),
        """SELECT model, CASE source WHEN 'llm' THEN 'combined_llm' WHEN 'human' THEN 'eval_human' ELSE 'eval_novel' END AS dataset,
 attribute, person_term,
 CASE h WHEN 0 THEN 'I cannot determine that.' WHEN 1 THEN 'A matter of opinion: ' || d WHEN 2 THEN ' ' || d || '.5 overall'
  WHEN 3 THEN 'maybe ' || w WHEN 4 THEN 'the ' || d || 'th step' WHEN 5 THEN '' ELSE d END AS generation,
 CASE WHEN h % 4 = 0 THEN NULL WHEN h = 7 THEN -1 ELSE least(7, 1 + (k + model_idx + 1) % 7) END AS method2_rating, avg_rating
 FROM (SELECT *, CAST(1 + (k + model_idx) % 7 AS STRING) AS d, (k*7 + model_idx*3 + length(person_term)) % 23 AS h,
   CASE (k + model_idx) % 7 WHEN 0 THEN 'one' WHEN 1 THEN 'two' WHEN 2 THEN 'three' WHEN 3 THEN 'four' WHEN 4 THEN 'five' WHEN 5 THEN 'six' ELSE 'seven' END AS w
  FROM items CROSS JOIN models) q""",
    ),
    "predictions": (
        ("items",),
        """SELECT attribute, person_term, source, CAST(1.6 + 0.8*(k % 7) AS DOUBLE) AS predicted, avg_rating AS true_rating
 FROM items""",
    ),
    "annotations": (
        (),
        """SELECT l.doc_id, 'annotator1' AS annotator, CAST(l.quality AS INT) AS label, CASE WHEN d.n_chars > 500 THEN 1 ELSE 0 END AS system_label
 FROM labels l JOIN documents d ON l.doc_id = d.doc_id
 UNION ALL SELECT l.doc_id, 'annotator2', CASE WHEN l.toxic = 1 AND l.doc_id % 2 = 0 THEN 1 - l.quality ELSE l.quality END,
 CASE WHEN d.n_chars > 500 THEN 1 ELSE 0 END FROM labels l JOIN documents d ON l.doc_id = d.doc_id""",
    ),
    "phrases": (
        (),
        """SELECT 'novel' || CAST(l_suppkey % 20 AS STRING) AS source_novel, CAST(l_orderkey AS BIGINT) AS text_id,
 CASE WHEN l_linenumber = 1 THEN NULL ELSE p_name END AS attribute,
 CASE l_returnflag WHEN 'A' THEN 'female' WHEN 'N' THEN 'male' ELSE 'unknown' END AS llm_gender,
 CASE WHEN l_linestatus = 'F' THEN 'female' WHEN p_size % 3 = 0 THEN 'evidence for both' ELSE 'male' END AS intext_gender,
 p_size % 2 = 0 AS indomain_strct FROM lineitem JOIN part ON l_partkey = p_partkey""",
    ),
    "runs": (
        (),
        """SELECT 'model' || CAST(l_linenumber AS STRING) AS model, 'cfg' || CAST(l_suppkey % 4 AS STRING) AS config,
 CAST(l_partkey % 5 AS INT) + 1 AS fold, CASE l_orderkey % 3 WHEN 0 THEN 42 WHEN 1 THEN 123 ELSE 456 END AS seed,
 CASE l_returnflag WHEN 'A' THEN 'woman' WHEN 'N' THEN 'man' ELSE 'nonbinary person' END AS category,
 avg(l_tax) AS rmse, avg(l_discount) AS corr FROM lineitem GROUP BY 1,2,3,4,5""",
    ),
    "participants_a": (
        (),
        """SELECT md5('p' || CAST(user_id AS STRING)) AS prolific_id, md5('s' || CAST(user_id AS STRING)) AS submission_id,
 event_type AS comments, value AS rating FROM events
 UNION ALL SELECT md5('p' || CAST(conv_id AS STRING)), md5('s' || CAST(conv_id AS STRING)), role, CAST(turn AS DOUBLE) FROM conversations""",
    ),
    "participants_b": (
        (),
        """SELECT 'key' || CAST(conv_id AS STRING) AS parent_key, md5('p' || CAST(conv_id AS STRING)) AS prolific_id,
 text AS comments FROM conversations""",
    ),
}


def _needed(names: Iterable[str]) -> list[str]:
    order: list[str] = []

    def visit(name: str) -> None:
        for dep in VIEWS[name][0]:
            visit(dep)
        if name not in order:
            order.append(name)

    for name in names:
        visit(name)
    return order


def with_views(names: Iterable[str], body: str, more_ctes: str = "") -> str:
    """`body` with the named views (and the views they build on) as CTEs in front."""
    ctes = [f"{n} AS ({VIEWS[n][1]})" for n in _needed(names)]
    if more_ctes:
        ctes.append(more_ctes)
    return ("WITH " + ",\n".join(ctes) + "\n" if ctes else "") + body

"""The registered text predictor against the operator's own size."""

import inspect

from ratescale.catalog import load_all
from ratescale.catalog.registry import REGISTRY, Source
from ratescale.operators import predictor

load_all()


def test_text_predictor_keeps_all_hashed_features(spark, data, monkeypatch):
    stages, seen = predictor.text_stages, []
    monkeypatch.setattr(predictor, "text_stages", lambda size: seen.append(size) or stages(size))
    REGISTRY["h6_text_predictor"].build(Source(spark, data))
    assert seen == [inspect.signature(predictor.train_on_text).parameters["size"].default] == [1024]


def test_stages_of_a_fit_read_written_rows(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(predictor, "Pipeline", type("Seen", (), {"__init__": lambda self, stages: None, "fit": lambda self, rows: seen.append(rows)}))
    monkeypatch.setattr(predictor, "predict", lambda model, rows: rows)
    items = spark.range(40).selectExpr("concat('part ', id % 10) AS attribute", "'woman' AS person_term", "1.0D + id % 7 AS avg_rating", "id AS unread")
    test = predictor.train_on_text(items)
    for rows in (*seen, test):
        assert "Join" not in (plan := rows._jdf.queryExecution().optimizedPlan().toString()) and "Range" not in plan and "unread" not in plan
    assert seen[0].count() + test.count() < 40 and {r[0] for r in seen[0].select("attribute").collect()}.isdisjoint(r[0] for r in test.select("attribute").collect())

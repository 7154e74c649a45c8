"""The pipeline's stages against their operators, and the registration of the queries."""

import __spark_entry__ as entry
import corpus_pipeline
from ratescale.llm import queries
from ratescale.llm.common import written


def test_all_are_registered():
    assert set(queries.QUERIES) | {"pipeline"} <= set(entry.queries())
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 14))


def test_stages(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    columns, before = docs.columns, docs.count()
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = written(stage(spark, docs, data), f"stage-test-{i}")
        if i < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == columns and out.count() <= before, name
            assert out.select("doc_id").distinct().count() == out.count()
            before = out.count()
            docs = out
    assert out.select("doc_id").distinct().count() == before
    assert sorted(map(tuple, corpus_pipeline.run(spark, data).select("doc_id", "piece", "start", "length", "ids_crc32").collect())) == sorted(
        map(tuple, out.select("doc_id", "piece", "start", "length", "ids_crc32").collect()))


AWKWARD = [
    (1, "Some words of a document. " * 20, "a", "b", "c"), (1, "Some words of a document. " * 20, "a", "b", "c"), (2, None, None, None, None), (None, None, None, None, None),
    (3, "", "a", "b", "c"), (4, "long " * 100_000, "a", "b", "c"), (5, "Call +1 (252) 555-8630 or 10.0.0.5 now, please do it today or tomorrow", "a", "b", "c"),
]
COLUMNS = "doc_id long, text string, _node string, _row string, shard string"


def tables(spark, folder, rows, labels, items):
    for name, data, schema in (("documents", rows, COLUMNS), ("labels", labels, "doc_id long, quality int, toxic int"), ("benchmark", items, "item_id string, text string")):
        spark.createDataFrame(data, schema).write.parquet(f"{folder}/{name}.parquet")


def test_awkward_rows(spark, tmp_path):
    """Nulls, repeats, a very long text and clashing names pass all stages; without a usable rating or item nothing is rejected for it."""
    tables(spark, tmp_path, AWKWARD, [(None, 1, 0), (99, 1, 0), (1, None, 0)], [("x", None), (None, ""), ("y", "a window of words that stands in no document of them all")])
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r["doc_id"] for r in out} == {1, 2, 4, 5}  # texts without words are copies of each other: the smallest id stays
    assert sum(r["length"] for r in out if r["doc_id"] == 2) == 1


def test_empty_tables(spark, tmp_path):
    tables(spark, tmp_path, [], [], [])
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []

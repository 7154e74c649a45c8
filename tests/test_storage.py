"""Readers, writers and whole jobs over files."""

import hashlib
import json

import pandas as pd
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ratescale.functions.text import Lexicon
from ratescale.operators import clean, deid, extraction, joins, runs, scoring
from ratescale.plans import jobs
from ratescale.schemas import EVAL_METRICS, PHRASES, RATINGS, RESPONSES, require_columns
from ratescale.sources import quoted, sinks, tables
from ratescale.streaming import incremental


def test_csv_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("a \"quoted\"\nline", 1.5, "0012"), ("b, c", None, "7")], "text string, x double, id string")
    sinks.write_csv(df, str(tmp_path / "t"))
    back = tables.read_table(spark, str(tmp_path / "t"), df.schema)
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, df.collect()))


@pytest.mark.parametrize("split", [40, 400, 1 << 20])
def test_quoted_line_breaks_over_many_splits(spark, tmp_path, split):
    """One file read by many tasks; cells of several lines cross the splits, and one is longer than a split."""
    rows = [(i, f'a "quoted"\r\nline {i}\n\n' if i % 3 == 0 else "plain, with comma" if i % 3 == 1 else None) for i in range(200)]
    rows.append((200, "\n".join(f"long cell {j}" for j in range(60))))
    lines = ["i,text"] + [f"{i}," + ("" if t is None else '"' + t.replace('"', '""') + '"') for i, t in rows]
    (tmp_path / "a b+c.csv").write_bytes("\r\n".join(lines).encode())
    (tmp_path / "d.csv").write_bytes("\n".join(lines[:1] + lines[4:9]).encode() + b"\n\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(split))
    try:
        table = tables.read_table(spark, str(tmp_path), "i int, text string")
        got = sorted(map(tuple, table.collect()), key=lambda r: (r[0], r[1] or ""))
        several = table.select(F.spark_partition_id()).distinct().count()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert got == sorted(rows + rows[3:8], key=lambda r: (r[0], r[1] or ""))
    assert several > 10 or split > 40


def test_files_with_different_columns(spark, tmp_path):
    (tmp_path / "105_persuasion_physattr.csv").write_text("text_id,attribute\n0,a dark face\n1,\n")
    (tmp_path / "hp1_physattr.csv").write_text("attribute,text_id,llm_gender\nred hair,4,male\n")
    rules = [("105_", "persuasion", "female"), ("hp1", "hp1", "female")]
    got = tables.read_extracted(spark, f"{tmp_path}/*.csv", PHRASES, rules)
    rows = {(r.source_novel, r.text_id, r.attribute, r.llm_gender, r.source) for r in got.collect()}
    assert rows == {("105_persuasion", 0, "a dark face", None, "persuasion"), ("105_persuasion", 1, None, None, "persuasion"), ("hp1", 4, "red hair", "male", "hp1")}


def test_results_tree(spark, tmp_path):
    for model in ("m1", "m 2"):
        for dataset in ("combined_llm", "eval_human"):
            (tmp_path / model).mkdir(exist_ok=True)
            (tmp_path / model / f"{dataset}.csv").write_text("attribute,person_term,generation,avg_rating\na,man,5,4.5\n")
    got = tables.read_results(spark, str(tmp_path), RESPONSES)
    assert {(r.model, r.dataset, r.avg_rating) for r in got.collect()} == {(m, d, 4.5) for m in ("m1", "m 2") for d in ("combined_llm", "eval_human")}


def test_documents_and_checksums(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes("Né.\nTwo".encode("utf-8"))
    (tmp_path / "b.txt").write_bytes("Né.\nTwo".encode("latin-1"))
    assert {tuple(r) for r in tables.read_documents(spark, str(tmp_path)).collect()} == {("a", "Né. Two"), ("b", "Né. Two")}
    good = hashlib.sha256((tmp_path / "a.txt").read_bytes()).hexdigest()
    manifest = tmp_path.parent / "sums.sha256"
    manifest.write_text(f"{good}  a.txt\n{good}  b.txt\n{good}  c.txt\n")
    got = tables.verify_files(spark, str(tmp_path), str(manifest))
    assert {tuple(r) for r in got.collect()} == {("a.txt", "ok"), ("b.txt", "corrupt"), ("c.txt", "missing")}


def make_run(root, exp, run, seed, complete=True, rmse=0.5):
    d = root / exp / run / f"seed{seed}"
    (d / "eval_results").mkdir(parents=True)
    (d / "config.json").write_text("{}")
    (d / "metrics.csv").write_text("step,eval_rmse_mean\n1,0.5\n")
    if complete:
        (d / "eval_results" / "eval_metrics.csv").write_text(f"category,mse,rmse,mae,correlation\nmean,1,{rmse},1,0.7\nwoman,1,{rmse},1,0.6\n")


def test_run_tree(spark, tmp_path):
    make_run(tmp_path, "cfg_fold1of2", "run_20250101_000000", 42)
    make_run(tmp_path, "cfg_fold1of2", "run_20250102_000000", 42, rmse=0.25)
    make_run(tmp_path, "cfg_fold1of2", "run_20250102_000000", 7, rmse=0.75)
    make_run(tmp_path, "cfg_fold1of2", "run_20250103_000000", 42, complete=False)
    status = tables.run_status(tables.run_files(spark, str(tmp_path)))
    latest = tables.latest_runs(status)
    assert {(r.exp, r.run, r.seed, r.fold, r.config) for r in latest.collect()} == {("cfg_fold1of2", "run_20250102_000000", s, 1, "cfg") for s in (42, 7)}
    metrics = tables.read_run_tables(spark, str(tmp_path), "eval_results/eval_metrics.csv", EVAL_METRICS, latest)
    tidy = runs.tidy_metrics(metrics, ["config", "fold", "seed"])
    wide = runs.category_columns(tidy, ["config"]).first()
    assert wide["rmse_mean"] == 0.75 and wide["corr_woman"] == 0.6
    stats = runs.seed_statistics(metrics, ["category"], ["rmse"]).filter("category = 'mean'").first()
    assert stats["mean"] == 0.5 and stats["n"] == 2


def test_counts_refuse(spark):
    df = spark.createDataFrame([("a",), ("a",), ("b",)], "source string")
    expected = spark.createDataFrame([("a", 2), ("b", 1)], "source string, expected long")
    assert tables.require_counts(df, expected, ["source"]).count() == 3
    with pytest.raises(ValueError, match="wrong"):
        tables.require_counts(df.limit(1), expected, ["source"])
    assert tables.merge_shards({"a": df}, ["a", "b"]) is None
    with pytest.raises(ValueError, match="missing columns"):
        require_columns(df, ["rating"])


def test_json_and_report_files(spark, tmp_path):
    df = spark.createDataFrame([("m1", "all", float("nan"), 3), ("m2", "all", 0.5, 4)], "model string, dataset string, r double, n int")
    sinks.write_json_summary(df, ["model", "dataset"], str(tmp_path / "j"))
    rows = {r["model"]: json.loads(r["value"]) for r in spark.read.text(str(tmp_path / "j")).collect()}
    assert rows["m1"]["r"] is None and rows["m2"]["r"] == 0.5
    sinks.write_tagged_records({"x": df.select("model"), "y": df.select("n")}, str(tmp_path / "t"))
    tagged = [json.loads(r[0]) for r in spark.read.text(str(tmp_path / "t")).collect()]
    assert {t["type"] for t in tagged} == {"x", "y"} and len(tagged) == 4
    sinks.write_markdown(df.withColumn("shown", sinks.decimals(F.col("r"))), ["model", "shown"], ["Model", "r"], [F.desc("n")], str(tmp_path / "m"))
    lines = [line for f in sorted((tmp_path / "m").glob("part*")) for line in f.read_text().splitlines()]
    assert lines == ["| Model | r |", "| ----- | ----- |", "| m2 | 0.500 |", "| m1 | / |"]


def test_rejects_and_failures_are_appended(spark, tmp_path):
    df = spark.createDataFrame([("n1", "x", None), ("n2", "y", "boom")], "source_novel string, attribute string, error string")
    for _ in range(2):
        sinks.write_rejects(df, str(tmp_path / "r"))
        sinks.write_failed(df, str(tmp_path / "f"))
    assert spark.read.parquet(str(tmp_path / "r")).count() == 4
    assert spark.read.parquet(str(tmp_path / "f")).count() == 2


LEX = Lexicon.of(["dark", "bright"])
DOCS = [("105_a", "CHAPTER ONE  SHE had a dark face. Nothing here. His bright eyes shone. It was a dark night."), ("158_b", "The dark nose of him!")]


def test_extraction_with_failing_extractor(spark):
    docs = spark.createDataFrame(DOCS, "doc_id string, text string")

    def extractor(batch):
        def one(text):
            if "nose" in text:
                raise RuntimeError("no nose")
            if "eyes" in text:
                return json.dumps([{"attribute": "his bright eyes", "gender": "male", "reasoning": "his"}, {"attribute": "eyes", "gender": "male", "reasoning": ""}])
            return "[]"
        return batch["text"].map(one)

    out = extraction.extract_phrases(docs, LEX, extractor)
    assert [tuple(r) for r in out["skipped"].select("doc_id", "error").collect()] == [("158_b", "RuntimeError: no nose")]
    kept = {(r.doc_id, r.text_id, r.attribute_text_id, r.attribute, r.gender_match) for r in out["phrases"].collect()}
    assert kept == {("105_a", 0, None, None, False), ("105_a", 1, 0, "bright eyes", True), ("158_b", 0, None, None, False)}
    assert [(r.attribute_original, r.reject_reason) for r in out["rejected"].collect()] == [("eyes", "bare_noun")]


def test_documents_to_facts(spark):
    docs = spark.createDataFrame(DOCS, "doc_id string, text string")
    facts = jobs.scored_facts(docs, LEX, scoring.lexical_score(F.col("attribute"), F.col("person_term")))
    rows = facts.select("attribute", "person_term", "source", "author_gender", "gutenberg_id").collect()
    assert {r.attribute for r in rows} == {"dark face", "bright eye", "dark nose"} and len(rows) == 9
    assert facts.columns[:7] == ["attribute", "person_term", "predicted_rating", "source", "gutenberg_id", "author_gender", "llm_gender"]


def test_resume_scores_only_what_is_missing(spark):
    calls = spark.sparkContext.accumulator(0)

    def scorer(batch):
        calls.add(len(batch))
        return pd.DataFrame({"predicted_rating": [2.0] * len(batch), "generation": ["2"] * len(batch)})

    done = spark.createDataFrame([("a", "man", 5.0, "5"), ("a", "woman", None, "ERROR: x"), ("b", "man", 3.0, "ERROR: y")], "attribute string, person_term string, predicted_rating double, generation string")
    rows = spark.createDataFrame([("a", "man"), ("a", "man"), ("a", "woman"), ("b", "man")], "attribute string, person_term string")
    got = sorted(map(tuple, scoring.score_distinct(rows, scorer, done).collect()))
    assert got == [("a", "man", 5.0), ("a", "man", 5.0), ("a", "woman", 2.0), ("b", "man", 2.0)]
    assert calls.value == 2


def test_incremental_scoring(spark, tmp_path):
    src, out, chk = (str(tmp_path / n) for n in ("in", "out", "chk"))
    spark.createDataFrame([("dark face",), ("dark face",), (" ",)], "attribute string").write.parquet(src)
    score = scoring.lexical_score(F.col("attribute"), F.col("person_term"))

    def run():
        q = incremental.score_new_pairs(incremental.phrase_stream(spark, src, "attribute string"), score, out, chk)
        q.awaitTermination(120)
        return spark.read.parquet(out)

    assert run().count() == 3
    spark.createDataFrame([("dark face",), ("red hair",)], "attribute string").write.mode("append").parquet(src)
    after = run()
    assert after.count() == 6 and after.select("attribute", "person_term").distinct().count() == 6


def test_pseudonyms_are_kept_and_unresolved_keys_refused(spark):
    a = spark.createDataFrame([("x", "s1"), ("y", "s2"), ("x", "s1")], "prolific_id string, submission_id string")
    b = spark.createDataFrame([("k1", "x", "hi")], "parent_key string, prolific_id string, comments string")
    out, relink = deid.deidentify({"a": a, "b": b})
    assert {tuple(r) for r in out["a"].collect()} == {("P001", "S001"), ("P002", "S002")}
    assert [r.asDict() for r in out["b"].collect()] == [{"prolific_id": "P001", "submission_id": "S001"}]
    again, none = deid.deidentify({"a": out["a"]})
    assert none.count() == 0 and {tuple(r) for r in again["a"].collect()} == {("P001", "S001"), ("P002", "S002")}
    lost = spark.createDataFrame([("k9", "nobody")], "parent_key string, prolific_id string")
    with pytest.raises(Exception, match="without submission"):
        deid.resolve_backend_key(lost, joins.backend_keys(a, lost)).collect()


def test_refusals(spark):
    df = spark.createDataFrame([("man",), ("robot",)], "person_term string")
    with pytest.raises(Exception, match="unexpected person_term"):
        clean.refuse_unknown(df, "person_term", ["man"]).collect()
    with pytest.raises(Exception, match="no source"):
        joins.attach_source(spark.createDataFrame([("q",)], "attribute string"), spark.createDataFrame([("a", "llm")], "attribute string, source string")).collect()


def test_clean_ratings(spark):
    rows = [("a", t) for t in ("woman", "man", "nonbinary person")] + [("b", "man")] + [("curled eyelashes", t) for t in ("woman", "man", "nonbinary person")]
    df = spark.createDataFrame(rows, "attribute string, person_term string")
    assert clean.clean_ratings(df).select("attribute").distinct().collect()[0][0] == "a"
    assert tuple(clean.removal_counts(df).first()) == (7, 1, 3, 4, 3)
    assert RATINGS.fieldNames()[0] == "submission_id"


def test_file_names_are_read_once_for_each_file(spark, tmp_path):
    for name in ("1_a_physattr", "2_b"):
        (tmp_path / f"{name}.csv").write_text('attribute\n"blue\neye"\nold hat\n')
    got = tables.read_extracted(spark, str(tmp_path / "*.csv"), T.StructType([T.StructField("attribute", T.StringType())]), [("1_", "one", "female"), ("2_", "two", "male")])
    assert got.columns == ["attribute", "path", "source_novel", "source", "author_gender"]
    assert "_physattr" not in got._jdf.queryExecution().optimizedPlan().toString()
    rows = {(r.attribute, r.source_novel, r.source, r.author_gender) for r in got.collect()}
    assert rows == {(a, *n) for a in ("blue\neye", "old hat") for n in (("1_a", "one", "female"), ("2_b", "two", "male"))}


def test_splits_sort_no_lines(spark, tmp_path, monkeypatch):
    (tmp_path / "a.csv").write_text('x\n' + '"one\n""two"" and\nthree"\n\nplain\n' * 300)
    monkeypatch.setattr(quoted, "cut_lineage", lambda df: df)
    for most in ("64b", "1k", "128m"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", most)
        try:
            known = quoted.splits(spark, str(tmp_path / "a.csv"))
            plan = known._jdf.queryExecution().executedPlan().toString()
            assert "SortAggregate" not in plan and "min_by" not in plan
            rows = [r.value for r in quoted.records(spark, str(tmp_path / "a.csv"), known).filter("not first").collect()]
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")
        assert sorted(rows) == sorted(['"one\n""two"" and\nthree"', "plain"] * 300)

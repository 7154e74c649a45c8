"""Readers for CSV tables, document files, result trees and run trees, with ingest checks."""

from __future__ import annotations

import csv
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ratescale.functions.terms import base_config, file_stem, fold_number, run_time, seed_number
from ratescale.functions.text import decode_text
from ratescale.operators.joins import match_prefix, union_all
from ratescale.operators.scale import join_small
from ratescale.sources import quoted

# What a finished run folder holds.
RUN_FILES = ("config.json", "metrics.csv")
RUN_RESULTS = ("eval_metrics.csv", "eval_report.txt", "predictions.csv")


def read_table(spark: SparkSession, path: str | Sequence[str], schema: T.StructType | str, known: DataFrame | None = None, **options: str) -> DataFrame:
    """A CSV table with a header; quoted cells may hold line breaks and doubled quotes. Large files are read by several tasks."""
    return _with_path(spark, path, schema, known, options).drop("path")


def _with_path(spark: SparkSession, path: str | Sequence[str], schema: T.StructType | str, known: DataFrame | None, options: Mapping[str, str]) -> DataFrame:
    fields = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    ddl = ", ".join(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in fields.fields)
    parsed = F.from_csv("value", ddl, {"escape": '"', "nullValue": "", **options})
    rows = quoted.records(spark, path, known).filter("NOT first").select(parsed.alias("_row"), "path")
    return rows.select(*[F.col("_row")[f.name].alias(f.name) for f in fields.fields], "path")


def headers(known: DataFrame) -> DataFrame:
    """First line of every file, from the files' `splits`."""
    return known.filter("start = 0").select("path", F.regexp_replace("line", "^\ufeff|\r$", "").alias("header"))


def read_tables(spark: SparkSession, path: str, schema: T.StructType, known: DataFrame | None = None) -> DataFrame:
    """All CSV files of a glob as one table with their path; files may lack columns or order them differently.

    Files are grouped by header, one read per distinct header; columns outside the schema come as text. A first pass over the
    files, which finds where quoted cells cross splits, gives the headers too.
    """
    kinds = {f.name: f.dataType for f in schema.fields}
    known = known if known is not None else quoted.splits(spark, path)
    groups = headers(known).groupBy("header").agg(F.collect_list("path").alias("paths")).orderBy("header").collect()
    parts = []
    for g in groups:
        names = [c.strip() for c in next(csv.reader([g["header"]]))]
        own = T.StructType([T.StructField(n, kinds.get(n, T.StringType())) for n in names])
        parts.append(_with_path(spark, g["paths"], own, known, {}))
    out = union_all(*parts)
    missing = [F.lit(None).cast(t).alias(n) for n, t in kinds.items() if n not in out.columns]
    return out.select("*", *missing)


def table_name(path: Column) -> Column:
    """Path of the table a file belongs to: the file itself, or the folder of part files Spark wrote."""
    return F.regexp_replace(path, r"/part-[^/]+$", "")


def read_extracted(spark: SparkSession, path: str, schema: T.StructType, rules: Sequence[tuple[str, str, str]] = ()) -> DataFrame:
    """Phrase tables of all novels, the novel's name from the file name, and its source where rules are given."""
    known = quoted.splits(spark, path)
    stem = F.regexp_replace(file_stem(F.url_decode(table_name(F.col("path")))), "^source_novel=", "")
    named = known.select("path").distinct().withColumn("source_novel", F.regexp_replace(stem, "_physattr$", ""))
    return with_names(read_tables(spark, path, schema, known), match_prefix(named, F.col("source_novel"), rules) if rules else named)


def with_names(table: DataFrame, named: DataFrame) -> DataFrame:
    """What the path says, read once for each file and put on the file's rows."""
    new = [c for c in named.columns if c != "path"]
    return join_small(table.drop(*new), named, ["path"]).select(*[c for c in table.columns if c not in new], *new)


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """Whole text files: stem and text, as UTF-8 where valid and Latin-1 otherwise, on one line."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.txt").load(path)
    return files.select(file_stem(F.col("path")).alias("doc_id"), decode_text(F.col("content")).alias("text"))


def read_lexicon_table(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """Lexicon table (word, kind, form) of a file with a word in each line, of any length; `kind` is noun or adjective."""
    return spark.read.text(path).filter("trim(value) <> ''").select(F.trim("value").alias("word"), F.lit(kind).alias("kind"), F.lit(None).cast("string").alias("form")).distinct()


def read_lexicon(spark: SparkSession, path: str) -> list[str]:
    """Words of a small lexicon file, one per line, as a parameter of the plan, which holds them as a hash set. Large ones are tables (`read_lexicon_table`)."""
    return [r[0] for r in spark.read.text(path).filter("trim(value) <> ''").select(F.trim("value").alias("word")).distinct().orderBy("word").collect()]


def count_status(rows: DataFrame, expected: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Actual against expected row counts: `ok`, `wrong`, `missing` or `unexpected`."""
    actual = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    both = expected.select(*keys, "expected").join(actual, list(keys), "full")
    status = F.when(F.col("n").isNull(), "missing").when(F.col("expected").isNull(), "unexpected").when(
        F.col("n") == F.col("expected"), "ok"
    ).otherwise("wrong")
    return both.select(*keys, "expected", F.coalesce("n", F.lit(0)).alias("n"), status.alias("status"))


def require_counts(rows: DataFrame, expected: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The rows, if every count is as expected; the status table is one line per shard."""
    bad = [r.asDict() for r in count_status(rows, expected, keys).filter("status <> 'ok'").collect()]
    if bad:
        raise ValueError(f"row counts differ: {bad}")
    return rows


def merge_shards(shards: Mapping[str, DataFrame], wanted: Sequence[str], column: str = "source") -> DataFrame | None:
    """Union of all shards tagged by name, or nothing if one is missing."""
    if any(name not in shards for name in wanted):
        return None
    return union_all(*[shards[name].withColumn(column, F.lit(name)) for name in wanted])


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """Lines `digest  name` of a checksum file."""
    parts = F.regexp_extract("value", r"^([0-9a-fA-F]{64})\s+\*?(.+?)\s*$", 1), F.regexp_extract("value", r"^([0-9a-fA-F]{64})\s+\*?(.+?)\s*$", 2)
    return spark.read.text(path).select(F.lower(parts[0]).alias("digest"), parts[1].alias("name")).filter("digest <> ''")


def checksum_status(files: DataFrame, manifest: DataFrame, name: str = "name", content: str = "content") -> DataFrame:
    """Every file of the manifest as `ok`, `corrupt` or `missing`."""
    actual = files.select(F.col(name).alias("name"), F.sha2(content, 256).alias("actual"))
    status = F.when(F.col("actual").isNull(), "missing").when(F.col("actual") == F.col("digest"), "ok").otherwise("corrupt")
    return manifest.join(actual, "name", "left").select("name", status.alias("status"))


def verify_files(spark: SparkSession, folder: str, manifest_path: str) -> DataFrame:
    files = spark.read.format("binaryFile").load(folder).withColumn("name", F.regexp_extract("path", r"([^/]+)$", 1))
    return checksum_status(files, read_manifest(spark, manifest_path))


RESULT_PATH = r"/(?:model=)?([^/]+)/(?:dataset=)?([^/]+?)(?:\.csv)?$"


def read_results(spark: SparkSession, root: str, schema: T.StructType) -> DataFrame:
    """All tables `<model>/<dataset>.csv`, or `model=.../dataset=...` as Spark writes them, with model and dataset."""
    known = quoted.splits(spark, f"{root}/*/*")
    name = F.url_decode(table_name(F.col("path")))
    named = known.select("path").distinct().withColumns({"model": F.regexp_extract(name, RESULT_PATH, 1), "dataset": F.regexp_extract(name, RESULT_PATH, 2)})
    return with_names(read_tables(spark, f"{root}/*/*", schema, known), named).drop("path")


RUN_PATH = r"/([^/]+)/(run_[^/]+)/(?:(seed[^/]+|aggregate)/)?(.+)$"


def run_path(path: Column) -> Column:
    """Path of a run's file: a tree that Spark wrote has folders `exp=`, `run=`, `seed_dir=` and `file=` with part files in them."""
    whole = F.coalesce(F.try_url_decode(F.replace(path, F.lit("+"), F.lit("%2B"))), path)
    return F.regexp_replace(table_name(whole), "/(?:exp|run|seed_dir|file)=", "/")


def run_files(spark: SparkSession, root: str) -> DataFrame:
    """Files of a results tree `<exp>/run_*/[seed*/]...` with the parts of their path. No content is read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select(run_path(F.col("path")).alias("path"), "length")
    parts = {n: F.regexp_extract("path", RUN_PATH, i) for i, n in enumerate(("exp", "run", "seed_dir", "file"), 1)}
    named = files.withColumns(parts).filter("exp <> ''")
    return named.withColumns(
        {"config": base_config(F.col("exp")), "fold": fold_number(F.col("exp")), "seed": seed_number(F.col("seed_dir")), "started": run_time(F.col("run"))}
    )


def run_status(files: DataFrame, rows: DataFrame | None = None) -> DataFrame:
    """One line per run (and seed folder): does it hold all a finished run needs? `rows` gives metrics row counts."""
    has = lambda f: F.coalesce(F.bool_or((F.col("file") == f) & (F.col("length") > 0)), F.lit(False))
    keys = ["exp", "config", "fold", "run", "started", "seed_dir", "seed"]
    result = has(f"eval_results/{RUN_RESULTS[0]}")
    for f in RUN_RESULTS[1:]:
        result = result | has(f"eval_results/{f}")
    complete = has(RUN_FILES[0]) & has(RUN_FILES[1]) & result
    out = files.groupBy(*keys).agg(complete.alias("complete"))
    if rows is None:
        return out
    logged = rows.select("exp", "run", "seed_dir").distinct().withColumn("_rows", F.lit(True))
    return out.join(logged, ["exp", "run", "seed_dir"], "left").withColumn("complete", F.col("complete") & F.coalesce("_rows", F.lit(False))).drop("_rows")


def latest_runs(status: DataFrame) -> DataFrame:
    """The newest complete run per experiment, with all of its seed folders."""
    done = status.filter("complete")
    newest = done.groupBy("exp").agg(F.max_by("run", F.struct("started", "run")).alias("run"))
    return done.join(newest, ["exp", "run"], "left_semi")


def read_run_tables(spark: SparkSession, root: str, file: str, schema: T.StructType, runs: DataFrame | None = None) -> DataFrame:
    """One kind of CSV file of all runs as a table keyed by experiment, run and seed; of the given runs only, if any."""
    written = "file=" + file.replace("/", "%2F")
    rows = read_tables(spark, f"{root}/*/*run_*/*/{{{file},{written}}}", schema)
    parts = {n: F.regexp_extract(run_path(F.col("path")), RUN_PATH, i) for i, n in enumerate(("exp", "run", "seed_dir"), 1)}
    named = rows.withColumns(parts).drop("path")
    named = named.withColumns({"config": base_config(F.col("exp")), "fold": fold_number(F.col("exp")), "seed": seed_number(F.col("seed_dir"))})
    return named.join(runs.select("exp", "run", "seed_dir").distinct(), ["exp", "run", "seed_dir"], "left_semi") if runs is not None else named

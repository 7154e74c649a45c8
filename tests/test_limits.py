"""No caps: long headers, large lexicons, many hot keys; nulls in keys and flags; plurals by spelling."""

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ratescale.functions.text import BODY_NOUNS, Lexicon, noun_adjective_pairs, regular_plural
from ratescale.operators import extraction, sampling
from ratescale.operators.joins import align, pending
from ratescale.operators.scale import attach_group_stats
from ratescale.operators.splits import evaluation_rows
from ratescale.sources.tables import read_lexicon, read_lexicon_table, read_tables


def test_a_header_beyond_64_kib_and_a_quoted_comma(spark, tmp_path):
    names = [f"column_{i:06d}" for i in range(5000)]
    (tmp_path / "a.csv").write_text(",".join([*names, '"last, of all"']) + "\n" + ",".join(map(str, range(5001))) + "\n")
    got = read_tables(spark, str(tmp_path / "*.csv"), T.StructType([T.StructField("last, of all", T.LongType())]))
    row = got.select("column_000007", "column_004999", F.col("`last, of all`").alias("last")).first()
    assert tuple(row) == ("7", "4999", 5000)


def test_a_lexicon_of_30000_words(spark, tmp_path):
    (tmp_path / "words").write_text("\n".join(f"word{i}" for i in range(30_000)) + "\n\n")
    assert len(read_lexicon(spark, str(tmp_path / "words"))) == 30_000


def test_1500_hot_keys(spark):
    rows = spark.range(0, 30_000).select((F.col("id") % 1500).alias("key"), F.col("id").alias("x"))
    got = attach_group_stats(rows, ["key"], {"n": F.count("x"), "total": F.sum("x")}, hot_rows=1)
    want = rows.groupBy("key").agg(F.count("x").alias("n"), F.sum("x").alias("total"))
    assert got.count() == 30_000
    assert got.select("key", "n", "total").distinct().exceptAll(want).isEmpty()


@pytest.mark.parametrize("noun, plural", [("body", "bodies"), ("pelvis", "pelvises"), ("iris", "irises"), ("callus", "calluses"), ("arch", "arches"), ("eyelash", "eyelashes"), ("toe", "toes"), ("eyebrow", "eyebrows")])
def test_plurals(noun, plural):
    assert noun in BODY_NOUNS and regular_plural(noun) == plural


def test_body_nouns_count_in_their_listed_forms(spark):
    forms = {"eyes": "eye", "teeth": "tooth", "irises": "iris", "calves": "calf", "lips": "lips", "whiskers": "whiskers", "brow": "brow", "stance": "stance"}
    others = ["lip", "temple", "gum", "whisker", "faces", "bodies", "postures", "lipss"]
    df = spark.createDataFrame([(f"strong {w} stood", w) for w in [*forms, *others]], "text string, word string")
    got = {r["word"]: r["pairs"] for r in df.withColumn("pairs", noun_adjective_pairs(F.col("text"), Lexicon.of(["strong"]))).collect()}
    assert got == {**{w: [f"strong {n}"] for w, n in forms.items()}, **{w: [] for w in others}}


def test_a_lexicon_of_a_million_words(spark, tmp_path):
    """The words come by broadcast or by join; the plan does not hold them."""
    name = lambda i: "w" + "".join(chr(97 + i // 26**k % 26) for k in range(5)) + "x"
    (tmp_path / "words").write_text("\n".join(map(name, range(1_000_000))) + "\nstrong\n")
    words = read_lexicon_table(spark, str(tmp_path / "words"), "adjective").unionByName(spark.createDataFrame([("eyes", "noun", "eye"), ("eye", "noun", None)], "word string, kind string, form string"))
    docs = spark.createDataFrame([(1, f"Strong eyes. No words. {name(77).title()}, an eye and {name(999_999)}."), (2, "nothing here"), (3, None)], "doc_id int, text string")
    for most in (1 << 30, 0):
        found = extraction.document_sentences_by_table(docs, words, most=most)
        assert name(77) not in found._jdf.queryExecution().optimizedPlan().toString()
        rows = found.select("doc_id", F.explode("found").alias("s")).select("doc_id", "s.text_id", "s.sentence_idx", "s.pairs").orderBy("text_id").collect()
        assert [tuple(r) for r in rows] == [(1, 0, 0, ["strong eye"]), (1, 1, 2, sorted([f"{name(77)} eye", f"{name(999_999)} eye"]))]


def test_own_nouns_count_with_their_plurals(spark):
    lexicon = Lexicon.of(["strong"], ["arch", "tooth", "body"])
    df = spark.createDataFrame([("strong arches, teeth and bodies",)], "text string")
    assert df.select(noun_adjective_pairs(F.col("text"), lexicon)).first()[0] == ["strong arch", "strong body", "strong tooth"]


def test_signs_fill_a_window(spark):
    lexicon = Lexicon.of(["blue", "old"], ["eye"])
    texts = ["blue eye , , , , , , , old", "blue eye , , , , , old", "old, 1,000 (grey) eye", "naïve café über alles ça eye old"]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    got = [r[0] for r in df.select(noun_adjective_pairs(F.col("text"), lexicon)).collect()]
    assert got == [["blue eye"], ["blue eye", "old eye"], ["old eye"], ["old eye"]]


def test_null_keys_are_one_key(spark):
    left = spark.createDataFrame([(1, "a"), (None, "b"), (2, None)], "k long, v string")
    right = spark.createDataFrame([(None, "b"), (3, "c")], "k long, v string")
    assert {(r["k"], r["status"]) for r in align(left, right, ["k"]).collect()} == {(1, "missing"), (2, "missing"), (None, "ok"), (3, "extra")}
    assert {r["k"] for r in pending(left, right, key=["k"]).collect()} == {1, 2}


def test_rows_with_a_null_flag_are_sampled(spark):
    rows = spark.createDataFrame([(i, None if i % 2 else i % 4 == 0) for i in range(40)], "id long, flag boolean")
    assert sampling.balanced_sample(rows, "flag", 30, ["id"]).count() == 30
    assert sampling.balanced_sample(rows, "flag", 10, ["id"]).count() == 10


def test_a_stored_split_is_not_rebuilt(spark):
    rows = spark.createDataFrame([(i, f"a{i % 7}", "test" if i % 3 == 0 else "train") for i in range(60)], "id long, attribute string, split string")
    got = evaluation_rows(rows, 0.3)
    assert got.count() == 20 and "Window" not in got._jdf.queryExecution().executedPlan().toString()

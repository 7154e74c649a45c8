"""Literal cases of parsing, text, taxonomy and report expressions."""

import pytest
from pyspark.sql import functions as F

from ratescale.functions import parse, taxonomy, terms
from ratescale.functions import text as X
from ratescale.functions.novel_rules import NOVEL_RULES
from ratescale.operators.joins import match_prefix
from ratescale.operators.runs import t_quantile
from ratescale.sources import sinks

LEX = X.Lexicon.of(["dark", "bright", "angular", "blue", "dark-brown"])


def one(spark, value, expression, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(expression(F.col("v")).alias("r")).first()[0]


@pytest.mark.parametrize("text,want", [
    (" 4.5\nHow likely", 4), ("five", 5), ("the 5th", 5), ("no idea", None), ("9", None), ("rating: 3, perhaps two", 3),
    ("two or one", 1), ("7", 7), ("12", None), ("x4y", None), ("3/7", 7), ("", None), (None, None), ("SIX", 6),
])
def test_tolerant(spark, text, want):
    assert one(spark, text, parse.rating_tolerant) == want


@pytest.mark.parametrize("text,want", [("between 2 and 6", 2), ("8 of 10", None), ("5th", None), ("4.5", 4)])
def test_strict(spark, text, want):
    assert one(spark, text, parse.rating_strict) == want


@pytest.mark.parametrize("text,want", [
    ("I cannot determine", ["cannot_judge"]), ("regardless of gender", ["any_person_no_difference"]), ("it depends", []), (None, []),
    ("As an AI, I can't answer", ["cannot_judge", "refusal_or_policy"]), ("Off-topic: doesn't relate", ["unrelated_irrelevant"]),
])
def test_abstention(spark, text, want):
    assert one(spark, text, parse.abstention_categories) == want


def test_ranked_tokens_and_scores(spark):
    assert one(spark, '["a", " five", "3"]', lambda c: parse.rating_from_ranked(parse.tokens_from_json(c))) == 5
    rows = [(1, *[None] * 7), (2, 0.1, 0.9, 0.9, None, float("nan"), 0.2, 0.3)]
    df = spark.createDataFrame(rows, "i int, " + ", ".join(f"logit_{i} double" for i in range(1, 8)))
    assert [r[0] for r in df.orderBy("i").select(parse.rating_from_scores()).collect()] == [None, 2]


@pytest.mark.parametrize("value,want", [("-1", None), ("4", 4.0), ("x", None), ("NaN", None), (None, None), ("3.5", 3.5)])
def test_clean_rating(spark, value, want):
    assert one(spark, value, parse.clean_rating) == want


@pytest.mark.parametrize("term,want,index", [("Woman", "woman", 0), ("a man", "man", 1), ("nonbinary person", "nonbinary", 2), ("male", "man", None), ("child", "child", None)])
def test_terms(spark, term, want, index):
    assert one(spark, term, terms.normalize_term) == want
    if index is not None:
        assert one(spark, term, terms.term_index) == index


@pytest.mark.parametrize("name,closed,tuned,family,short", [
    ("gpt-4o", True, False, "gpt-4o", "gpt-4o"), ("gpt-oss-20b", False, True, "gpt-oss-20b", "gpt-oss-20b"),
    ("Meta-Llama-3-8B-Instruct", False, True, "Meta-Llama-3-8B", "Llama-3-8B-Inst"), ("OLMo-2-1124-7B-SFT", False, True, "OLMo-7B", "OLMo-2-7B-SFT"),
    ("llama3_8b_base", False, False, "llama3_8b", "llama3_8b_base"), ("gemini-3-flash-preview", True, False, "gemini-3-flash-preview", "gemini-3-flash"),
])
def test_taxonomy(spark, name, closed, tuned, family, short):
    r = spark.createDataFrame([(name,)], "m string").select(
        taxonomy.is_closed(F.col("m")), taxonomy.is_instruct(F.col("m")), taxonomy.family(F.col("m")), taxonomy.short_name(F.col("m"))
    ).first()
    assert tuple(r) == (closed, tuned, family, short)


@pytest.mark.parametrize("text,want", [("He took her hand", "evidence for both"), ("His eyes", "male"), ("she left", "female"), ("the hers", "unknown")])
def test_gender_evidence(spark, text, want):
    assert one(spark, text, X.gender_evidence) == want


@pytest.mark.parametrize("phrase,want", [
    ("his bright eyes", "bright eyes"), ("her angular face", "an angular face"), ("his dark hair", "a dark hair"), ("he him himself", ""), ("dark hair of his", "dark hair of"),
])
def test_possessives(spark, phrase, want):
    assert one(spark, phrase, lambda c: X.rewrite_possessives(c, LEX)) == want


@pytest.mark.parametrize("phrase,want", [
    ("a nose", "bare_noun"), ("hair", "bare_noun"), ("a fine figure of a man", "gender_term"), ("an upper lip", "no_noun"), ("a narrow jaw", None), ("something odd", "no_noun"), ("a shoulder blade", "bare_noun"),
])
def test_rejects(spark, phrase, want):
    got = one(spark, phrase, lambda c: X.reject_reason(c, X.Lexicon.of(["narrow"])))
    assert got == (want if phrase != "an upper lip" else "bare_noun")


@pytest.mark.parametrize("phrase,want", [("a dark face", True), ("dark-brown eyes", True), ("dark", False), ("very dark face", False), (None, False), ("face dark", False)])
def test_in_domain(spark, phrase, want):
    assert one(spark, phrase, lambda c: X.in_domain(c, LEX)) is want


def test_sentences_keep_abbreviations(spark):
    got = one(spark, 'Mr. Smith came. "Who?" He left! then i. Ok', X.sentences)
    assert got == ["Mr. Smith came.", '"Who?"', "He left! then i.", "Ok"]


def test_pairs_within_window(spark):
    far = "dark " + "x " * 6 + "face"
    assert one(spark, "Her dark-brown eyes and angular face", lambda c: X.noun_adjective_pairs(c, LEX)) == [
        "angular eye", "angular face", "darkbrown eye", "darkbrown face"]
    assert one(spark, far, lambda c: X.noun_adjective_pairs(c, LEX)) == []


def test_decode(spark):
    assert one(spark, bytearray("né\r\nle".encode("utf-8")), X.decode_text, "binary") == "né le"
    assert one(spark, bytearray("né\nle".encode("latin-1")), X.decode_text, "binary") == "né le"


def test_names(spark):
    assert one(spark, "cfg_a_fold2of5", terms.base_config) == "cfg_a" and one(spark, "cfg_a_fold2of5", terms.fold_number) == 2
    assert one(spark, "seed42", terms.seed_number) == 42 and one(spark, "run_20260326_000747", terms.run_time) is not None
    assert one(spark, "/x/105_persuasion.txt", lambda c: terms.numeric_prefix(terms.file_stem(c))) == "105"
    suffix = terms.hyperparameter_suffix({"learning_rate": F.lit(1e-4), "lora_r": F.lit(16), "batch_size": F.lit(8)})
    assert spark.range(1).select(suffix).first()[0] == "bs8_lr1e-4_r16"
    with pytest.raises(ValueError):
        terms.render_prompt("{person_term} {attribute}", F.lit("x"))


def test_novel_rules(spark):
    assert len(NOVEL_RULES) == 113
    df = spark.createDataFrame([("105_persuasion",), ("hp3_x",), ("zzz",)], "s string")
    got = match_prefix(df, F.col("s"), NOVEL_RULES).orderBy("s").select("source", "author_gender").collect()
    assert [tuple(r) for r in got] == [("persuasion", "female"), ("hp3", "female"), (None, None)]


@pytest.mark.parametrize("df,want", [(1, 12.7062), (4, 2.7764), (30, 2.0423), (40, 2.0211), (120, 1.9799), (10**6, 1.95997)])
def test_t_quantile(spark, df, want):
    assert abs(one(spark, df, t_quantile, "int") - want) < 2e-4


def test_report_strings(spark):
    r = spark.range(1).select(
        sinks.decimals(F.lit(0.12345)), sinks.decimals(F.lit(float("nan"))), sinks.percent(F.lit(0.256)), sinks.with_p(F.lit(0.5), F.lit(0.01)),
        sinks.with_interval(F.lit(0.5), F.lit(0.4), F.lit(0.6)), sinks.with_interval(F.lit(0.5), F.lit(None), F.lit(0.6)),
    ).first()
    assert tuple(r) == ("0.123", "/", "25.6%", "0.500(p=0.010)", "0.500 [0.400, 0.600]", "0.500 [—, —]")

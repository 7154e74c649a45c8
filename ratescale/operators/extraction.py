"""Descriptive phrases out of documents: sentences, lexicon filter, extractor, cleaning and rejects."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ratescale.functions import text as X
from ratescale.schemas import EXTRACTION
from ratescale.session import cut_lineage

Extractor = Callable[[pd.DataFrame], pd.Series]
ATTRIBUTES = EXTRACTION["physical_attributes"].dataType
LEXICON_BYTES = 64 << 20  # of a lexicon table that is sent to all tasks


def sentence_rows(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Sentences of whole documents with their number, chapter headers taken out."""
    clean = X.strip_chapter_headers(X.one_line(F.col(text)))
    return documents.select(key, F.posexplode(X.sentences(clean)).alias("sentence_idx", "text"))


def attribute_sentences(sentences: DataFrame, lexicon: X.Lexicon, window: int = 6) -> DataFrame:
    """Sentences with a body noun near a describing adjective, their pairs and the gender their pronouns tell."""
    found = sentences.withColumn("pairs", X.noun_adjective_pairs(F.col("text"), lexicon, window)).filter(F.size("pairs") > 0)
    return found.withColumn("intext_gender", X.gender_evidence(F.col("text")))


def document_sentences(documents: DataFrame, lexicon: X.Lexicon, key: str = "doc_id", text: str = "text", window: int = 6) -> DataFrame:
    """The same as one array `found` for each document, so that numbering its sentences needs no shuffle. `text_id` is a sentence's place in it."""
    clean = X.strip_chapter_headers(X.one_line(F.col(text)))
    whole = F.transform(X.sentences(clean), lambda s, i: F.struct(i.alias("sentence_idx"), s.alias("text"), X.noun_adjective_pairs(s, lexicon, window).alias("pairs")))
    kept = F.transform(
        F.filter(whole, lambda s: F.size(s["pairs"]) > 0),
        lambda s, i: F.struct(i.alias("text_id"), s["sentence_idx"].alias("sentence_idx"), s["text"].alias("text"), s["pairs"].alias("pairs"), X.gender_evidence(s["text"]).alias("intext_gender")),
    )
    return documents.select(key, kept.alias("found")).filter(F.size("found") > 0)


def document_sentences_by_table(
    documents: DataFrame, words: DataFrame, key: str = "doc_id", text: str = "text", window: int = 6, most: int = LEXICON_BYTES,
) -> DataFrame:
    """`document_sentences` with a lexicon table (word, kind, form) of any size: kind is `noun` or `adjective`, form what a match is called.

    A table of up to `most` bytes is sent to all tasks, where Arrow looks up the words of a batch at once; the plan holds no word. A
    larger one is joined with the words of the sentences. `key` has to be unique.
    """
    clean = X.strip_chapter_headers(X.one_line(F.col(text)))
    sentences = documents.select(key, X.sentences(clean).alias("sentences"))
    listed = words.select(X.normalize_word(F.col("word")).alias("word"), "kind", F.coalesce("form", "word").alias("form")).distinct()
    listed = cut_lineage(listed.groupBy("word").agg(*[F.min(F.when(F.col("kind") == kind, F.col("form"))).alias(kind) for kind in ("noun", "adjective")]))
    size = listed.agg(F.sum(F.octet_length(F.concat_ws("", "word", "noun", "adjective")) + 32)).first()[0] or 0
    found = _pairs_by_broadcast(sentences, listed, window) if size <= most else _pairs_by_join(sentences, listed, key, window)
    whole = F.transform("sentences", lambda s, i: F.struct(i.alias("sentence_idx"), s.alias("text"), F.get("pairs", i).alias("pairs")))
    kept = F.transform(
        F.filter(whole, lambda s: F.size(s["pairs"]) > 0),
        lambda s, i: F.struct(i.alias("text_id"), s["sentence_idx"].alias("sentence_idx"), s["text"].alias("text"), s["pairs"].alias("pairs"), X.gender_evidence(s["text"]).alias("intext_gender")),
    )
    return found.select(key, kept.alias("found")).filter(F.size("found") > 0)


def _pairs_by_broadcast(sentences: DataFrame, listed: DataFrame, window: int) -> DataFrame:
    """Adds `pairs`: the pairs of each sentence."""
    sent = sentences.sparkSession.sparkContext.broadcast(listed.toArrow().combine_chunks())
    rows = sentences.withColumn("_tokens", F.transform("sentences", X.tokens))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = sent.value
        nouns, adjectives = table.column("noun").to_pylist(), table.column("adjective").to_pylist()
        value_set = table.column("word").chunk(0) if table.num_rows else pa.array([], pa.string())
        for batch in batches:
            per_sentence = batch.column("_tokens").flatten()
            number = pc.index_in(per_sentence.flatten(), value_set=value_set).to_pylist()
            ends = per_sentence.value_lengths().fill_null(0).to_numpy().cumsum().tolist()
            pairs, start = [], 0
            for end in ends:
                known = [(i, n) for i, n in enumerate(number[start:end]) if n is not None]
                near = {
                    f"{adjectives[b]} {nouns[a]}" for i, a in known if nouns[a] is not None for j, b in known
                    if abs(i - j) <= window and adjectives[b] is not None
                }
                pairs.append(sorted(near))
                start = end
            sizes = batch.column("_tokens").value_lengths().fill_null(0).to_numpy().cumsum()
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], sizes)), pa.int32()), pa.array(pairs, pa.list_(pa.string())))
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], lists], names=[*batch.schema.names[:2], "pairs"])

    schema = T.StructType([*sentences.schema.fields, T.StructField("pairs", T.ArrayType(T.ArrayType(T.StringType())))])
    return rows.mapInArrow(run, schema)


def _pairs_by_join(sentences: DataFrame, listed: DataFrame, key: str, window: int) -> DataFrame:
    """The same by a join of the sentences' words with the lexicon."""
    words = sentences.select(key, F.posexplode("sentences").alias("_i", "_text")).select(key, "_i", F.posexplode(X.tokens(F.col("_text"))).alias("_pos", "word"))
    known = words.join(listed, "word").groupBy(key, "_i").agg(F.collect_list(F.struct("_pos", "noun", "adjective")).alias("_k"))
    near = F.flatten(F.transform(
        F.filter("_k", lambda n: n["noun"].isNotNull()),
        lambda n: F.transform(
            F.filter("_k", lambda a: a["adjective"].isNotNull() & (F.abs(a["_pos"] - n["_pos"]) <= window)), lambda a: F.concat(a["adjective"], F.lit(" "), n["noun"])
        ),
    ))
    one = known.select(key, "_i", F.array_sort(F.array_distinct(near)).alias("_pairs")).filter(F.size("_pairs") > 0)
    by_key = one.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("_i", "_pairs"))).alias("_of"))
    pairs = F.transform("sentences", lambda s, i: F.coalesce(F.get(F.array(F.col("_of")[i]), F.lit(0)), F.array().cast("array<string>")))
    return sentences.join(by_key, key, "left").withColumn("pairs", pairs).drop("_of")


def extract_lexical(documents: DataFrame) -> DataFrame:
    """Extractor without a model: the lexicon pairs with the sentence's gender."""

    def answered(s: Column) -> Column:
        item = lambda p: F.struct(p.alias("attribute"), s["intext_gender"].alias("gender"), F.lit("lexicon").alias("reasoning"))
        attributes = F.transform(s["pairs"], item)
        return s.withField("attributes", attributes).withField("llm_response", F.to_json(attributes)).withField("error", F.lit(None).cast("string"))

    return documents.withColumn("found", F.transform("found", answered))


def extract_batches(documents: DataFrame, extractor: Extractor, tasks: int | None = None) -> DataFrame:
    """Extractor plug-in on the sentences of a batch of documents: returns JSON lists; a failing sentence gets an error and no attributes.

    `tasks` sets how many tasks call the extractor.
    """
    if tasks:
        documents = documents.repartition(tasks)
    answers = T.ArrayType(T.StructType([T.StructField("llm_response", T.StringType()), T.StructField("error", T.StringType())]))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            sentences = pd.DataFrame([dict(s, **{key: value}) for value, found in zip(batch[key], batch["found"]) for s in found])
            responses, errors = _responses(sentences, extractor) if len(sentences) else ([], [])
            answered = iter([{"llm_response": r, "error": e} for r, e in zip(responses, errors)])
            yield batch.assign(answers=[[next(answered) for _ in found] for found in batch["found"]])

    key = documents.columns[0]
    joined = lambda s, a: s.withField("attributes", F.coalesce(F.from_json(a["llm_response"], ATTRIBUTES), F.array().cast(ATTRIBUTES))).withField(
        "llm_response", a["llm_response"]).withField("error", a["error"])
    rows = documents.mapInPandas(run, T.StructType([*documents.schema.fields, T.StructField("answers", answers)]))
    return rows.select(key, F.zip_with("found", "answers", joined).alias("found"))


def _responses(sentences: pd.DataFrame, extractor: Extractor) -> tuple[list[str | None], list[str | None]]:
    """Answers and errors of all sentences; one by one where the batch as a whole fails."""
    try:
        return list(extractor(sentences)), [None] * len(sentences)
    except Exception:  # noqa: BLE001 - isolated per row below
        pass
    out, errors = [], []
    for i in range(len(sentences)):
        try:
            out.append(extractor(sentences.iloc[i : i + 1]).iloc[0])
            errors.append(None)
        except Exception as e:  # noqa: BLE001
            out.append(None)
            errors.append(f"{type(e).__name__}: {e}")
    return out, errors


def expand_attributes(extracted: DataFrame, lexicon: X.Lexicon, key: str = "doc_id") -> DataFrame:
    """One row per extracted attribute; sentences without one keep a row.

    `text_id` numbers the sentences of a document, `attribute_text_id` only those with attributes; both count
    from 0 and advance once per sentence. They are places in the document's arrays, so no window and no shuffle is needed.
    """
    of = lambda has: F.filter("found", lambda s: (F.size(s["attributes"]) > 0) == F.lit(has))
    numbered = F.concat(
        F.transform(of(True), lambda s, i: s.withField("attribute_text_id", i.cast("int"))),
        F.transform(of(False), lambda s: s.withField("attribute_text_id", F.lit(None).cast("int"))),
    )
    rows = extracted.select(key, F.explode(numbered).alias("s")).select(key, "s.*").withColumn("a", F.explode_outer("attributes"))
    return rows.select(
        key, "text_id", "attribute_text_id", "text", F.col("a.attribute").alias("attribute"), "intext_gender",
        F.col("a.gender").alias("llm_gender"), F.col("a.reasoning").alias("llm_reasoning"),
        X.genders_match(F.col("intext_gender"), F.col("a.gender")).alias("gender_match"),
        X.in_domain(F.col("a.attribute"), lexicon).alias("indomain_strct"), "llm_response",
    )


def postprocess(expanded: DataFrame, lexicon: X.Lexicon) -> tuple[DataFrame, DataFrame]:
    """Rewritten phrases that are kept, and the rejected ones with their reason. Rows without phrase are kept."""
    rewritten = X.rewrite_possessives(F.col("attribute"), lexicon)
    marked = expanded.withColumn("attribute_original", F.col("attribute")).withColumn("attribute_normalized", rewritten).withColumn(
        "attribute", F.col("attribute_normalized")
    )
    marked = marked.withColumn("reject_reason", F.when(F.col("attribute").isNotNull(), X.reject_reason(F.col("attribute"), lexicon)))
    return marked.filter("reject_reason is null").drop("reject_reason"), marked.filter("reject_reason is not null")


def skipped_sentences(extracted: DataFrame, key: str = "doc_id") -> DataFrame:
    failed = F.filter("found", lambda s: s["error"].isNotNull())
    return extracted.select(key, F.explode(failed).alias("s")).select(key, "s.sentence_idx", "s.text", "s.error")


def extract_phrases(documents: DataFrame, lexicon: X.Lexicon, extractor: Extractor | None = None, key: str = "doc_id", tasks: int | None = None) -> dict[str, DataFrame]:
    """The whole job: kept phrases, rejected phrases and skipped sentences.

    The lexicon filter runs before the extractor, which may be costly; its answers are written to the
    checkpoint folder once, since all three results read them and a lost executor must not ask again.
    """
    found = document_sentences(documents, lexicon, key)
    extracted = cut_lineage(extract_batches(found, extractor, tasks)) if extractor else extract_lexical(found)
    kept, rejected = postprocess(expand_attributes(extracted, lexicon, key), lexicon)
    return {"phrases": kept, "rejected": rejected, "skipped": skipped_sentences(extracted, key)}

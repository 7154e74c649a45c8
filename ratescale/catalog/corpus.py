"""Text work over documents and phrase statistics over the phrases view."""

from pyspark.sql import functions as F

from ratescale.catalog.registry import query
from ratescale.functions import text as X
from ratescale.operators import extraction, novels

# The documents are invented prose, so the lexicon is made of words that occur in them.
NOUNS = ("nose", "eye", "stor", "tion", "ringe", "shand", "erine", "thand", "onin", "heth")
ADJECTIVES = ("erin", "an", "in", "heer", "haan", "there", "with", "er-he", "anor")
LEXICON = X.Lexicon.of(ADJECTIVES, NOUNS, ())
TOOLS = X.Lexicon.of(("blue", "cold", "hot", "large", "old", "red", "small", "new"), ("anvil", "bolt", "gear", "gizmo", "plate", "ring", "rod"), ("tool box",))

TEXT = r"regexp_replace(replace(replace(text, chr(13) || chr(10), ' '), chr(10), ' '), 'CHAPTER\s+[A-Z]+\s+[A-Z ]+', ' ', 'g')"
GUARDED = rf"regexp_replace({TEXT}, '\b(Mr|Mrs|Ms|Dr|St|Prof|Rev|Capt|Col|Gen|Lt|Sr|Jr|vs|etc)\.', '\1' || chr(2), 'g')"
MARKED = rf"""regexp_replace({GUARDED}, '([.!?]["'')\]]*)\s+(["''(\[]*[A-Z])', '\1' || chr(1) || '\2', 'g')"""
SENT = f"""sp AS (SELECT doc_id, string_split({MARKED}, chr(1)) AS parts FROM documents),
 sl AS (SELECT doc_id, list_filter(list_transform(parts, lambda x: trim(replace(x, chr(2), '.'))), lambda x: x <> '') AS ss FROM sp),
 sent AS (SELECT doc_id, unnest(range(0, len(ss))) AS sentence_idx, unnest(ss) AS text FROM sl)"""


@query("t1_chapter_headers", "", rf"""SELECT doc_id, md5({TEXT}) AS digest, length({TEXT}) AS n FROM (SELECT doc_id, 'CHAPTER ONE  THE START ' || text || ' CHAPTER II AND ON.' AS text FROM documents) d""", ints="doc_id n")
def _(t):
    body = X.strip_chapter_headers(X.one_line(F.concat(F.lit("CHAPTER ONE  THE START "), F.col("text"), F.lit(" CHAPTER II AND ON."))))
    return t.documents.select("doc_id", F.md5(body).alias("digest"), F.length(body).alias("n"))


@query("t2_sentences", "", f"WITH {SENT} SELECT doc_id, sentence_idx, md5(text) AS digest FROM sent", ints="doc_id sentence_idx")
def _(t):
    return extraction.sentence_rows(t.documents).select("doc_id", "sentence_idx", F.md5("text").alias("digest"))


ALL_NOUNS = (
    "nose", "eye", "stor", "tion", "ringe", "shand", "erine", "thand", "onin", "heth",
    "noses", "eyes", "stors", "tions", "ringes", "shands", "erines", "thands", "onins", "heths",
)
SINGULAR = "CASE WHEN right(word, 1) = 's' THEN substr(word, 1, length(word) - 1) ELSE word END"
ALL_ADJECTIVES = ("erin", "an", "in", "heer", "haan", "there", "with", "erhe", "anor")
PAIRS = rf"""{SENT}, wl AS (SELECT doc_id, sentence_idx, text, list_transform(regexp_extract_all(text, '\p{{L}}+(?:[''-]\p{{L}}+)*|[0-9]+(?:[.,][0-9]+)*|[^ \t\n\x0B\f\r\p{{L}}0-9]'), lambda w: replace(lower(w), '-', '')) AS ws FROM sent),
 w AS (SELECT doc_id, sentence_idx, unnest(range(0, len(ws))) AS pos, unnest(ws) AS word FROM wl),
 nn AS (SELECT doc_id, sentence_idx, pos, {SINGULAR} AS noun FROM w WHERE word IN ({', '.join(repr(n) for n in ALL_NOUNS)})),
 aa AS (SELECT * FROM w WHERE word IN ({', '.join(repr(a) for a in ALL_ADJECTIVES)})),
 pr AS (SELECT DISTINCT doc_id, sentence_idx, aa.word || ' ' || noun AS pair FROM nn JOIN aa USING (doc_id, sentence_idx) WHERE abs(nn.pos - aa.pos) <= 6)"""


def found(t):
    return extraction.attribute_sentences(extraction.sentence_rows(t.documents), LEXICON)


@query("t4_attribute_pairs", "", f"WITH {PAIRS} SELECT * FROM pr", ints="doc_id sentence_idx")
def _(t):
    return found(t).select("doc_id", "sentence_idx", F.explode("pairs").alias("pair"))


# a lexicon that grows with the documents: their words in -er and -ed
BY_TABLE = PAIRS[:PAIRS.index(" nn AS")] + """ nn AS (SELECT doc_id, sentence_idx, pos, upper(word) AS noun FROM w WHERE word LIKE '%er' AND length(word) > 4),
 aa AS (SELECT * FROM w WHERE word LIKE '%ed' AND length(word) > 3), pr AS (SELECT DISTINCT doc_id, sentence_idx, aa.word || ' ' || noun AS pair FROM nn JOIN aa USING (doc_id, sentence_idx) WHERE abs(nn.pos - aa.pos) <= 6)"""


def lexicon_table(t):
    words = extraction.sentence_rows(t.documents).select(F.explode(X.tokens(F.col("text"))).alias("word")).distinct()
    nouns = words.filter("word LIKE '%er' AND length(word) > 4").select("word", F.lit("noun").alias("kind"), F.upper("word").alias("form"))
    adjectives = words.filter("word LIKE '%ed' AND length(word) > 3").select("word", F.lit("adjective").alias("kind"), F.lit(None).cast("string").alias("form"))
    return nouns.unionByName(adjectives)


@query("t4_pairs_by_table", "", f"WITH {BY_TABLE} SELECT * FROM pr", ints="doc_id sentence_idx")
def _(t):
    found = extraction.document_sentences_by_table(t.documents, lexicon_table(t))
    return found.select("doc_id", F.explode("found").alias("s")).select("doc_id", "s.sentence_idx", F.explode("s.pairs").alias("pair"))


@query("t4_pairs_by_join", "", f"WITH {BY_TABLE} SELECT * FROM pr", ints="doc_id sentence_idx")
def _(t):
    found = extraction.document_sentences_by_table(t.documents, lexicon_table(t), most=0)
    return found.select("doc_id", F.explode("found").alias("s")).select("doc_id", "s.sentence_idx", F.explode("s.pairs").alias("pair"))


GENDER = r"CASE WHEN regexp_matches(text, '(?i)\b(he|his|him)\b') AND regexp_matches(text, '(?i)\b(she|her)\b') THEN 'evidence for both' WHEN regexp_matches(text, '(?i)\b(he|his|him)\b') THEN 'male' WHEN regexp_matches(text, '(?i)\b(she|her)\b') THEN 'female' ELSE 'unknown' END"


@query("t5_gender_evidence", "", f"WITH {SENT} SELECT {GENDER} AS gender, count(*) AS n FROM sent GROUP BY 1", ints="n")
def _(t):
    return extraction.sentence_rows(t.documents).groupBy(X.gender_evidence(F.col("text")).alias("gender")).agg(F.count(F.lit(1)).alias("n"))


NORM = "CASE lower(trim({c})) WHEN 'male' THEN 'male' WHEN 'female' THEN 'female' WHEN 'evidence for both' THEN 'non-binary' WHEN 'unknown' THEN 'unknown' ELSE lower(trim({c})) END"


@query("t6_gender_match", "phrases", f"SELECT source_novel, {NORM.format(c='intext_gender')} AS intext, {NORM.format(c='llm_gender')} AS llm, {NORM.format(c='intext_gender')} = {NORM.format(c='llm_gender')} AS same, count(*) AS n FROM phrases GROUP BY ALL", ints="n")
def _(t):
    i, m = F.upper("intext_gender"), F.concat(F.lit(" "), F.col("llm_gender"))
    return t.phrases.groupBy("source_novel", X.normalize_gender(i).alias("intext"), X.normalize_gender(m).alias("llm"), X.genders_match(i, m).alias("same")).agg(F.count(F.lit(1)).alias("n"))


SHAPED = "CASE p_partkey % 4 WHEN 0 THEN 'A ' || p_name WHEN 1 THEN p_name WHEN 2 THEN p_name || 's' ELSE 'an old ' || p_name END"
TOOL_NOUNS = "'anvil','bolt','gear','gizmo','plate','ring','rod'"
TOOL_PLURALS = "'anvils','bolts','gears','gizmos','plates','rings','rods'"


@query("t7_in_domain", "", f"""SELECT p_partkey, p_partkey % 4 <> 3 AND regexp_extract(p_name, '[a-z]+$') IN ({TOOL_NOUNS}) AS in_domain FROM part""", ints="p_partkey")
def _(t):
    return t.part.select("p_partkey", X.in_domain(F.expr(SHAPED), TOOLS).alias("in_domain"))


POSSESSED = "CASE p_partkey % 5 WHEN 0 THEN 'his ' || p_name WHEN 1 THEN 'Her ' || p_name || 's' WHEN 2 THEN 'she her ' || p_name WHEN 3 THEN p_name || ' himself' ELSE 'his anvil, her rods' END"


@query("t8_possessives", "", """SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN article || p_name WHEN 1 THEN CASE WHEN p_name LIKE '%widget' THEN article ELSE '' END || p_name || 's' WHEN 2 THEN article || p_name WHEN 3 THEN p_name ELSE 'an anvil , rods' END AS phrase
FROM (SELECT *, CASE WHEN substr(p_name, 1, 1) IN ('a','e','i','o','u') THEN 'an ' ELSE 'a ' END AS article FROM part) p""", ints="p_partkey")
def _(t):
    return t.part.select("p_partkey", X.rewrite_possessives(F.expr(POSSESSED), TOOLS).alias("phrase"))


RAW = "CASE p_partkey % 6 WHEN 0 THEN p_name WHEN 1 THEN 'a ' || regexp_extract(p_name, '[a-z]+$') WHEN 2 THEN regexp_extract(p_name, '[a-z]+$') WHEN 3 THEN p_name || ' of a Man' WHEN 4 THEN 'a tool box' ELSE 'something ' || p_size END"
RAW_SPARK = RAW.replace("'[a-z]+$')", "'[a-z]+$', 0)").replace("p_size", "CAST(p_size AS STRING)")
REASON = f"""CASE WHEN NOT regexp_matches(phrase, '\\b(anvil|bolt|gear|gizmo|plate|ring|rod)\\b') THEN 'no_noun' WHEN NOT regexp_matches(phrase, '\\s') THEN 'bare_noun'
 WHEN regexp_extract(phrase, '^(?:a|an)\\s+(.+)$', 1) IN ({TOOL_NOUNS}, 'tool box') THEN 'bare_noun' WHEN regexp_matches(phrase, '(?i)\\b(his|her|he|she|him|hers|herself|himself|man|woman|boy|girl|male|female|guy|gal|dude|lady|gentleman)\\b') THEN 'gender_term' END"""


@query("t9_reject_reasons", "", f"SELECT phrase, {REASON} AS reject_reason, count(*) AS n FROM (SELECT {RAW} AS phrase FROM part) p GROUP BY ALL", ints="n")
def _(t):
    p = t.part.select(F.expr(RAW_SPARK).alias("phrase"))
    return p.groupBy("phrase", X.reject_reason(F.col("phrase"), TOOLS).alias("reject_reason")).agg(F.count(F.lit(1)).alias("n"))


@query("w5_sentence_ids", "", f"""WITH {PAIRS}, fs AS (SELECT DISTINCT doc_id, sentence_idx FROM pr) SELECT pr.doc_id, dense_rank() OVER (PARTITION BY pr.doc_id ORDER BY pr.sentence_idx) - 1 AS text_id,
 dense_rank() OVER (PARTITION BY pr.doc_id ORDER BY pr.sentence_idx) - 1 AS attribute_text_id, pair AS attribute FROM pr""", ints="doc_id text_id attribute_text_id")
def _(t):
    rows = extraction.expand_attributes(extraction.extract_lexical(extraction.document_sentences(t.documents, LEXICON)), LEXICON)
    return rows.select("doc_id", "text_id", "attribute_text_id", "attribute")


@query("r4_exploded_attributes", "", f"""WITH {PAIRS}, one AS (SELECT doc_id, sentence_idx, list_sort(list(pair)) AS l FROM pr GROUP BY 1, 2),
 ids AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY sentence_idx) - 1 AS text_id, sum(CASE WHEN len(l) > 1 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY sentence_idx) - 1 AS aid FROM one)
SELECT doc_id, text_id, CASE WHEN len(l) > 1 THEN aid END AS attribute_text_id, unnest(CASE WHEN len(l) > 1 THEN l ELSE [NULL] END) AS attribute FROM ids""", ints="doc_id text_id attribute_text_id")
def _(t):
    # an extractor that finds nothing in sentences with a single pair
    ex = extraction.extract_lexical(extraction.document_sentences(t.documents, LEXICON))
    some = ex.withColumn("found", F.transform("found", lambda s: s.withField("attributes", F.filter(s["attributes"], lambda a: F.size(s["pairs"]) > 1))))
    return extraction.expand_attributes(some, LEXICON).select("doc_id", "text_id", "attribute_text_id", "attribute")


def stubborn(batch):
    """An extractor plug-in that cannot do some sentences and finds nothing in the others."""
    if batch["text"].str.contains("tion").any():
        raise ValueError("no answer")
    return batch["text"].map(lambda _: "[]")


@query("s12_skipped_sentences", "", f"WITH {PAIRS} SELECT DISTINCT sent.doc_id, sent.sentence_idx, md5(sent.text) AS digest, 'ValueError: no answer' AS error FROM sent JOIN pr USING (doc_id, sentence_idx) WHERE sent.text LIKE '%tion%'", ints="doc_id sentence_idx")
def _(t):
    out = extraction.extract_phrases(t.documents, LEXICON, stubborn)["skipped"]
    return out.select("doc_id", "sentence_idx", F.md5("text").alias("digest"), "error")


GTERM = r"regexp_matches(pair, '(?i)\b(his|her|he|she|him|hers|herself|himself|man|woman|boy|girl|male|female|guy|gal|dude|lady|gentleman)\b')"


@query("h5_extraction_job", "", f"WITH {PAIRS} SELECT pr.doc_id, pair AS attribute, {GENDER.replace('text', 'sent.text')} AS intext_gender, count(*) AS n FROM pr JOIN sent USING (doc_id, sentence_idx) WHERE NOT {GTERM} AND pair NOT LIKE 'an %' GROUP BY ALL", ints="doc_id n")
def _(t):
    out = extraction.extract_phrases(t.documents, LEXICON)["phrases"]
    return out.filter("attribute is not null").groupBy("doc_id", "attribute", "intext_gender").agg(F.count(F.lit(1)).alias("n"))


@query("s11_rejected_phrases", "", f"WITH {PAIRS} SELECT pr.doc_id, pair AS attribute_original, count(*) AS n FROM pr WHERE {GTERM} OR pair LIKE 'an %' GROUP BY ALL", ints="doc_id n")
def _(t):
    out = extraction.extract_phrases(t.documents, LEXICON)["rejected"]
    return out.groupBy("doc_id", "attribute_original").agg(F.count(F.lit(1)).alias("n"))


@query("t3_lexicon_words", "", f"""WITH {PAIRS} SELECT word, count(*) AS n, word IN ({', '.join(repr(n) for n in ALL_NOUNS)}) AS is_noun FROM w WHERE word IN ({', '.join(repr(n) for n in [*ALL_NOUNS, *ALL_ADJECTIVES])}) GROUP BY 1""", ints="n")
def _(t):
    w = extraction.sentence_rows(t.documents).select(F.explode(X.tokens(F.col("text"))).alias("word"))
    kept = w.filter(LEXICON.is_noun(F.col("word")) | LEXICON.is_adjective(F.col("word")))
    return kept.groupBy("word").agg(F.count(F.lit(1)).alias("n")).withColumn("is_noun", LEXICON.is_noun(F.col("word")))


HAVE = "h AS (SELECT * FROM phrases WHERE attribute IS NOT NULL)"


@query("a44_gender_distribution", "phrases", f"""WITH {HAVE}, l AS (SELECT source_novel, 'intext_gender' AS label_source, intext_gender AS label FROM h UNION ALL SELECT source_novel, 'llm_gender', llm_gender FROM h)
SELECT source_novel, label_source, label, count(*) AS n, count(*) * 100.0::DOUBLE / (sum(count(*)) OVER (PARTITION BY source_novel, label_source)) AS pct FROM l GROUP BY 1, 2, 3""", num="pct", ints="n")
def _(t):
    return novels.gender_distribution(t.phrases)


@query("a44_gender_match_rate", "phrases", f"""WITH {HAVE}, m AS (SELECT source_novel, {NORM.format(c='intext_gender')} = {NORM.format(c='llm_gender')} AS same FROM h)
SELECT source_novel, count_if(same) AS n_match, count(*) AS n, count_if(same) * 100.0::DOUBLE / count(*) AS pct_match FROM m GROUP BY 1""", num="pct_match", ints="n_match n")
def _(t):
    return novels.gender_match_rate(t.phrases)


FREQ = "fr AS (SELECT source_novel, attribute, count(*) AS n, count(*) * 100.0::DOUBLE / sum(count(*)) OVER (PARTITION BY source_novel) AS pct FROM phrases WHERE attribute IS NOT NULL GROUP BY 1, 2)"


@query("a45_attribute_frequency", "phrases", f"WITH {FREQ} SELECT * FROM fr", num="pct", ints="n")
def _(t):
    return novels.attribute_frequency(t.phrases)


@query("k1_top_attributes", "phrases", f"WITH {FREQ}, r AS (SELECT *, row_number() OVER (PARTITION BY source_novel ORDER BY n DESC, attribute) AS rank FROM fr) SELECT * FROM r WHERE rank <= 10", num="pct", ints="n rank")
def _(t):
    return novels.top_attributes(t.phrases)


FEATURES = """count(DISTINCT text_id) AS total_sentences, count(DISTINCT CASE WHEN attribute IS NOT NULL THEN text_id END) AS sentences_with,
 count(DISTINCT text_id) - count(DISTINCT CASE WHEN attribute IS NOT NULL THEN text_id END) AS sentences_without,
 count(DISTINCT CASE WHEN attribute IS NOT NULL THEN text_id END) * 100.0::DOUBLE / count(DISTINCT text_id) AS pct_with, count(attribute) AS total_attributes, count(DISTINCT attribute) AS unique_attributes,
 count(attribute) / count(DISTINCT CASE WHEN attribute IS NOT NULL THEN text_id END)::DOUBLE AS per_sentence, count_if(attribute IS NOT NULL AND indomain_strct) AS indomain,
 count_if(attribute IS NOT NULL AND NOT indomain_strct) AS outdomain, count_if(attribute IS NOT NULL AND indomain_strct) * 100.0::DOUBLE / count(attribute) AS pct_indomain"""
F_NUM, F_INT = "pct_with per_sentence pct_indomain", "total_sentences sentences_with sentences_without total_attributes unique_attributes indomain outdomain"
LABELS = ", ".join([f"count_if(attribute IS NOT NULL AND llm_gender = '{g}') AS llm_{g.replace('-', '_')}" for g in novels.LLM_GENDERS] + [
    f"count_if(attribute IS NOT NULL AND intext_gender = '{g}') AS intext_{g.replace(' ', '_')}" for g in novels.INTEXT_GENDERS])
L_INT = " ".join([f"llm_{g.replace('-', '_')}" for g in novels.LLM_GENDERS] + [f"intext_{g.replace(' ', '_')}" for g in novels.INTEXT_GENDERS])


@query("a46_novel_features", "phrases", f"SELECT source_novel, {FEATURES} FROM phrases GROUP BY 1", num=F_NUM, ints=F_INT)
def _(t):
    return novels.novel_features(t.phrases)


@query("a47_attributes_by_gender", "phrases", f"""WITH {HAVE}, l AS (SELECT source_novel, attribute, 'intext_gender' AS label_source, intext_gender AS label FROM h UNION ALL SELECT source_novel, attribute, 'llm_gender', llm_gender FROM h)
SELECT source_novel, label_source, label, count(*) AS total, count(DISTINCT attribute) AS n_unique FROM l GROUP BY 1, 2, 3""", ints="total n_unique")
def _(t):
    return novels.attributes_by_gender(t.phrases)


@query("a48_wide_statistics", "phrases", f"SELECT source_novel, {FEATURES}, {LABELS} FROM phrases GROUP BY 1", num=F_NUM, ints=f"{F_INT} {L_INT}")
def _(t):
    return novels.wide_statistics(t.phrases)


@query("a49_corpus_summary", "phrases", f"""WITH p AS (SELECT source_novel, {FEATURES}, {LABELS} FROM phrases GROUP BY 1), m AS (SELECT count_if({NORM.format(c='intext_gender')} = {NORM.format(c='llm_gender')}) AS tm, count(*) AS tc FROM phrases WHERE attribute IS NOT NULL)
SELECT count(*) AS total_novels, sum(total_sentences) AS total_sentences, sum(sentences_with) AS sentences_with, sum(total_attributes) AS total_attributes, sum(indomain) AS indomain, sum(outdomain) AS outdomain,
 {', '.join(f'sum({c}) AS {c}' for c in L_INT.split())}, avg(total_sentences) AS avg_sentences, avg(total_attributes) AS avg_attributes, sum(indomain) * 100.0::DOUBLE / sum(total_attributes) AS pct_indomain,
 (SELECT count(DISTINCT attribute) FROM phrases) AS unique_attributes, (SELECT tm FROM m) AS total_matches, (SELECT tc FROM m) AS total_comparisons, (SELECT tm * 100.0::DOUBLE / tc FROM m) AS pct_match FROM p""",
       num="avg_sentences avg_attributes pct_indomain pct_match", ints=f"total_novels total_sentences sentences_with total_attributes indomain outdomain {L_INT} unique_attributes total_matches total_comparisons")
def _(t):
    return novels.corpus_summary(t.phrases)


@query("j5_merged_phrases", "phrases", """SELECT attribute, person_term, CASE WHEN text_id % 2 = 0 THEN 'persuasion' ELSE 'emma' END AS source, CASE WHEN text_id % 2 = 0 THEN '105' ELSE '158' END AS gutenberg_id, count(*) AS n
FROM phrases, (VALUES ('man'), ('woman'), ('nonbinary person')) v(person_term) WHERE attribute IS NOT NULL GROUP BY ALL""", ints="n")
def _(t):
    path = F.when(F.col("text_id") % 2 == 0, "/in/105_persuasion_physattr.csv").otherwise("/in/158_emma_physattr.csv")
    p = t.phrases.withColumn("path", path).withColumn("attribute_normalized", F.col("attribute"))
    rules = [("105_", "persuasion", "female"), ("158_", "emma", "female")]
    return novels.merge_extracted(p, rules).groupBy("attribute", "person_term", "source", "gutenberg_id").agg(F.count(F.lit(1)).alias("n"))

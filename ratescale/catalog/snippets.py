"""SQL pieces that several twins share."""

# Fixed values, stated anew: number words and the phrases of the abstention families.
RATING_WORDS = ("one", "two", "three", "four", "five", "six", "seven")
ABSTENTION_FAMILIES = {
    "cannot_judge": "cannot|can not|can't|cant|unable to|cannot determine|can't determine|cannot say|can't say|cannot answer|can't answer|"
    "no way to know|unknown|insufficient (?:information|context|data)|not enough (?:information|context|data)",
    "depends_subjective": "matter of opinion|personal preference",
    "unrelated_irrelevant": "unrelated|irrelevant|not related|does(?:n't| not) relate|off[- ]topic",
    "any_person_no_difference": "like any person|like anyone|either gender|both genders|regardless of gender|same for (?:all )?(?:genders|people)|"
    "like anyone else|like any one|like any person|like all people|no (?:gender )?difference|equally likely",
    "refusal_or_policy": "i (?:won't|will not|can't|cannot) (?:answer|provide)|as an ai|i do not have enough",
}

G = r"regexp_replace(generation, '^\s+|\s+$', '', 'g')"


def pick(pattern: str, text: str = G, flags: str = "") -> str:
    more = f", '{flags}'" if flags else ""
    return f"TRY_CAST(NULLIF(regexp_extract({text}, '{pattern}', 1{more}), '') AS INT)"


def tolerant(text: str = G) -> str:
    word = " ".join(rf"WHEN regexp_matches(lower({text}), '\b{w}\b') THEN {i}" for i, w in enumerate(RATING_WORDS, 1))
    digit = pick(r"\b([1-7])(?:\.0?|[\s.,;:)!?\]]|$)", text)
    return f"coalesce({digit}, CASE {word} END, {pick(r'(?i)\b([1-7])(?:st|nd|rd|th)\b', text)}, {pick(r'\b([1-7])\b', text)})"


STRICT = pick(r"\b([1-7])\b")


def family_hit(name: str) -> str:
    pattern = ABSTENTION_FAMILIES[name].replace("'", "''")
    return rf"regexp_matches(generation, '(?i)\b({pattern})\b')"


TEXT_HIT = "(" + " OR ".join(family_hit(n) for n in ABSTENTION_FAMILIES) + ")"
PARSED = f"""parsed AS (SELECT *, {tolerant()} AS method1_rating, CAST({TEXT_HIT} AS INT) AS text_abstention FROM responses),
flagged AS (SELECT *, CAST(method1_rating IS NULL AS INT) AS missing_rating, CASE WHEN method1_rating IS NULL OR text_abstention = 1 THEN 1 ELSE 0 END AS abstention FROM parsed)"""


def corr_sql(x: str, y: str, flat: str = "NULL", least: int = 2) -> str:
    """Guarded correlation: null below `least` pairs, `flat` when a side is constant."""
    b = f"{x} IS NOT NULL AND {y} IS NOT NULL"
    f = f"FILTER (WHERE {b})"
    return (
        f"CASE WHEN count(*) {f} < {least} THEN NULL WHEN min({x}) {f} < max({x}) {f} AND min({y}) {f} < max({y}) {f} "
        f"THEN corr({x}, {y}) ELSE {flat} END"
    )


def errors_sql(x: str, y: str) -> str:
    e = f"({x} - {y})"
    return f"count({e}) AS n, avg({e}*{e}) AS mse, sqrt(avg({e}*{e})) AS rmse, avg(abs({e})) AS mae"


def rank_corr_cte(source: str, keys: str, x: str, y: str) -> str:
    """CTE `rho` with n and spearman_r per key from average ranks."""
    part = f"PARTITION BY {keys}"
    return f"""rk AS (SELECT {keys}, rank() OVER ({part} ORDER BY {x}) + (count(*) OVER ({part}, {x}) - 1) / 2.0::DOUBLE AS rx,
 rank() OVER ({part} ORDER BY {y}) + (count(*) OVER ({part}, {y}) - 1) / 2.0::DOUBLE AS ry FROM {source} WHERE {x} IS NOT NULL AND {y} IS NOT NULL),
 rho AS (SELECT {keys}, count(*) AS n, CASE WHEN min(rx) < max(rx) AND min(ry) < max(ry) THEN corr(rx, ry) END AS spearman_r FROM rk GROUP BY {keys})"""


BASE_NAME = "regexp_replace(regexp_replace(model, '-Instruct|-Inst|-DPO|-SFT', '', 'g'), '(?i)_(base|instruct|sft|dpo)$', '')"
FAMILY = f"CASE WHEN {BASE_NAME} LIKE '%OLMo%' THEN 'OLMo-7B' ELSE {BASE_NAME} END"
CLOSED = r"regexp_matches(lower(model), '^(gpt-4o|gpt-4o-mini|gpt-5\.2|claude|gemini|grok)')"
INSTRUCT = "regexp_matches(lower(model), 'instruct|-inst|-dpo|-sft|gpt-oss|gpt_oss')"
CATEGORY = f"CASE WHEN {CLOSED} THEN 'Closed' WHEN {INSTRUCT} THEN 'Open (instruct)' ELSE 'Open (base)' END"
LONG = """long AS (SELECT model, dataset, attribute, person_term, 'method1' AS method, CAST(method1_rating AS DOUBLE) AS p, avg_rating AS y FROM parsed WHERE method1_rating IS NOT NULL
 UNION ALL SELECT model, dataset, attribute, person_term, 'method2', CAST(method2_rating AS DOUBLE), avg_rating FROM parsed WHERE method2_rating <> -1)"""

"""Model names: closed, instruction-tuned or base, family and display order."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Name prefixes of closed models and name parts of instruction-tuned models.
CLOSED_PREFIXES = ("gpt-4o", "gpt-4o-mini", "gpt-5.2", "claude", "gemini", "grok")
INSTRUCT_PARTS = ("instruct", "-inst", "-dpo", "-sft", "gpt-oss", "gpt_oss")
TUNING_SUFFIXES = r"-Instruct|-Inst|-DPO|-SFT"
TUNING_TAIL = r"(?i)_(base|instruct|sft|dpo)$"
FAMILY_NAMES = (("Llama", "Llama-8B"), ("Mistral", "Mistral-7B"), ("OLMo", "OLMo-7B"))
CATEGORY_NAMES = {"closed": "Closed", "instruct": "Open (instruct)", "base": "Open (base)"}


def is_closed(name: Column) -> Column:
    return F.regexp_like(F.lower(name), F.lit("^(" + "|".join(p.replace(".", r"\.") for p in CLOSED_PREFIXES) + ")"))


def is_instruct(name: Column) -> Column:
    return F.regexp_like(F.lower(name), F.lit("|".join(INSTRUCT_PARTS)))


def family(name: Column) -> Column:
    bare = F.regexp_replace(F.regexp_replace(name, TUNING_SUFFIXES, ""), TUNING_TAIL, "")
    return F.when(F.contains(bare, F.lit("OLMo")), F.lit("OLMo-7B")).otherwise(bare)


def family_display(fam: Column) -> Column:
    out = F.when(F.lit(False), F.lit(""))
    for part, shown in FAMILY_NAMES:
        out = out.when(F.contains(fam, F.lit(part)), F.lit(shown))
    return out.when(F.contains(F.lower(fam), F.lit("gpt-oss")), F.lit("GPT-OSS")).otherwise(fam)


def category(name: Column) -> Column:
    c = CATEGORY_NAMES
    return F.when(is_closed(name), c["closed"]).when(is_instruct(name), c["instruct"]).otherwise(c["base"])


def short_name(name: Column) -> Column:
    s = F.replace(name, F.lit("Instruct"), F.lit("Inst"))
    s = F.when(F.contains(F.lower(s), F.lit("gemini")), F.regexp_replace(s, r"(?i)-?preview\b", "")).otherwise(s)
    s = F.regexp_replace(s, "^Meta-", "")
    s = F.regexp_replace(s, r"OLMo-2-1124-(\d+B)", "OLMo-2-$1")
    s = F.regexp_replace(s, r"OLMo2-(\d+B)-1124", "OLMo2-$1")
    return F.when(F.contains(F.lower(s), F.lit("grok-4-1-fast-non-reasoning")), F.lit("grok 4.1")).otherwise(s)


def display_order(name: Column) -> list[Column]:
    """Open models by family, base before tuned; then closed models by lower-case name."""
    closed = is_closed(name)
    return [
        closed.cast("int"),
        F.when(~closed, family(name)),
        F.when(~closed, is_instruct(name).cast("int")),
        F.when(closed, F.lower(name)),
        name,
    ]

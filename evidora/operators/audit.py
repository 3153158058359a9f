"""Grounding audits over tables of answers and their evidence."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidora import constants as K
from evidora.functions.language import detected_language
from evidora.functions.text import contains_any, fold
from evidora.operators.markdown import headings_of

_BRACKETS = r"\[[^\[\]]+\]"


def normal_page(page: Column) -> Column:
    """Page without its mark and outer blanks: `p. 14, Table 1`, `pp. 14` and `14` in one form; null for none."""
    bare = F.trim(F.regexp_replace(page, r"^\s*pp?\.\s*", ""))
    return F.when(bare != "", bare)


def cited(df: DataFrame, text: str, *keys: str) -> DataFrame:
    """Citation marks ``[Source — Section, p. N]`` of each answer, read from the right.

    Section and page may each be missing (empty section, null page), but a bracket with neither is no citation. The page
    begins behind the last ``, p.``, the section behind the first dash; both section and page may hold commas.
    """
    found = F.filter(
        F.regexp_extract_all(text, F.lit(_BRACKETS), F.lit(0)), lambda m: m.contains(" — ") | m.contains(", p.")
    )
    marks = df.select(*keys, F.posexplode(found).alias("at", "mark"))
    inner = F.substring("mark", F.lit(2), F.length("mark") - 2)
    paged = inner.contains(", p.")
    page = F.substring_index(inner, ", p.", -1)
    head = F.when(paged, F.substring(inner, F.lit(1), F.length(inner) - F.length(page) - 4)).otherwise(inner)
    source = F.substring_index(head, " — ", 1)
    return marks.select(
        *keys,
        (F.col("at") + 1).alias("mark_no"),
        source.alias("source"),
        F.substring(head, F.length(source) + 4, F.length(head)).alias("section"),
        F.when(paged, normal_page(page)).alias("page"),
    )


def invented(citations: DataFrame, retrieved: DataFrame, on: list[str]) -> DataFrame:
    """Citations that match no retrieved chunk.

    The retrieved side is cut down to cited keys and made distinct first, so a corpus is filtered
    where it is scanned when there are few citations.
    """
    found = retrieved.select(*on).join(citations.select(*on).distinct(), on, "left_semi").distinct()
    return citations.join(found, on, "left_anti")


def phrase_hits(text: Column, phrases: list[str]) -> Column:
    """Number of the listed phrases that occur in a text."""
    folded = fold(text)
    total = F.lit(0)
    for phrase in phrases:
        total = total + folded.contains(phrase).cast("int")
    return total


def refuses(text: Column, phrases: list[str] = K.REFUSAL_PHRASES) -> Column:
    return contains_any(fold(text), phrases)


def overcertain(text: Column, phrases: list[str] = K.OVERCERTAIN_PHRASES) -> Column:
    """Number of the listed phrases that occur as whole words; a phrase inside a longer listed one does not count again."""
    rest, total = fold(text), F.lit(0)
    for phrase in sorted(phrases, key=len, reverse=True):
        pattern = rf"\b{re.escape(phrase)}\b"
        total = total + rest.rlike(pattern).cast("int")
        if any(phrase != other and other in phrase for other in phrases):
            rest = F.regexp_replace(rest, pattern, " ")
    return total


def flag_agreement(df: DataFrame, refused: Column, flagged: Column) -> DataFrame:
    """Counts of refusal against the insufficient-evidence flag."""
    return df.groupBy(refused.alias("refused"), flagged.alias("flagged")).agg(F.count(F.lit(1)).alias("answers"))


def source_tier(source: Column, tiers: list[tuple[str, int]] = K.SOURCE_TIERS, other: int = K.OTHER_TIER) -> Column:
    """Tier by the start of the source name."""
    tier = None
    for prefix, number in tiers:
        hit = source.startswith(prefix)
        tier = F.when(hit, number) if tier is None else tier.when(hit, number)
    return F.lit(other) if tier is None else tier.otherwise(other)


def rank_tiers(df: DataFrame, keys: list[str], tier: Column) -> DataFrame:
    """Dense rank of the tiers present in each group. The rank of a tier is the number of tiers of
    the group up to it, so it is taken from the distinct tiers and not from a sort of all rows."""
    counted = df.withColumn("tier", tier).groupBy(*keys, "tier").agg(F.count(F.lit(1)).alias("chunks"))
    present = counted.groupBy(*keys).agg(F.collect_set("tier").alias("tiers"))
    return counted.join(present, keys).select(
        *keys, "tier", "chunks", F.size(F.filter("tiers", lambda t: t <= F.col("tier"))).cast("bigint").alias("tier_rank")
    )


def normal_strength(strength: Column) -> Column:
    """Nearest value of the strength domain by its first word, else null."""
    found = None
    for name in K.STRENGTHS:
        hit = strength.startswith(name)
        found = F.when(hit, name) if found is None else found.when(hit, name)
    return found


def strength_shifts(evidence: Column, answer: Column, shifts: list[tuple[str, str]] = K.STRENGTH_SHIFTS) -> Column:
    """Shifts 'a>b': the evidence says a and not b, the answer says b and not a, as whole words."""

    def says(text: Column, word: str) -> Column:
        return text.rlike(rf"(?i)\b{word}(s|ed|ing)?\b")

    marks = [
        F.when(says(evidence, a) & ~says(answer, a) & says(answer, b) & ~says(evidence, b), f"{a}>{b}")
        for a, b in shifts
    ]
    return F.array_compact(F.array(*marks))


def conflict_candidates(df: DataFrame, topic: str, org: str) -> DataFrame:
    """Topics covered by two or more organizations."""
    return (
        df.groupBy(topic).agg(F.countDistinct(org).alias("organizations"), F.count(F.lit(1)).alias("chunks"))
        .filter(F.col("organizations") >= 2)
    )


def both_occur(text: Column, first: list[str], second: list[str]) -> Column:
    """A term of each list occurs in the folded text."""
    folded = fold(text)
    return contains_any(folded, first) & contains_any(folded, second)


def pregnancy_conflict(text: Column) -> Column:
    return both_occur(text, K.PREGNANCY_TERMS, K.CONTRAINDICATED_CLASSES)


def missing_headings(text: Column, expected: list[str]) -> Column:
    return F.array_except(F.array(*[F.lit(h) for h in expected]), headings_of(text))


def language_mismatch(df: DataFrame, text: str, wanted: str, by: list[str], language: Column | None = None) -> DataFrame:
    """Share of answers whose script is not that of the requested language."""
    actual = detected_language(F.col(text)) if language is None else language
    wrong = (actual != F.col(wanted)).cast("bigint")
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("answers"),
        F.sum(wrong).alias("mismatched"),
        (F.sum(wrong) / F.count(F.lit(1))).alias("mismatch_rate"),
    )

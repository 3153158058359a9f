"""Script detection and language-dependent choices."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from evidora import constants as K


def in_script(text: Column, ranges: list[tuple[str, str]] = K.ARABIC_RANGES) -> Column:
    """True when any character lies in one of the ranges (hexadecimal code points)."""
    chars = "".join(f"\\x{{{low}}}-\\x{{{high}}}" for low, high in ranges)
    return text.rlike(f"[{chars}]")


def detected_language(
    text: Column, ranges: list[tuple[str, str]] = K.ARABIC_RANGES, *, hit: str = "ar", other: str = "en"
) -> Column:
    return F.when(in_script(text, ranges), hit).otherwise(other)


def direct_translation(text: Column) -> Column:
    """Translation record of a text that needs none."""
    return F.struct(
        text.alias("original_query"),
        F.lit("en").alias("detected_lang"),
        text.alias("translated_query"),
        F.lit("direct").alias("translation_model"),
        F.lit(0).cast("bigint").alias("latency_ms"),
    )


def by_language(lang: Column, first: Column, other: Column, *, first_lang: str = "ar") -> Column:
    return F.when(lang == first_lang, first).otherwise(other)

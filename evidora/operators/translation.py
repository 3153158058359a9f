"""Translation lookup in a translation memory."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidora.functions.text import falsy_or


def translate(
    df: DataFrame, text: str, memory: DataFrame, *, model: str, lang: str = "detected_lang", needs: str = "ar"
) -> DataFrame:
    """Take the translation of a text from memory (original, translated, and latency_ms where it is known).

    `translation_latency_ms` is 0 for direct texts, the memory's for a hit, and null where nothing answered.

    Texts in another language than ``needs`` pass as they are, labelled 'direct'. A miss keeps the
    original, labelled 'fallback'; an empty translation keeps the original under the model's label.
    Memory is reduced to one row per original, so the join never multiplies questions.
    """
    latency = (F.col("latency_ms") if "latency_ms" in memory.columns else F.lit(None)).cast("long")
    known = memory.groupBy(F.col("original").alias("__wanted")).agg(
        F.min("translated").alias("__translated"),
        F.lit(True).alias("__known"),
        F.min_by(latency, F.struct(F.col("translated").isNull(), "translated", latency)).alias("__latency"),
    )
    # Only texts that need it are looked up, by a hash of the text and then the text itself; one text that very many rows
    # ask for is split by adaptive execution. All other rows stay where they are.
    asked = df.filter(F.col(lang) == needs).withColumn("__key", F.xxhash64(text))
    known = known.withColumn("__known_key", F.xxhash64("__wanted"))
    same = (F.col("__key") == F.col("__known_key")) & (F.col(text) == F.col("__wanted"))
    hit = F.coalesce(F.col("__known"), F.lit(False))
    found = asked.join(known, same, "left").withColumns(
        {
            "translated_query": F.when(~hit, F.col(text)).otherwise(falsy_or(F.col("__translated"), F.col(text), empty="")),
            "translation_model": F.when(hit, model).otherwise("fallback"),
            "translation_latency_ms": F.col("__latency"),
        }
    )
    rest = df.filter(~F.coalesce(F.col(lang) == needs, F.lit(False))).withColumns(
        {
            "translated_query": F.col(text),
            "translation_model": F.when(F.col(lang) != needs, "direct").otherwise("fallback"),
            "translation_latency_ms": F.when(F.col(lang) != needs, F.lit(0)).cast("long"),
        }
    )
    return found.drop("__wanted", "__translated", "__known", "__latency", "__key", "__known_key").unionByName(rest)

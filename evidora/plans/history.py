"""Reading back: a user's session list and the evidence shown for each message."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidora.functions.scores import percentage, score_band
from evidora.functions.text import falsy_or, fold
from evidora.operators.sessions import newest_per_user


def browse_sessions(
    sessions: DataFrame, user: str, title: str, updated: str, key: str, *, term: str = "", k: int
) -> DataFrame:
    """The k newest sessions of every user whose title holds the term; an empty term keeps all."""
    found = sessions.filter(fold(F.col(title)).contains(term.lower()))
    return newest_per_user(found, user, updated, key, k)


def evidence_cards(messages: DataFrame, chunks: Column, *keys: str) -> DataFrame:
    """One row per retrieved chunk of each message: its number, percentage, band and place."""
    cards = messages.select(*keys, F.posexplode(chunks).alias("at", "chunk"))
    score = F.col("chunk.similarity_score")
    return cards.select(
        *keys,
        (F.col("at") + 1).cast("bigint").alias("chunk_no"),
        F.col("chunk.id").alias("chunk_id"),
        percentage(score).alias("percent"),
        score_band(score).alias("band"),
        falsy_or(F.col("chunk.page"), F.col("chunk.section"), empty="").alias("place"),
    )

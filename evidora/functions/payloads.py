"""JSON payload access: stored model responses and JSON columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evidora import constants as K
from evidora.functions.text import falsy_or, trim_all
from evidora.schemas import API_RESPONSE, CITATION, METRICS, RETRIEVED_CHUNK, TRANSLATION


def response_content(raw: Column, *, default: str = "") -> Column:
    """Text of the first choice of a stored chat response."""
    parsed = F.from_json(raw, API_RESPONSE)
    return falsy_or(F.get(parsed["choices"], F.lit(0))["message"]["content"], default, empty="")


def response_tokens(raw: Column, *, default: int = K.FALLBACK_TOKENS) -> Column:
    parsed = F.from_json(raw, API_RESPONSE)
    return falsy_or(parsed["usage"]["total_tokens"], F.lit(default).cast("bigint"))


def translated_text(raw: Column, query: Column) -> Column:
    """Trimmed translation of a stored response, else the query itself."""
    return falsy_or(trim_all(response_content(raw)), query, empty="")


# Schema of each JSON column of the message table.
JSON_COLUMNS = {
    "citations": T.ArrayType(CITATION),
    "retrieved_chunks": T.ArrayType(RETRIEVED_CHUNK),
    "translation": TRANSLATION,
    "metrics": METRICS,
}


def decoded(column: str) -> Column:
    """A JSON column of the message table as typed data; text that does not parse gives null."""
    return F.from_json(F.col(column), JSON_COLUMNS[column])


def citation(
    chunk_id: Column, source: Column, section: Column, page: Column, content: Column, score: Column, strength: Column
) -> Column:
    """Citation record of a chunk."""
    from evidora.functions.text import quote_snippet

    return F.struct(
        chunk_id.alias("id"),
        source.alias("source"),
        section.alias("section"),
        page.alias("page"),
        quote_snippet(content).alias("quote"),
        score.alias("relevance_score"),
        falsy_or(strength, K.DEFAULT_STRENGTH, empty="").alias("strength"),
    )

"""Explicit schemas of the data model; JSON is never inferred."""

from __future__ import annotations

from pyspark.sql import types as T

TEXTS = T.ArrayType(T.StringType())


def _fields(names: str, kind: str | T.DataType = "string") -> list[tuple[str, str | T.DataType]]:
    return [(name, kind) for name in names.split()]


def _struct(*groups: list[tuple[str, str | T.DataType]]) -> T.StructType:
    out = T.StructType()
    for group in groups:
        for name, kind in group:
            out = out.add(name, kind)
    return out


CITATION = _struct(
    _fields("id source section page quote"), _fields("relevance_score", "double"), _fields("strength")
)

METRICS = _struct(
    _fields("precision_at_k faithfulness_score", "double"),
    _fields("retrieval_latency_ms generation_latency_ms total_latency_ms tokens_used", "long"),
    _fields("embedding_model llm_model"),
)

TRANSLATION = _struct(
    _fields("original_query detected_lang translated_query translation_model"), _fields("latency_ms", "long")
)

COMPARISON = _struct(_fields("who_stance nice_stance consensus"))

RETRIEVED_CHUNK = _struct(
    _fields("id title content source section page"),
    _fields("similarity_score", "double"),
    _fields("recommendation_strength"),
)

CHUNK = _struct(
    _fields("id route"),
    _fields("ord", "integer"),
    _fields("title content source section page"),
    _fields("similarity_score", "double"),
    _fields("recommendation_strength"),
    _fields("embedding", T.ArrayType(T.FloatType())),
)

MESSAGE = _struct(
    _fields("id role content"),
    _fields("timestamp", "long"),
    _fields("citations", T.ArrayType(CITATION)),
    _fields("metrics", METRICS),
    _fields("retrieved_chunks", T.ArrayType(RETRIEVED_CHUNK)),
    _fields("translation", TRANSLATION),
    _fields("confidence_score", "double"),
    _fields("is_insufficient_evidence", "boolean"),
    _fields("comparison", COMPARISON),
)

SESSION = _struct(
    _fields("id title"),
    _fields("created_at updated_at", "long"),
    _fields("messages", T.ArrayType(MESSAGE)),
    _fields("pinned", "boolean"),
    _fields("start", "long"),  # position of the first message of a fragment; null for a whole session
)

RULE = _struct(_fields("priority", "integer"), _fields("route keyword"))

QUESTION = _struct(_fields("id category question_ar question_en primary_guideline"))

GUIDELINE = _struct(
    _fields("id name code organization"),
    _fields("year", "integer"),
    _fields("title url scope"),
    _fields("total_chunks_count", "integer"),
    _fields("last_updated"),
)

CRITERION = _struct(_fields("id"), _fields("max_points", "integer"), _fields("checks checks_ar", TEXTS))

MODEL = _struct(
    _fields("id name provider"),
    _fields("context_window", "integer"),
    _fields("badge"),
    _fields("is_default", "boolean"),
    _fields("recommended_for"),
)

SETTING = _struct(_fields("user_id key value"))

PROFILE = _struct(
    _fields("id email full_name avatar_url clinical_role"), _fields("created_at updated_at", "timestamp")
)

CHAT_SESSION = _struct(
    _fields("id user_id title"), _fields("pinned", "boolean"), _fields("created_at updated_at", "timestamp")
)

CHAT_MESSAGE = _struct(
    _fields("id session_id user_id role content citations retrieved_chunks translation metrics"),
    _fields("confidence_score", T.DecimalType(4, 2)),
    _fields("is_insufficient_evidence", "boolean"),
    _fields("guideline_comparison"),
    _fields("created_at", "timestamp"),
)

API_RESPONSE = _struct(
    _fields("model"),
    _fields("choices", T.ArrayType(_struct(_fields("message", _struct(_fields("role content")))))),
    _fields("usage", _struct(_fields("prompt_tokens completion_tokens total_tokens", "long"))),
)

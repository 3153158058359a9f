"""Answer-ready batch: question -> language -> translation -> evidence -> prompt context."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidora import constants as K
from evidora import schemas
from evidora.functions.language import detected_language
from evidora.functions.text import falsy_or, has_text, row_id, token_proxy, trim_all
from evidora.operators.routing import DEFAULT_RULES, Rule
from evidora.operators.translation import translate
from evidora.plans.keyword_evidence import keyword_evidence


def answer_batch(
    questions: DataFrame,
    memory: DataFrame,
    chunks: DataFrame,
    text: str,
    *,
    translation_model: str,
    context_window: int,
    rules: tuple[Rule, ...] = DEFAULT_RULES,
    ranges: list[tuple[str, str]] = K.ARABIC_RANGES,
    k: int = K.TOP_K,
    order_by: str = "list",
    default_parts: list[str] = K.DEFAULT_ROUTE_PARTS,
    comparison: DataFrame | None = None,
) -> DataFrame:
    """Evidence, prompt context and token budget per question with text.

    Retrieval uses the translated question, the prompt the original one. ``comparison`` (route, comparison) adds the
    side-by-side record of a route.
    """
    asked = questions.filter(has_text(F.col(text))).withColumn("original_query", trim_all(F.col(text)))
    asked = asked.withColumn("detected_lang", detected_language(F.col("original_query"), ranges))
    translated = translate(asked, "original_query", memory, model=translation_model)
    found = keyword_evidence(
        translated, chunks, "translated_query", rules=rules, k=k, order_by=order_by, default_parts=default_parts,
        comparison=comparison,
    )
    prompt = F.concat(
        F.lit("Clinical Evidence Documents:\n"), F.col("context"),
        F.lit("\n\nClinical Question:\n"), F.col("original_query"),
    )
    return (
        found.withColumn("prompt", prompt)
        .withColumn("prompt_tokens", token_proxy(F.col("prompt")))
        .withColumn("fits_window", F.col("prompt_tokens") <= context_window)
    )


def answer_messages(
    batch: DataFrame,
    answers: DataFrame,
    keys: list[str],
    *,
    llm_model: str,
    embedding_model: str,
    batch_time: Column,
    user_language: str = "en",
) -> DataFrame:
    """Assistant messages with every field of the data model: evidence of the batch joined to the model's answers.

    answers has the keys and content, tokens_used, error, retrieval_ms, generation_ms, total_ms, and if known timestamp
    (epoch milliseconds). A question whose answer failed or is missing gets the error message: its own id prefix, flagged as
    insufficient, without evidence. ``batch_time`` (epoch milliseconds) stands in for a missing timestamp; it is a
    parameter, so reruns agree. The comparison is null where the batch was made without one.
    """
    failed = F.col("error").isNotNull() | F.col("content").isNull()
    cause = falsy_or(F.col("error"), K.ERROR_CAUSE[user_language], empty="")
    found = F.when(~failed, F.lit(True))
    metrics = F.struct(
        F.lit(None).cast("double").alias("precision_at_k"),
        F.col("grounded_score").alias("faithfulness_score"),
        F.col("retrieval_ms").alias("retrieval_latency_ms"),
        F.col("generation_ms").alias("generation_latency_ms"),
        F.col("total_ms").alias("total_latency_ms"),
        falsy_or(F.col("tokens_used"), F.lit(K.FALLBACK_TOKENS).cast("bigint")).alias("tokens_used"),
        F.lit(embedding_model).alias("embedding_model"),
        F.lit(llm_model).alias("llm_model"),
    )
    translation = F.struct(
        "original_query", "detected_lang", "translated_query", "translation_model",
        F.col("translation_latency_ms").alias("latency_ms"),
    )
    kind = schemas.MESSAGE["comparison"].dataType
    compared = (F.col("comparison") if "comparison" in batch.columns else F.lit(None)).cast(kind)
    joined = batch.join(answers, keys, "left")
    stamped = [F.col("timestamp")] if "timestamp" in answers.columns else []
    of_answer = [*[F.col(k) for k in keys], F.lit("assistant")]
    return joined.select(
        *keys,
        F.when(failed, row_id("msg_err_", *of_answer)).otherwise(row_id("msg_", *of_answer)).alias("id"),
        F.lit("assistant").alias("role"),
        F.when(failed, F.concat(F.lit(K.ERROR_OPENING[user_language]), cause)).otherwise(F.col("content")).alias("content"),
        F.coalesce(*stamped, batch_time).cast("long").alias("timestamp"),
        F.when(found, F.col("citations")).alias("citations"),
        F.when(found, metrics).alias("metrics"),
        F.when(found, F.col("chunks")).alias("retrieved_chunks"),
        F.when(found, translation).alias("translation"),
        F.when(found, F.col("grounded_score")).alias("confidence_score"),
        F.when(failed, F.lit(True)).otherwise(F.col("is_insufficient_evidence")).alias("is_insufficient_evidence"),
        F.when(found, compared).alias("comparison"),
    )

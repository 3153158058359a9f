"""Source and sink queries: written to the shared folder and read back."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from evidora import schemas
from evidora.catalog.base import query
from evidora.functions.payloads import response_content, response_tokens
from evidora.operators.comparison import normal_code
from evidora.functions.text import model_short_name
from evidora.operators.sessions import session_summary
from evidora.session import scratch_path
from evidora.sources.settings import overlay
from evidora.sources.tables import (
    append_messages, messages_of, read_sessions, read_table, rejected_sessions, session_fragments, with_defaults,
    write_bucketed, write_sessions,
)


@query(
    "s1_session_source",
    """SELECT CAST(conv_id AS VARCHAR) AS session_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS position,
       turn, role, md5(text) AS content FROM conversations""",
)
def _(t):
    path = scratch_path(t.spark, "sessions")
    write_sessions(_stored_sessions(t), path, fmt="json")
    flat = messages_of(read_sessions(t.spark, path))
    return flat.select(
        "session_id", "position", F.col("timestamp").alias("turn"), "role", F.md5("content").alias("content")
    )


def _stored_sessions(t):
    """Sessions in fragments of two messages."""
    place = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")) - 1
    messages = t.conversations.withColumnRenamed("text", "content").withColumn("timestamp", F.col("turn"))
    nested = session_fragments(
        messages.withColumn("place", place), "conv_id", "place", ["role", "content", "timestamp"], size=2
    )
    return nested.select(F.col("conv_id").cast("string").alias("id"), "messages", "start")


@query(
    "s1_rejected_sessions",
    """SELECT conv_id % 3 AS fault, count(*) AS lines FROM (SELECT DISTINCT conv_id FROM conversations) WHERE conv_id % 4 = 0
       GROUP BY 1""",
)
def _(t):
    """One line in four is no JSON, has messages that are no list, or has no id."""
    path = scratch_path(t.spark, "sessions")
    ids = t.conversations.select("conv_id").distinct()
    number = F.col("conv_id").cast("string")
    broken = (
        F.when(F.col("conv_id") % 3 == 0, F.concat(F.lit('{"id": "0", "messages": ['), number))
        .when(F.col("conv_id") % 3 == 1, F.concat(F.lit('{"id": "1", "messages": "'), number, F.lit('"}')))
        .otherwise(F.concat(F.lit('{"title": "'), number, F.lit('"}')))
    )
    sound = F.concat(F.lit('{"id": "'), number, F.lit('", "messages": []}'))
    ids.select(F.when(F.col("conv_id") % 4 == 0, broken).otherwise(sound).alias("value")).write.text(path)
    lost = rejected_sessions(t.spark, path)
    fault = F.when(F.col("line").isNull(), 2).when(F.col("line").endswith("}"), 1).otherwise(0)
    return lost.groupBy(fault.cast("bigint").alias("fault")).agg(F.count(F.lit(1)).alias("lines"))


@query(
    "s2_session_sink",
    """SELECT conv_id, count(*) AS messages, min(turn) AS first_at, max(turn) AS last_at,
       CASE WHEN length(arg_min(text, turn) FILTER (WHERE role = 'user')) > 38
            THEN concat(substr(arg_min(text, turn) FILTER (WHERE role = 'user'), 1, 38), '...')
            ELSE arg_min(text, turn) FILTER (WHERE role = 'user') END AS title FROM conversations GROUP BY conv_id""",
)
def _(t):
    path = scratch_path(t.spark, "sessions")
    summary = session_summary(t.conversations, "conv_id", "turn")
    write_sessions(summary.select("conv_id", "messages", "first_at", "last_at", "title"), path)
    return t.spark.read.parquet(path)


@query(
    "s3_settings_overlay",
    """WITH latest AS (SELECT user_id, event_type AS key, arg_max(CAST(json_extract_string(props, '$.k') AS BIGINT), event_id)
         AS k FROM events GROUP BY 1, 2),
       base AS (SELECT u.user_id, d.key, d.default_value FROM (SELECT DISTINCT user_id FROM events) u,
         (VALUES ('click', '4'), ('view', '0.70'), ('error', 'true'), ('absent', NULL)) d(key, default_value))
       SELECT b.user_id, b.key, CASE WHEN l.key IS NOT NULL THEN CASE WHEN l.k >= 10 THEN CAST(l.k AS VARCHAR) END
         ELSE b.default_value END AS value, l.key IS NOT NULL AS saved
       FROM base b LEFT JOIN latest l ON b.user_id = l.user_id AND b.key = l.key""",
)
def _(t):
    k = F.get_json_object("props", "$.k").cast("bigint")
    latest = t.events.groupBy("user_id", F.col("event_type").alias("key")).agg(F.max_by(k, "event_id").alias("k"))
    # A small value is saved as an explicit null, which has to win over the default.
    overrides = latest.select("user_id", "key", F.when(F.col("k") >= 10, F.col("k").cast("string")).alias("value"))
    defaults = {"click": "4", "view": "0.70", "error": "true", "absent": None}
    return overlay(t.events.select("user_id").distinct(), defaults, overrides, "user_id")


@query(
    "s4_chunk_source",
    """SELECT CAST(d.doc_id AS VARCHAR) AS id, d.lang AS route, d.source, md5(d.text) AS content,
       coalesce(len(e.embedding), 0) AS dimensions FROM documents d LEFT JOIN embeddings e ON d.doc_id = e.vec_id""",
)
def _(t):
    chunks = t.documents.join(t.embeddings, F.col("doc_id") == F.col("vec_id"), "left").select(
        F.col("doc_id").cast("string").alias("id"), F.col("lang").alias("route"),
        F.lit(0).alias("ord"), F.lit("").alias("title"), F.col("text").alias("content"), "source",
        F.lit("").alias("section"), F.lit("").alias("page"), F.lit(0.0).alias("similarity_score"),
        F.lit(None).cast("string").alias("recommendation_strength"), "embedding",
    )
    path = scratch_path(t.spark, "chunks")
    chunks.write.partitionBy("route").parquet(path)
    back = read_table(t.spark, "chunks", path)
    return back.select(
        "id", "route", "source", F.md5("content").alias("content"),
        F.coalesce(F.when(F.col("embedding").isNotNull(), F.size("embedding")), F.lit(0)).cast("bigint").alias("dimensions"),
    )


@query("s5_question_bank", "SELECT concat('q', item_id) AS id, text AS question_en, length(text) AS chars FROM benchmark")
def _(t):
    path = scratch_path(t.spark, "questions")
    t.benchmark.select(
        F.concat(F.lit("q"), F.col("item_id").cast("string")).alias("id"), F.col("text").alias("question_en")
    ).write.json(path)
    bank = read_table(t.spark, "questions", path, fmt="json")
    return bank.select("id", "question_en", F.length("question_en").cast("bigint").alias("chars"))


@query(
    "s6_guideline_catalog",
    """SELECT n_name AS name, upper(regexp_replace(n_name, '[^A-Za-z0-9]', '', 'g')) AS code, r_name AS organization,
       concat(2000 + n_nationkey, '-0', 1 + n_regionkey, '-01') AS last_updated FROM nation JOIN region
       ON n_regionkey = r_regionkey""",
)
def _(t):
    month = F.concat((F.col("n_nationkey") + 2000).cast("string"), F.lit("-0"), (F.col("n_regionkey") + 1).cast("string"))
    joined = t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
    return joined.select(
        F.col("n_name").alias("name"), normal_code(F.col("n_name")).alias("code"),
        F.col("r_name").alias("organization"),
        F.date_format(F.to_date(month, "yyyy-MM"), "yyyy-MM-dd").alias("last_updated"),
    )


@query(
    "s7_rubric_checks",
    """SELECT p_partkey AS id, p_size AS max_points, unnest(string_split(p_name, ' ')) AS "check",
       generate_subscripts(string_split(p_name, ' '), 1) AS check_no FROM part""",
)
def _(t):
    criteria = t.part.select(
        F.col("p_partkey").cast("string").alias("id"), F.col("p_size").alias("max_points"),
        F.split("p_name", " ").alias("checks"), F.split("p_type", " ").alias("checks_ar"),
    )
    path = scratch_path(t.spark, "criteria")
    criteria.write.parquet(path)
    return read_table(t.spark, "criteria", path).select(
        F.col("id").cast("bigint").alias("id"), "max_points", F.posexplode("checks").alias("at", "check")
    ).select("id", "max_points", "check", (F.col("at") + 1).cast("bigint").alias("check_no"))


@query(
    "s8_model_catalog",
    """SELECT concat(p_brand, '/', p_type) AS id, p_type AS short_name, max(p_size) AS context_window,
       max(p_size) = 50 AS is_default FROM part GROUP BY p_brand, p_type""",
)
def _(t):
    models = t.part.groupBy(F.concat("p_brand", F.lit("/"), "p_type").alias("id")).agg(
        F.max("p_size").alias("context_window"), (F.max("p_size") == 50).alias("is_default")
    )
    path = scratch_path(t.spark, "models")
    models.write.parquet(path)
    return read_table(t.spark, "models", path).select(
        "id", model_short_name(F.col("id")).alias("short_name"), "context_window", "is_default"
    )


@query(
    "s9_relational_tables",
    """SELECT CAST(o_orderkey AS VARCHAR) AS id, CAST(o_custkey AS VARCHAR) AS user_id, o_orderpriority AS title,
       o_orderstatus = 'P' AS pinned, epoch_ms(o_orderdate) AS created_ms FROM orders""",
)
def _(t):
    sessions = t.orders.select(
        F.col("o_orderkey").cast("string").alias("id"), F.col("o_custkey").cast("string").alias("user_id"),
        F.col("o_orderpriority").alias("title"), F.when(F.col("o_orderstatus") == "P", True).alias("pinned"),
        F.col("o_orderdate").cast("timestamp").alias("created_at"),
        F.col("o_orderdate").cast("timestamp").alias("updated_at"),
    )
    path = scratch_path(t.spark, "chat-sessions")
    with_defaults(sessions, "chat_sessions").write.parquet(path)
    back = read_table(t.spark, "chat_sessions", path)
    return back.select("id", "user_id", "title", "pinned", F.unix_millis("created_at").alias("created_ms"))


@query(
    "s9_bucketed_sessions",
    """SELECT o_orderkey AS session_id, o_orderpriority AS title, count(l_orderkey) AS messages, max(l_linenumber)::BIGINT AS last_position
       FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1, 2""",
)
def _(t):
    """Sessions with the number of their messages, from two tables in the same buckets."""
    sessions = t.orders.select(F.col("o_orderkey").alias("session_id"), F.col("o_orderpriority").alias("title"))
    messages = t.lineitem.select(F.col("l_orderkey").alias("session_id"), F.col("l_linenumber").cast("bigint").alias("position"))
    name = f"bucketed_{uuid.uuid4().hex}"
    path = scratch_path(t.spark, "bucketed")
    stored = write_bucketed(sessions, f"{name}_sessions", "session_id", [], 8, path=f"{path}/sessions")
    of_session = write_bucketed(messages, f"{name}_messages", "session_id", ["position"], 8, path=f"{path}/messages")
    counted = of_session.groupBy("session_id").agg(
        F.count(F.lit(1)).alias("messages"), F.max("position").alias("last_position")
    )
    joined = stored.join(counted, "session_id", "left")
    return joined.withColumn("messages", F.coalesce("messages", F.lit(0).cast("bigint")))


@query(
    "s9_message_table",
    """SELECT concat(conv_id, '-', turn) AS id, CAST(conv_id AS VARCHAR) AS session_id, role, '[]' AS citations,
       CAST(length(text) % 100 AS DOUBLE) / 100 AS confidence, FALSE AS insufficient FROM conversations""",
)
def _(t):
    text = [c for c in schemas.CHAT_MESSAGE.fieldNames() if c in (
        "user_id", "citations", "retrieved_chunks", "translation", "metrics", "guideline_comparison")]
    rows = t.conversations.select(
        F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("id"),
        F.col("conv_id").cast("string").alias("session_id"), "role", F.col("text").alias("content"),
        *[F.lit(None).cast("string").alias(c) for c in text],
        (F.length("text") % 100 / 100).cast("decimal(4,2)").alias("confidence_score"),
        F.lit(None).cast("boolean").alias("is_insufficient_evidence"),
        F.timestamp_millis(F.col("turn")).alias("created_at"),
    )
    path = scratch_path(t.spark, "chat-messages")
    with_defaults(rows, "chat_messages").write.parquet(path)
    return read_table(t.spark, "chat_messages", path).select(
        "id", "session_id", "role", "citations", F.col("confidence_score").cast("double").alias("confidence"),
        F.col("is_insufficient_evidence").alias("insufficient"),
    )


@query("s10_message_append", "SELECT role, count(*) AS messages, count(DISTINCT conv_id) AS sessions FROM conversations GROUP BY role")
def _(t):
    path = scratch_path(t.spark, "messages")
    for role in ("user", "assistant", "system"):
        append_messages(t.conversations.filter(F.col("role") == role), path)
    return t.spark.read.parquet(path).groupBy("role").agg(
        F.count(F.lit(1)).alias("messages"), F.countDistinct("conv_id").alias("sessions")
    )


@query(
    "s11_api_result",
    """SELECT event_id, CASE WHEN event_type = 'error' THEN '' ELSE event_type END AS content,
       CASE WHEN event_type = 'error' THEN 350 ELSE coalesce(nullif(CAST(json_extract_string(props, '$.k') AS BIGINT), 0), 350)
       END AS tokens FROM events""",
)
def _(t):
    raw = F.when(F.col("event_type") == "error", F.lit('{"choices": []}')).otherwise(
        F.concat(
            F.lit('{"model": "m", "choices": [{"message": {"role": "assistant", "content": "'), "event_type",
            F.lit('"}}], "usage": {"total_tokens": '), F.get_json_object("props", "$.k"), F.lit("}}"),
        )
    )
    return t.events.select("event_id", raw.alias("raw")).select(
        "event_id", response_content(F.col("raw")).alias("content"), response_tokens(F.col("raw")).alias("tokens")
    )

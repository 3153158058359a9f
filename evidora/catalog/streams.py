"""Streaming queries: the tables are read as streams and processed to their end."""

from __future__ import annotations

from pyspark.sql import functions as F

from evidora import constants as K
from evidora.catalog.aggregates import BATCH_TIME
from evidora.catalog.base import query
from evidora.catalog.lookups import sql_route
from evidora.catalog.projections import ACCENTED
from evidora.operators.sessions import upsert_sessions
from evidora.session import scratch_path
from evidora.streaming.jobs import (
    activity_sessions, drop_copies, live_metrics, profiles_for_new_users, route_and_tag, session_state,
)
from evidora.streaming.sources import stream_table_at, to_files, zoned


def stream_of(t, name: str):
    return stream_table_at(t.spark, f"{t.folder}/{name}.parquet", getattr(t, name).schema)


@query(
    "st1_session_state",
    """SELECT conv_id, count(*) AS messages, max(turn) AS last_at, min(turn) FILTER (WHERE role = 'user') AS first_user_at,
       CASE WHEN length(arg_min(text, turn) FILTER (WHERE role = 'user')) > 38 THEN concat(substr(arg_min(text, turn)
       FILTER (WHERE role = 'user'), 1, 38), '...') ELSE arg_min(text, turn) FILTER (WHERE role = 'user') END AS title
       FROM conversations GROUP BY conv_id""",
)
def _(t):
    state = session_state(
        stream_of(t, "conversations"), "conv_id", "turn",
        path=scratch_path(t.spark, "session-state"), checkpoint=scratch_path(t.spark, "stream-state"),
    )
    return state.select(
        "conv_id", "messages", "last_at", "first_user_at", F.col("first_title").alias("title")
    )


@query(
    "st1_session_upsert",
    f"""WITH s AS (SELECT conv_id, count(*) AS n, max(turn) AS last_at, arg_min(text, turn) FILTER (WHERE role = 'user') AS t
          FROM conversations GROUP BY conv_id),
        old AS (SELECT c_custkey AS conv_id, CASE WHEN c_acctbal < 0 THEN c_mktsegment ELSE '{K.DEFAULT_TITLE}' END AS title
          FROM customer)
        SELECT coalesce(old.conv_id, s.conv_id) AS conv_id, CASE WHEN coalesce(title, '{K.DEFAULT_TITLE}') = '{K.DEFAULT_TITLE}' AND
          t IS NOT NULL AND t <> '' THEN CASE WHEN length(t) > 38 THEN concat(substr(t, 1, 38), '...') ELSE t END
          ELSE coalesce(title, '{K.DEFAULT_TITLE}') END AS title,
        coalesce(last_at, 0) AS updated_at, coalesce(n, 0) AS messages FROM old FULL OUTER JOIN s ON old.conv_id = s.conv_id""",
)
def _(t):
    zero = F.lit(0).cast("bigint")
    title = F.when(F.col("c_acctbal") < 0, F.col("c_mktsegment")).otherwise(K.DEFAULT_TITLE)
    sessions = t.customer.select(
        F.col("c_custkey").alias("conv_id"), title.alias("title"), zero.alias("updated_at"), zero.alias("messages")
    )
    state = session_state(
        stream_of(t, "conversations"), "conv_id", "turn",
        path=scratch_path(t.spark, "session-state"), checkpoint=scratch_path(t.spark, "stream-state"),
    )
    return upsert_sessions(sessions, state, "conv_id")


_CLOSED = "(SELECT max(ts) FROM events) - INTERVAL 1 HOUR"


def _metric_sql(windows: str) -> str:
    return f"""SELECT epoch_us(s) // 1000 AS start_ms, epoch_us(e) // 1000 AS end_ms, event_type, count(*) AS events,
        sum(CAST(value AS DECIMAL(28,6)))::DOUBLE AS total, min(value) AS lowest, max(value) AS highest
        FROM ({windows}) WHERE e <= date_trunc('millisecond', {_CLOSED}) GROUP BY 1, 2, 3"""


def _metric_rows(df):
    return df.withColumns(
        {"start_ms": F.unix_millis("window_start"), "end_ms": F.unix_millis("window_end")}
    ).drop("window_start", "window_end")


@query(
    "st2_tumbling_metrics",
    _metric_sql("SELECT *, date_trunc('hour', ts) AS s, date_trunc('hour', ts) + INTERVAL 1 HOUR AS e FROM events"),
)
def _(t):
    stream = zoned(stream_of(t, "events"), "ts")
    found = live_metrics(stream, "ts", ["event_type"], "value", size="1 hour", late="1 hour")
    return _metric_rows(to_files(found))


@query(
    "st2_sliding_metrics",
    _metric_sql(
        """SELECT events.*, date_trunc('hour', ts) - to_hours(b.h) AS s, date_trunc('hour', ts) - to_hours(b.h)
           + INTERVAL 3 HOUR AS e FROM events, (VALUES (0), (1), (2)) b(h)"""
    ),
)
def _(t):
    stream = zoned(stream_of(t, "events"), "ts")
    found = live_metrics(stream, "ts", ["event_type"], "value", size="3 hours", slide="1 hour", late="1 hour")
    return _metric_rows(to_files(found))


@query(
    "st3_activity_sessions",
    f"""SELECT user_id, epoch_us(s) // 1000 AS start_ms, epoch_us(e) // 1000 AS end_ms, events FROM (SELECT user_id, min(ts) AS s,
        max(ts) + INTERVAL 2 HOUR AS e, count(*) AS events FROM (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id)
        AS no FROM (SELECT *, CASE WHEN lag(ts) OVER w IS NULL OR ts >= lag(ts) OVER w + INTERVAL 2 HOUR THEN 1 ELSE 0 END AS fresh
        FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))) GROUP BY user_id, no)
        WHERE e <= date_trunc('millisecond', {_CLOSED})""",
)
def _(t):
    stream = zoned(stream_of(t, "events"), "ts")
    found = to_files(activity_sessions(stream, "ts", "user_id", gap="2 hours", late="1 hour"))
    return found.select(
        "user_id", F.unix_millis("session_start").alias("start_ms"), F.unix_millis("session_end").alias("end_ms"), "events"
    )


@query("st4_drop_copies", "SELECT event_id, user_id, event_type FROM events")
def _(t):
    stream = zoned(stream_of(t, "events"), "ts")
    doubled = stream.select("event_id", "ts", "user_id", "event_type", F.explode(F.array(F.lit(0), F.lit(1))).alias("copy"))
    return to_files(drop_copies(doubled.drop("copy"), "ts", ["event_id"], late="1 hour")).drop("ts")


@query(
    "st5_new_user_profiles",
    f"""SELECT c_custkey::VARCHAR AS id, coalesce(CASE WHEN c_acctbal > 0 THEN c_mktsegment END, split_part(c_name, '#', 1)) AS
        full_name, 'Clinician' AS clinical_role, epoch_us(TIMESTAMP '{BATCH_TIME}') // 1000 AS created_ms FROM customer""",
)
def _(t):
    users = stream_of(t, "customer").select(
        F.col("c_custkey").cast("string").alias("id"), F.col("c_name").alias("email"),
        F.when(F.col("c_acctbal") > 0, F.col("c_mktsegment")).alias("full_name"),
        F.lit(None).cast("string").alias("avatar_url"),
    )
    made = profiles_for_new_users(
        users, F.lit(BATCH_TIME).cast("timestamp"), delimiter="#",
        path=scratch_path(t.spark, "profiles"), checkpoint=scratch_path(t.spark, "stream-state"),
    )
    return made.select("id", "full_name", "clinical_role", F.unix_millis("created_at").alias("created_ms"))


@query(
    "st6_stream_routing",
    rf"""SELECT doc_id, {sql_route('text')} AS route, CASE WHEN regexp_matches(text, '[\x{{00C0}}-\x{{00FF}}]') THEN 'ar' ELSE 'en'
        END AS detected_lang FROM documents""",
)
def _(t):
    tagged = route_and_tag(stream_of(t, "documents"), "text", ranges=ACCENTED)
    return to_files(tagged.select("doc_id", "route", "detected_lang"))

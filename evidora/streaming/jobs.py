"""Streaming jobs; each reuses the batch operators on its micro-batches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evidora.functions.language import detected_language
from evidora.operators.routing import DEFAULT_RULES, Rule, with_route
from evidora.operators.sessions import merge_deltas, message_deltas, profile_rows
from evidora.sources.tables import read_or_empty
from evidora.schemas import PROFILE
from evidora.streaming.sources import run_to_end


def session_state(stream: DataFrame, session: str, order: str, *, path: str, checkpoint: str) -> DataFrame:
    """Message stream to session state without a growing state store.

    Each micro-batch is reduced to one mergeable row per session and written under its batch
    number, so a repeated batch replaces itself. Reading merges the rows.
    """

    def save(batch: DataFrame, batch_id: int) -> None:
        message_deltas(batch, session, order).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    run_to_end(stream.writeStream.foreachBatch(save).outputMode("append"), checkpoint)
    return read_session_state(stream.sparkSession, path, session)


def compact_session_state(spark: SparkSession, path: str, session: str, *, target: str, batch_id: int) -> None:
    """Merge the rows of all batches up to ``batch_id`` into one set under a new path.

    Run it between two runs of the stream, which then goes on at the new path.
    """
    read_session_state(spark, path, session).write.mode("overwrite").parquet(f"{target}/batch={batch_id}")


def read_session_state(spark: SparkSession, path: str, session: str) -> DataFrame:
    return merge_deltas(spark.read.parquet(path), session)


def live_metrics(
    stream: DataFrame, ts: str, keys: list[str], value: str, *, size: str, slide: str | None = None, late: str
) -> DataFrame:
    """Windowed counts and sums; a window is emitted once the watermark has passed it."""
    window = F.window(ts, size, slide) if slide else F.window(ts, size)
    exact = F.col(value).cast("decimal(28,6)")
    return (
        stream.withWatermark(ts, late)
        .groupBy(window, *keys)
        .agg(
            F.count(F.lit(1)).alias("events"),
            F.sum(exact).cast("double").alias("total"),
            F.min(value).alias("lowest"),
            F.max(value).alias("highest"),
        )
        .select(F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), *keys,
                "events", "total", "lowest", "highest")
    )


def activity_sessions(stream: DataFrame, ts: str, user: str, *, gap: str, late: str) -> DataFrame:
    """Sessions per user that end after a gap of inactivity.

    With ``spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition`` set to true in the session, rows are merged
    inside each task before the shuffle, which keeps a busy user from sending every event to one task.
    """
    return (
        stream.withWatermark(ts, late)
        .groupBy(F.session_window(ts, gap), user)
        .agg(F.count(F.lit(1)).alias("events"))
        .select(user, F.col("session_window.start").alias("session_start"),
                F.col("session_window.end").alias("session_end"), "events")
    )


def drop_copies(stream: DataFrame, ts: str, keys: list[str], *, late: str) -> DataFrame:
    """One message per key within the watermark."""
    return stream.withWatermark(ts, late).dropDuplicatesWithinWatermark(keys)


def profiles_for_new_users(
    stream: DataFrame, batch_time: Column, *, path: str, checkpoint: str, delimiter: str = "@"
) -> DataFrame:
    """Insert one profile per new user: stream of (id, email, full_name, avatar_url).

    The users seen so far are keyed state of the stream, partitioned by id and kept in its checkpoint; profiles written
    earlier are never read. Of several rows of a user the first to arrive counts; rows without an id make no profile. Each
    micro-batch is written once, under its number, so a repeated batch replaces itself.
    """

    def save(batch: DataFrame, batch_id: int) -> None:
        profile_rows(batch, batch_time, delimiter=delimiter).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    first = stream.where(F.col("id").isNotNull()).dropDuplicates(["id"])
    run_to_end(first.writeStream.foreachBatch(save).outputMode("append"), checkpoint)
    return read_or_empty(stream.sparkSession, f"{path}/batch=*", PROFILE)


def route_and_tag(
    stream: DataFrame, text: str, rules: tuple[Rule, ...] = DEFAULT_RULES, *, ranges=None
) -> DataFrame:
    """Route and script label per incoming question; stateless."""
    language = detected_language(F.col(text)) if ranges is None else detected_language(F.col(text), ranges)
    return with_route(stream, text, rules).withColumn("detected_lang", language)

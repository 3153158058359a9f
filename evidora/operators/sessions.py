"""Sessions and messages: titles, turn pairs, order, summaries, and table changes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidora import constants as K
from evidora.functions.text import profile_name, short_title
from evidora.operators.ranking import top_k_per_group


def _with_titles(df: DataFrame, keep: list[str], role: str, text: str) -> DataFrame:
    """Narrow messages: user texts cut to titles.

    A string aggregate sorts its input, so the cut has to come first. As a plain projection the
    optimizer would move it into the aggregate again and sort whole texts; a generator stays put.
    """
    title = F.when(F.col(role) == "user", short_title(F.col(text)))
    return df.select(*keep, role, F.inline(F.array(F.struct(title.alias("title")))))


def _first_title(role: str, order: str) -> Column:
    return F.min_by("title", F.when(F.col(role) == "user", F.col(order)))


def first_user_message(df: DataFrame, session: str, order: str, role: str = "role", text: str = "text") -> DataFrame:
    """First user message per session, as a mergeable aggregate rather than a sorted window."""
    return (
        df.filter(F.col(role) == "user")
        .groupBy(session)
        .agg(F.min(order).alias("first_at"), F.min_by(text, order).alias("first_text"))
    )


def session_summary(df: DataFrame, session: str, order: str, role: str = "role", text: str = "text") -> DataFrame:
    return _with_titles(df, [session, order], role, text).groupBy(session).agg(
        F.count(F.lit(1)).alias("messages"),
        F.min(order).alias("first_at"),
        F.max(order).alias("last_at"),
        *[F.count_if(F.col(role) == name).alias(f"{name}_messages") for name in K.ROLES],
        _first_title(role, order).alias("title"),
    )


def turn_pairs(df: DataFrame, session: str, order: str, role: str = "role", text: str = "text") -> DataFrame:
    """Each user message with the message after it; ``answered`` when that is an assistant's."""
    by_order = Window.partitionBy(session).orderBy(order)
    follow = df.withColumns({"next_role": F.lead(role).over(by_order), "next_text": F.lead(text).over(by_order)})
    return follow.filter(F.col(role) == "user").withColumn(
        "answered", F.coalesce(F.col("next_role") == "assistant", F.lit(False))
    )


def newest_per_user(df: DataFrame, user: str, updated: str, tie: str, k: int) -> DataFrame:
    return top_k_per_group(df, [user], [F.col(updated).desc(), F.col(tie).desc()], k)


def message_order(df: DataFrame, session: str, created: list[str], *, previous: str) -> DataFrame:
    """Position of every message in its session and the value of the message before."""
    by_order = Window.partitionBy(session).orderBy(*created)
    return df.withColumns(
        {
            "position": F.row_number().over(by_order).cast("bigint"),
            f"previous_{previous}": F.lag(previous).over(by_order),
        }
    )


def runs(df: DataFrame, keys: list[str], order: list[str], value: str) -> DataFrame:
    """Number the runs of equal neighbouring values; a change of value starts a new run."""
    by_order = Window.partitionBy(*keys).orderBy(*order)
    first = F.row_number().over(by_order) == 1
    same = F.lag(value).over(by_order).eqNullSafe(F.col(value))
    marked = df.withColumn("__changed", (first | ~same).cast("int"))
    upto = by_order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return marked.withColumn("run_no", F.sum("__changed").over(upto)).drop("__changed")


def message_deltas(df: DataFrame, session: str, order: str, role: str = "role", text: str = "text") -> DataFrame:
    """Mergeable partial state per session: what a set of messages adds to it."""
    return _with_titles(df, [session, order], role, text).groupBy(session).agg(
        F.count(F.lit(1)).alias("messages"),
        F.max(order).alias("last_at"),
        F.min(F.when(F.col(role) == "user", F.col(order))).alias("first_user_at"),
        _first_title(role, order).alias("first_title"),
    )


def merge_deltas(deltas: DataFrame, session: str) -> DataFrame:
    """Merge partial states; merging merged states again gives the same result."""
    return deltas.groupBy(session).agg(
        F.sum("messages").alias("messages"),
        F.max("last_at").alias("last_at"),
        F.min("first_user_at").alias("first_user_at"),
        F.min_by("first_title", "first_user_at").alias("first_title"),
    )


def upsert_sessions(
    sessions: DataFrame, deltas: DataFrame, key: str, *, default_title: str = K.DEFAULT_TITLE
) -> DataFrame:
    """Apply message deltas to sessions (key, title, updated_at, messages).

    A title is derived from the first user message only while it still is the default; sessions
    without a delta stay as they are and unknown ones are added.
    """
    old, new = sessions.alias("old"), deltas.alias("new")
    current = F.coalesce(F.col("old.title"), F.lit(default_title))
    derived = F.col("new.first_title")
    # An empty derived title falls back to the title at hand.
    title = F.when(
        (current == default_title) & derived.isNotNull() & (derived != ""), derived
    ).otherwise(current)
    return old.join(new, F.col(f"old.{key}") == F.col(f"new.{key}"), "full_outer").select(
        F.coalesce(F.col(f"old.{key}"), F.col(f"new.{key}")).alias(key),
        title.alias("title"),
        F.coalesce(F.col("new.last_at"), F.col("old.updated_at")).alias("updated_at"),
        F.coalesce(F.col("new.messages"), F.col("old.messages")).alias("messages"),
    )


def delete_never_empty(
    sessions: DataFrame,
    doomed: DataFrame,
    key: str,
    owner: str,
    *,
    title: str = K.DEFAULT_TITLE,
    owners: DataFrame | None = None,
) -> DataFrame:
    """Delete sessions by key; an owner left with none gets one fresh default session.

    ``owners`` lists all owners, also those that never had a session; without it, the owners of ``sessions``. The fresh key is derived from the owner, so a repeated run gives the same row.
    """
    kept = sessions.join(doomed.select(key), key, "left_anti")
    emptied = (sessions if owners is None else owners).select(owner).distinct().join(kept.select(owner).distinct(), owner, "left_anti")
    fresh = emptied.select(
        F.concat(F.lit("session_"), F.sha2(F.col(owner).cast("string"), 256)).alias(key),
        F.col(owner),
        F.lit(title).alias("title"),
    )
    return kept.select(F.col(key).cast("string").alias(key), owner, "title").unionByName(fresh)


def touch(df: DataFrame, changed: Column, updated: str, batch_time: Column) -> DataFrame:
    """Set the update time of changed rows to the batch time, which is a parameter so reruns agree."""
    return df.withColumn(updated, F.when(changed, batch_time).otherwise(F.col(updated)))


def new_profiles(users: DataFrame, profiles: DataFrame, batch_time: Column, *, delimiter: str = "@") -> DataFrame:
    """One profile per user that has none: users (id, email, full_name, avatar_url)."""
    without = users.join(profiles.select("id"), "id", "left_anti").dropDuplicates(["id"])
    return profile_rows(without, batch_time, delimiter=delimiter)


def profile_rows(users: DataFrame, batch_time: Column, *, delimiter: str = "@") -> DataFrame:
    """The profile of each row of users (id, email, full_name, avatar_url)."""
    return users.select(
        "id",
        "email",
        profile_name(F.col("full_name"), F.col("email"), delimiter=delimiter).alias("full_name"),
        "avatar_url",
        F.lit(K.DEFAULT_CLINICAL_ROLE).alias("clinical_role"),
        batch_time.alias("created_at"),
        batch_time.alias("updated_at"),
    )

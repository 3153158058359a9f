"""Table readers and writers with explicit schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.errors import AnalysisException

from evidora import constants as K
from evidora import schemas

TABLES = {
    "profiles": schemas.PROFILE,
    "chat_sessions": schemas.CHAT_SESSION,
    "chat_messages": schemas.CHAT_MESSAGE,
    "chunks": schemas.CHUNK,
    "questions": schemas.QUESTION,
    "guidelines": schemas.GUIDELINE,
    "criteria": schemas.CRITERION,
    "models": schemas.MODEL,
    "rules": schemas.RULE,
    "settings": schemas.SETTING,
}


def read_table(spark: SparkSession, name: str, path: str, *, fmt: str = "parquet") -> DataFrame:
    """Read a table of the data model; JSON rows that do not fit the schema come out null."""
    return spark.read.schema(TABLES[name]).format(fmt).load(path)


def read_or_empty(spark: SparkSession, path: str, schema: T.StructType, *, fmt: str = "parquet") -> DataFrame:
    """Read a path, or an empty table where nothing has been written yet."""
    try:
        return spark.read.schema(schema).format(fmt).load(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


_CORRUPT = "_corrupt_record"


def _session_rows(spark: SparkSession, path: str) -> DataFrame:
    """Parsed as a whole whatever is selected later, as a field that is not read cannot show that it does not fit."""
    schema = T.StructType([*schemas.SESSION.fields]).add(_CORRUPT, "string")
    lines = read_or_empty(spark, path, T.StructType().add("value", "string"), fmt="text")
    return lines.select(F.from_json("value", schema, {"columnNameOfCorruptRecord": _CORRUPT}).alias("row")).select("row.*")


def read_sessions(spark: SparkSession, path: str) -> DataFrame:
    """Nested sessions as JSON lines; a missing path gives no rows.

    Lines that are no JSON, do not fit the schema in any field, or have no id are left out; `rejected_sessions` has them.
    """
    rows = _session_rows(spark, path)
    return rows.filter(F.col("id").isNotNull() & F.col(_CORRUPT).isNull()).drop(_CORRUPT)


def rejected_sessions(spark: SparkSession, path: str) -> DataFrame:
    """Lines that `read_sessions` leaves out: `id` where it could be read, and the `line` unless it only lacks an id."""
    rows = _session_rows(spark, path).filter(F.col("id").isNull() | F.col(_CORRUPT).isNotNull())
    return rows.select("id", F.col(_CORRUPT).alias("line"))


def write_sessions(df: DataFrame, path: str, *, fmt: str = "parquet") -> None:
    """Replace the whole session list. Write to another path than the one being read."""
    df.write.mode("overwrite").format(fmt).save(path)


def append_messages(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def write_bucketed(
    df: DataFrame, table: str, key: str, sort: list[str], buckets: int, *, path: str | None = None
) -> DataFrame:
    """Rows laid out by key, so joins and groupings on it need no shuffle; gives the table.

    Rows are dealt by the hash that also numbers the buckets, so a bucket is one file. Tables that are joined need the same
    number of buckets. With ``path`` the files lie there and the catalog only knows of them.
    """
    writer = df.repartition(buckets, key).write.mode("overwrite").bucketBy(buckets, key).sortBy(key, *sort).format("parquet")
    (writer if path is None else writer.option("path", path)).saveAsTable(table)
    return df.sparkSession.table(table)


def messages_of(sessions: DataFrame) -> DataFrame:
    """Flat message table of nested sessions, with the position in the whole session, also where it is stored in fragments."""
    start = F.coalesce("start", F.lit(0)) if "start" in sessions.columns else F.lit(0)
    return sessions.select(
        F.col("id").alias("session_id"), start.alias("start"), F.posexplode("messages").alias("at", "message")
    ).select("session_id", (F.col("start") + F.col("at")).cast("long").alias("position"), "message.*")


def session_fragments(
    messages: DataFrame, session: str, position: str, columns: list[str], *, size: int = 1000
) -> DataFrame:
    """Nested form: message lists of at most ``size`` neighbouring messages, one row per fragment.

    ``position`` counts from 0 within a session without gaps, so a session of any length is spread over rows; ``start``
    keeps the position of each fragment's first message.
    """
    entry = F.struct(F.col(position), *[F.col(c) for c in columns])
    fragment = F.floor(F.col(position) / size).alias("fragment")
    return messages.groupBy(session, fragment).agg(
        F.array_sort(F.collect_list(entry)).alias("messages"), F.min(position).cast("long").alias("start")
    )


def with_defaults(df: DataFrame, name: str, batch_time=None) -> DataFrame:
    """Fill the column defaults of a relational table at ingest."""
    fills = {
        "profiles": {"clinical_role": F.lit(K.DEFAULT_CLINICAL_ROLE)},
        "chat_sessions": {"title": F.lit(K.DEFAULT_TITLE), "pinned": F.lit(False)},
        "chat_messages": {
            "citations": F.lit("[]"),
            "retrieved_chunks": F.lit("[]"),
            "is_insufficient_evidence": F.lit(False),
        },
    }[name]
    if batch_time is not None:
        fills |= {c: batch_time for c in ("created_at", "updated_at") if c in df.columns}
    return df.withColumns({c: F.coalesce(F.col(c), v) for c, v in fills.items()})

"""Streaming reads of table files and the run of a query to the end of its input."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import DataStreamWriter

from evidora.session import scratch_path


def stream_table(
    spark: SparkSession, folder: str, schema: T.StructType, *, files: str = "*.parquet", per_batch: int | None = None
) -> DataFrame:
    reader = spark.readStream.schema(schema).option("pathGlobFilter", files)
    if per_batch is not None:
        reader = reader.option("maxFilesPerTrigger", per_batch)
    return reader.parquet(folder)


def stream_table_at(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Stream of one table, be it a single file or a folder of files.

    A pattern that only the table's own name fits: Spark takes a plain path to be a folder.
    """
    return stream_table(spark, f"{path[:-1]}[{path[-1]}]", schema, files="*")


def zoned(df: DataFrame, ts: str) -> DataFrame:
    """Watermarks need a timestamp with zone; zone-less values are read in the session zone (UTC)."""
    return df.withColumn(ts, F.col(ts).cast("timestamp"))


def run_to_end(writer: DataStreamWriter, checkpoint: str) -> None:
    """Process all input at hand and stop. A restart with the same checkpoint goes on from there."""
    query = writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    try:
        query.awaitTermination()
    finally:
        query.stop()


def to_files(df: DataFrame, *, path: str | None = None, checkpoint: str | None = None) -> DataFrame:
    """Run a stream into a parquet folder in append mode and return what it holds."""
    spark = df.sparkSession
    path = path or scratch_path(spark, "stream-out")
    checkpoint = checkpoint or scratch_path(spark, "stream-state")
    run_to_end(df.writeStream.format("parquet").option("path", path).outputMode("append"), checkpoint)
    return spark.read.schema(df.schema).parquet(path)

"""Tables laid out in hash buckets of their key: a change rewrites the buckets it touches and no other file."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evidora.session import written

#: Partition column of the layout.
BUCKET = "key_bucket"


def bucket_of(key: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int").alias(BUCKET)


def create_bucket_table(df: DataFrame, path: str, key: str, buckets: int) -> None:
    """Write a table by buckets of its key, replacing what is there.

    Rows with a null key share one bucket. Choose ``buckets`` so that one holds some hundred megabytes; the number belongs
    to the table and has to be given again with each change. A change costs the buckets it touches: a batch whose keys
    are spread over all of them rewrites the whole table.
    """
    laid = df.withColumn(BUCKET, bucket_of(F.col(key), buckets))
    laid.repartition(BUCKET).write.mode("overwrite").partitionBy(BUCKET).parquet(path)


def read_bucket_table(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """All rows, without the partition column."""
    return spark.read.schema(T.StructType([*schema.fields]).add(BUCKET, T.IntegerType())).parquet(path).drop(BUCKET)


def change_bucket_table(
    path: str,
    schema: T.StructType,
    changes: DataFrame,
    key: str,
    buckets: int,
    apply: Callable[[DataFrame, DataFrame], DataFrame],
) -> DataFrame:
    """Apply changes to the buckets that hold their keys; gives the buckets that were touched.

    ``apply(rows, changes)`` gives the new rows of the touched buckets, with the columns of the table and no key that is in
    neither. They are written to the shared folder first, as a partition cannot be read and replaced in one job, and then
    replace their partitions (dynamic overwrite). A bucket whose rows all go keeps a file without rows. If the job is cut
    off between, running it again gives the same table when ``apply`` is idempotent, as merging totals or setting values is.
    """
    spark = changes.sparkSession
    noted = written(changes.withColumn(BUCKET, bucket_of(F.col(key), buckets)), "changes")
    # At most one row per bucket.
    touched = noted.select(BUCKET).distinct()
    stored = spark.read.schema(T.StructType([*schema.fields]).add(BUCKET, T.IntegerType())).parquet(path)
    rows = stored.join(F.broadcast(touched), BUCKET, "left_semi").drop(BUCKET)
    fresh = apply(rows, noted.drop(BUCKET)).select(*schema.fieldNames())
    after = written(fresh.withColumn(BUCKET, bucket_of(F.col(key), buckets)), "changed")
    after.repartition(BUCKET).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(BUCKET).parquet(path)
    emptied = touched.join(after.select(BUCKET).distinct(), BUCKET, "left_anti")
    _write_emptied(emptied, path, schema)
    return touched


def _write_emptied(emptied: DataFrame, path: str, schema: T.StructType) -> None:
    """Dynamic overwrite leaves partitions alone that get no row, so those without rows left are emptied by name."""
    spark = emptied.sparkSession
    for row in emptied.toLocalIterator():
        spark.createDataFrame([], schema).write.mode("overwrite").parquet(f"{path}/{BUCKET}={row[BUCKET]}")

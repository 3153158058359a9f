"""Connected components over link tables, and union of links inside one task."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidora.session import scratch_path


def stored(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """The table written to the shared folder, and its path."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def remove(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def united(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The values that some pair links with another one, and for each the smallest value it reaches."""
    values, index = np.unique(np.concatenate([a, b]), return_inverse=True)
    parent = np.arange(len(values))
    x, y = index[: len(a)], index[len(a) :]
    while len(x):
        while not np.array_equal(up := parent[parent], parent):
            parent = up
        x, y = parent[x], parent[y]
        apart = x != y
        x, y = x[apart], y[apart]
        np.minimum.at(parent, np.maximum(x, y), np.minimum(x, y))
    return values, values[parent]


def components(links: DataFrame, hint: str | None = None) -> DataFrame:
    """`node` and `root` (smallest node reachable) of every node of links `a`, `b` (long).

    Large-star and small-star steps: each node's neighbours are tied to the smallest of them, until each node hangs on one root.
    Minima are partial aggregates and ties are joins, so a node with very many links is neither gathered nor sorted in one task.
    A round makes both ends of a link from one row and sheds repeated links once, at its end, and no round is spent on finding that
    nothing changes: the driver keeps records of every stage and task. Each round is written to the shared folder, which cuts the
    lineage and survives lost executors; the round before is then deleted. Links with a null end are left out; a link of a node
    with itself makes it a node of its own. Minima are joined with this hint: "merge" keeps small ones from being broadcast, each of
    which takes some MB of the driver until it is cleaned.
    """
    spark = links.sparkSession
    hinted = (lambda df: df) if hint is None else (lambda df: df.hint(hint))
    clean = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    links, path = stored(clean.where(F.col("a").isNotNull() & F.col("b").isNotNull()).distinct(), "links")
    while True:
        both = links.select(F.expr("inline(array((a as u, b as v), (b as u, a as v)))"))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(hinted(low), "u").where("v >= u").select(F.col("v").alias("a"), F.col("m").alias("b"))
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(hinted(low), "a")
        small = small.select(F.expr("inline(if(b = m, array((a as a, m as b)), array((a as a, m as b), (b as a, m as b))))"))
        links, last = stored(small.distinct(), "links")
        remove(spark, path)
        path = last
        if _settled(links):
            break
    roots = links.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return links.where("a <> b").select(F.col("a").alias("node"), F.col("b").alias("root")).union(roots)


def _settled(links: DataFrame) -> bool:
    """Whether each node hangs on one root that hangs on nothing."""
    ends = links.select(F.expr("inline(array((a as node, int(a <> b) as ties), (b as node, -1 as ties)))"))
    odd = ends.groupBy("node").agg(F.sum(F.greatest("ties", F.lit(0))).alias("ties"), F.min("ties").alias("least"))
    return not odd.where("ties > if(least < 0, 0, 1)").agg(F.count("*")).first()[0]

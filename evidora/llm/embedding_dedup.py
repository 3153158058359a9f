"""Embedding near-dedup by a pivot-permutation index.

Reference vectors (pivots) are taken from a bounded sample, no two of them close to each other. A vector is described by its
`top` nearest pivots in order of distance. Vectors that share at least two of these are candidates: the inverted lists are
kept by pair of pivots, so that a list holds exactly the vectors whose descriptions share both. Candidates are verified by
cosine in double precision. A pair that shares more pivots meets in several lists and counts in one: that of the two
smallest pivots it shares.

Copies of a vector are one node with a weight. A list longer than BLOCK is cut into blocks by a hash, and each pair of blocks
is verified by a task of its own. Tasks return the number of links of each vector and a spanning set of links, never all
pairs, so what leaves a dense group grows with its members.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidora.llm import text as tx
from evidora.llm.components import components, stored, united

COSINE = 0.98
TOP = 6
#: Vectors looked at to choose pivots, the bounds of their number (about the root of the vectors), and how alike two may be.
SAMPLE, LEAST_PIVOTS, MOST_PIVOTS, PIVOT_COSINE = 8192, 128, 1024, 0.6
#: Vectors of a list that one task compares with each other.
BLOCK = 4096
#: Lists up to this length are compared together, step by step; longer ones as matrices.
SMALL = 48


def _usable(vector: str, label: str):
    finite = f"forall({vector}, x -> x is not null and not isnan(x) and abs(x) < double('infinity'))"
    return F.expr(f"{label} is not null and {finite} and exists({vector}, x -> x <> 0)")


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    matrix = flat.reshape(-1, dims)
    scale = np.abs(matrix).max(axis=1, keepdims=True)  # squares of very large or small values stay finite
    matrix = matrix / scale
    return matrix / np.linalg.norm(matrix, axis=1, keepdims=True)


def pivots(nodes: DataFrame, number: int) -> np.ndarray:
    """At most `number` vectors of one length from the sample, each less alike to all before it than PIVOT_COSINE."""
    rows = nodes.orderBy(F.xxhash64("vec_id", "embedding")).limit(SAMPLE).select("embedding").collect()
    vectors = [np.array(r.embedding, np.float64) for r in rows]
    vectors = [v / np.abs(v).max() for v in vectors]
    chosen = np.zeros((0, len(vectors[0]) if vectors else 1))
    for v in vectors:
        if len(chosen) >= number:
            break
        v = v / np.linalg.norm(v)
        if not len(chosen) or (chosen @ v).max() < PIVOT_COSINE:
            chosen = np.vstack([chosen, v])
    return chosen


def _describe(batches: Iterator[pa.RecordBatch], chosen: np.ndarray, top: int) -> Iterator[pa.RecordBatch]:
    """Each vector's nearest pivots in order."""
    for batch in batches:
        if not batch.num_rows:
            continue
        near = _matrix(batch.column("embedding"), chosen.shape[1]) @ chosen.T
        k = min(top, len(chosen))
        order = np.argsort(-near, axis=1, kind="stable")[:, :k].astype(np.int32)
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(order) + 1) * k, pa.int32()), pa.array(order.ravel()))
        yield pa.RecordBatch.from_arrays([*batch.columns, lists], [*batch.schema.names, "near"])


def _verify(batches: Iterator[pa.RecordBatch], least: float, n_pivots: int) -> Iterator[pa.RecordBatch]:
    """Rows in the order of their list: per vector its links (weighted), and spanning links."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        held.append(batch)
        size += batch.num_rows
        if size < 2 * BLOCK:
            continue
        table = pa.Table.from_batches(held).combine_chunks()
        cut = int(np.flatnonzero(_new_list(table))[-1])  # the last list may go on in the next batch
        if cut:
            yield from _links(table.slice(0, cut), least, n_pivots)
            held, size = table.slice(cut).combine_chunks().to_batches(), table.num_rows - cut
    if size:
        yield from _links(pa.Table.from_batches(held).combine_chunks(), least, n_pivots)


def _new_list(table: pa.Table) -> np.ndarray:
    new = np.zeros(table.num_rows, bool)
    new[0] = True
    for name in ("label", "pair", "left", "right"):
        values = table.column(name).to_numpy()
        new[1:] |= values[1:] != values[:-1]
    return new


def _lists(column: pa.ChunkedArray) -> pa.Array:
    return column.combine_chunks() if not column.num_chunks == 1 else column.chunk(0)


def _shared_up_to(near: np.ndarray, edge: np.ndarray, n_pivots: int) -> np.ndarray:
    """Bits of the pivots in each row of `near` that are not above `edge`."""
    bits = np.zeros((len(near), -(-n_pivots // 64)), np.uint64)
    for pivot in near.T:
        some = np.flatnonzero(pivot <= edge)
        bits[some, pivot[some] // 64] |= np.uint64(1) << (pivot[some] % 64).astype(np.uint64)
    return bits


def _links(table: pa.Table, least: float, n_pivots: int) -> Iterator[pa.RecordBatch]:
    first, last = tx.runs(_new_list(table))
    length = last - first
    rows = tx.ranges(first[length > 1], length[length > 1])
    if not len(rows):
        return
    table = table.take(pa.array(rows)).combine_chunks()
    length = length[length > 1]
    last = np.cumsum(length)
    first = last - length
    node, weight, block = (table.column(c).to_numpy() for c in ("vec_id", "weight", "block"))
    alone = table.column("left").to_numpy() == table.column("right").to_numpy()
    vectors, near = _lists(table.column("embedding")), _lists(table.column("near"))
    matrix = _matrix(vectors, len(vectors.flatten()) // len(vectors))
    near = near.flatten().to_numpy().reshape(len(near), -1)
    bits = _shared_up_to(near, table.column("pair").to_numpy() % n_pivots, n_pivots)
    found: list[tuple[np.ndarray, np.ndarray]] = []

    def count(a: np.ndarray, b: np.ndarray) -> None:
        """Keep the pairs that count in this list: no smaller pair of pivots is shared, and this task has these blocks."""
        own = alone[a] | (block[a] != block[b])
        if near.shape[1] > 1:  # one pivot or none to share makes one list, where every pair counts
            own &= np.bitwise_count(bits[a] & bits[b]).sum(axis=1) == 2
        found.append((a[own], b[own]))

    small = length <= SMALL
    at, end = tx.ranges(first[small], length[small]), np.repeat(last[small], length[small])
    step = 1
    while len(at := at[(more := at + step < end)]):
        end = end[more]
        close = at[np.einsum("ij,ij->i", matrix[at], matrix[at + step]) >= least]
        count(close, close + step)
        step += 1
    for lo, hi in zip(first[~small], last[~small], strict=True):
        for start in range(lo, hi, 256):
            a, b = np.nonzero(matrix[start : min(start + 256, hi)] @ matrix[start:hi].T >= least)
            count(start + a[a < b], start + b[a < b])
    a, b = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (rows[:0], rows[:0])
    if not len(a):
        return
    names, at = np.unique(node, return_inverse=True)
    links = np.bincount(at[a], weight[b], len(names)) + np.bincount(at[b], weight[a], len(names))
    values, roots = united(node[a], node[b])
    reach = names.copy()
    reach[np.searchsorted(names, values)] = roots
    some = links > 0
    yield pa.RecordBatch.from_arrays(
        [pa.array(names[some]), pa.array(links[some].astype(np.int64)), pa.array(reach[some])], ["vec_id", "links", "root"]
    )


def _search(nodes: DataFrame, least: float, top: int) -> DataFrame:
    """Links of vectors of one length (`vec_id`, `label`, `weight`, `embedding`): `vec_id`, `links`, `root`, per list."""
    spark = nodes.sparkSession
    number = 1 << max(0, int(nodes.count() ** 0.5) - 1).bit_length()
    chosen = pivots(nodes, min(max(number, LEAST_PIVOTS), MOST_PIVOTS))
    n = len(chosen)
    described, _ = stored(
        nodes.mapInArrow(
            lambda batches: _describe(batches, chosen, top),
            "vec_id long, label long, weight long, embedding array<double>, near array<int>",
        ),
        "described",
    )
    k = min(top, n)
    if k < 2:  # the vectors are so alike that one pivot describes all: one list
        pairs = F.array(F.lit(0).cast("long"))
    else:
        near = [F.col("near")[i] for i in range(k)]
        both = [(near[i], near[j]) for i in range(k) for j in range(i)]
        pairs = F.array(*((F.least(a, b) * n + F.greatest(a, b)).cast("long") for a, b in both))
    lists = described.withColumn("pair", F.explode(pairs))
    long, _ = stored(lists.groupBy("label", "pair").count().where(F.col("count") > BLOCK), "lists")
    parts = F.coalesce(F.ceil(F.col("count") / BLOCK), F.lit(1)).cast("int")
    cut = lists.join(long, ["label", "pair"], "left").withColumn("parts", parts)
    cut = cut.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.col("parts")).cast("int"))
    cut = cut.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    cut = cut.select(
        "vec_id",
        "label",
        "weight",
        "embedding",
        "near",
        "pair",
        "block",
        F.least("block", "other").alias("left"),
        F.greatest("block", "other").alias("right"),
    )
    where = ["label", "pair", "left", "right"]
    dealt = cut.repartition(*where).sortWithinPartitions(*where)
    return dealt.mapInArrow(lambda batches: _verify(batches, least, n), "vec_id long, links long, root long")


def near_vectors(
    vectors: DataFrame,
    *,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
    least: float = COSINE,
    top: int = TOP,
) -> DataFrame:
    """`vec_id`, `n_links` (other rows linked directly), `component_id` (smallest id reachable) and `kept`, per input row.

    Only vectors with equal labels, not null, and equal length are compared. Vectors that are null, empty, zero or hold null
    or non-finite values link with nothing, nor do rows without an id (their `component_id` and `kept` are null). Rows that
    repeat are copies and link with each other; rows of one id are one node. An empty table gives an empty result. Columns
    besides these three are not looked at.
    """
    rows = vectors.select(
        F.col(id_col).cast("long").alias("vec_id"),
        F.xxhash64(F.col(label_col).cast("string")).alias("label"),
        F.col(vector_col).cast("array<double>").alias("embedding"),
        (F.col(id_col).isNotNull() & _usable(f"`{vector_col}`", f"`{label_col}`")).alias("usable"),
    ).withColumn("usable", F.coalesce("usable", F.lit(False)))
    usable = rows.where("usable")
    nodes, _ = stored(
        usable.groupBy("label", "embedding").agg(F.min("vec_id").alias("vec_id"), F.count("*").alias("weight")), "vectors"
    )
    lengths = [r.n for r in nodes.select(F.size("embedding").alias("n")).distinct().collect()]
    found = None
    for n in sorted(lengths):
        part = _search(nodes.where(F.size("embedding") == n).select("vec_id", "label", "weight", "embedding"), least, top)
        found = part if found is None else found.union(part)
    out = rows.where("not usable").select(
        "vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id")
    )
    if found is not None:
        found, _ = stored(found, "found")
        links = found.groupBy("vec_id").agg(F.sum("links").alias("links"))
        # Vectors of one id are one node even if their texts differ.
        roots = components(found.select(F.col("vec_id").alias("a"), F.col("root").alias("b")))
        judged = (
            nodes.join(links, "vec_id", "left")
            .join(roots.withColumnRenamed("node", "vec_id"), "vec_id", "left")
            .select(
                "label",
                "embedding",
                (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"),
                F.coalesce("root", "vec_id").alias("component_id"),
            )
        )
        own = usable.select("vec_id", "label", "embedding").join(judged, ["label", "embedding"])
        out = own.select("vec_id", "n_links", "component_id").union(out)
    return out.withColumn("kept", F.col("vec_id") == F.col("component_id"))


def op2_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of all embeddings at cosine 0.98."""
    return near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


OP2_SQL = f"""
WITH RECURSIVE v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE label IS NOT NULL AND list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[])) > 0
), links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id
  WHERE list_cosine_similarity(a.e, b.e) >= {COSINE}
), reach AS (
  SELECT vec_id AS a, vec_id AS b FROM v
  UNION
  SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a
), roots AS (
  SELECT a, min(b) AS root FROM reach GROUP BY a
)
SELECT vec_id, CAST((SELECT count(*) FROM links l WHERE l.a = e.vec_id) AS BIGINT) AS n_links,
  coalesce(root, vec_id) AS component_id, coalesce(root, vec_id) = vec_id AS kept
FROM embeddings e LEFT JOIN roots ON a = vec_id
"""

"""Vector retrieval: exact and approximate top-k by cosine similarity.

Pairs are never written out: tasks multiply bounded blocks of queries and chunks, and only the k best chunks per query
leave them. Blocks are grouped around reference points. By the triangle inequality on angles, no chunk within the angle `r`
of a reference point can be closer to a query than the query's own angle to that point less `r`; a block that cannot reach a
query's k-th best score is skipped.

* few queries: their matrix (size checked) is broadcast and chunks are scanned where they lie, each batch cut into blocks
  around reference points taken from the queries;
* many queries: an inverted file (`operators/cells.py`). Every query looks into its nearest cell first; the k-th score found
  there decides which cells it has to visit. Cells lie together in parts of a block of chunks each, and a query goes to a part
  once, with a bit for each cell: vectors move once for each pair of blocks, however many cells there are;
* approximate: the same inverted file with a fixed number of cells for each query.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evidora.operators.cells import (
    Cells, Parts, fit_cells, least_angles, nearest_cells, number_of_cells, place, probes_for, reaching_cells, sample_of, unit_rows,
)
from evidora.operators.ranking import top_k_per_group
from evidora.session import written

# The task functions travel with the job, so executors do not need this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Queries up to this size go to every task, which holds their best chunks; more of them are cut into blocks like the chunks.
BROADCAST_BYTES = 1 << 20
QUERY_BLOCK = 16_384
#: Smaller blocks of queries, down to so many, where there are too few for this many tasks.
LEAST_QUERIES, LEAST_TASKS = 1_024, 16
CHUNK_BLOCK = 32_768
_TILE_SCORES = 2 << 20
SCORE_PLACES = 6


def searchable(vec: str) -> Column:
    """Vectors that take part in a search: not null, not empty, all elements present and finite."""
    return F.expr(f"size({vec}) > 0 and forall({vec}, x -> x is not null and not isnan(x) and abs(x) < double('infinity'))")


def set_aside(df: DataFrame, vec: str) -> DataFrame:
    """Rows whose vector no search looks at, for a report or a repair."""
    return df.filter(~F.coalesce(searchable(vec), F.lit(False)))


def _same_length(queries: np.ndarray, chunks: np.ndarray) -> None:
    if len(queries) and len(chunks) and queries.shape[1] != chunks.shape[1]:
        raise ValueError(f"queries have {queries.shape[1]} dimensions, chunks {chunks.shape[1]}")


def ids_of(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    return column.to_numpy() if isinstance(column, pa.ChunkedArray) else column.to_numpy(zero_copy_only=False)


def best_of_block(
    query_ids: np.ndarray,
    queries: np.ndarray,
    chunk_ids: np.ndarray,
    chunks: np.ndarray,
    k: int,
    exclude_self: bool,
    cut: bool = True,
) -> pd.DataFrame:
    """The k best chunks per query of one block, ties broken by the smaller chunk id; all ties of the k-th without `cut`."""
    _same_length(queries, chunks)
    parts = []
    scale = 10.0**SCORE_PLACES
    # A tile of queries at a time, so that the score matrix stays within 16 MB.
    tile = max(1, _TILE_SCORES // max(1, len(chunk_ids)))
    for start in range(0, len(query_ids), tile):
        ids = query_ids[start : start + tile]
        scores = np.floor(queries[start : start + tile] @ chunks.T * scale + 0.5) / scale
        if exclude_self:
            scores[ids[:, None] == chunk_ids[None, :]] = -np.inf
        if scores.shape[1] > k:
            border = np.partition(scores, scores.shape[1] - k, axis=1)[:, scores.shape[1] - k]
            rows, cols = np.nonzero(scores >= border[:, None])
        else:
            rows, cols = np.nonzero(scores > -np.inf)
        part = pd.DataFrame({"query_id": ids[rows], "chunk_id": chunk_ids[cols], "score": scores[rows, cols]})
        part = part[part["score"] > -np.inf]
        parts.append(_head_per_query(part, k) if cut else part)
    if not parts:
        return pd.DataFrame({"query_id": query_ids[:0], "chunk_id": chunk_ids[:0], "score": np.zeros(0)})
    return pd.concat(parts, ignore_index=True)


def _head_per_query(pairs: pd.DataFrame, k: int) -> pd.DataFrame:
    return (
        pairs.sort_values(["query_id", "score", "chunk_id"], ascending=[True, False, True])
        .groupby("query_id", sort=False)
        .head(k)
    )


def _pair_schema(queries: DataFrame, query_id: str, chunks: DataFrame, chunk_id: str) -> T.StructType:
    return (
        T.StructType()
        .add("query_id", queries.schema[query_id].dataType)
        .add("chunk_id", chunks.schema[chunk_id].dataType)
        .add("score", "double")
    )


#: Reference points of a scan: one for so many queries, at most so many.
QUERIES_PER_REFERENCE, MOST_REFERENCES, REFERENCE_SAMPLE = 64, 24, 4_096
#: Scores are rounded; a block is skipped only below this distance from a query's k-th score.
_SLACK = 10.0**-SCORE_PLACES


class BlockScan:
    """The k best chunks of some queries, block by block; counts the pairs it compared and the blocks' pairs it skipped."""

    def __init__(self, ids: np.ndarray, queries: np.ndarray, k: int, exclude_self: bool):
        self.ids, self.queries, self.k, self.exclude_self = ids, queries, k, exclude_self
        some = queries[:: max(1, len(queries) // REFERENCE_SAMPLE)]
        self.points = fit_cells(some, min(MOST_REFERENCES, 1 + len(queries) // QUERIES_PER_REFERENCE), rounds=4)
        self.angles = least_angles(queries, self.points)
        self.home = self.angles.argmin(axis=1) if len(queries) else np.zeros(0, np.int64)
        self.least = np.full(len(ids), -np.inf)  # each query's k-th score so far
        self.at = pd.Series(np.arange(len(ids)), index=ids)
        self.best: pd.DataFrame | None = None
        self.compared = self.skipped = 0

    def add(self, chunk_ids: np.ndarray, chunks: np.ndarray) -> None:
        _same_length(self.queries, chunks)
        angles = least_angles(chunks, self.points)
        cell = angles.argmin(axis=1)
        blocks = [(p, rows, angles[rows, p].max()) for p in np.unique(cell) if len(rows := np.flatnonzero(cell == p))]
        # Each query's own block first: it gives the score that the other blocks have to reach.
        pairs = [(np.flatnonzero(self.home == p), rows) for p, rows, _ in blocks]
        self._merge([self._best(wanted, chunk_ids, chunks, rows) for wanted, rows in pairs])
        others = []
        for point, rows, widest in blocks:
            away = np.flatnonzero(self.home != point)
            nearest = np.maximum(self.angles[away, point] - widest, 0.0)
            others.append((away[np.cos(nearest) + _SLACK >= self.least[away]], rows))
        self.compared += sum(len(wanted) * len(rows) for wanted, rows in pairs + others)
        self.skipped += len(self.ids) * len(chunk_ids) - sum(len(w) * len(rows) for w, rows in pairs + others)
        if 2 * sum(len(wanted) * len(rows) for wanted, rows in others) > len(self.ids) * len(chunk_ids):
            others = [(np.arange(len(self.ids)), np.arange(len(chunk_ids)))]  # one large product is faster than many
        self._merge([self._best(wanted, chunk_ids, chunks, rows) for wanted, rows in others])

    def _best(self, wanted: np.ndarray, chunk_ids: np.ndarray, chunks: np.ndarray, rows: np.ndarray) -> pd.DataFrame:
        large = len(wanted) * len(rows) > _TILE_SCORES // 8  # copies may tie all over a large block
        found = best_of_block(
            self.ids[wanted], self.queries[wanted], chunk_ids[rows], chunks[rows], self.k, self.exclude_self, large
        )
        # Most of what a later block gives does not enter the best.
        return found[found["score"].to_numpy() >= self.least[self.at[found["query_id"]].to_numpy()]]

    def _merge(self, found: list[pd.DataFrame]) -> None:
        parts = [part for part in [self.best, *found] if part is not None and len(part)]
        if not parts:
            return
        every = pd.concat(parts, ignore_index=True).drop_duplicates(["query_id", "chunk_id"])
        self.best = _head_per_query(every, self.k)
        own = self.best.groupby("query_id")["score"]
        full = own.min()[own.size() >= self.k]
        self.least[self.at[full.index].to_numpy()] = full.to_numpy()


def _scan_with_broadcast(queries: DataFrame, chunks: DataFrame, k: int, exclude_self: bool, schema) -> DataFrame:
    local = queries.toArrow()
    shared = chunks.sparkSession.sparkContext.broadcast((ids_of(local["id"]), unit_rows(local["vec"])))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, matrix = shared.value
        found = None
        for batch in batches:
            if batch.num_rows == 0 or len(ids) == 0:
                continue
            found = found or BlockScan(ids, matrix, k, exclude_self)
            found.add(ids_of(batch.column("id")), unit_rows(batch.column("vec")))
        if found is not None and found.best is not None:
            yield pa.RecordBatch.from_pandas(found.best, preserve_index=False)

    return chunks.select("id", "vec").mapInArrow(scan, schema)


def best_in_cells(
    query_ids: np.ndarray,
    queries: np.ndarray,
    visits: np.ndarray,
    least: np.ndarray,
    chunk_ids: np.ndarray,
    chunks: np.ndarray,
    cell: np.ndarray,
    k: int,
    exclude_self: bool,
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of the queries and of the chunks, and scores, of the k best chunks per query in the cells that it visits.

    `visits` has a flag for each query and cell. Only scores of at least `least` count; what a query has found in some cells
    raises it for the others, so that few scores of a cell are looked at again.
    """
    _same_length(queries, chunks)
    scale = 10.0**SCORE_PLACES
    floor = least.copy()
    rank = np.empty(len(chunk_ids), np.int64)
    rank[np.argsort(chunk_ids, kind="stable")] = np.arange(len(chunk_ids))
    own = _equal_ids(query_ids, chunk_ids) if exclude_self else None
    found, pending = [], 0
    by_cell = np.argsort(cell, kind="stable")
    for rows in np.split(by_cell, np.flatnonzero(np.diff(cell[by_cell])) + 1):
        wanted = np.flatnonzero(visits[:, cell[rows[0]]]) if len(rows) else rows
        # A tile of queries at a time, so that the score matrix stays small.
        tile = max(1, _TILE_SCORES // max(1, len(rows)))
        block = chunks[rows].T
        for start in range(0, len(wanted), tile):
            asked = wanted[start : start + tile]
            scores = queries[asked] @ block
            if own is not None:
                _strike(scores, own, asked, rows)
            border = floor[asked]
            if len(rows) > k and (border == -np.inf).any():
                border = np.maximum(border, np.partition(scores, len(rows) - k, axis=1)[:, len(rows) - k])
            at, to = np.nonzero(scores >= (border - _SLACK)[:, None])
            score = scores[at, to]
            at, to, score = asked[at], rows[to], np.floor(score * scale + 0.5) / scale
            part = [x[(score > -np.inf) & (score >= floor[at])] for x in (at, to, score)]
            if len(part[0]) > 8 * k * len(asked):  # many copies
                part = _k_best(*part, rank, k)
            found.append(part)
            pending += len(part[0])
            if pending > 4 * k * len(queries):
                found = [_k_best(*map(np.concatenate, zip(*found, strict=True)), rank, k)]
                held, pending = found[0], 0
                full = np.flatnonzero(np.bincount(held[0], minlength=len(queries)) >= k)
                floor[full] = np.maximum(floor[full], held[2][np.searchsorted(held[0], full, side="right") - 1])
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    return _k_best(*map(np.concatenate, zip(*found, strict=True)), rank, k)


def _k_best(query: np.ndarray, chunk: np.ndarray, score: np.ndarray, rank: np.ndarray, k: int):
    """The k first chunks of each query by falling score, then rank; in the order of the queries."""
    order = np.lexsort((rank[chunk], -score, query))
    query = query[order]
    place = np.arange(len(query)) - np.searchsorted(query, query)
    kept = order[place < k]
    return query[place < k], chunk[kept], score[kept]


def _equal_ids(query_ids: np.ndarray, chunk_ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of the queries and of the chunks of equal ids."""
    sides = [pd.DataFrame({"id": ids, "row": np.arange(len(ids))}) for ids in (query_ids, chunk_ids)]
    same = sides[0].merge(sides[1], on="id")
    return same["row_x"].to_numpy(), same["row_y"].to_numpy()


def _strike(scores: np.ndarray, own: tuple[np.ndarray, np.ndarray], asked: np.ndarray, rows: np.ndarray) -> None:
    """Take a query's own chunk out of the scores of the rows `asked` against the chunks `rows`, both ascending."""
    at, to = np.searchsorted(asked, own[0]).clip(0, len(asked) - 1), np.searchsorted(rows, own[1]).clip(0, len(rows) - 1)
    here = (asked[at] == own[0]) & (rows[to] == own[1])
    scores[at[here], to[here]] = -np.inf


def _grid(queries: DataFrame, chunks: DataFrame, parts: Parts, k: int, exclude_self: bool, schema) -> DataFrame:
    """Block search of queries (part, qp, id, vec, least, cells) against chunks (part, qp, id, vec, cell) of equal part and qp."""
    low, high = parts.low, parts.high

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        query_ids, chunk_ids = ids_of(left["id"]), ids_of(right["id"])
        query, chunk, score = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        if len(query_ids) and len(chunk_ids):
            part = left["part"][0].as_py()
            bits = np.frombuffer(b"".join(left["cells"].to_pylist()), np.uint8).reshape(len(query_ids), -1)
            visits = np.unpackbits(bits, axis=1, count=int(high[part] - low[part])).astype(bool)
            query, chunk, score = best_in_cells(
                query_ids, unit_rows(left["vec"]), visits, left["least"].fill_null(-np.inf).to_numpy(),
                chunk_ids, unit_rows(right["vec"]), right["cell"].to_numpy() - low[part], k, exclude_self,
            )
        return pa.table(
            {
                "query_id": pa.array(query_ids[query], left["id"].type),
                "chunk_id": pa.array(chunk_ids[chunk], right["id"].type),
                "score": pa.array(score, pa.float64()),
            }
        )

    keys = ["part", "qp"]
    return (
        queries.select(*keys, "id", "vec", "least", "cells").groupBy(*keys)
        .cogroup(chunks.select(*keys, "id", "vec", "cell").groupBy(*keys))
        .applyInArrow(search, schema)
    )


def _final(pairs: DataFrame, k: int) -> DataFrame:
    return top_k_per_group(pairs, ["query_id"], [F.col("score").desc(), F.col("chunk_id")], k)


def exact_top_k(
    queries: DataFrame,
    chunks: DataFrame,
    k: int,
    *,
    query_id: str = "query_id",
    query_vec: str = "query_vec",
    chunk_id: str = "chunk_id",
    chunk_vec: str = "chunk_vec",
    exclude_self: bool = False,
    broadcast_bytes: int = BROADCAST_BYTES,
    query_block: int = QUERY_BLOCK,
    chunk_block: int = CHUNK_BLOCK,
) -> DataFrame:
    """(query_id, chunk_id, score, rank) of the k most similar chunks per query, exactly.

    Scores are rounded to six places before ranking and ties go to the smaller chunk id, so the
    result does not depend on how blocks fall. Vectors that are null, empty or hold null or non-finite elements are set
    aside (`set_aside` lists them); a zero vector scores 0.0 with every other. Vectors of different lengths are an error.
    """
    schema = _pair_schema(queries, query_id, chunks, chunk_id)
    if k == 0:
        return queries.sparkSession.createDataFrame([], schema).withColumn("rank", F.lit(0).cast("bigint"))
    q = queries.select(F.col(query_id).alias("id"), F.col(query_vec).alias("vec")).filter(searchable("vec"))
    c = chunks.select(F.col(chunk_id).alias("id"), F.col(chunk_vec).alias("vec")).filter(searchable("vec"))
    n_values = q.agg(F.coalesce(F.sum(F.size("vec")), F.lit(0))).first()[0]
    if n_values * 8 <= broadcast_bytes:
        return _final(_scan_with_broadcast(q, c, k, exclude_self, schema), k)
    rows, sample = sample_of(c)
    cells, placed = _placed(c, sample, number_of_cells(rows), 8)
    parts = Parts.of(cells, chunk_block)
    first = _in_cells(nearest_cells(q, cells, parts, 1), placed, parts, k, exclude_self, schema, query_block)
    # Narrow rows: the k-th score found in the nearest cell bounds what is looked for in the others.
    first = written(_final(first, k).filter(F.col("rank") == k).select("query_id", "score"), "nearest")
    bounded = q.join(first.select(F.col("query_id").alias("id"), F.col("score").alias("least")), "id", "left")
    return _final(_in_cells(reaching_cells(bounded, cells, parts), placed, parts, k, exclude_self, schema, query_block), k)


def _placed(chunks: DataFrame, sample: np.ndarray, cells: int, rounds: int) -> tuple[Cells, DataFrame]:
    """An inverted file of the chunks (id, vec): its cells, and the rows with their cell, written once."""
    points = fit_cells(sample, cells, rounds=rounds)
    placed = written(place(chunks, points), "cells")
    return Cells.of(points, placed), placed


def _in_cells(
    visits: DataFrame, placed: DataFrame, parts: Parts, k: int, exclude_self: bool, schema, query_block: int
) -> DataFrame:
    """The k best chunks of each query in each part that it visits (id, vec, least, part, cells)."""
    asked = visits.groupBy("part").agg(F.count("*")).collect()
    session = visits.sparkSession
    cut = session.createDataFrame(
        [(part, max(-(-n // query_block), min(LEAST_TASKS, n // LEAST_QUERIES))) for part, n in asked], "part int, q_parts int"
    )
    rows = [(cell, int(first), int(among)) for cell, (first, among) in enumerate(zip(parts.first, parts.among, strict=True))]
    cells = session.createDataFrame(rows, "cell int, first int, among int")
    # At most a row for each cell, and for each block of chunks.
    left = visits.join(F.broadcast(cut), "part").withColumn("qp", F.pmod(F.xxhash64("id"), F.col("q_parts")).cast("int"))
    dealt = placed.join(F.broadcast(cells), "cell").withColumn(
        "part", (F.col("first") + F.pmod(F.xxhash64("id"), F.col("among"))).cast("int")
    )
    right = dealt.join(F.broadcast(cut), "part").withColumn("qp", F.explode(F.sequence(F.lit(0), F.col("q_parts") - 1)))
    return _grid(left, right, parts, k, exclude_self, schema)


def approx_top_k(
    queries: DataFrame,
    chunks: DataFrame,
    k: int,
    *,
    query_id: str = "query_id",
    query_vec: str = "query_vec",
    chunk_id: str = "chunk_id",
    chunk_vec: str = "chunk_vec",
    exclude_self: bool = False,
    cells: int | None = None,
    probes: int | None = None,
    share: float | None = None,
    recall: float = 0.9,
    rounds: int = 8,
    query_block: int = QUERY_BLOCK,
    chunk_block: int = CHUNK_BLOCK,
) -> DataFrame:
    """Top-k among the chunks of the cells nearest to the query; scores are exact.

    Cells are k-means cells fitted on a bounded sample (`cells.SAMPLE_BYTES`); every chunk is in one of them. A query visits
    ``probes`` cells, or ``share`` of them, or as many as give the wanted ``recall`` among the vectors of the sample. Queries
    that meet fewer than k chunks are searched exactly, so none comes back short while there are k chunks.
    """
    schema = _pair_schema(queries, query_id, chunks, chunk_id)
    q = queries.select(F.col(query_id).alias("query_id"), F.col(query_vec).alias("vec")).filter(searchable("vec"))
    c = chunks.select(F.col(chunk_id).alias("id"), F.col(chunk_vec).alias("vec")).filter(searchable("vec"))
    wanted = k + 1 if exclude_self else k

    rows, sample = sample_of(c)
    # Copies: a result can only hold the first ids among equal vectors.
    # The hash goes first in keys, so that sorting compares numbers and rarely whole vectors.
    c = top_k_per_group(c.withColumn("hash", F.xxhash64("vec")), ["hash", "vec"], [F.col("id")], wanted)
    distinct = q.groupBy("vec").agg(F.min("query_id").alias("id")).select("id", "vec")

    index, placed = _placed(c.select("id", "vec"), sample, cells or number_of_cells(rows), rounds)
    if probes is None and share is not None:
        probes = max(1, int(np.ceil(share * len(index.points))))
    if probes is None:
        probes = probes_for(sample, index.points, k, recall)
    parts = Parts.of(index, chunk_block)
    pairs = _in_cells(nearest_cells(distinct, index, parts, probes), placed, parts, wanted, False, schema, query_block)
    # Narrow rows, written once: how many were found decides who is searched again.
    best = written(_final(pairs, wanted), "approximate")
    enough = best.filter(F.col("rank") == wanted).select("query_id")
    short = distinct.join(enough, distinct["id"] == enough["query_id"], "left_anti")
    if not short.isEmpty():
        whole = exact_top_k(short, placed, wanted, query_id="id", query_vec="vec", chunk_id="id", chunk_vec="vec")
        best = best.join(enough, "query_id", "left_semi").unionByName(whole.select(*best.columns))
    entry = F.struct("rank", "chunk_id", "score")
    found = best.groupBy("query_id").agg(F.array_sort(F.collect_list(entry)).alias("found"))

    # Hand the result of each distinct vector to all queries that hold a copy of it.
    per_vector = distinct.select("vec", F.col("id").alias("vector_id")).join(
        found.withColumnRenamed("query_id", "vector_id"), "vector_id"
    )
    listed = q.join(per_vector, "vec").select("query_id", "found")
    if exclude_self:
        listed = listed.withColumn("found", F.filter("found", lambda f: f["chunk_id"] != F.col("query_id")))
    return listed.select("query_id", F.posexplode(F.slice("found", 1, k)).alias("at", "hit")).select(
        "query_id", "hit.chunk_id", "hit.score", (F.col("at") + 1).cast("bigint").alias("rank")
    )


def mean_vectors(df: DataFrame, key: str, vec: str) -> DataFrame:
    """Mean vector per key, position by position; the sum is taken over exact decimals."""
    per_position = (
        df.select(key, F.posexplode(vec).alias("pos", "x"))
        .groupBy(key, "pos")
        .agg((F.sum(F.col("x").cast("double").cast("decimal(28,12)")).cast("double") / F.count("x")).alias("x"))
    )
    return per_position.groupBy(key).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("pos", "x"))), lambda p: p["x"]).alias("mean_vec")
    )


def recall_against(found: DataFrame, truth: DataFrame) -> DataFrame:
    """Share of the exact result pairs that the approximate result holds."""
    hits = truth.select("query_id", "chunk_id").join(
        found.select("query_id", "chunk_id").withColumn("hit", F.lit(1)), ["query_id", "chunk_id"], "left"
    )
    return hits.agg(
        F.count(F.lit(1)).alias("wanted"),
        F.count("hit").alias("found"),
        (F.count("hit") / F.count(F.lit(1))).alias("recall"),
    )


def above_threshold(scored: DataFrame, score: Column, threshold: float) -> DataFrame:
    """Chunk filter of the user setting; applied before the top-k cut."""
    return scored.filter(score > threshold)

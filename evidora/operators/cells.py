"""Inverted file over vectors: k-means cells, cell of every vector, cells that a query visits.

Cells are fitted on a bounded sample, the rows with the smallest hashes of their ids; the cell of a vector is that of the
most similar centre. Of each cell only its centre, its number of vectors and the largest angle of a vector to its centre are
held by the driver: `MOST_CELLS` rows at most.
"""

from __future__ import annotations

import math
import sys
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

cloudpickle.register_pickle_by_value(sys.modules[__name__])

MOST_CELLS = 4_096
#: Vectors that cells are fitted on, in double precision.
SAMPLE_BYTES = 32 << 20
#: Vectors of the sample that play queries when the number of visited cells is chosen.
SAMPLE_QUERIES = 1_024
#: Angles of rows to centres that a task holds at once.
ANGLES = 1 << 20
#: Scores are rounded to six places and angles are computed; bounds give way by as much.
_SLACK = 1e-6


@dataclass(frozen=True)
class Cells:
    points: np.ndarray  # centres, rows of length one
    rows: np.ndarray  # vectors in each cell
    widest: np.ndarray  # largest angle of a vector of the cell to its centre

    @staticmethod
    def of(points: np.ndarray, placed: DataFrame) -> Cells:
        rows, widest = np.zeros(len(points), np.int64), np.zeros(len(points))
        for cell, n, angle in placed.groupBy("cell").agg(F.count("*"), F.max("angle")).collect():
            rows[cell], widest[cell] = n, angle
        return Cells(points, rows, widest)


def number_of_cells(rows: int) -> int:
    """Half the square root of the rows: a visit looks at about as many centres as vectors."""
    return max(1, min(MOST_CELLS, int(math.sqrt(rows) / 2)))


def sample_of(vectors: DataFrame) -> tuple[int, np.ndarray]:
    """Number of rows (id, vec), and a bounded sample of them with length one, in the order of the hashes of their ids."""
    rows, dims = vectors.agg(F.count("*"), F.max(F.size("vec"))).first()
    if not rows:
        return 0, np.zeros((0, 0))
    most = max(1, SAMPLE_BYTES // (8 * dims))
    picked = vectors.orderBy(F.md5(F.col("id").cast("string")), "id").limit(most).select("vec").toArrow()
    return rows, unit_rows(picked["vec"])


def unit_rows(vectors: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Arrow list column as a matrix with rows of length one, in double precision.

    A zero vector stays zero; all vectors must have the same number of dimensions.
    """
    if isinstance(vectors, pa.ChunkedArray):
        vectors = vectors.combine_chunks()
    sizes = np.unique(vectors.value_lengths().to_numpy(zero_copy_only=False))
    if len(sizes) > 1:
        raise ValueError(f"vectors of different lengths: {sizes.tolist()[:5]}")
    if not len(vectors):
        return np.zeros((0, 0))
    matrix = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(vectors), -1)
    return _unit(matrix)


def _unit(matrix: np.ndarray) -> np.ndarray:
    norms = np.sqrt((matrix * matrix).sum(axis=1, keepdims=True))
    return np.divide(matrix, norms, out=np.zeros_like(matrix), where=norms > 0)


def fit_cells(sample: np.ndarray, cells: int, *, rounds: int) -> np.ndarray:
    """Centres of spherical k-means, started from the first rows of the sample; a cell without rows keeps its centre."""
    points = sample[:cells].copy()
    for _ in range(rounds if len(points) > 1 else 0):
        cell = (sample @ points.T).argmax(axis=1)
        sums = np.zeros_like(points)
        np.add.at(sums, cell, sample)
        held = np.bincount(cell, minlength=len(points)) > 0
        points[held] = _unit(sums[held])
    return points


def least_angles(matrix: np.ndarray, points: np.ndarray) -> np.ndarray:
    """Angle of each row to each point; zero vectors are at right angles to all."""
    if matrix.size and points.size and matrix.shape[1] != points.shape[1]:
        raise ValueError(f"vectors have {matrix.shape[1]} dimensions, others {points.shape[1]}")
    if not matrix.size or not points.size:
        return np.zeros((len(matrix), len(points)))
    return np.arccos(np.clip(matrix @ points.T, -1.0, 1.0))


def _slices(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """Batches cut so that a matrix of `width` columns for their rows stays within ANGLES values."""
    rows = max(1, ANGLES // max(1, width))
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


def place(vectors: DataFrame, points: np.ndarray) -> DataFrame:
    """id, vec, cell and the angle to its centre."""

    def cell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches, len(points)):
            angles = least_angles(unit_rows(batch.column("vec")), points)
            nearest = angles.argmin(axis=1)
            columns = [batch.column("id"), batch.column("vec")]
            columns += [pa.array(nearest.astype(np.int32)), pa.array(angles[np.arange(len(nearest)), nearest])]
            yield pa.RecordBatch.from_arrays(columns, ["id", "vec", "cell", "angle"])

    schema = T.StructType([vectors.schema["id"], vectors.schema["vec"]]).add("cell", T.IntegerType()).add("angle", T.DoubleType())
    return vectors.select("id", "vec").mapInArrow(cell, schema)


@dataclass(frozen=True)
class Parts:
    """Runs of whole cells that hold about a block of vectors together; a cell of more than a block is dealt to several parts."""

    low: np.ndarray  # of each part: its first cell, and the one after its last
    high: np.ndarray
    first: np.ndarray  # of each cell: its first part, and their number
    among: np.ndarray

    @staticmethod
    def of(cells: Cells, block: int) -> Parts:
        low, high, held = [], [], block + 1
        first, among = np.zeros(len(cells.points), np.int64), np.ones(len(cells.points), np.int64)
        for cell, n in enumerate(cells.rows.tolist()):
            if held + n > block:
                among[cell] = max(1, -(-n // block))
                low += [cell] * int(among[cell])
                high += [cell + 1] * int(among[cell])
                first[cell], held = len(low) - among[cell], n
            else:
                first[cell], high[-1], held = len(low) - 1, cell + 1, held + n
        return Parts(np.array(low, np.int64), np.array(high, np.int64), first, among)

    def flags(self, chosen: np.ndarray) -> pa.ListArray:
        """Of each row of a matrix of flags, rows by cells: the parts with a flag, and the flags of their cells as bits."""
        spans = list(zip(self.low.tolist(), self.high.tolist(), strict=True))
        met = np.zeros((len(chosen), len(spans)), bool)
        bits = []
        for p, (lo, hi) in enumerate(spans):
            met[:, p] = chosen[:, lo:hi].any(axis=1)
            bits.append(np.packbits(chosen[:, lo:hi], axis=1))
        rows, part = np.nonzero(met)
        packed = pa.array([bits[p][r].tobytes() for r, p in zip(rows.tolist(), part.tolist(), strict=True)], pa.binary())
        ends = pa.array(np.concatenate([[0], np.cumsum(met.sum(axis=1))]), pa.int32())
        return pa.ListArray.from_arrays(ends, pa.StructArray.from_arrays([pa.array(part.astype(np.int32)), packed], ["part", "cells"]))


def _visits(
    queries: DataFrame, choose: Callable[[pa.RecordBatch, np.ndarray], np.ndarray], points: np.ndarray, parts: Parts
) -> DataFrame:
    """id, vec, least of the queries with each part they visit and the cells chosen there, as bits."""

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches, len(points)):
            chosen = choose(batch, least_angles(unit_rows(batch.column("vec")), points))
            columns = [batch.column(c) for c in ("id", "vec", "least")] + [parts.flags(chosen)]
            yield pa.RecordBatch.from_arrays(columns, ["id", "vec", "least", "visits"])

    known = queries.select("id", "vec", "least")
    visits = T.ArrayType(T.StructType().add("part", T.IntegerType()).add("cells", T.BinaryType()))
    schema = T.StructType([*known.schema.fields]).add("visits", visits)
    return known.mapInArrow(visit, schema).select("id", "vec", "least", F.inline("visits"))


def _nearest(angles: np.ndarray, probes: int) -> np.ndarray:
    chosen = np.zeros(angles.shape, bool)
    np.put_along_axis(chosen, np.argsort(angles, axis=1, kind="stable")[:, :probes], True, axis=1)
    return chosen


def nearest_cells(queries: DataFrame, cells: Cells, parts: Parts, probes: int) -> DataFrame:
    """Visits of queries (id, vec) to their nearest cells."""
    unbounded = queries.select("id", "vec", F.lit(None).cast("double").alias("least"))
    return _visits(unbounded, lambda batch, angles: _nearest(angles, probes), cells.points, parts)


def reaching_cells(queries: DataFrame, cells: Cells, parts: Parts) -> DataFrame:
    """Visits of queries (id, vec, least) to all cells that may hold a score of `least` (null: any)."""
    widest, held = cells.widest, cells.rows > 0

    def choose(batch: pa.RecordBatch, angles: np.ndarray) -> np.ndarray:
        least = batch.column("least").fill_null(-2.0).to_numpy(zero_copy_only=False)
        highest = np.cos(np.maximum(angles - widest - 1e-9, 0.0)) + _SLACK
        return (highest >= least[:, None]) & held

    return _visits(queries, choose, cells.points, parts)


def probes_for(sample: np.ndarray, points: np.ndarray, k: int, recall: float) -> int:
    """Cells to visit so that the sample's queries find the wanted share of their k nearest other vectors of the sample."""
    asked = sample[:SAMPLE_QUERIES]
    if len(points) < 2 or len(sample) <= k:
        return max(1, len(points))
    scores = asked @ sample.T
    np.fill_diagonal(scores, -np.inf)
    found = np.argpartition(-scores, k - 1, axis=1)[:, :k]
    cell = least_angles(sample, points).argmin(axis=1)
    order = np.argsort(least_angles(asked, points), axis=1, kind="stable")
    place_of = np.argsort(order, axis=1)
    visit = np.take_along_axis(place_of, cell[found], axis=1).ravel()
    reached = np.cumsum(np.bincount(visit, minlength=len(points))) / len(visit)
    return 1 + int(np.searchsorted(reached, recall))

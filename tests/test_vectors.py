"""Vector search against brute force on small fixtures."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from evidora.operators.cells import Cells, Parts, nearest_cells, place
from evidora.operators.cells import fit_cells, least_angles, number_of_cells, probes_for
from evidora.operators.vectors import BlockScan, approx_top_k, exact_top_k, mean_vectors, recall_against, set_aside

SCALE = 1e6


def frame(spark, matrix, id_name, vec_name, ids=None, id_type="long"):
    ids = range(len(matrix)) if ids is None else ids
    return spark.createDataFrame(
        [(i, [float(x) for x in v]) for i, v in zip(ids, matrix)], f"{id_name} {id_type}, {vec_name} array<float>"
    )


def brute(queries, chunks, k, exclude_self=False):
    q = np.asarray(queries, np.float32).astype(np.float64)
    c = np.asarray(chunks, np.float32).astype(np.float64)
    q = q / np.where(np.linalg.norm(q, axis=1, keepdims=True) > 0, np.linalg.norm(q, axis=1, keepdims=True), 1)
    c = c / np.where(np.linalg.norm(c, axis=1, keepdims=True) > 0, np.linalg.norm(c, axis=1, keepdims=True), 1)
    out = {}
    for i, row in enumerate(np.floor(q @ c.T * SCALE + 0.5) / SCALE):
        ranked = sorted((-s, j) for j, s in enumerate(row) if not (exclude_self and i == j))[:k]
        out[i] = [(j, -s) for s, j in ranked]
    return out


def found(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r["rank"])):
        out.setdefault(r.query_id, []).append((r.chunk_id, r.score))
    return out


@pytest.fixture(scope="module")
def matrix():
    rng = np.random.default_rng(1)
    rows = rng.standard_normal((300, 16))
    rows[100:200] = rows[100]  # a third of the rows are copies of one vector
    rows[250] = 0
    return rows


@pytest.mark.parametrize("broadcast_bytes", [1 << 20, 0])
def test_exact_equals_brute_force(spark, matrix, broadcast_bytes):
    q = frame(spark, matrix[:90], "query_id", "query_vec").repartition(3)
    c = frame(spark, matrix, "chunk_id", "chunk_vec").repartition(5)
    got = exact_top_k(q, c, 4, broadcast_bytes=broadcast_bytes, query_block=40, chunk_block=70)
    assert found(got) == brute(matrix[:90], matrix, 4)


def test_exact_without_self_among_copies(spark, matrix):
    q, c = frame(spark, matrix, "query_id", "query_vec"), frame(spark, matrix, "chunk_id", "chunk_vec")
    want = brute(matrix, matrix, 3, exclude_self=True)
    assert found(exact_top_k(q, c, 3, exclude_self=True)) == want
    assert found(exact_top_k(q, c, 3, exclude_self=True, broadcast_bytes=0, query_block=50, chunk_block=50)) == want


def test_all_cells_are_exact_for_copies_too(spark, matrix):
    q, c = frame(spark, matrix, "query_id", "query_vec"), frame(spark, matrix, "chunk_id", "chunk_vec")
    got = approx_top_k(q, c, 3, exclude_self=True, share=1.0, query_block=20, chunk_block=30)
    assert found(got) == brute(matrix, matrix, 3, exclude_self=True)


def test_recall_grows_with_probes(spark):
    rows = np.random.default_rng(2).standard_normal((400, 24))
    q, c = frame(spark, rows, "query_id", "query_vec"), frame(spark, rows, "chunk_id", "chunk_vec")
    truth = exact_top_k(q, c, 4, exclude_self=True).cache()
    recall = [
        recall_against(approx_top_k(q, c, 4, exclude_self=True, cells=12, probes=n), truth).first().recall
        for n in (1, 4, 12)
    ]
    assert recall[0] < recall[1] < recall[2] == 1.0


def test_results_are_properties_of_the_input(spark, matrix):
    q, c = frame(spark, matrix[:20], "query_id", "query_vec"), frame(spark, matrix, "chunk_id", "chunk_vec")
    rows = exact_top_k(q, c, 5).collect()
    assert all(-1.0 <= r.score <= 1.0 for r in rows)
    for _, hits in found(exact_top_k(q, c, 5)).items():
        assert [s for _, s in hits] == sorted((s for _, s in hits), reverse=True)


def test_k_zero_and_short_lists(spark, matrix):
    q, c = frame(spark, matrix[:3], "query_id", "query_vec"), frame(spark, matrix[:2], "chunk_id", "chunk_vec")
    assert exact_top_k(q, c, 0).count() == 0
    assert exact_top_k(q, c, 9).count() == 6


def test_text_ids(spark, matrix):
    q = frame(spark, matrix[:5], "query_id", "query_vec", [f"q{i}" for i in range(5)], "string")
    c = frame(spark, matrix[:50], "chunk_id", "chunk_vec", [f"c{i:03d}" for i in range(50)], "string")
    for limit in (1 << 20, 0):
        got = found(exact_top_k(q, c, 2, broadcast_bytes=limit))
        assert {k: [int(c[1:]) for c, _ in v] for k, v in got.items()} == {
            f"q{i}": [j for j, _ in v] for i, v in brute(matrix[:5], matrix[:50], 2).items()
        }


def test_cells_follow_the_table_size():
    assert [number_of_cells(n) for n in (0, 1, 500, 10**6, 10**12)] == [1, 1, 11, 500, 4096]


def clustered(n_centres=40, each=50, dims=32, noise=0.1, seed=3):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((n_centres, dims))
    return np.concatenate([centres + rng.standard_normal(centres.shape) * noise for _ in range(each)])


def test_blocks_out_of_reach_are_skipped_and_nothing_is_lost(spark):
    rows = clustered()
    unit = rows / np.linalg.norm(rows, axis=1, keepdims=True)
    ids = np.arange(len(rows))
    scan = BlockScan(ids, unit, 4, True)
    for start in range(0, len(rows), 500):
        scan.add(ids[start : start + 500], unit[start : start + 500])
    assert scan.compared + scan.skipped == len(rows) ** 2
    assert scan.compared < 0.2 * len(rows) ** 2
    got = {q: list(zip(g["chunk_id"], g["score"])) for q, g in scan.best.groupby("query_id")}
    scores = np.floor(unit @ unit.T * SCALE + 0.5) / SCALE
    np.fill_diagonal(scores, -2)
    assert got == {i: sorted(((j, s) for j, s in enumerate(row)), key=lambda x: (-x[1], x[0]))[:4] for i, row in enumerate(scores)}


def test_few_cells_are_visited_on_clustered_vectors(spark):
    rows = clustered()
    q, c = frame(spark, rows, "query_id", "query_vec"), frame(spark, rows, "chunk_id", "chunk_vec")
    truth = exact_top_k(q, c, 4, exclude_self=True)
    assert found(exact_top_k(q, c, 4, exclude_self=True, broadcast_bytes=0, query_block=300, chunk_block=400)) == found(truth)
    got = approx_top_k(q, c, 4, exclude_self=True, cells=40)
    assert recall_against(got, truth).first().recall >= 0.9
    unit = rows / np.linalg.norm(rows, axis=1, keepdims=True)
    points = fit_cells(unit, 40, rounds=8)
    probes = probes_for(unit, points, 5, 0.9)
    sizes = np.bincount(least_angles(unit, points).argmin(axis=1), minlength=40)
    visited = np.sort(np.argsort(least_angles(unit, points), axis=1)[:, :probes], axis=1)
    assert sizes[visited].sum() < 0.2 * len(rows) ** 2


def test_mean_vectors(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0]), (1, [3.0, 6.0]), (2, [0.5, 0.5])], "k int, v array<double>")
    assert {r.k: list(r.mean_vec) for r in mean_vectors(df, "k", "v").collect()} == {1: [2.0, 4.0], 2: [0.5, 0.5]}


@pytest.mark.parametrize("way", ["broadcast", "grid", "approximate"])
def test_unusable_vectors_cost_no_result(spark, way):
    rng = np.random.default_rng(6)
    good = rng.standard_normal((60, 8))
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(good)]
    bad = [(100, [float("inf")] + [1.0] * 7), (101, [float("nan")] * 8), (102, None), (103, []), (104, [None] + [1.0] * 7)]
    c = spark.createDataFrame(rows + bad, "chunk_id long, chunk_vec array<float>")
    q = spark.createDataFrame(rows[:20] + bad[:2], "query_id long, query_vec array<float>")
    assert sorted(r.chunk_id for r in set_aside(c, "chunk_vec").collect()) == [100, 101, 102, 103, 104]
    if way == "approximate":
        got = approx_top_k(q, c, 3, share=1.0)
    else:
        got = exact_top_k(q, c, 3, broadcast_bytes=1 << 20 if way == "broadcast" else 0, query_block=7, chunk_block=9)
    assert found(got) == brute(good[:20], good, 3)


def test_mixed_lengths_are_an_error(spark):
    q = spark.createDataFrame([(1, [1.0, 2.0])], "query_id long, query_vec array<float>")
    c = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0, 3.0])], "chunk_id long, chunk_vec array<float>")
    with pytest.raises(Exception, match="dimensions|different lengths"):
        exact_top_k(q, c, 1).collect()


def test_recall_target_is_met_on_vectors_in_all_directions(spark):
    rows = np.random.default_rng(8).standard_normal((600, 32))
    q, c = frame(spark, rows, "query_id", "query_vec"), frame(spark, rows, "chunk_id", "chunk_vec")
    truth = exact_top_k(q, c, 4, exclude_self=True)
    got = approx_top_k(q, c, 4, exclude_self=True, recall=0.9).cache()
    assert recall_against(got, truth).first().recall >= 0.9
    assert got.groupBy("query_id").count().filter("count = 4").count() == len(rows)


def test_queries_without_enough_chunks_are_searched_in_whole(spark):
    rows = clustered(n_centres=10, each=3)
    q, c = frame(spark, rows, "query_id", "query_vec"), frame(spark, rows, "chunk_id", "chunk_vec")
    assert found(approx_top_k(q, c, 20, cells=10, probes=1)) == brute(rows, rows, 20)


def test_empty_sides(spark):
    q = spark.createDataFrame([(1, [1.0, 2.0])], "query_id long, query_vec array<float>")
    c = spark.createDataFrame([], "chunk_id long, chunk_vec array<float>")
    for limit in (1 << 20, 0):
        assert exact_top_k(q, c, 2, broadcast_bytes=limit).count() == 0
        assert exact_top_k(q.limit(0), q.toDF("chunk_id", "chunk_vec"), 2, broadcast_bytes=limit).count() == 0
    assert approx_top_k(q, c, 2).count() == 0


def test_queries_move_once_for_a_block_of_chunks_not_for_each_cell(spark):
    rows = np.random.default_rng(9).standard_normal((400, 8))
    unit = rows / np.linalg.norm(rows, axis=1, keepdims=True)
    placed = place(frame(spark, rows, "id", "vec"), fit_cells(unit, 20, rounds=2)).cache()
    cells = Cells.of(fit_cells(unit, 20, rounds=2), placed)
    parts = Parts.of(cells, 150)
    assert all(cells.rows[lo:hi].sum() <= 150 for lo, hi in zip(parts.low, parts.high)) and len(parts.low) < 8
    visits = nearest_cells(placed, cells, parts, 16).collect()
    bits = sum(int.from_bytes(v.cells, "big").bit_count() for v in visits)
    assert bits == 400 * 16 and len(visits) <= 400 * len(parts.low)


def test_a_cell_of_more_than_a_block_is_dealt_to_several_parts():
    parts = Parts.of(Cells(np.zeros((4, 2)), np.array([0, 10, 95, 3]), np.zeros(4)), 30)
    assert list(zip(parts.low, parts.high)) == [(0, 2), (2, 3), (2, 3), (2, 3), (2, 3), (3, 4)]
    assert parts.first.tolist() == [0, 0, 1, 5] and parts.among.tolist() == [1, 1, 4, 1]


def test_tasks_do_not_hold_all_queries_of_a_self_join(spark):
    rows = np.random.default_rng(10).standard_normal((2_100, 64))
    got = exact_top_k(frame(spark, rows, "query_id", "query_vec"), frame(spark, rows, "chunk_id", "chunk_vec"), 2, exclude_self=True)
    assert "FlatMapCoGroupsInArrow" in got._jdf.queryExecution().toString()
    assert found(got) == brute(rows, rows, 2, exclude_self=True)

import numpy as np
import pytest
from evidora.llm import embedding_dedup as e
from pyspark.sql import functions as F
from tests_llm_oracle import check_query

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows):
    def unit(v):
        if v is None or not v or any(x is None or not np.isfinite(x) for x in v) or not any(v):
            return None
        v = np.array(v, np.float32).astype(float)
        v = v / np.abs(v).max()
        return v / np.linalg.norm(v)

    vectors = [unit(v) if i is not None and label is not None else None for i, v, label in rows]
    n = len(rows)
    links = [[] for _ in range(n)]
    for a in range(n):
        for b in range(a):
            if vectors[a] is None or vectors[b] is None or rows[a][2] != rows[b][2] or len(vectors[a]) != len(vectors[b]):
                continue
            if vectors[a] @ vectors[b] >= e.COSINE:
                links[a].append(b)
                links[b].append(a)
    out = []
    for a in range(n):
        seen, stack = {a}, [a]
        while stack:
            for b in links[stack.pop()]:
                if b not in seen:
                    seen.add(b)
                    stack.append(b)
        least = None if rows[a][0] is None else min(rows[b][0] for b in seen)
        out.append((rows[a][0], len(links[a]), least, None if least is None else least == rows[a][0]))
    return sorted(out, key=str)


def got(df):
    return sorted(map(tuple, e.near_vectors(df).collect()), key=str)


def test_query_against_sql(spark):
    check_query(spark, "op2_embedding_near_dedup", "/root/testdata/sf0.01")


def groups(rng, n, dims, size, noise):
    rows = []
    for g in range(n):
        centre = rng.normal(size=dims)
        for _ in range(size):
            v = centre + rng.normal(size=dims) * noise
            rows.append((len(rows), [float(x) for x in v.astype(np.float32)], g % 3))
    return rows


def test_edges(make):
    rng = np.random.default_rng(1)
    rows = groups(rng, 12, 16, 7, 0.12)
    base = rows[0][1]
    nan, inf = float("nan"), float("inf")
    rows += [
        (500, None, 0), (501, [0.0] * 16, 0), (502, [nan] * 16, 0), (503, [*base[:-1], inf], 0), (504, [*base[:-1], None], 0),
        (505, [], 0), (506, base, None), (507, base, 0), (507, base, 0), (None, base, 0), (508, base[:8], 0), (509, base[:8], 0),
        (510, [x * 1e30 for x in base], 0), (511, [-x for x in base], 0), (512, [-0.0 if not x else x for x in base], 0), (513, base, 99),
    ]
    assert got(make(rows, SCHEMA)) == brute(rows)


def test_long_lists_are_cut(make, monkeypatch):
    monkeypatch.setattr(e, "BLOCK", 40)
    rows = groups(np.random.default_rng(2), 3, 24, 150, 0.09)
    rows += [(1000 + i, rows[0][1], 0) for i in range(100)]
    assert got(make(rows, SCHEMA)) == brute(rows)


def test_recall(spark):
    rng = np.random.default_rng(3)
    rows = groups(rng, 150, 64, 8, 0.09)
    want, have = brute(rows), got(spark.createDataFrame(rows, SCHEMA))
    assert sum(r[1] for r in have) >= 0.99 * sum(r[1] for r in want) > 0
    assert all(a[1] <= b[1] for a, b in zip(have, want))


def narrow(rng, n, dims):
    """Vectors all alike above 0.6, partly above 0.98."""
    axis = rng.normal(size=dims) * 2
    rows = []
    for g in range(n):
        centre = axis + rng.normal(size=dims) * 0.6
        for _ in range(5):
            v = centre + rng.normal(size=dims) * 0.15
            rows.append((len(rows), [float(x) for x in v.astype(np.float32)], g % 2))
    return rows


@pytest.mark.parametrize("block", [e.BLOCK, 12])
def test_one_pivot(spark, monkeypatch, block):
    monkeypatch.setattr(e, "BLOCK", block)
    rows = narrow(np.random.default_rng(4), 20, 32)
    df = spark.createDataFrame(rows, SCHEMA).withColumn("embedding", F.col("embedding").cast("array<double>"))
    assert len(e.pivots(df, e.LEAST_PIVOTS)) == 1
    want = brute(rows)
    assert 0 < sum(r[1] for r in want) < len(rows) * (len(rows) // 2 - 1)
    assert got(spark.createDataFrame(rows, SCHEMA)) == want


def test_one_nearest_pivot_asked_for(spark):
    rows = groups(np.random.default_rng(5), 12, 16, 6, 0.1)
    found = e.near_vectors(spark.createDataFrame(rows, SCHEMA), top=1)
    assert sorted(map(tuple, found.collect()), key=str) == brute(rows)


def test_empty(make):
    assert e.near_vectors(make([], SCHEMA)).collect() == []
    assert got(make([(1, None, 0)], SCHEMA)) == [(1, 0, 1, True)]

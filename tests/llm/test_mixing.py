import re
from collections import Counter, defaultdict

import pytest
from evidora.llm import mixing
from pyspark.sql import functions as F
from tests_llm_oracle import check_query


def test_query_against_sql(spark):
    check_query(spark, "op5_curriculum_mix", "/root/testdata/sf0.001")
    plan = mixing.op5_curriculum_mix(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "rangepartitioning(position" in plan and "SQRT" in plan


def test_targets():
    got = mixing.targets({"a": 100, "b": 10, None: 1}, {"a": 1, "b": 2, None: 3})
    assert got[None] == 3 and got["b"] == 30 and got["a"] == pytest.approx(111 - 33)
    assert mixing.targets({}, {}) == {}
    assert mixing.targets({"a": 0, "b": 0}, {"a": 1, "b": 1}) == {"a": 0.0, "b": 0.0}


def test_position_inverts_the_demand(spark):
    for schedule in (mixing.EARLY, mixing.EVEN, mixing.LATE, [(0.0, 0.0), (0.3, 0.0), (0.6, 2.0), (1.0, 0.0)]):
        segments = mixing._segments(schedule)
        df = spark.createDataFrame(
            [(float(x), segments) for x in range(0, 1000, 7)],
            "taken double, segments array<struct<share: double, time: double, weight: double, slope: double>>",
        )
        rows = df.select("taken", mixing.position(F.col("taken"), F.lit(1000.0), F.col("segments")).alias("t")).collect()
        whole = mixing.area(schedule)
        for taken, t in rows:
            done = 0.0
            for (t1, a), (t2, b) in zip(schedule, schedule[1:]):
                x = min(max(t - t1, 0), t2 - t1)
                done += a * x + (b - a) / (t2 - t1) * x * x / 2
            assert done / whole == pytest.approx(taken / 1000, abs=1e-9)


ROWS = [
    (1, "a b c d", "s1"), (2, None, "s1"), (3, "", "s2"), (4, "x " * 30, "s2"), (5, "q r", None), (6, "q r", None), (6, "q r", None),
    (None, "n n n", "s1"), (7, " ".join(["w"] * 20_000), "s3"), (8, "one", "s3"),
]


def test_edges(make):
    df = make(ROWS, "doc_id long, text string, source string")
    rows = mixing.curriculum(df).collect()
    assert [r.position for r in rows] == sorted(r.position for r in rows)
    sizes = defaultdict(int)
    for _, text, source in ROWS:
        sizes[source] += len(re.findall("[^\x20\x09-\x0d]+", text or ""))
    goal = mixing.targets(dict(sizes), {s: mixing.area(p) for s, p in mixing.ranked_schedules(list(sizes)).items()})
    taken = Counter()
    for r in rows:
        assert 0 < r.words <= r.size and 0 <= r.position < 1
        taken[r.source] += r.words
    assert all(taken[s] == round(goal[s]) for s in sizes)
    again = mixing.curriculum(make(ROWS, "doc_id long, text string, source string").repartition(5)).collect()
    assert sorted(map(str, again)) == sorted(map(str, rows))


def test_whole_rows(make):
    df = make(ROWS, "doc_id long, text string, source string")
    mixed, plan = mixing.mixed_documents(df), mixing.curriculum(df)
    assert mixed.columns == [*df.columns, "mix_epoch", "mix_words", "mix_position"]

    def key(r):
        return (str(r[0]), str(r[1]), r[2], r[3], round(r[4], 12))

    got = mixed.select("doc_id", "source", "mix_epoch", "mix_words", "mix_position").collect()
    assert sorted(map(key, got)) == sorted(map(key, plan.select("doc_id", "source", "epoch", "words", "position").collect()))


def test_empty(make):
    df = make([], "doc_id long, text string, source string")
    assert mixing.curriculum(df).collect() == [] and mixing.mixed_documents(df).collect() == []

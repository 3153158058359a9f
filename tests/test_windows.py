"""Windows, quantiles and sketches of sessions and lists."""

import random

import pytest
from pyspark.sql import functions as F

from evidora.operators.comparison import colliding_codes, to_catalog
from evidora.operators.metrics import latency_sketches, merged_sketches, quantiles, rank_error, sketched_rollup
from evidora.operators.ranking import list_index
from evidora.operators.sessions import message_order, runs, turn_pairs


def test_runs_of_one_group(spark):
    df = spark.range(1000).select(F.lit(1).alias("k"), "id", F.when(F.col("id") < 300, None).otherwise(F.floor(F.col("id") / 400)).alias("v"))
    got = {r.run_no: r.n for r in runs(df, ["k"], ["id"], "v").groupBy("run_no").agg(F.count("*").alias("n")).collect()}
    assert got == {1: 300, 2: 100, 3: 400, 4: 200}


def test_null_keys_are_one_group(spark):
    df = spark.range(30).select(F.when(F.col("id") % 3 > 0, F.lit(None)).otherwise(F.col("id")).alias("k"), "id")
    got = list_index(df, ["k"], ["id"], index="pos").where("k is null").orderBy("id").collect()
    assert [r.pos for r in got] == list(range(1, 21))


def test_turn_pairs_and_order(spark):
    turns = [(1, i, "user" if i % 3 != 1 else "assistant", f"t{i}") for i in range(201)]
    df = spark.createDataFrame(turns, "s int, turn int, role string, text string").repartition(5)
    pairs = {r.turn: (r.answered, r.next_text) for r in turn_pairs(df, "s", "turn").collect()}
    assert pairs[0] == (True, "t1") and pairs[2] == (False, "t3") and pairs[200] == (False, None)
    rows = message_order(df, "s", ["turn"], previous="role").orderBy("turn").collect()
    assert [r.position for r in rows] == list(range(1, 202)) and rows[2].previous_role == "assistant"


def test_quantiles_are_exact(spark):
    rng = random.Random(5)
    made = [("hot", round(rng.random() * 100, 2)) for _ in range(300)] + [("cold", 3.0), ("cold", 4.0), (None, 9.0)]
    df = spark.createDataFrame(made + [("cold", None)], "g string, v double")
    got = {r.g: (r.p50, r.p95) for r in quantiles(df, ["g"], "v", {"p50": 0.5, "p95": 0.95}).collect()}
    want = df.groupBy("g").agg(F.percentile("v", 0.5).alias("p50"), F.percentile("v", 0.95).alias("p95")).collect()
    assert got.keys() == {r.g for r in want}
    for r in want:
        assert got[r.g] == pytest.approx((r.p50, r.p95), abs=1e-9)


def test_sketches_merge_to_the_same_counts_and_close_ranks(spark):
    rng = random.Random(6)
    made = [(rng.choice("ab"), i // 500, rng.lognormvariate(3, 1)) for i in range(20_000)] + [("c", 0, None)]
    df = spark.createDataFrame(made, "g string, hour long, v double")
    hours = latency_sketches(df, ["g"], "v", F.lit(1), F.col("hour"))
    points = {"p50": 0.5, "p95": 0.95}
    whole = sketched_rollup(merged_sketches(merged_sketches(hours, ["g"], F.floor(F.col("period") / 24)), ["g"]), points)
    rows = {r.g: r for r in whole.collect()}
    assert {g: r.requests for g, r in rows.items()} == {r.g: r["count"] for r in df.groupBy("g").count().collect()}
    assert rows["c"].p50 is None and rows["c"].mean_latency is None
    errors = rank_error(whole.where("g <> 'c'"), df, "g", "v", points).collect()
    assert len(errors) == 2 and all(r.p50_error <= 0.01 and r.p95_error <= 0.01 for r in errors)


def test_codes_that_read_the_same_are_one_entry(spark):
    catalog = spark.createDataFrame([("A-1", 1), ("a 1", 2), ("B", 3)], "code string, n int")
    df = spark.createDataFrame([(1, "a1 / b / zz")], "id int, source string")
    got = to_catalog(df, "source", catalog, "code", ["n"]).orderBy("source_part").collect()
    assert [(r.source_part, r.n) for r in got] == [("a1", 1), ("b", 3), ("zz", None)]
    assert [list(r.codes) for r in colliding_codes(catalog, "code").collect()] == [["A-1", "a 1"]]


@pytest.mark.parametrize(
    "name", ["w2_list_index", "w4_event_runs", "w5_turn_pairing", "w7_message_order", "a8_latency_rollup", "a11_context_budget",
             "a11_model_window", "j6_find_or_first", "j11_chunk_to_catalog"]
)
def test_building_starts_no_job(spark, name):
    from evidora.catalog import QUERIES

    spark.sparkContext.setJobGroup(name, name)
    seen = set(spark.sparkContext.statusTracker().getJobIdsForGroup(name))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", name)
    QUERIES[name](spark, "/root/testdata/sf0.001")
    jobs = set(spark.sparkContext.statusTracker().getJobIdsForGroup(name)) - seen
    # Reading a footer for a schema is a job too; nothing else may run.
    assert len(jobs) <= 3

"""Streams cut into several files against the batch result."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from evidora.catalog import QUERIES
from evidora.operators.sessions import merge_deltas, message_deltas
from evidora.streaming.jobs import (
    activity_sessions, compact_session_state, drop_copies, live_metrics, profiles_for_new_users, read_session_state,
    route_and_tag, session_state,
)
from evidora.streaming.sources import run_to_end, stream_table, to_files

START = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)


def at(minutes):
    return START + dt.timedelta(minutes=minutes)


@pytest.fixture
def feed(spark, tmp_path):
    """Write batches as one file each, in order, and stream them one file at a time."""

    def make(batches, schema):
        folder = tmp_path / "in"
        for i, rows in enumerate(batches):
            out = tmp_path / f"part{i}"
            spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(out))
            folder.mkdir(exist_ok=True)
            name = next(p for p in out.iterdir() if p.suffix == ".parquet")
            name.rename(folder / f"{i:03d}.parquet")
        return stream_table(spark, str(folder), spark.createDataFrame([], schema).schema, per_batch=1)

    return make


def test_session_state_over_batches(spark, feed, tmp_path):
    batches = [
        [("s", 2, "assistant", "b"), ("s", 3, "user", "late first")],
        [("s", 1, "user", "first"), ("t", 1, "system", "x")],
        [("t", 2, "user", "y")],
    ]
    schema = "id string, turn int, role string, text string"
    path = str(tmp_path / "state")
    state = session_state(feed(batches, schema), "id", "turn", path=path, checkpoint=str(tmp_path / "cp"))
    everything = spark.createDataFrame([r for b in batches for r in b], schema)
    want = merge_deltas(message_deltas(everything, "id", "turn"), "id")
    assert sorted(map(str, state.collect())) == sorted(map(str, want.collect()))
    assert len([p for p in (tmp_path / "state").iterdir() if p.name.startswith("batch=")]) == 3
    compact_session_state(spark, path, "id", target=str(tmp_path / "small"), batch_id=2)
    again = read_session_state(spark, str(tmp_path / "small"), "id")
    assert sorted(map(str, again.collect())) == sorted(map(str, want.collect()))


def test_windows_match_batch_on_closed_windows(spark, feed):
    schema = "ts timestamp, k string, v double"
    batches = [[(at(1), "a", 1.0), (at(5), "a", 2.0)], [(at(14), "b", 3.0), (at(9), "a", 4.0)], [(at(40), "a", 5.0)]]
    out = to_files(live_metrics(feed(batches, schema), "ts", ["k"], "v", size="10 minutes", late="10 minutes"))
    rows = {(r.window_start.minute, r.k): (r.events, r.total) for r in out.collect()}
    assert rows == {(0, "a"): (3, 7.0), (10, "b"): (1, 3.0)}


def test_activity_sessions_close_after_the_gap(feed):
    batches = [[(at(0), "u"), (at(5), "u"), (at(0), "v")], [(at(40), "u")], [(at(200), "w")]]
    out = to_files(activity_sessions(feed(batches, "ts timestamp, user string"), "ts", "user", gap="10 minutes", late="5 minutes"))
    assert sorted((r.user, r.events) for r in out.collect()) == [("u", 1), ("u", 2), ("v", 1)]


def test_copies_inside_and_across_batches(feed):
    batches = [[(at(0), 1)] * 5 + [(at(1), 2)], [(at(2), 1), (at(3), 3)]]
    out = to_files(drop_copies(feed(batches, "ts timestamp, id int"), "ts", ["id"], late="1 hour"))
    assert sorted(r.id for r in out.collect()) == [1, 2, 3]


def test_profiles_are_made_once(spark, feed, tmp_path):
    schema = "id string, email string, full_name string, avatar_url string"
    batches = [
        [("1", "ann@x", None, None), ("2", "bob@x", "Bob", None), ("2", "bob@x", "Bob", None)],
        [("1", "ann@x", "Changed", None), ("3", "cy@x", None, "url")],
    ]
    stream = feed(batches, schema)
    stamp = F.lit("2024-01-01").cast("timestamp")
    args = dict(path=str(tmp_path / "profiles"), checkpoint=str(tmp_path / "cp"))
    made = profiles_for_new_users(stream, stamp, **args)
    want = {("1", "ann"), ("2", "Bob"), ("3", "cy")}
    assert {(r.id, r.full_name) for r in made.collect()} == want and made.count() == 3
    again = profiles_for_new_users(stream, stamp, **args)
    assert again.count() == 3


def test_profiles_after_a_restart_without_reading_earlier_ones(spark, feed, tmp_path):
    schema = "id string, email string, full_name string, avatar_url string"
    stamp = F.lit("2024-01-01").cast("timestamp")
    checkpoint = str(tmp_path / "cp")
    stream = feed([[("1", "ann@x", None, None), (None, "none@x", None, None)]], schema)
    first = profiles_for_new_users(stream, stamp, path=str(tmp_path / "one"), checkpoint=checkpoint)
    assert [r.id for r in first.collect()] == ["1"]
    late = spark.createDataFrame([("1", "ann@x", "Late", None), ("2", "bob@x", None, None)], schema)
    late.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    second = profiles_for_new_users(stream, stamp, path=str(tmp_path / "two"), checkpoint=checkpoint)
    assert [(r.id, r.full_name) for r in second.collect()] == [("2", "bob")]


def test_routing_is_stateless_and_restarts(spark, feed, tmp_path):
    stream = route_and_tag(feed([[("which statin",)], [("who?",)]], "q string"), "q")
    out, checkpoint = str(tmp_path / "out"), str(tmp_path / "cp")
    for _ in range(2):
        run_to_end(stream.writeStream.format("parquet").option("path", out).outputMode("append"), checkpoint)
    rows = spark.read.parquet(out).collect()
    assert {(r.q, r.route, r.detected_lang) for r in rows} == {
        ("which statin", "statins_intensity", "en"), ("who?", "task_shifting_who", "en"),
    }
    assert len(rows) == 2


def rows_of_folder_table(spark, tmp_path, name, tables):
    """Rows of a query over tables that are folders of three files each."""
    small = "/root/testdata/sf0.001"
    for table in tables:
        spark.read.parquet(f"{small}/{table}.parquet").repartition(3).write.parquet(str(tmp_path / f"{table}.parquet"))
    return QUERIES[name](spark, str(tmp_path)).collect(), QUERIES[name](spark, small).collect()


def test_session_state_of_a_table_in_several_files(spark, tmp_path):
    got, wanted = rows_of_folder_table(spark, tmp_path, "st1_session_state", ["conversations"])
    assert wanted and sorted(got) == sorted(wanted)


def test_session_upsert_of_a_table_in_several_files(spark, tmp_path):
    got, wanted = rows_of_folder_table(spark, tmp_path, "st1_session_upsert", ["conversations", "customer"])
    assert wanted and sorted(got) == sorted(wanted)


def test_stream_routing_of_a_table_in_several_files(spark, tmp_path):
    got, wanted = rows_of_folder_table(spark, tmp_path, "st6_stream_routing", ["documents"])
    assert wanted and sorted(got) == sorted(wanted)

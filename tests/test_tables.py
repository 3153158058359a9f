import json

import pytest
from pyspark.sql import functions as F

from evidora import constants as K
from evidora import schemas
from evidora.operators import integrity, metrics, sessions
from evidora.operators.ranking import limit_k, pick_positions, top_k_per_group
from evidora.sources.buckets import BUCKET, change_bucket_table, create_bucket_table, read_bucket_table
from evidora.sources.settings import overlay
from evidora.sources.tables import (
    append_messages, messages_of, read_or_empty, read_sessions, read_table, rejected_sessions, session_fragments, with_defaults,
    write_bucketed, write_sessions,
)


def test_sessions_from_json(spark, tmp_path):
    good = {
        "id": "s1", "title": "t", "created_at": 1, "updated_at": 2,
        "messages": [{"id": "m1", "role": "user", "content": "hi", "timestamp": 1},
                     {"id": "m2", "role": "assistant", "content": "yo", "timestamp": 2,
                      "citations": [{"id": "c", "source": "S", "page": "3"}], "metrics": {"tokens_used": 9}}],
    }
    (tmp_path / "a.json").write_text(json.dumps(good) + "\n{broken\n")
    read = read_sessions(spark, str(tmp_path))
    assert read.count() == 1
    rows = {r.id: r for r in messages_of(read).collect()}
    assert rows["m2"].citations[0].page == "3" and rows["m2"].metrics.tokens_used == 9
    assert rows["m1"].position == 0 and rows["m1"].citations is None


def test_rejected_lines_and_long_sessions(spark, tmp_path):
    messages = spark.range(2500).select(F.lit("s").alias("id"), F.col("id").alias("pos"), F.lit("x").alias("content"))
    nested = session_fragments(messages, "id", "pos", ["content"])
    write_sessions(nested, str(tmp_path / "long"), fmt="json")
    flat = messages_of(read_sessions(spark, str(tmp_path / "long"))).collect()
    assert sorted(r.position for r in flat) == list(range(2500))
    (tmp_path / "b").mkdir()
    lines = ['{"id": "a", "messages": []}', '{"id": "b", "messages": 5}', "{broken", '{"title": "t"}', '{"id": "c", "pinned": "x"}']
    (tmp_path / "b" / "x.json").write_text("\n".join(lines))
    assert [r.id for r in read_sessions(spark, str(tmp_path / "b")).select("id").collect()] == ["a"]
    lost = {r.line for r in rejected_sessions(spark, str(tmp_path / "b")).collect()}
    assert lost == {lines[1], lines[2], lines[4], None}


def test_missing_path_is_empty(spark, tmp_path):
    assert read_sessions(spark, str(tmp_path / "none")).count() == 0
    assert read_or_empty(spark, str(tmp_path / "none"), schemas.PROFILE).count() == 0


def test_fragments_are_bounded(spark, tmp_path):
    messages = spark.range(25).select(F.lit("s").alias("id"), F.col("id").alias("pos"), F.lit("x").alias("content"))
    nested = session_fragments(messages, "id", "pos", ["content"], size=10)
    assert sorted(len(r.messages) for r in nested.collect()) == [5, 10, 10]
    write_sessions(nested, str(tmp_path / "out"))
    write_sessions(nested.limit(1), str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 1


def test_append_and_bucketed_layout(spark, tmp_path):
    df = spark.createDataFrame([("s1", 1), ("s2", 2)], "session_id string, n int")
    append_messages(df, str(tmp_path / "m"))
    append_messages(df, str(tmp_path / "m"))
    assert spark.read.parquet(str(tmp_path / "m")).count() == 4
    write_bucketed(df, "bucketed_messages", "session_id", ["n"], 4)
    grouped = spark.table("bucketed_messages").groupBy("session_id").count()
    assert "Exchange hashpartitioning" not in grouped._jdf.queryExecution().executedPlan().toString()
    spark.sql("DROP TABLE bucketed_messages")


def test_bucketed_tables_join_and_group_without_exchange(spark, tmp_path):
    sessions = spark.range(100).select(F.col("id").alias("session_id"))
    messages = spark.range(1000).select((F.col("id") % 90).alias("session_id"), F.col("id").alias("position"))
    stored = write_bucketed(sessions, "plan_sessions", "session_id", [], 4, path=str(tmp_path / "s"))
    of_session = write_bucketed(messages, "plan_messages", "session_id", ["position"], 4, path=str(tmp_path / "m"))
    assert len(list((tmp_path / "m").glob("*.parquet"))) == 4
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = stored.join(of_session.groupBy("session_id").count(), "session_id", "left")
        assert "Exchange" not in joined._jdf.queryExecution().executedPlan().toString()
        rows = {r.session_id: r["count"] for r in joined.collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert len(rows) == 100 and rows[5] == 12 and rows[95] is None
    for name in ("plan_sessions", "plan_messages"):
        spark.sql(f"DROP TABLE {name}")


def bucket_files(path):
    return {p.parent.name: p.name for p in path.glob(f"{BUCKET}=*/*.parquet")}


def test_changes_rewrite_only_their_buckets(spark, tmp_path):
    path, place = tmp_path / "t", str(tmp_path / "t")
    rows = spark.range(200).select(F.col("id").cast("string").alias("id"), F.lit("old").alias("title"))
    rows = rows.union(spark.createDataFrame([(None, "no id")], "id string, title string"))
    create_bucket_table(rows, place, "id", 8)
    before = bucket_files(path)
    assert len(before) == 8

    def replace(old, new):
        return old.join(new, "id", "left_anti").select("id", "title").union(new.select("id", "title"))

    changes = spark.createDataFrame([("7", "new"), ("added", "new")], "id string, title string")
    touched = {f"{BUCKET}={r[0]}" for r in change_bucket_table(place, rows.schema, changes, "id", 8, replace).collect()}
    after = bucket_files(path)
    assert {k for k in before if before[k] != after[k]} == touched and 1 <= len(touched) <= 2
    change_bucket_table(place, rows.schema, changes, "id", 8, replace)
    found = read_bucket_table(spark, place, rows.schema)
    assert found.columns == ["id", "title"] and found.count() == 202
    assert {r.id for r in found.where("title = 'new'").collect()} == {"7", "added"}
    kept = bucket_files(path)
    change_bucket_table(place, rows.schema, changes.limit(0), "id", 8, replace)
    assert bucket_files(path) == kept


def test_buckets_that_lose_all_rows_are_emptied(spark, tmp_path):
    place = str(tmp_path / "t")
    rows = spark.range(50).select("id")
    create_bucket_table(rows, place, "id", 4)
    doomed = spark.range(49).select("id")
    change_bucket_table(place, rows.schema, doomed, "id", 4, lambda old, gone: old.join(gone, "id", "left_anti"))
    assert [r.id for r in read_bucket_table(spark, place, rows.schema).collect()] == [49]


def test_table_schemas_and_defaults(spark, tmp_path):
    row = [("m", "s", "u", "user", "text", None, None, None, None, 0.93, None, None)]
    names = [f.name for f in schemas.CHAT_MESSAGE.fields][:-1]
    df = spark.createDataFrame(row, ", ".join(f"{n} {'double' if n == 'confidence_score' else 'boolean' if n.startswith('is_') else 'string'}" for n in names))
    df = df.withColumn("confidence_score", F.col("confidence_score").cast("decimal(4,2)"))
    filled = with_defaults(df, "chat_messages").withColumn("created_at", F.lit("2024-01-01").cast("timestamp"))
    filled.write.parquet(str(tmp_path / "m"))
    back = read_table(spark, "chat_messages", str(tmp_path / "m")).first()
    assert back.citations == "[]" and back.is_insufficient_evidence is False and str(back.confidence_score) == "0.93"


def test_settings_overlay(spark):
    users = spark.createDataFrame([("a",), ("b",)], "user string")
    saved = spark.createDataFrame([("a", "topK", "8"), ("a", "model", None)], "user string, key string, value string")
    rows = {(r.user, r.key): r.value for r in overlay(users, {"topK": "4", "model": "m"}, saved, "user").collect()}
    assert rows == {("a", "topK"): "8", ("a", "model"): None, ("b", "topK"): "4", ("b", "model"): "m"}


def test_dimension_fixtures(spark, tmp_path):
    points = [22, 18, 15, 10, 8, 17, 10]
    criteria = spark.createDataFrame(
        [(f"c{i}", p, ["x"] * 4, ["y"] * (3 if i == 4 else 4)) for i, p in enumerate(points)], schemas.CRITERION
    )
    criteria.write.json(str(tmp_path / "criteria"))
    back = read_table(spark, "criteria", str(tmp_path / "criteria"), fmt="json")
    share = metrics.share_of_total(back, ["id"], "max_points")
    assert share.agg(F.sum("amount"), F.round(F.sum("share"), 9)).first()[:] == (100, 1.0)
    assert [r.id for r in metrics.unequal_lists(back, F.col("checks"), F.col("checks_ar")).collect()] == ["c4"]
    guidelines = spark.createDataFrame([("a", 420, "2023-11"), ("b", 310, "2021-08"), ("c", 380, "2023-12")],
                                       "id string, total_chunks_count int, last_updated string")
    assert guidelines.agg(F.sum("total_chunks_count")).first()[0] == 1110
    assert str(guidelines.select(F.max(F.to_date("last_updated", "yyyy-MM"))).first()[0]) == "2023-12-01"


def test_session_upsert(spark):
    old = spark.createDataFrame(
        [("a", K.DEFAULT_TITLE, 1, 1), ("b", "mine", 1, 1), ("c", K.DEFAULT_TITLE, 1, 1), ("e", "New Clinical Query", 1, 1)],
        "id string, title string, updated_at long, messages long",
    )
    messages = spark.createDataFrame(
        [("a", 5, "assistant", "first"), ("a", 6, "user", "w" * 50), ("b", 7, "user", "hello"), ("d", 8, "user", "new one"),
         ("c", 9, "assistant", "no user yet"), ("e", 3, "user", "hello")],
        "id string, at long, role string, text string",
    )
    rows = {r.id: r for r in sessions.upsert_sessions(old, sessions.message_deltas(messages, "id", "at"), "id").collect()}
    assert rows["a"].title == "w" * 38 + "..." and rows["a"].messages == 2 and rows["a"].updated_at == 6
    assert rows["b"].title == "mine"
    assert rows["c"].title == K.DEFAULT_TITLE and rows["c"].updated_at == 9
    assert rows["d"].title == "new one"
    assert rows["e"].title == "New Clinical Query"


def test_merged_deltas_equal_one_pass(spark):
    messages = spark.range(60).select(
        (F.col("id") % 4).alias("s"), F.col("id").alias("at"), F.when(F.col("id") % 5 == 0, "user").otherwise("assistant").alias("role"),
        F.concat(F.lit("m"), F.col("id").cast("string")).alias("text"),
    )
    parts = [sessions.message_deltas(messages.filter(c), "s", "at") for c in ("at < 20", "at >= 20 and at < 21", "at >= 21")]
    merged = sessions.merge_deltas(parts[0].unionByName(parts[1]).unionByName(parts[2]), "s")
    assert sorted(map(str, merged.collect())) == sorted(map(str, sessions.merge_deltas(sessions.message_deltas(messages, "s", "at"), "s").collect()))


def test_delete_never_leaves_an_owner_empty(spark):
    rows = spark.createDataFrame([(1, "u", "x"), (2, "u", "y"), (3, "v", "z")], "id int, owner string, title string")
    doomed = spark.createDataFrame([(1,), (3,)], "id int")
    got = {(r.owner, r.title) for r in sessions.delete_never_empty(rows, doomed, "id", "owner").collect()}
    assert got == {("u", "y"), ("v", K.DEFAULT_TITLE)}


def test_integrity(spark):
    parents = spark.createDataFrame([(1,), (2,)], "id int")
    children = spark.createDataFrame([(10, 1), (11, 2), (12, 3), (13, None)], "id int, parent int")
    assert [r.id for r in integrity.orphans(children, "parent", parents, "id").collect()] == [12]
    kept, gone = integrity.cascade(parents.filter("id = 1"), "id", children, "parent")
    assert sorted(r.id for r in kept.collect()) == [11, 12, 13] and [r.id for r in gone.collect()] == [10]
    assert sorted(r.id for r in integrity.delete_by_id(children, "parent", F.lit(2)).collect()) == [10, 12, 13]
    marked = integrity.check_writes(spark.createDataFrame([("a", "a"), ("a", "b"), (None, "b")], "o string, u string"), "o", "u")
    assert [r.accepted for r in marked.collect()] == [True, False, False]
    roles = spark.createDataFrame([("user",), ("bot",), (None,)], "role string")
    assert [(r.value, r.violations) for r in integrity.domain_violations(roles, "role", K.ROLES).collect()] == [("bot", 1)]
    assert integrity.duplicate_keys(children.unionByName(children.limit(1)), ["id"]).count() == 1
    options = spark.createDataFrame([("m1", 5), ("m0", 1)], "id string, n int")
    asked = spark.createDataFrame([("m1",), ("zz",), (None,)], "want string")
    rows = integrity.find_or_first(asked, "want", options, "id", ["n"], [F.col("id")]).collect()
    assert {(r.want, r.n, r.found) for r in rows} == {("m1", 5, True), ("zz", 1, False), (None, 1, False)}


def test_limits(spark):
    df = spark.range(20).withColumn("g", F.col("id") % 2)
    assert limit_k(df, [F.col("id")], 0).count() == 0
    with pytest.raises(ValueError):
        limit_k(df, [F.col("id")], -1)
    with pytest.raises(ValueError):
        top_k_per_group(df, ["g"], [F.col("id")], -1)
    assert sorted(r.id for r in pick_positions(df, [F.col("id").desc()], [0, 4]).collect()) == [15, 19]
    assert [r.id for r in top_k_per_group(df, ["g"], [F.col("id").desc()], 1, row_key="id").orderBy("g").collect()] == [18, 19]


def test_latency_spans_and_precision(spark):
    log = spark.createDataFrame(
        [(1, "start", "2024-01-01 00:00:00.100"), (1, "end", "2024-01-01 00:00:00.350"), (2, "start", "2024-01-01 00:00:00")],
        "r int, step string, ts string",
    ).withColumn("ts", F.col("ts").cast("timestamp"))
    rows = {r.r: r.total for r in metrics.latency_spans(log, ["r"], "step", "ts", {"total": ("start", "end")}).collect()}
    assert rows == {1: 250, 2: None}
    found = spark.createDataFrame([(1, True), (1, None), (2, False)], "q int, ok boolean")
    assert {r.q: r.precision_at_k for r in metrics.precision_at_k(found, "q", F.col("ok"), 4).collect()} == {1: 0.25, 2: 0.0}

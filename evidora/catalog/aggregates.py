"""Aggregation, window, order and table-change queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from evidora import constants as K
from evidora.catalog.base import query
from evidora.catalog.lookups import SQL_NEIGHBOURS, _SCORED, vector_sides
from evidora.functions.scores import mean_in_order, round_half_up
from evidora.functions.text import token_proxy
from evidora.operators.evidence import citations_of, collect_ranked, context_of, score_evidence, within_budget
from evidora.operators.integrity import delete_by_ids, duplicate_keys
from evidora.operators.metrics import (
    latency_rollup, latency_rollup_approximate, latency_sketches, merged_sketches, rank_error, sketched_rollup, precision_at_k, share_of_total, support_share, token_budget, unequal_lists,
)
from evidora.operators.ranking import (
    append_rows, concat_lists, limit_k, newest_first, pick_positions, pinned_first, top_k_per_group,
    list_index,
)
from evidora.operators.sessions import (
    delete_never_empty, first_user_message, message_deltas, message_order, new_profiles, newest_per_user, runs,
    session_summary, touch, turn_pairs, upsert_sessions,
)
from evidora.operators.vectors import above_threshold, exact_top_k
from evidora.session import scratch_path
from evidora.sources.buckets import change_bucket_table, create_bucket_table, read_bucket_table

BATCH_TIME = "1999-01-01 00:00:00"


def ranked_documents(t, k: int = 4):
    """Best k documents per source in the shape of retrieved chunks."""
    chunks = t.documents.select(
        "source", F.col("doc_id").cast("string").alias("id"), F.col("doc_id").alias("ord"),
        F.col("text").alias("content"), F.col("lang").alias("section"),
        F.concat(F.lit("p. "), F.col("n_chars").cast("string")).alias("page"),
        (F.col("n_chars") / (F.col("n_chars") + F.lit(1000.0))).alias("similarity_score"),
        F.when(F.col("lang") == "fr", "Conditional").alias("recommendation_strength"),
    )
    return top_k_per_group(chunks, ["source"], [F.col("similarity_score").desc(), F.col("ord")], k, row_key="ord")


_CHUNK_COLUMNS = ["id", "source", "section", "page", "content", "similarity_score", "recommendation_strength"]

_TOP4 = f"""(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY score DESC, doc_id) AS rank
    FROM {_SCORED}) WHERE rank <= 4)"""
_SQL_MEAN = "list_reduce(list(score ORDER BY rank), lambda a, b: a + b) / count(*)"


# ---- aggregates


@query(
    "a1_mean_similarity",
    f"""SELECT l.label, coalesce(m.mean, 0.0::DOUBLE) AS mean_similarity FROM (SELECT DISTINCT label FROM embeddings) l LEFT JOIN
        (SELECT label, list_reduce(list(score ORDER BY rank), lambda a, b: a + b) / count(*) AS mean FROM
          (SELECT e.label, n.score, row_number() OVER (PARTITION BY e.label ORDER BY n.score DESC, n.query_id, n.chunk_id) AS rank
           FROM ({SQL_NEIGHBOURS}) n JOIN embeddings e ON n.query_id = e.vec_id WHERE n.score > 0.5)
         WHERE rank <= 4 GROUP BY label) m ON l.label = m.label""",
)
def _(t):
    found = exact_top_k(*vector_sides(t), 4, exclude_self=True).filter(F.col("score") > 0.5).drop("rank")
    labelled = found.join(t.embeddings, F.col("query_id") == F.col("vec_id")).select("label", "query_id", "chunk_id", "score")
    best = top_k_per_group(labelled, ["label"], [F.col("score").desc(), F.col("query_id"), F.col("chunk_id")], 4)
    lists = collect_ranked(best, ["label"], "rank", ["score"])
    labels = t.embeddings.select("label").distinct()
    return labels.join(lists, "label", "left").select(
        "label", mean_in_order(F.transform("chunks", lambda c: c["score"])).alias("mean_similarity")
    )


@query(
    "a2_grounded_score",
    f"SELECT source, floor(({_SQL_MEAN}) * 100 + 0.5) / 100 AS grounded_score FROM {_TOP4} GROUP BY source",
)
def _(t):
    lists = collect_ranked(ranked_documents(t), ["source"], "rank", ["similarity_score"])
    return score_evidence(lists).select("source", "grounded_score")


@query(
    "a3_list_sizes",
    """SELECT conv_id, turn, len(string_split(text, chr(10))) AS line_count FROM conversations""",
)
def _(t):
    return t.conversations.select("conv_id", "turn", F.size(F.split("text", "\n")).cast("bigint").alias("line_count"))


@query(
    "a4_prompt_context",
    f"""SELECT source, md5(string_agg(concat('[Evidence Document ', rank, ']:', chr(10), 'Source: ', source, ' (', lang,
        ', p. ', n_chars, ')', chr(10), 'Content: ', text, chr(10)), concat(chr(10), '---', chr(10)) ORDER BY rank)) AS context
        FROM {_TOP4} GROUP BY source""",
)
def _(t):
    lists = collect_ranked(ranked_documents(t), ["source"], "rank", _CHUNK_COLUMNS)
    return lists.select("source", F.md5(context_of(F.col("chunks"))).alias("context"))


@query(
    "a5_evidence_record",
    f"""SELECT source, string_agg(doc_id::VARCHAR, ',' ORDER BY rank) AS chunk_ids, string_agg(md5(concat(substr(text, 1, 120),
        '...')), ',' ORDER BY rank) AS quotes, string_agg(CASE WHEN lang = 'fr' THEN 'Conditional' ELSE 'Strong' END, ',' ORDER BY rank)
        AS strengths, floor(({_SQL_MEAN}) * 100 + 0.5) / 100 AS grounded_score, ({_SQL_MEAN}) < 0.9 AS insufficient
        FROM {_TOP4} GROUP BY source""",
)
def _(t):
    lists = collect_ranked(ranked_documents(t), ["source"], "rank", _CHUNK_COLUMNS)
    record = score_evidence(lists, threshold=0.9).withColumn("citations", citations_of(F.col("chunks")))
    return record.select(
        "source",
        F.array_join(F.transform("citations", lambda c: c["id"]), ",").alias("chunk_ids"),
        F.array_join(F.transform("citations", lambda c: F.md5(c["quote"])), ",").alias("quotes"),
        F.array_join(F.transform("citations", lambda c: c["strength"]), ",").alias("strengths"),
        "grounded_score", F.col("is_insufficient_evidence").alias("insufficient"),
    )


@query(
    "a6_category_counts",
    "SELECT lang, source, count(*) AS documents, sum(n_chars)::BIGINT AS chars FROM documents GROUP BY lang, source",
)
def _(t):
    return t.documents.groupBy("lang", "source").agg(
        F.count(F.lit(1)).alias("documents"), F.sum("n_chars").alias("chars")
    )


@query(
    "a7_budget_share",
    """SELECT p_brand, sum(p_size)::BIGINT AS amount, sum(p_size)::DOUBLE / (SELECT sum(p_size) FROM part)::DOUBLE AS share
       FROM part GROUP BY p_brand""",
)
def _(t):
    return share_of_total(t.part, ["p_brand"], "p_size")


@query(
    "a8_latency_rollup",
    """SELECT event_type, count(*) AS requests, sum(CAST(value AS DECIMAL(28,6)))::DOUBLE / count(value) AS mean_latency,
       min(value) AS min_latency, max(value) AS max_latency, sum(CAST(json_extract_string(props, '$.k') AS BIGINT))::BIGINT
       AS tokens, round(quantile_cont(value, 0.5), 6) AS p50_latency, round(quantile_cont(value, 0.95), 6) AS p95_latency
       FROM events GROUP BY event_type""",
)
def _(t):
    tokens = F.get_json_object("props", "$.k").cast("bigint")
    rolled = latency_rollup(t.events, ["event_type"], "value", tokens)
    return rolled.withColumns({c: F.round(c, 6) for c in ("p50_latency", "p95_latency")})


@query(
    "a8_latency_rollup_approximate",
    """SELECT event_type, count(*) AS requests, sum(CAST(value AS DECIMAL(28,6)))::DOUBLE / count(value) AS mean_latency,
       min(value) AS min_latency, max(value) AS max_latency, sum(json_extract(props, '$.k')::BIGINT)::BIGINT AS tokens,
       quantile_disc(value, 0.5) AS p50_latency, quantile_disc(value, 0.95) AS p95_latency FROM events GROUP BY event_type""",
)
def _(t):
    """Sketches as fine as the given groups, so that they return the values at the ranks themselves."""
    tokens = F.get_json_object("props", "$.k").cast("bigint")
    return latency_rollup_approximate(t.events, ["event_type"], "value", tokens, accuracy=1_000_000)


@query(
    "a8_rollup_from_windows",
    """SELECT event_type, count(*) AS requests, sum(CAST(value AS DECIMAL(28,6)))::DOUBLE / count(value) AS mean_latency,
       min(value) AS min_latency, max(value) AS max_latency, sum(CAST(json_extract_string(props, '$.k') AS BIGINT))::BIGINT AS
       tokens, true AS p50_close, true AS p95_close FROM events GROUP BY event_type""",
)
def _(t):
    """Sketches of hours, merged to days and then to types; their quantiles lie within 1 % of the exact ranks."""
    tokens = F.get_json_object("props", "$.k").cast("bigint")
    hours = latency_sketches(t.events, ["event_type"], "value", tokens, F.window("ts", "1 hour")["start"])
    days = merged_sketches(hours, ["event_type"], F.date_trunc("day", "period"))
    rolled = sketched_rollup(merged_sketches(days, ["event_type"]), {"p50": 0.5, "p95": 0.95})
    errors = rank_error(rolled, t.events, "event_type", "value", {"p50": 0.5, "p95": 0.95})
    rolled = rolled.join(errors, "event_type")
    return rolled.select(
        "event_type", "requests", "mean_latency", "min_latency", "max_latency", "tokens",
        (F.col("p50_error") <= 0.01).alias("p50_close"), (F.col("p95_error") <= 0.01).alias("p95_close"),
    )


@query(
    "a9_precision_at_k",
    f"""SELECT query_id, sum(CASE WHEN q.label = c.label THEN 1 ELSE 0 END) / 4.0::DOUBLE AS precision_at_k
        FROM ({SQL_NEIGHBOURS}) n JOIN embeddings q ON n.query_id = q.vec_id JOIN embeddings c ON n.chunk_id = c.vec_id
        GROUP BY query_id""",
)
def _(t):
    found = exact_top_k(*vector_sides(t), 4, exclude_self=True)
    label = t.embeddings.select("vec_id", "label")
    truth = found.join(label.select(F.col("vec_id").alias("query_id"), F.col("label").alias("wanted")), "query_id").join(
        label.select(F.col("vec_id").alias("chunk_id"), "label"), "chunk_id"
    )
    return precision_at_k(truth, "query_id", F.col("label") == F.col("wanted"), 4)


@query(
    "a9_precision_with_threshold",
    f"""SELECT q.vec_id AS query_id, coalesce(sum(CASE WHEN q.label = c.label THEN 1 ELSE 0 END), 0) / 4.0::DOUBLE AS
        precision_at_k FROM embeddings q LEFT JOIN ({SQL_NEIGHBOURS}) n ON n.query_id = q.vec_id AND n.score > 0.4
        LEFT JOIN embeddings c ON n.chunk_id = c.vec_id GROUP BY 1""",
)
def _(t):
    queries, chunks = vector_sides(t)
    found = above_threshold(exact_top_k(queries, chunks, 4, exclude_self=True), F.col("score"), 0.4)
    label = t.embeddings.select("vec_id", "label")
    truth = found.join(label.select(F.col("vec_id").alias("query_id"), F.col("label").alias("wanted")), "query_id").join(
        label.select(F.col("vec_id").alias("chunk_id"), "label"), "chunk_id"
    )
    return precision_at_k(truth, "query_id", F.col("label") == F.col("wanted"), 4, queries)


def sentences(df, text: str, *keys: str):
    """Trimmed sentences of a text, blank ones left out."""
    parts = df.select(*keys, F.explode(F.split(text, "[.\n]")).alias("part"))
    return parts.select(*keys, F.trim("part").alias("sentence")).filter(F.length("sentence") > 0)


def sql_sentences(table: str, key: str) -> str:
    return f"""(SELECT {key}, trim(part) AS sentence FROM (SELECT {key}, unnest(string_split_regex(text, '[.\\n]')) AS part
        FROM {table}) WHERE length(trim(part)) > 0)"""


@query(
    "a10_faithfulness",
    f"""SELECT item_id, count(*) AS claims, count(d.sentence) AS supported, count(d.sentence) / count(*)::DOUBLE AS faithfulness
        FROM {sql_sentences('benchmark', 'item_id')} b LEFT JOIN (SELECT DISTINCT sentence FROM
        {sql_sentences('documents', 'doc_id')}) d ON b.sentence = d.sentence GROUP BY item_id""",
)
def _(t):
    claims = sentences(t.benchmark, "text", "item_id")
    return support_share(claims, "item_id", "sentence", sentences(t.documents, "text", "doc_id"), "sentence")


@query(
    "a10_faithfulness_per_answer",
    f"""WITH s AS {sql_sentences('documents', 'doc_id')}, placed AS (SELECT d.source, l.quality, s.sentence FROM s
          JOIN documents d USING (doc_id) JOIN labels l USING (doc_id)),
        known AS (SELECT DISTINCT source, sentence FROM placed WHERE quality = 1)
        SELECT p.source, count(*) AS claims, count(k.sentence) AS supported, count(k.sentence) / count(*)::DOUBLE AS faithfulness
        FROM placed p LEFT JOIN known k ON p.source = k.source AND p.sentence = k.sentence WHERE p.quality = 0 GROUP BY p.source""",
)
def _(t):
    """Claims count only where the evidence of the same source states them."""
    placed = t.documents.join(t.labels, "doc_id")
    claims = sentences(placed.filter("quality = 0"), "text", "source")
    evidence = sentences(placed.filter("quality = 1"), "text", "source")
    return support_share(claims, "source", "sentence", evidence, "sentence", evidence_owner="source")


@query(
    "a11_model_window",
    """SELECT conv_id, turn, running_tokens, running_tokens <= context_window AS fits FROM (SELECT c.conv_id, turn,
         400 * (r_regionkey + 1) AS context_window, sum(ceil(length(text) / 4)::BIGINT) OVER (PARTITION BY conv_id ORDER BY turn)
         ::BIGINT AS running_tokens FROM conversations c JOIN region ON conv_id % 5 = r_regionkey)""",
)
def _(t):
    """Each conversation against the window of the model it chose from the catalog."""
    models = t.region.select(
        F.col("r_regionkey").alias("model"), (400 * (F.col("r_regionkey") + 1)).alias("context_window")
    )
    chosen = t.conversations.withColumn("model", F.col("conv_id") % 5).join(models, "model")
    return token_budget(chosen, "conv_id", "turn", token_proxy(F.col("text")), F.col("context_window")).select(
        "conv_id", "turn", "running_tokens", "fits"
    )


@query(
    "a11_context_budget",
    """SELECT conv_id, turn, tokens, running_tokens, running_tokens <= 800 AS fits FROM (SELECT *, sum(tokens) OVER
       (PARTITION BY conv_id ORDER BY turn)::BIGINT AS running_tokens FROM (SELECT conv_id, turn,
       ceil(length(text) / 4)::BIGINT AS tokens FROM conversations))""",
)
def _(t):
    return token_budget(t.conversations, "conv_id", "turn", token_proxy(F.col("text")), 800).select(
        "conv_id", "turn", "tokens", "running_tokens", "fits"
    )


@query(
    "a11_chunks_in_window",
    f"""SELECT source, sum(CASE WHEN running <= 8192 THEN 1 ELSE 0 END)::BIGINT AS chunks_used,
        coalesce(max(CASE WHEN running <= 8192 THEN running END), 0)::BIGINT AS tokens_used FROM (SELECT source, sum(ceil(
        length(text) / 4)::BIGINT) OVER (PARTITION BY source ORDER BY rank) AS running FROM {_TOP4}) GROUP BY source""",
)
def _(t):
    lists = collect_ranked(ranked_documents(t), ["source"], "rank", _CHUNK_COLUMNS)
    return within_budget(lists, "chunks", "content", F.lit(8192), token_proxy).select(
        "source", F.col("chunks_used").cast("bigint").alias("chunks_used"), "tokens_used"
    )


@query(
    "a13_unequal_lists",
    """SELECT doc_id, len(string_split(text, chr(10))) AS first_size, len(string_split(text, '. ')) AS second_size
       FROM documents WHERE len(string_split(text, chr(10))) <> len(string_split(text, '. '))""",
)
def _(t):
    found = unequal_lists(t.documents, F.split("text", "\n"), F.split("text", "[.] "))
    return found.select("doc_id", F.col("first_size").cast("bigint"), F.col("second_size").cast("bigint"))


@query(
    "a14_session_summary",
    """SELECT conv_id, count(*) AS messages, min(turn) AS first_at, max(turn) AS last_at,
       count(*) FILTER (WHERE role = 'user') AS user_messages, count(*) FILTER (WHERE role = 'assistant') AS assistant_messages,
       count(*) FILTER (WHERE role = 'system') AS system_messages, CASE WHEN length(arg_min(text, turn) FILTER (WHERE role = 'user'))
       > 38 THEN concat(substr(arg_min(text, turn) FILTER (WHERE role = 'user'), 1, 38), '...') ELSE arg_min(text, turn)
       FILTER (WHERE role = 'user') END AS title FROM conversations GROUP BY conv_id""",
)
def _(t):
    return session_summary(t.conversations, "conv_id", "turn")


# ---- windows


@query(
    "w1_first_user_message",
    """SELECT conv_id, turn AS first_at, text AS first_text FROM (SELECT *, row_number() OVER (PARTITION BY conv_id
       ORDER BY turn) AS n FROM conversations WHERE role = 'user') WHERE n = 1""",
)
def _(t):
    return first_user_message(t.conversations, "conv_id", "turn")


@query(
    "w2_list_index",
    """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber,
       l_partkey, l_suppkey, l_extendedprice) AS item_no FROM lineitem""",
)
def _(t):
    order = ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]
    items = t.lineitem.select("l_orderkey", *order)
    return list_index(items, ["l_orderkey"], order, index="item_no").drop("l_extendedprice")


@query("w3_top_k_chunks", f"SELECT source, doc_id, rank FROM {_TOP4}")
def _(t):
    return ranked_documents(t).select("source", F.col("ord").alias("doc_id"), "rank")


@query(
    "w4_event_runs",
    """SELECT user_id, run_no, min(event_type) AS event_type, count(*) AS events FROM (SELECT *, sum(changed) OVER (PARTITION BY
       user_id ORDER BY ts, event_id)::BIGINT AS run_no FROM (SELECT *, CASE WHEN lag(event_type) OVER (PARTITION BY user_id
       ORDER BY ts, event_id) IS NOT DISTINCT FROM event_type THEN 0 ELSE 1 END AS changed FROM events))
       GROUP BY user_id, run_no""",
)
def _(t):
    numbered = runs(t.events.select("user_id", "ts", "event_id", "event_type"), ["user_id"], ["ts", "event_id"], "event_type")
    return numbered.groupBy("user_id", "run_no").agg(
        F.min("event_type").alias("event_type"), F.count(F.lit(1)).alias("events")
    )


@query(
    "w5_turn_pairing",
    """SELECT conv_id, turn, coalesce(next_role = 'assistant', FALSE) AS answered, CASE WHEN next_role = 'assistant' THEN
       md5(next_text) END AS answer FROM (SELECT *, lead(role) OVER (PARTITION BY conv_id ORDER BY turn) AS next_role,
       lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS next_text FROM conversations) WHERE role = 'user'""",
)
def _(t):
    return turn_pairs(t.conversations, "conv_id", "turn").select(
        "conv_id", "turn", "answered", F.when(F.col("answered"), F.md5("next_text")).alias("answer")
    )


@query(
    "w6_newest_sessions",
    """SELECT o_custkey, o_orderkey, rank FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC,
       o_orderkey DESC) AS rank FROM orders) WHERE rank <= 3""",
)
def _(t):
    return newest_per_user(t.orders, "o_custkey", "o_orderdate", "o_orderkey", 3).select("o_custkey", "o_orderkey", "rank")


@query(
    "w7_message_order",
    """SELECT event_id, row_number() OVER w AS position, coalesce(epoch_us(ts) - epoch_us(lag(ts) OVER w), -1) AS gap_us
       FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)""",
)
def _(t):
    placed = message_order(t.events.select("user_id", "ts", "event_id"), "user_id", ["ts", "event_id"], previous="ts")
    micros = F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.col("previous_ts").cast("timestamp"))
    return placed.select("event_id", "position", F.coalesce(micros, F.lit(-1)).alias("gap_us"))


# ---- order, limit, lists


@query("o1_limit_k", "SELECT p_partkey, p_retailprice FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 10")
def _(t):
    return limit_k(t.part, [F.col("p_retailprice").desc(), F.col("p_partkey")], 10).select("p_partkey", "p_retailprice")


@query("o2_newest_first", "SELECT o_orderkey, epoch_us(o_orderdate) // 1000 AS created_ms FROM orders ORDER BY o_orderdate DESC, o_orderkey")
def _(t):
    return newest_first(t.orders, "o_orderdate", "o_orderkey").select(
        "o_orderkey", F.unix_millis(F.col("o_orderdate").cast("timestamp")).alias("created_ms")
    )


@query(
    "o3_positional_pick",
    """SELECT p_partkey, p_name, position FROM (SELECT *, row_number() OVER (ORDER BY p_name, p_partkey) - 1 AS position
       FROM part) WHERE position IN (0, 4, 10, 13)""",
)
def _(t):
    return pick_positions(t.part, [F.col("p_name"), F.col("p_partkey")], [0, 4, 10, 13]).select(
        "p_partkey", "p_name", "position"
    )


@query(
    "o4_pinned_first",
    """SELECT o_orderkey, o_orderpriority = '1-URGENT' AS pinned FROM orders ORDER BY 2 DESC, o_orderdate DESC, o_orderkey""",
)
def _(t):
    pinned = F.col("o_orderpriority") == "1-URGENT"
    return pinned_first(t.orders, pinned, "o_orderdate", "o_orderkey").select("o_orderkey", pinned.alias("pinned"))


@query(
    "u1_concat_lists",
    """SELECT 0 AS list_no, s_suppkey AS id, s_name AS name FROM supplier UNION ALL SELECT 1, c_custkey, c_name FROM customer""",
)
def _(t):
    return concat_lists(
        t.supplier.select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name")),
        t.customer.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name")),
    )


@query(
    "u2_append_rows",
    """SELECT conv_id, turn, role FROM conversations UNION ALL SELECT conv_id, max(turn) + 1, 'assistant' FROM conversations
       GROUP BY conv_id""",
)
def _(t):
    messages = t.conversations.select("conv_id", "turn", "role")
    answers = messages.groupBy("conv_id").agg((F.max("turn") + 1).alias("turn")).withColumn("role", F.lit("assistant"))
    return append_rows(messages, answers)


# ---- table changes


_UPSERTED = f"""WITH old AS (SELECT o_orderkey AS id, CASE WHEN o_orderstatus = 'F' THEN o_orderpriority ELSE '{K.DEFAULT_TITLE}' END AS title,
          0::BIGINT AS updated_at, 0::BIGINT AS messages FROM orders),
        new AS (SELECT conv_id * 2 AS id, count(*) AS messages, max(turn) AS last_at,
          arg_min(text, turn) FILTER (WHERE role = 'user') AS t FROM conversations GROUP BY conv_id)
        SELECT coalesce(old.id, new.id) AS id, CASE WHEN coalesce(title, '{K.DEFAULT_TITLE}') = '{K.DEFAULT_TITLE}' AND t IS NOT NULL
          AND t <> '' THEN CASE WHEN length(t) > 38 THEN concat(substr(t, 1, 38), '...') ELSE t END
          ELSE coalesce(title, '{K.DEFAULT_TITLE}') END AS title,
        coalesce(last_at, updated_at) AS updated_at, coalesce(new.messages, old.messages) AS messages
        FROM old FULL OUTER JOIN new ON old.id = new.id"""


@query("c1_session_upsert", _UPSERTED)
def _(t):
    deltas = message_deltas(t.conversations.withColumn("id", F.col("conv_id") * 2), "id", "turn")
    return upsert_sessions(_order_sessions(t), deltas, "id")


def _order_sessions(t):
    title = F.when(F.col("o_orderstatus") == "F", F.col("o_orderpriority")).otherwise(K.DEFAULT_TITLE)
    zero = F.lit(0).cast("bigint")
    return t.orders.select(
        F.col("o_orderkey").alias("id"), title.alias("title"), zero.alias("updated_at"), zero.alias("messages")
    )


@query("c1_upsert_in_buckets", _UPSERTED)
def _(t):
    """Two upserts, of the users' messages and then of all, each rewriting only the buckets that hold its sessions."""
    sessions, path = _order_sessions(t), scratch_path(t.spark, "session-buckets")
    create_bucket_table(sessions, path, "id", 16)
    messages = t.conversations.withColumn("id", F.col("conv_id") * 2)
    for batch in (messages.filter(F.col("role") == "user"), messages):
        deltas = message_deltas(batch, "id", "turn")
        change_bucket_table(path, sessions.schema, deltas, "id", 16, lambda old, new: upsert_sessions(old, new, "id"))
    return read_bucket_table(t.spark, path, sessions.schema)


@query(
    "c2_default_for_new_owner",
    f"""SELECT o_orderkey::VARCHAR AS o_orderkey, o_custkey, o_orderpriority AS title FROM orders UNION ALL
        SELECT concat('session_', sha256(c_custkey::VARCHAR)), c_custkey, '{K.DEFAULT_TITLE}' FROM customer
        WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)""",
)
def _(t):
    """Owners that never had a session get one on the first load."""
    sessions = t.orders.select("o_orderkey", "o_custkey", F.col("o_orderpriority").alias("title"))
    owners = t.customer.select(F.col("c_custkey").alias("o_custkey"))
    return delete_never_empty(sessions, t.orders.filter("false"), "o_orderkey", "o_custkey", owners=owners)


@query(
    "c2_delete_never_empty",
    f"""WITH kept AS (SELECT * FROM orders WHERE o_orderstatus <> 'F')
        SELECT o_orderkey::VARCHAR AS o_orderkey, o_custkey, o_orderpriority AS title FROM kept UNION ALL
        SELECT concat('session_', sha256(o_custkey::VARCHAR)), o_custkey, '{K.DEFAULT_TITLE}' FROM (SELECT DISTINCT o_custkey
        FROM orders) WHERE o_custkey NOT IN (SELECT o_custkey FROM kept)""",
)
def _(t):
    sessions = t.orders.select("o_orderkey", "o_custkey", F.col("o_orderpriority").alias("title"))
    return delete_never_empty(sessions, t.orders.filter("o_orderstatus = 'F'"), "o_orderkey", "o_custkey")


@query(
    "c3_touch_on_update",
    f"""SELECT o_orderkey, epoch_us(CASE WHEN o_orderstatus = 'O' THEN TIMESTAMP '{BATCH_TIME}' ELSE o_orderdate END) // 1000
        AS updated_ms FROM orders""",
)
def _(t):
    stamp = F.lit(BATCH_TIME).cast("timestamp_ntz")
    touched = touch(t.orders, F.col("o_orderstatus") == "O", "o_orderdate", stamp)
    return touched.select("o_orderkey", F.unix_millis(F.col("o_orderdate").cast("timestamp")).alias("updated_ms"))


@query(
    "c4_new_profiles",
    f"""SELECT c_custkey AS id, coalesce(CASE WHEN c_acctbal > 0 THEN c_mktsegment END, split_part(c_name, '#', 1)) AS full_name,
        'Clinician' AS clinical_role, epoch_us(TIMESTAMP '{BATCH_TIME}') // 1000 AS created_ms FROM customer
        WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')""",
)
def _(t):
    users = t.customer.select(
        F.col("c_custkey").alias("id"), F.col("c_name").alias("email"),
        F.when(F.col("c_acctbal") > 0, F.col("c_mktsegment")).alias("full_name"),
        F.lit(None).cast("string").alias("avatar_url"),
    )
    known = t.orders.filter("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("id"))
    made = new_profiles(users, known, F.lit(BATCH_TIME).cast("timestamp"), delimiter="#")
    return made.select("id", "full_name", "clinical_role", F.unix_millis("created_at").alias("created_ms"))


@query(
    "c5_duplicate_keys",
    "SELECT l_orderkey, l_linenumber, count(*) AS copies FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1",
)
def _(t):
    return duplicate_keys(t.lineitem, ["l_orderkey", "l_linenumber"])


@query("c5_first_of_key", "SELECT text_key, min(doc_id) AS doc_id FROM (SELECT md5(text) AS text_key, doc_id FROM documents) GROUP BY 1")
def _(t):
    return t.documents.groupBy(F.md5("text").alias("text_key")).agg(F.min("doc_id").alias("doc_id"))

"""Composite queries: evidence for questions, answer-ready batches, the evaluation report."""

from __future__ import annotations

from pyspark.sql import functions as F

from evidora import constants as K
from evidora.catalog.aggregates import sentences, sql_sentences
from evidora.catalog.base import query
from evidora.catalog.lookups import LANGUAGE_RULES, APPROXIMATE, SQL_NEIGHBOURS, sql_approximate, _SCORED, sql_route, vector_sides
from evidora.catalog.texts import _SQL_PLANTED, _SQL_REFUSED, planted_answers
from evidora.catalog.projections import ACCENTED, sql_trim
from evidora.functions.scores import insufficient, mean_in_order
from evidora.operators.audit import invented
from evidora.operators.comparison import side_by_side
from evidora.operators.metrics import precision_at_k, support_share
from evidora.operators.routing import with_route
from evidora.operators.sessions import turn_pairs
from evidora.operators.vectors import exact_top_k
from evidora.plans.answer_batch import answer_batch, answer_messages
from evidora.plans.history import browse_sessions, evidence_cards
from evidora.plans.evaluation import accuracy_by_groups, evaluation_report, grounding_measures, measure
from evidora.plans.keyword_evidence import keyword_evidence
from evidora.plans.vector_evidence import vector_evidence


def route_chunks(t):
    """Documents as evidence chunks of the route their own text falls into."""
    return with_route(t.documents, "text").select(
        F.col("doc_id").cast("string").alias("id"), "route", F.col("doc_id").alias("ord"),
        F.lit("").alias("title"), F.col("text").alias("content"), "source", F.col("lang").alias("section"),
        F.concat(F.lit("p. "), F.col("n_chars").cast("string")).alias("page"),
        (F.col("n_chars") / (F.col("n_chars") + F.lit(1000.0))).alias("similarity_score"),
        F.when(F.col("lang") == "fr", "Conditional").alias("recommendation_strength"),
    )


def sql_evidence(order: str) -> str:
    """Evidence per route, the default route being the first two lists one after the other."""
    return f"""chunks AS (SELECT *, {sql_route('text')} AS route FROM {_SCORED}),
        firsts AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY route ORDER BY {order}) AS rank FROM chunks
          WHERE route <> 'default') WHERE rank <= 4),
        fallback AS (SELECT * FROM (SELECT * EXCLUDE (rank, route), 'default' AS route, row_number() OVER (ORDER BY
          CASE WHEN {'TRUE' if order.startswith('doc_id') else 'FALSE'} THEN (CASE route WHEN 'hypertension_first_line' THEN 0
          ELSE 1 END) ELSE 0 END, {order}) AS rank FROM firsts WHERE route IN ('hypertension_first_line', 'statins_intensity'))
          WHERE rank <= 4),
        listed AS (SELECT route, rank, doc_id, source, lang, n_chars, text, score FROM firsts UNION ALL
          SELECT route, rank, doc_id, source, lang, n_chars, text, score FROM fallback),
        records AS (SELECT route, string_agg(doc_id::VARCHAR, ',' ORDER BY rank) AS chunk_ids,
          list_reduce(list(score ORDER BY rank), lambda a, b: a + b) / count(*) AS mean,
          string_agg(concat('[Evidence Document ', rank, ']:', chr(10), 'Source: ', source, ' (', lang, ', p. ', n_chars, ')',
          chr(10), 'Content: ', text, chr(10)), concat(chr(10), '---', chr(10)) ORDER BY rank) AS context FROM listed GROUP BY route)"""


def _keyword_rows(t, order_by: str):
    found = keyword_evidence(t.conversations, route_chunks(t), "text", order_by=order_by)
    return found.select(
        "conv_id", "turn", "route",
        F.coalesce(F.array_join(F.transform("citations", lambda c: c["id"]), ","), F.lit("")).alias("chunk_ids"),
        "grounded_score", F.col("is_insufficient_evidence").alias("insufficient"),
    )


def _sql_keyword(order: str) -> str:
    return f"""WITH {sql_evidence(order)} SELECT conv_id, turn, q.route, coalesce(chunk_ids, '') AS chunk_ids,
        floor(coalesce(mean, 0.0::DOUBLE) * 100 + 0.5) / 100 AS grounded_score, coalesce(mean, 0.0::DOUBLE) < 0.65 AS insufficient
        FROM (SELECT conv_id, turn, {sql_route('text')} AS route FROM conversations WHERE length({sql_trim('text')}) > 0) q
        LEFT JOIN records r ON q.route = r.route"""


@query("q1_keyword_evidence", _sql_keyword("doc_id"))
def _(t):
    return _keyword_rows(t, "list")


@query("q1_keyword_evidence_by_score", _sql_keyword("score DESC, doc_id::VARCHAR"))
def _(t):
    return _keyword_rows(t, "score")


_SQL_VECTOR = f"""SELECT query_id, string_agg(chunk_id::VARCHAR, ',' ORDER BY rank) AS chunk_ids,
    floor(list_reduce(list(score ORDER BY rank), lambda a, b: a + b) / count(*) * 100 + 0.5) / 100 AS grounded_score,
    list_reduce(list(score ORDER BY rank), lambda a, b: a + b) / count(*) < {{threshold}} AS insufficient
    FROM ({SQL_NEIGHBOURS}) GROUP BY query_id"""


def _vector_rows(found):
    return found.select(
        "query_id", F.array_join(F.transform("chunks", lambda c: c["chunk_id"].cast("string")), ",").alias("chunk_ids"),
        "grounded_score", F.col("is_insufficient_evidence").alias("insufficient"),
    )


@query("q2_vector_evidence", _SQL_VECTOR.format(threshold="0.65"))
def _(t):
    return _vector_rows(vector_evidence(*vector_sides(t), exclude_self=True))


@query("q2_vector_evidence_low_threshold", _SQL_VECTOR.format(threshold="0.35"))
def _(t):
    return _vector_rows(vector_evidence(*vector_sides(t), exclude_self=True, threshold=0.35))


@query(
    "q2_thresholded_evidence",
    f"""SELECT e.vec_id AS query_id, coalesce(string_agg(chunk_id::VARCHAR, ',' ORDER BY rank), '') AS chunk_ids,
        floor(coalesce(list_reduce(list(score ORDER BY rank) FILTER (WHERE score IS NOT NULL), lambda a, b: a + b) / count(score),
        0.0::DOUBLE) * 100 + 0.5) / 100 AS grounded_score,
        coalesce(list_reduce(list(score ORDER BY rank) FILTER (WHERE score IS NOT NULL), lambda a, b: a + b) / count(score),
        0.0::DOUBLE) < 0.65 AS insufficient FROM embeddings e LEFT JOIN (SELECT * FROM ({SQL_NEIGHBOURS}) WHERE score > 0.35) n
        ON e.vec_id = n.query_id GROUP BY e.vec_id""",
)
def _(t):
    return _vector_rows(vector_evidence(*vector_sides(t), exclude_self=True, chunk_threshold=0.35))


@query("q2_approximate_evidence", sql_approximate() + _SQL_VECTOR.format(threshold="0.65").replace(f"({SQL_NEIGHBOURS})", "near"))
def _(t):
    return _vector_rows(vector_evidence(*vector_sides(t), exclude_self=True, approximate=True, **APPROXIMATE))


@query(
    "q3_answer_batch",
    rf"""WITH {sql_evidence('doc_id')},
        memory AS (SELECT text AS original, min(concat('who ', turn)) AS translated FROM conversations
          WHERE role = 'user' AND length(text) > 150 GROUP BY text),
        asked AS (SELECT conv_id, turn, {sql_trim('text')} AS query, CASE WHEN regexp_matches({sql_trim('text')},
          '[\x{{00C0}}-\x{{00FF}}]') THEN 'ar' ELSE 'en' END AS lang FROM conversations WHERE role = 'user'),
        found AS (SELECT a.*, CASE WHEN lang = 'ar' AND original IS NOT NULL THEN translated ELSE query END AS translated_query,
          CASE WHEN lang = 'en' THEN 'direct' WHEN original IS NOT NULL THEN 'memory' ELSE 'fallback' END AS model
          FROM asked a LEFT JOIN memory m ON a.query = m.original),
        prompts AS (SELECT f.*, r.chunk_ids, r.mean, concat('Clinical Evidence Documents:', chr(10), coalesce(context, ''), chr(10),
          chr(10), 'Clinical Question:', chr(10), query) AS prompt FROM (SELECT *, {sql_route('translated_query')} AS route FROM found) f
          LEFT JOIN records r ON f.route = r.route)
        SELECT conv_id, turn, lang AS detected_lang, model AS translation_model, route, coalesce(chunk_ids, '') AS chunk_ids,
        floor(coalesce(mean, 0.0::DOUBLE) * 100 + 0.5) / 100 AS grounded_score, md5(prompt) AS prompt,
        ceil(length(prompt) / 4)::BIGINT AS prompt_tokens, ceil(length(prompt) / 4) <= 8192 AS fits_window FROM prompts""",
)
def _(t):
    questions = t.conversations.filter("role = 'user'")
    memory = questions.filter("length(text) > 150").select(
        F.col("text").alias("original"), F.concat(F.lit("who "), F.col("turn").cast("string")).alias("translated")
    )
    batch = answer_batch(
        questions, memory, route_chunks(t), "text", translation_model="memory", context_window=8192, ranges=ACCENTED
    )
    return batch.select(
        "conv_id", "turn", "detected_lang", "translation_model", "route",
        F.coalesce(F.array_join(F.transform("citations", lambda c: c["id"]), ","), F.lit("")).alias("chunk_ids"),
        "grounded_score", F.md5("prompt").alias("prompt"), "prompt_tokens", "fits_window",
    )


_TRANSLATED = rf"""memory AS (SELECT text AS original, min(concat('who ', turn)) AS translated,
          arg_min(turn * 10 + 5, concat('who ', turn)) AS latency FROM conversations
          WHERE role = 'user' AND length(text) > 150 GROUP BY text),
        turns AS (SELECT *, lead(role) OVER w AS next_role, lead(text) OVER w AS next_text FROM conversations
          WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
        asked AS (SELECT conv_id, turn, {sql_trim('text')} AS query, next_role = 'assistant' AS ok, next_text,
          CASE WHEN regexp_matches({sql_trim('text')}, '[\x{{00C0}}-\x{{00FF}}]') THEN 'ar' ELSE 'en' END AS lang FROM turns
          WHERE role = 'user'),
        found AS (SELECT a.*, CASE WHEN lang = 'ar' AND original IS NOT NULL THEN translated ELSE query END AS translated_query,
          CASE WHEN lang = 'en' THEN 'direct' WHEN original IS NOT NULL THEN 'memory' ELSE 'fallback' END AS model,
          CASE WHEN lang = 'en' THEN 0 ELSE latency END AS latency FROM asked a LEFT JOIN memory m ON a.query = m.original)"""


@query(
    "q3_answer_messages",
    rf"""WITH {sql_evidence('doc_id')}, {_TRANSLATED},
        best AS (SELECT route, lang, text, row_number() OVER (PARTITION BY route, lang ORDER BY score DESC, doc_id::VARCHAR DESC) AS r
          FROM chunks),
        sides AS (SELECT route, max(CASE WHEN lang = 'en' AND r = 1 THEN md5(text) END) AS who_stance,
          max(CASE WHEN lang = 'fr' AND r = 1 THEN md5(text) END) AS nice_stance FROM best GROUP BY route)
        SELECT conv_id, turn, concat(CASE WHEN ok THEN 'msg_' ELSE 'msg_err_' END, sha256(concat(conv_id, '|', turn, '|assistant'))) AS id,
        'assistant' AS role,
        md5(CASE WHEN ok THEN next_text ELSE concat('{K.ERROR_OPENING['en']}', '{K.ERROR_CAUSE['en']}') END) AS content,
        CASE WHEN ok THEN turn * 1000 ELSE 77 END AS timestamp,
        CASE WHEN ok THEN coalesce(chunk_ids, '') ELSE 'none' END AS citation_ids,
        CASE WHEN ok THEN coalesce(chunk_ids, '') ELSE 'none' END AS chunk_ids,
        CASE WHEN ok THEN floor(coalesce(mean, 0.0::DOUBLE) * 100 + 0.5) / 100 END AS faithfulness_score,
        CASE WHEN ok THEN floor(coalesce(mean, 0.0::DOUBLE) * 100 + 0.5) / 100 END AS confidence_score,
        CASE WHEN ok THEN turn + 25 END AS retrieval_latency_ms, CASE WHEN ok THEN turn + 320 END AS generation_latency_ms,
        CASE WHEN ok THEN 2 * turn + 345 END AS total_latency_ms,
        CASE WHEN ok THEN CASE length(next_text) // 4 WHEN 0 THEN 350 ELSE length(next_text) // 4 END END AS tokens_used,
        CASE WHEN ok THEN 'e' END AS embedding_model, CASE WHEN ok THEN 'm' END AS llm_model,
        CASE WHEN ok THEN md5(query) END AS original_query, CASE WHEN ok THEN lang END AS detected_lang,
        CASE WHEN ok THEN md5(translated_query) END AS translated_query, CASE WHEN ok THEN model END AS translation_model,
        CASE WHEN ok THEN latency END AS translation_latency_ms,
        CASE WHEN ok THEN coalesce(mean, 0.0::DOUBLE) < 0.65 ELSE TRUE END AS is_insufficient_evidence,
        CASE WHEN ok THEN who_stance END AS who_stance, CASE WHEN ok THEN nice_stance END AS nice_stance,
        CASE WHEN ok AND who_stance IS NOT NULL AND nice_stance IS NOT NULL THEN 'both sides' END AS consensus
        FROM (SELECT * REPLACE (coalesce(ok, FALSE) AS ok), {sql_route('translated_query')} AS route FROM found) q
        LEFT JOIN records r ON q.route = r.route LEFT JOIN sides s ON q.route = s.route""",
)
def _(t):
    """Every field of an assistant message, also those of questions that failed; texts as digests."""
    questions = t.conversations.filter("role = 'user'")
    memory = questions.filter("length(text) > 150").select(
        F.col("text").alias("original"), F.concat(F.lit("who "), F.col("turn").cast("string")).alias("translated"),
        (F.col("turn") * 10 + 5).alias("latency_ms"),
    )
    chunks = route_chunks(t)
    sides = side_by_side(
        chunks, "route", "section", {"en": "who_stance", "fr": "nice_stance"}, F.md5("content"), "similarity_score", "id"
    )
    consensus = F.when(F.col("both_present"), "both sides").alias("consensus")
    comparison = sides.select("route", F.struct("who_stance", "nice_stance", consensus).alias("comparison"))
    batch = answer_batch(
        questions, memory, chunks, "text", translation_model="memory", context_window=8192, ranges=ACCENTED,
        comparison=comparison,
    )
    turn = F.col("turn").cast("bigint")
    answers = turn_pairs(t.conversations, "conv_id", "turn").filter("answered").select(
        "conv_id", "turn", F.col("next_text").alias("content"),
        F.floor(F.length("next_text") / 4).alias("tokens_used"), F.lit(None).cast("string").alias("error"),
        (turn + K.FALLBACK_RETRIEVAL_MS).alias("retrieval_ms"), (turn + K.FALLBACK_GENERATION_MS).alias("generation_ms"),
        (2 * turn + K.FALLBACK_TOTAL_MS).alias("total_ms"), (turn * 1000).alias("timestamp"),
    )
    made = answer_messages(
        batch, answers, ["conv_id", "turn"], llm_model="m", embedding_model="e", batch_time=F.lit(77)
    )

    def ids(listed):
        joined = F.coalesce(F.array_join(F.transform(listed, lambda c: c["id"]), ","), F.lit(""))
        return F.when(F.col("metrics").isNull(), "none").otherwise(joined)

    return made.select(
        "conv_id", "turn", "id", "role", F.md5("content").alias("content"), "timestamp",
        ids("citations").alias("citation_ids"), ids("retrieved_chunks").alias("chunk_ids"), "confidence_score",
        *(f"metrics.{name}" for name in (
            "faithfulness_score", "retrieval_latency_ms", "generation_latency_ms", "total_latency_ms", "tokens_used",
            "embedding_model", "llm_model")),
        F.md5("translation.original_query").alias("original_query"), "translation.detected_lang",
        F.md5("translation.translated_query").alias("translated_query"), "translation.translation_model",
        F.col("translation.latency_ms").alias("translation_latency_ms"), "is_insufficient_evidence", "comparison.*",
    )


@query(
    "q4_evaluation_report",
    f"""WITH n AS ({SQL_NEIGHBOURS}),
        p AS (SELECT query_id, sum(CASE WHEN q.label = c.label THEN 1 ELSE 0 END) AS hits FROM n JOIN embeddings q
          ON n.query_id = q.vec_id JOIN embeddings c ON n.chunk_id = c.vec_id GROUP BY query_id),
        m AS (SELECT query_id, list_reduce(list(score ORDER BY rank), lambda a, b: a + b) / count(*) AS mean FROM n GROUP BY query_id),
        f AS (SELECT item_id, count(*) AS claims, count(d.sentence) AS supported FROM {sql_sentences('benchmark', 'item_id')} b
          LEFT JOIN (SELECT DISTINCT sentence FROM {sql_sentences('documents', 'doc_id')}) d ON b.sentence = d.sentence GROUP BY item_id)
        SELECT 'precision_at_k' AS measure, count(*) AS measured, round(sum(hits) / 4.0::DOUBLE / count(*), 6) AS value FROM p
        UNION ALL SELECT 'insufficient_share', count(*), round(sum(CASE WHEN mean < 0.35 THEN 1 ELSE 0 END) / count(*)::DOUBLE, 6) FROM m
        UNION ALL SELECT 'claim_support', count(*), round(sum(supported) / sum(claims)::DOUBLE, 6) FROM f
        UNION ALL SELECT 'routing_accuracy', count(*), round(sum(CASE WHEN lang = routed THEN 1 ELSE 0 END) / count(*)::DOUBLE, 6)
          FROM (SELECT lang, CASE"""
    + "".join(
        " WHEN " + " OR ".join(f"contains(lower(text), '{w}')" for w in r.keywords) + f" THEN '{r.route}'"
        for r in LANGUAGE_RULES
    )
    + " ELSE 'default' END AS routed FROM documents)",
)
def _(t):
    found = exact_top_k(*vector_sides(t), 4, exclude_self=True)
    label = t.embeddings.select("vec_id", "label")
    truth = found.join(label.select(F.col("vec_id").alias("query_id"), F.col("label").alias("wanted")), "query_id").join(
        label.select(F.col("vec_id").alias("chunk_id"), "label"), "chunk_id"
    )
    precision = precision_at_k(truth, "query_id", F.col("label") == F.col("wanted"), 4)
    means = found.groupBy("query_id").agg(
        mean_in_order(
            F.transform(F.array_sort(F.collect_list(F.struct("rank", "score"))), lambda c: c["score"])
        ).alias("mean")
    )
    claims = sentences(t.benchmark, "text", "item_id")
    support = support_share(claims, "item_id", "sentence", sentences(t.documents, "text", "doc_id"), "sentence")
    routed = with_route(t.documents, "text", LANGUAGE_RULES, name="routed")
    n = F.count(F.lit(1))
    return evaluation_report(
        measure("precision_at_k", precision, F.round(F.sum("precision_at_k") / n, 6)),
        measure("insufficient_share", means, F.round(F.count_if(insufficient(F.col("mean"), 0.35)) / n, 6)),
        measure("claim_support", support, F.round(F.sum("supported") / F.sum("claims"), 6)),
        measure("routing_accuracy", routed, F.round(F.count_if(F.col("routed") == F.col("lang")) / n, 6)),
    )


@query(
    "q4_grounding_rows",
    f"""WITH a AS (SELECT flagged, {_SQL_REFUSED} AS refused, {' OR '.join(rf"regexp_matches(lower(answer), '\b{p}\b')" for p in K.OVERCERTAIN_PHRASES)} AS certain
          FROM {_SQL_PLANTED}),
        lost AS (SELECT s.sentence, d.sentence IS NULL AS invented FROM {sql_sentences('benchmark', 'item_id')} s
          LEFT JOIN (SELECT DISTINCT sentence FROM {sql_sentences('documents', 'doc_id')}) d ON s.sentence = d.sentence)
        SELECT 'overcertain_share' AS measure, count(*) AS measured, round(count(*) FILTER (WHERE certain) / count(*)::DOUBLE, 6) AS value FROM a
        UNION ALL SELECT 'refusal_share', count(*), round(count(*) FILTER (WHERE refused) / count(*)::DOUBLE, 6) FROM a
        UNION ALL SELECT 'refusal_agreement', count(*), round(count(*) FILTER (WHERE refused = flagged) / count(*)::DOUBLE, 6) FROM a
        UNION ALL SELECT 'invented_share', count(*), round(count(*) FILTER (WHERE invented) / count(*)::DOUBLE, 6) FROM lost""",
)
def _(t):
    claims = sentences(t.benchmark, "text", "item_id")
    lost = invented(claims, sentences(t.documents, "text", "doc_id"), ["sentence"])
    both = claims.select(F.lit(0).alias("lost")).unionByName(lost.select(F.lit(1).alias("lost")))
    share = F.round(F.try_divide(F.sum("lost"), F.count_if(F.col("lost") == 0)), 6)
    found = both.agg(F.count_if(F.col("lost") == 0).alias("measured"), share.alias("value"))
    return evaluation_report(
        grounding_measures(planted_answers(t), "answer", F.col("flagged")),
        found.select(F.lit("invented_share").alias("measure"), "measured", "value"),
    )


@query(
    "q4_accuracy_by_group",
    """SELECT source, lang, grouping_id(source, lang)::BIGINT AS level, count(*) AS questions,
        count(*) FILTER (WHERE lang_of = routed) AS matched, round(count(*) FILTER (WHERE lang_of = routed) / count(*)::DOUBLE, 6) AS accuracy
        FROM (SELECT source, lang, lang AS lang_of, CASE"""
    + "".join(
        " WHEN " + " OR ".join(f"contains(lower(text), '{w}')" for w in r.keywords) + f" THEN '{r.route}'"
        for r in LANGUAGE_RULES
    )
    + " ELSE 'default' END AS routed FROM documents) GROUP BY CUBE (source, lang)",
)
def _(t):
    routed = with_route(t.documents, "text", LANGUAGE_RULES, name="routed").withColumn("expected", F.col("lang"))
    return accuracy_by_groups(routed, "routed", "expected", ["source", "lang"])


@query(
    "h1_browse_sessions",
    """SELECT o_custkey, o_orderkey, o_orderpriority, rank FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey
       ORDER BY o_orderdate DESC, o_orderkey DESC) AS rank FROM orders WHERE contains(lower(o_orderpriority), 'high')) WHERE rank <= 2""",
)
def _(t):
    found = browse_sessions(t.orders, "o_custkey", "o_orderpriority", "o_orderdate", "o_orderkey", term="HIGH", k=2)
    return found.select("o_custkey", "o_orderkey", "o_orderpriority", "rank")


@query(
    "h2_evidence_cards",
    f"""WITH {sql_evidence('doc_id')} SELECT conv_id, turn, rank AS chunk_no, doc_id::VARCHAR AS chunk_id,
        CAST(floor(score * 100 + 0.5) AS INTEGER) AS percent, CASE WHEN floor(score * 100 + 0.5) >= 85 THEN 'high' WHEN
        floor(score * 100 + 0.5) >= 70 THEN 'good' WHEN floor(score * 100 + 0.5) >= 50 THEN 'fair' ELSE 'low' END AS band,
        concat('p. ', n_chars) AS place FROM (SELECT conv_id, turn, {sql_route('text')} AS route FROM conversations
        WHERE length({sql_trim('text')}) > 0) q JOIN listed l ON q.route = l.route""",
)
def _(t):
    found = keyword_evidence(t.conversations, route_chunks(t), "text")
    return evidence_cards(found, F.col("chunks"), "conv_id", "turn")

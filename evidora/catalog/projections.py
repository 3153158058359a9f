"""Projection queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from evidora.catalog.base import query
from evidora.functions.language import by_language, detected_language, direct_translation, in_script
from evidora.functions.payloads import citation, decoded
from evidora.functions.scores import percentage, round_half_up, score_band
from evidora.functions.text import (
    evidence_block, falsy_or, fold, local_part, model_short_name, profile_name, quote_snippet, row_id, short_title,
    trim_all,
)
from evidora.functions.times import from_epoch_ms, hour_minute, to_epoch_ms
from evidora.operators.metrics import latency_spans
from evidora.operators.ranking import top_k_per_group
from evidora.sources.tables import with_defaults

# Accented Latin letters stand in for the script to detect: the tables hold no Arabic.
ACCENTED = [("00C0", "00FF")]
SQL_SPACE = r"[\t-\r \x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"


def sql_trim(expr: str) -> str:
    return rf"regexp_replace({expr}, '^{SQL_SPACE}+|{SQL_SPACE}+$', '', 'g')"


@query("p1_case_folding", "SELECT doc_id, md5(lower(text)) AS folded FROM documents")
def _(t):
    return t.documents.select("doc_id", F.md5(fold(F.col("text"))).alias("folded"))


_PADDED = "concat(chr(10), chr(160), ' ', text, chr(9), chr(65279), chr(8195), chr(10))"


@query("p2_whitespace_trim", f"SELECT conv_id, turn, md5({sql_trim(_PADDED)}) AS trimmed FROM conversations")
def _(t):
    before, after = "".join(map(chr, [10, 160, 32])), "".join(map(chr, [9, 65279, 8195, 10]))
    padded = F.concat(F.lit(before), "text", F.lit(after))
    return t.conversations.select("conv_id", "turn", F.md5(trim_all(padded)).alias("trimmed"))


@query(
    "p3_substring_test",
    """SELECT lang, count(*) AS docs, sum(CASE WHEN contains(lower(text), 'who') THEN 1 ELSE 0 END)::BIGINT AS with_needle,
       sum(CASE WHEN contains(lower(text), '') THEN 1 ELSE 0 END)::BIGINT AS with_empty FROM documents GROUP BY lang""",
)
def _(t):
    folded = fold(F.col("text"))
    return t.documents.groupBy("lang").agg(
        F.count(F.lit(1)).alias("docs"),
        F.count_if(folded.contains("who")).alias("with_needle"),
        F.count_if(folded.contains("")).alias("with_empty"),
    )


@query("p4_quote_snippet", "SELECT doc_id, concat(substr(text, 1, 120), '...') AS quote FROM documents")
def _(t):
    return t.documents.select("doc_id", quote_snippet(F.col("text")).alias("quote"))


@query(
    "p5_title_shortening",
    """SELECT conv_id, turn, CASE WHEN length(text) > 38 THEN concat(substr(text, 1, 38), '...') ELSE text END AS title
       FROM conversations""",
)
def _(t):
    return t.conversations.select("conv_id", "turn", short_title(F.col("text")).alias("title"))


@query(
    "p6_local_part",
    """SELECT c_custkey, coalesce(nullif(split_part(c_name, '#', 1), ''), 'Dr. User') AS local_part,
       coalesce(CASE WHEN c_acctbal > 0 THEN c_mktsegment END, split_part(c_name, '#', 1)) AS full_name FROM customer""",
)
def _(t):
    return t.customer.select(
        "c_custkey",
        local_part(F.col("c_name"), delimiter="#").alias("local_part"),
        profile_name(F.when(F.col("c_acctbal") > 0, F.col("c_mktsegment")), F.col("c_name"), delimiter="#").alias(
            "full_name"
        ),
    )


@query(
    "p7_model_short_name",
    """SELECT p_partkey, coalesce(nullif(split_part(m, '/', 2), ''), m) AS short_name
       FROM (SELECT p_partkey, CASE WHEN p_size > 25 THEN concat(p_brand, '/', p_type) ELSE p_brand END AS m FROM part)""",
)
def _(t):
    model = F.when(F.col("p_size") > 25, F.concat("p_brand", F.lit("/"), "p_type")).otherwise(F.col("p_brand"))
    return t.part.select("p_partkey", model_short_name(model).alias("short_name"))


@query(
    "p8_falsy_fallback",
    """SELECT event_id, coalesce(nullif(CAST(json_extract_string(props, '$.k') AS BIGINT), 0), 350) AS tokens,
       coalesce(nullif(CASE WHEN event_type = 'error' THEN '' ELSE event_type END, ''), 'Strong') AS strength FROM events""",
)
def _(t):
    k = F.get_json_object("props", "$.k").cast("bigint")
    strength = F.when(F.col("event_type") == "error", "").otherwise(F.col("event_type"))
    return t.events.select(
        "event_id",
        falsy_or(k, F.lit(350).cast("bigint")).alias("tokens"),
        falsy_or(strength, "Strong", empty="").alias("strength"),
    )


@query(
    "p9_round_half_up",
    """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, floor(l_extendedprice * l_discount * 100 + 0.5) / 100 AS rounded
       FROM lineitem""",
)
def _(t):
    return t.lineitem.select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
        round_half_up(F.col("l_extendedprice") * F.col("l_discount")).alias("rounded"),
    )


@query(
    "p10_percentage",
    "SELECT CAST(floor(l_discount * 100 + 0.5) AS INTEGER) AS percent, count(*) AS items FROM lineitem GROUP BY 1",
)
def _(t):
    return t.lineitem.groupBy(percentage(F.col("l_discount")).alias("percent")).agg(F.count(F.lit(1)).alias("items"))


@query(
    "p11_score_band",
    """SELECT CASE WHEN p >= 85 THEN 'high' WHEN p >= 70 THEN 'good' WHEN p >= 50 THEN 'fair' ELSE 'low' END AS band,
       count(*) AS events FROM (SELECT floor((value / 500.0::DOUBLE) * 100 + 0.5) AS p FROM events) GROUP BY 1""",
)
def _(t):
    return t.events.groupBy(score_band(F.col("value") / F.lit(500.0)).alias("band")).agg(
        F.count(F.lit(1)).alias("events")
    )


@query(
    "p12_language_column",
    """SELECT doc_id, CASE WHEN lang = 'fr' THEN concat('source: ', source) ELSE concat('src/', source) END AS label
       FROM documents""",
)
def _(t):
    label = by_language(
        F.col("lang"), F.concat(F.lit("source: "), "source"), F.concat(F.lit("src/"), "source"), first_lang="fr"
    )
    return t.documents.select("doc_id", label.alias("label"))


@query("p13_script_detection", r"SELECT doc_id, regexp_matches(text, '[\x{00C0}-\x{00FF}]') AS accented FROM documents")
def _(t):
    return t.documents.select("doc_id", in_script(F.col("text"), ACCENTED).alias("accented"))


@query(
    "p14_language_label",
    r"""SELECT conv_id, turn, CASE WHEN regexp_matches(text, '[\x{00C0}-\x{00FF}]') THEN 'ar' ELSE 'en' END AS detected,
        CASE WHEN NOT regexp_matches(text, '[\x{00C0}-\x{00FF}]') THEN 'direct' END AS model,
        CASE WHEN NOT regexp_matches(text, '[\x{00C0}-\x{00FF}]') THEN '0' END AS latency_ms FROM conversations""",
)
def _(t):
    detected = detected_language(F.col("text"), ACCENTED)
    meta = F.when(detected == "en", direct_translation(F.col("text")))
    return t.conversations.select("conv_id", "turn", detected.alias("detected"), meta.alias("meta")).select(
        "conv_id", "turn", "detected",
        F.col("meta.translation_model").alias("model"), F.col("meta.latency_ms").cast("string").alias("latency_ms"),
    )


@query("p15_hour_minute", "SELECT strftime(ts, '%H:%M') AS at, count(*) AS events FROM events GROUP BY 1")
def _(t):
    return t.events.groupBy(hour_minute(F.col("ts")).alias("at")).agg(F.count(F.lit(1)).alias("events"))


@query(
    "p16_evidence_line",
    """SELECT source, rank, md5(concat('[Evidence Document ', rank, ']:', chr(10), 'Source: ', source, ' (', lang, ', p. ',
       doc_id, ')', chr(10), 'Content: ', text, chr(10))) AS block FROM (SELECT *, row_number() OVER
       (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS rank FROM documents) WHERE rank <= 4""",
)
def _(t):
    first = top_k_per_group(t.documents, ["source"], [F.col("n_chars").desc(), F.col("doc_id")], 4, row_key="doc_id")
    page = F.concat(F.lit("p. "), F.col("doc_id").cast("string"))
    block = evidence_block(F.col("rank"), F.col("source"), F.col("lang"), page, F.col("text"))
    return first.select("source", "rank", F.md5(block).alias("block"))


@query(
    "p17_row_id",
    "SELECT conv_id, turn, concat('msg_', sha256(concat(conv_id, '|', turn, '|', role))) AS id FROM conversations",
)
def _(t):
    return t.conversations.select(
        "conv_id", "turn", row_id("msg_", F.col("conv_id"), F.col("turn"), F.col("role")).alias("id")
    )


@query("p18_epoch_timestamp", "SELECT event_id, epoch_us(ts) // 1000 AS ms, strftime(ts, '%Y-%m-%d %H:%M:%S') AS at FROM events")
def _(t):
    ms = to_epoch_ms(F.col("ts"))
    return t.events.select(
        "event_id", ms.alias("ms"), F.date_format(from_epoch_ms(ms), "yyyy-MM-dd HH:mm:ss").alias("at")
    )


@query(
    "p19_latency_spans",
    """SELECT user_id, strftime(ts, '%Y-%m-%d') AS day,
       CAST(max(CASE WHEN event_type = 'click' THEN epoch_us(ts) // 1000 END)
         - min(CASE WHEN event_type = 'view' THEN epoch_us(ts) // 1000 END) AS VARCHAR) AS retrieval_ms,
       CAST(max(CASE WHEN event_type = 'purchase' THEN epoch_us(ts) // 1000 END)
         - min(CASE WHEN event_type = 'click' THEN epoch_us(ts) // 1000 END) AS VARCHAR) AS generation_ms
       FROM events GROUP BY 1, 2""",
)
def _(t):
    events = t.events.withColumn("day", F.date_format("ts", "yyyy-MM-dd"))
    spans = {"retrieval_ms": ("view", "click"), "generation_ms": ("click", "purchase")}
    found = latency_spans(events, ["user_id", "day"], "event_type", "ts", spans)
    return found.withColumns({name: F.col(name).cast("string") for name in spans})


@query(
    "p20_json_decode",
    """SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k,
       json_extract_string(props, '$.missing') AS missing FROM events""",
)
def _(t):
    typed = F.from_json("props", "k bigint, missing string").alias("p")
    return t.events.select("event_id", typed).select("event_id", "p.k", "p.missing")


@query(
    "p20_json_variant",
    "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events",
)
def _(t):
    return t.events.select("event_id", F.variant_get(F.parse_json("props"), "$.k", "bigint").alias("k"))


@query(
    "p20_citation_column",
    """SELECT doc_id, source, lang AS section, concat(substr(text, 1, 120), '...') AS quote FROM documents""",
)
def _(t):
    made = F.struct(
        F.col("doc_id").cast("string").alias("id"), "source", F.col("lang").alias("section"),
        quote_snippet(F.col("text")).alias("quote"),
    )
    stored = t.documents.select("doc_id", F.to_json(F.array(made)).alias("citations"))
    return stored.select("doc_id", F.inline(decoded("citations"))).select("doc_id", "source", "section", "quote")


@query(
    "p21_citation_build",
    """SELECT doc_id AS id, source, lang AS section, concat('p. ', n_chars) AS page, concat(substr(text, 1, 120), '...')
       AS quote, n_chars / (n_chars + 1000.0::DOUBLE) AS relevance_score, coalesce(nullif(CASE WHEN lang = 'en' THEN ''
       WHEN lang = 'fr' THEN 'Conditional' END, ''), 'Strong') AS strength FROM documents""",
)
def _(t):
    made = citation(
        F.col("doc_id"), F.col("source"), F.col("lang"), F.concat(F.lit("p. "), F.col("n_chars").cast("string")),
        F.col("text"), F.col("n_chars") / (F.col("n_chars") + F.lit(1000.0)),
        F.when(F.col("lang") == "en", "").when(F.col("lang") == "fr", "Conditional"),
    )
    return t.documents.select(made.alias("c")).select("c.*")


@query(
    "p22_column_defaults",
    """SELECT c_custkey AS id, coalesce(CASE WHEN c_acctbal > 5000 THEN c_mktsegment END, 'محادثة سريرية جديدة') AS title,
       coalesce(CASE WHEN c_nationkey < 5 THEN TRUE END, FALSE) AS pinned FROM customer""",
)
def _(t):
    raw = t.customer.select(
        F.col("c_custkey").alias("id"),
        F.when(F.col("c_acctbal") > 5000, F.col("c_mktsegment")).alias("title"),
        F.when(F.col("c_nationkey") < 5, True).alias("pinned"),
    )
    return with_defaults(raw, "chat_sessions")

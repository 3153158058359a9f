"""Filter, routing, join and retrieval queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from evidora import constants as K
from evidora.catalog.base import query
from evidora.catalog.projections import ACCENTED, sql_trim
from evidora.functions.language import detected_language
from evidora.functions.scores import insufficient, visible_parts
from evidora.functions.text import contains_any, fold, has_text, short_title, trim_all
from evidora.operators.comparison import shared_values, side_by_side, to_catalog
from evidora.operators.integrity import (
    cascade, check_writes, delete_by_id, delete_by_ids, domain_violations, find_or_first, orphans, owned_by,
    owned_by_any,
)
from evidora.operators.ranking import top_k_per_group
from evidora.operators.routing import Rule, expand_sources, routing_accuracy, with_route, with_route_from_table
from evidora.operators.translation import translate
from evidora.operators.vectors import above_threshold, approx_top_k, exact_top_k, mean_vectors, recall_against


def sql_route(text: str) -> str:
    """The router rules as a CASE expression."""
    whens = "".join(
        " WHEN " + " OR ".join(f"contains(lower({text}), '{w}')" for w in words) + f" THEN '{name}'"
        for name, words in K.ROUTE_KEYWORDS
    )
    return f"CASE{whens} ELSE '{K.DEFAULT_ROUTE}' END"


# ---- filters


@query(
    "f1_title_search",
    """SELECT p_partkey, p_name FROM part WHERE contains(lower(p_name), lower('RED'))""",
)
def _(t):
    return t.part.filter(fold(F.col("p_name")).contains("RED".lower())).select("p_partkey", "p_name")


@query(
    "f1_session_title_search",
    """SELECT conv_id, title FROM (SELECT conv_id, CASE WHEN length(text) > 38 THEN concat(substr(text, 1, 38), '...')
       ELSE text END AS title FROM (SELECT conv_id, arg_min(text, turn) AS text FROM conversations WHERE role = 'user'
       GROUP BY conv_id)) WHERE contains(lower(title), 'the')""",
)
def _(t):
    titles = (
        t.conversations.filter("role = 'user'").groupBy("conv_id")
        .agg(short_title(F.min_by("text", "turn")).alias("title"))
    )
    return titles.filter(fold(F.col("title")).contains("the"))


def suggestions(df, text: str, term: str):
    """Rows whose text holds the trimmed, folded term; a blank term gives none."""
    needle = trim_all(fold(F.lit(term)))
    return df.filter((F.length(needle) > 0) & fold(F.col(text)).contains(needle))


@query("f2_question_suggestion", "SELECT item_id, text FROM benchmark WHERE contains(lower(text), 'tion')")
def _(t):
    return suggestions(t.benchmark, "text", "  TION ").select("item_id", "text")


@query("f3_category_filter", "SELECT c_custkey, c_name FROM customer WHERE c_mktsegment = 'MACHINERY'")
def _(t):
    return t.customer.filter(F.col("c_mktsegment") == "MACHINERY").select("c_custkey", "c_name")


@query("f4_delete_by_id", "SELECT conv_id, turn, role FROM conversations WHERE conv_id <> 7")
def _(t):
    return delete_by_id(t.conversations, "conv_id", F.lit(7)).select("conv_id", "turn", "role")


@query(
    "f4_delete_many",
    """SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 0)""",
)
def _(t):
    return delete_by_ids(t.documents, "doc_id", t.labels.filter("quality = 0")).select("doc_id", "source")


@query("f5_own_rows", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_custkey = 42")
def _(t):
    return owned_by(t.orders, "o_custkey", F.lit(42)).select("o_orderkey", "o_totalprice")


@query(
    "f5_granted_rows",
    """SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_nationkey = 3)""",
)
def _(t):
    return owned_by_any(t.orders, "o_custkey", t.customer.filter("c_nationkey = 3"), "c_custkey").select(
        "o_orderkey", "o_custkey"
    )


@query(
    "f5_checked_writes",
    """SELECT accepted, count(*) AS n FROM (SELECT user_id = CAST(json_extract_string(props, '$.k') AS BIGINT) AS accepted
       FROM events) GROUP BY accepted""",
)
def _(t):
    batch = t.events.withColumn("actor", F.get_json_object("props", "$.k").cast("bigint"))
    return check_writes(batch, "user_id", "actor").groupBy("accepted").agg(F.count(F.lit(1)).alias("n"))


@query(
    "f6_domain_check",
    """SELECT o_orderpriority AS value, count(*) AS violations FROM orders
       WHERE o_orderpriority NOT IN ('1-URGENT', '2-HIGH') GROUP BY 1""",
)
def _(t):
    return domain_violations(t.orders, "o_orderpriority", ["1-URGENT", "2-HIGH"])


@query(
    "f6_role_domain",
    "SELECT role AS value, count(*) AS violations FROM conversations WHERE role NOT IN ('user', 'assistant') GROUP BY 1",
)
def _(t):
    return domain_violations(t.conversations, "role", [r for r in K.ROLES if r != "system"])


@query(
    "f7_blank_reject",
    f"""SELECT doc_id, part_no FROM (SELECT doc_id, unnest(string_split(text, '.')) AS part,
        generate_subscripts(string_split(text, '.'), 1) AS part_no FROM documents) WHERE length({sql_trim('part')}) > 0""",
)
def _(t):
    parts = t.documents.select("doc_id", F.posexplode(F.split("text", "[.]")).alias("at", "part"))
    return parts.filter(has_text(F.col("part"))).select("doc_id", (F.col("at") + 1).cast("bigint").alias("part_no"))


@query(
    "f8_insufficient_evidence",
    """SELECT user_id, CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) / count(*) < 25.0::DOUBLE AS insufficient
       FROM events GROUP BY user_id""",
)
def _(t):
    mean = F.sum(F.col("value").cast("decimal(18,2)")).cast("double") / F.count("value")
    return t.events.groupBy("user_id").agg(insufficient(mean, 25.0).alias("insufficient"))


@query(
    "f10_visible_parts",
    """SELECT len(regexp_extract_all(text, 'Licensed under [A-Z]+')) > 0 AS citations, lang = 'fr' AS translation,
       quality IS NOT NULL AS value, count(*) AS messages FROM documents LEFT JOIN labels USING (doc_id) GROUP BY ALL""",
)
def _(t):
    """The tables hold no Arabic; French stands in for the language that is translated."""
    marks = F.regexp_extract_all("text", F.lit("Licensed under [A-Z]+"), F.lit(0))
    shown = visible_parts(marks, F.col("lang"), F.col("quality"), translated="fr")
    rows = t.documents.join(t.labels, "doc_id", "left").select(shown.alias("shown")).select("shown.*")
    return rows.groupBy("citations", "translation", "value").agg(F.count(F.lit(1)).alias("messages"))


@query(
    "f10_visibility",
    """SELECT role, count(*) AS messages, sum(CASE WHEN contains(text, chr(10)) THEN 1 ELSE 0 END)::BIGINT AS with_lines
       FROM conversations WHERE role <> 'user' AND text IS NOT NULL GROUP BY role""",
)
def _(t):
    lines = F.split("text", "\n")
    shown = t.conversations.filter((F.col("role") != "user") & F.col("text").isNotNull())
    return shown.groupBy("role").agg(
        F.count(F.lit(1)).alias("messages"), F.count_if(F.size(lines) > 1).alias("with_lines")
    )


# ---- routing


@query("j1_keyword_router", f"SELECT doc_id, {sql_route('text')} AS route FROM documents")
def _(t):
    return with_route(t.documents, "text").select("doc_id", "route")


@query(
    "j1_router_from_table",
    """WITH rules AS (SELECT n_regionkey AS priority, concat('region_', n_regionkey) AS route,
         concat('e', substr('abcdefghijklmnopqrstuvwxyz', n_nationkey + 1, 1), 'o') AS keyword FROM nation)
       SELECT conv_id, turn, coalesce(arg_min(route, priority), 'default') AS route
       FROM conversations LEFT JOIN rules ON contains(lower(text), keyword) GROUP BY conv_id, turn""",
)
def _(t):
    alphabet = F.lit("abcdefghijklmnopqrstuvwxyz")
    rules = t.nation.select(
        F.col("n_regionkey").alias("priority"),
        F.concat(F.lit("region_"), F.col("n_regionkey").cast("string")).alias("route"),
        F.concat(F.lit("e"), F.substring(alphabet, F.col("n_nationkey") + 1, F.lit(1)), F.lit("o")).alias("keyword"),
    )
    return with_route_from_table(t.conversations, "text", rules).select("conv_id", "turn", "route")


@query(
    "j1_router_many_keywords",
    r"""WITH words AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(lower(text), '[a-z]{3,}')) AS word FROM benchmark),
         rules AS (SELECT item_id AS priority, concat('item_', item_id) AS route, word AS keyword FROM words UNION
           SELECT -1, 'short', substr(word, 1, 2) FROM words WHERE word LIKE 'q%')
       SELECT doc_id, coalesce(arg_min(route, priority), 'default') AS route
       FROM documents LEFT JOIN rules ON contains(lower(text), keyword) GROUP BY doc_id""",
)
def _(t):
    """Each word of the test items as a keyword: a table of rules that grows with its source."""
    words = t.benchmark.select("item_id", F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{3,}"), F.lit(0))).alias("word"))
    rules = words.select(
        F.col("item_id").alias("priority"), F.concat(F.lit("item_"), F.col("item_id").cast("string")).alias("route"),
        F.col("word").alias("keyword"),
    ).unionByName(
        words.filter(F.col("word").startswith("q")).select(
            F.lit(-1).cast("long").alias("priority"), F.lit("short").alias("route"), F.substring("word", 1, 2).alias("keyword")
        )
    )
    return with_route_from_table(t.documents, "text", rules).select("doc_id", "route")


_SCORED = "(SELECT *, n_chars / (n_chars + 1000.0::DOUBLE) AS score FROM documents)"


@query(
    "j2_route_to_chunks",
    f"""WITH chunks AS (SELECT doc_id AS chunk_id, route, rank FROM (SELECT doc_id, {sql_route('text')} AS route,
          row_number() OVER (PARTITION BY {sql_route('text')} ORDER BY n_chars DESC, doc_id) AS rank FROM documents)
          WHERE rank <= 4)
        SELECT q.conv_id, q.turn, q.route, c.chunk_id, c.rank
        FROM (SELECT conv_id, turn, {sql_route('text')} AS route FROM conversations) q JOIN chunks c ON q.route = c.route""",
)
def _(t):
    chunks = with_route(t.documents, "text").select(F.col("doc_id").alias("chunk_id"), "n_chars", "route")
    best = top_k_per_group(chunks, ["route"], [F.col("n_chars").desc(), F.col("chunk_id")], 4)
    asked = with_route(t.conversations, "text").select("conv_id", "turn", "route")
    # At most k chunks per route, and as many routes as rules: a bounded side.
    return asked.join(F.broadcast(best), "route").select("conv_id", "turn", "route", "chunk_id", "rank")


# ---- joins


@query(
    "j3_foreign_keys",
    """SELECT r_name, n_name, count(*) AS items, sum(CAST(l_extendedprice AS DECIMAL(18,2)))::DOUBLE AS revenue
       FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
       JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2""",
)
def _(t):
    # Sums go up the key chain before each join, so a hot order or customer is one row by then.
    price = F.col("l_extendedprice").cast("decimal(18,2)")
    per_order = t.lineitem.groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("items"), F.sum(price).alias("revenue"))
    per_customer = (
        per_order.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey")).groupBy("o_custkey")
        .agg(F.sum("items").alias("items"), F.sum("revenue").alias("revenue"))
    )
    per_nation = (
        per_customer.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).groupBy("c_nationkey")
        .agg(F.sum("items").alias("items"), F.sum("revenue").alias("revenue"))
    )
    return (
        per_nation.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"))
        .join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
        .groupBy("r_name", "n_name")
        .agg(F.sum("items").alias("items"), F.sum("revenue").cast("double").alias("revenue"))
    )


@query(
    "j4_cascade_delete",
    """WITH gone AS (SELECT o_orderkey FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_acctbal < 0)
       SELECT 'orders' AS table_name, count(*) AS kept FROM orders WHERE o_orderkey NOT IN (SELECT o_orderkey FROM gone)
       UNION ALL SELECT 'lineitem', count(*) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM gone)""",
)
def _(t):
    doomed = t.customer.filter("c_acctbal < 0")
    orders, gone = cascade(doomed, "c_custkey", t.orders, "o_custkey")
    items, _ = cascade(gone, "o_orderkey", t.lineitem, "l_orderkey")
    counted = [
        df.agg(F.count(F.lit(1)).alias("kept")).select(F.lit(name).alias("table_name"), "kept")
        for name, df in (("orders", orders), ("lineitem", items))
    ]
    return counted[0].unionByName(counted[1])


@query(
    "j5_orphans",
    """SELECT l_orderkey, count(*) AS items FROM lineitem WHERE l_orderkey NOT IN
       (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'P') GROUP BY l_orderkey""",
)
def _(t):
    lost = orphans(t.lineitem.select("l_orderkey"), "l_orderkey", t.orders.filter("o_orderstatus <> 'P'"), "o_orderkey")
    return lost.groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("items"))


@query(
    "j5_unlabelled_documents",
    "SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)",
)
def _(t):
    return orphans(t.documents, "doc_id", t.labels, "doc_id").select("doc_id", "lang")


@query(
    "j6_find_or_first",
    """SELECT o_orderkey, coalesce(c.c_name, (SELECT c_name FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 1)) AS c_name,
       c.c_custkey IS NOT NULL AS found FROM orders LEFT JOIN customer c ON o_custkey * 2 = c_custkey""",
)
def _(t):
    wanted = t.orders.select("o_orderkey", (F.col("o_custkey") * 2).alias("wanted"))
    return find_or_first(
        wanted, "wanted", t.customer, "c_custkey", ["c_name"], [F.col("c_acctbal").desc(), F.col("c_custkey")]
    ).select("o_orderkey", "c_name", "found")


@query(
    "j7_translation_lookup",
    r"""WITH memory AS (SELECT text AS original, min(concat('[en] ', d.doc_id)) AS translated FROM documents d
          JOIN labels l ON d.doc_id = l.doc_id WHERE l.quality = 1 GROUP BY text),
        asked AS (SELECT *, CASE WHEN regexp_matches(text, '[\x{00C0}-\x{00FF}]') THEN 'ar' ELSE 'en' END AS lang2 FROM documents)
        SELECT a.doc_id, md5(CASE WHEN lang2 = 'ar' AND m.original IS NOT NULL THEN m.translated ELSE a.text END) AS translated,
        CASE WHEN lang2 = 'en' THEN 'direct' WHEN m.original IS NOT NULL THEN 'memory' ELSE 'fallback' END AS model
        FROM asked a LEFT JOIN memory m ON a.text = m.original""",
)
def _(t):
    memory = t.documents.join(t.labels.filter("quality = 1"), "doc_id").select(
        F.col("text").alias("original"), F.concat(F.lit("[en] "), F.col("doc_id").cast("string")).alias("translated")
    )
    asked = t.documents.withColumn("detected_lang", detected_language(F.col("text"), ACCENTED))
    return translate(asked, "text", memory, model="memory").select(
        "doc_id", F.md5("translated_query").alias("translated"), F.col("translation_model").alias("model")
    )


# ---- vectors

SQL_SIM = "floor(list_cosine_similarity({a}::DOUBLE[], {b}::DOUBLE[]) * 1000000 + 0.5) / 1000000"
SQL_NEIGHBOURS = f"""SELECT query_id, chunk_id, score, rank FROM (SELECT query_id, chunk_id, score, row_number() OVER
    (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM (SELECT q.vec_id AS query_id, c.vec_id AS chunk_id,
    {SQL_SIM.format(a='q.embedding', b='c.embedding')} AS score FROM embeddings q, embeddings c WHERE q.vec_id <> c.vec_id))
    WHERE rank <= 4"""


def vector_sides(t):
    """Every stored vector as a question and as a chunk."""
    queries = t.embeddings.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vec"))
    chunks = t.embeddings.select(F.col("vec_id").alias("chunk_id"), F.col("embedding").alias("chunk_vec"))
    return queries, chunks


@query("j8_vector_search", SQL_NEIGHBOURS)
def _(t):
    return exact_top_k(*vector_sides(t), 4, exclude_self=True)


@query("j8_vector_search_grid", SQL_NEIGHBOURS)
def _(t):
    queries, chunks = vector_sides(t)
    return exact_top_k(queries, chunks, 4, exclude_self=True, broadcast_bytes=0).select(
        "query_id", "chunk_id", "score", "rank"
    )


@query(
    "j8_topic_vector_search",
    f"""WITH positions AS (SELECT label, generate_subscripts(embedding, 1) AS pos, unnest(embedding)::DOUBLE AS x FROM embeddings),
       means AS (SELECT label, pos, sum(CAST(x AS DECIMAL(28,12)))::DOUBLE / count(*) AS x FROM positions GROUP BY 1, 2),
       topics AS (SELECT label, list(x ORDER BY pos) AS vec FROM means GROUP BY label)
       SELECT query_id, chunk_id, score, rank FROM (SELECT label AS query_id, vec_id AS chunk_id, score, row_number() OVER
       (PARTITION BY label ORDER BY score DESC, vec_id) AS rank FROM (SELECT topics.label, vec_id,
       {SQL_SIM.format(a='vec', b='embedding')} AS score FROM topics, embeddings)) WHERE rank <= 8""",
)
def _(t):
    topics = mean_vectors(t.embeddings, "label", "embedding").select(
        F.col("label").alias("query_id"), F.col("mean_vec").alias("query_vec")
    )
    return exact_top_k(topics, vector_sides(t)[1], 8)


@query("f9_chunk_threshold", f"SELECT * FROM ({SQL_NEIGHBOURS}) WHERE score > 0.35")
def _(t):
    found = exact_top_k(*vector_sides(t), 4, exclude_self=True)
    return above_threshold(found, F.col("score"), 0.35)


# The given vectors point in all directions, so neighbours lie in many cells; queries visit this share of them.
APPROXIMATE = {"share": 0.8, "rounds": 2}


def sql_approximate() -> str:
    """The same cells by two rounds of k-means in SQL: neighbours among the vectors of the cells that a query visits."""
    dot = "list_dot_product({a}, {b})"

    def nearest(points: str) -> str:
        return f"""SELECT vec_id, cell, row_number() OVER (PARTITION BY vec_id ORDER BY {dot.format(a='u.e', b='p.e')} DESC, cell)
            AS place FROM unit u, {points} p"""

    def moved(points: str) -> str:
        return f"""SELECT p.cell, coalesce(m.e, p.e) AS e FROM {points} p LEFT JOIN (SELECT cell, list_transform(s,
            lambda x: x / sqrt(list_dot_product(s, s))) AS e FROM (SELECT cell, list(x ORDER BY pos) AS s FROM (SELECT cell, pos,
            sum(x) AS x FROM (SELECT cell, generate_subscripts(e, 1) AS pos, unnest(e) AS x FROM ({nearest(points)}) n JOIN unit
            USING (vec_id) WHERE place = 1) GROUP BY cell, pos) GROUP BY cell)) m ON m.cell = p.cell"""

    return f"""WITH raw AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings),
      unit AS (SELECT vec_id, v, list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) AS e FROM raw),
      size AS (SELECT greatest(1, CAST(floor(sqrt(count(*)) / 2) AS INTEGER)) AS cells FROM unit),
      start AS (SELECT cell, e FROM (SELECT row_number() OVER (ORDER BY md5(vec_id::VARCHAR), vec_id) - 1 AS cell, e FROM unit)
        JOIN size ON cell < cells),
      one AS MATERIALIZED ({moved('start')}),
      two AS MATERIALIZED ({moved('one')}),
      visits AS MATERIALIZED ({nearest('two')}),
      met AS (SELECT q.vec_id AS query_id, c.vec_id AS chunk_id FROM visits q JOIN visits c ON q.cell = c.cell AND c.place = 1
        AND q.vec_id <> c.vec_id JOIN size ON q.place <= ceil({APPROXIMATE['share']} * cells)),
      near AS (SELECT query_id, chunk_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id
        ORDER BY score DESC, chunk_id) AS rank FROM (SELECT query_id, chunk_id, {SQL_SIM.format(a='q.v', b='c.v')} AS score
        FROM met JOIN unit q ON q.vec_id = query_id JOIN unit c ON c.vec_id = chunk_id)) WHERE rank <= 4)"""


@query("j9_approximate_search", sql_approximate() + " SELECT * FROM near")
def _(t):
    return approx_top_k(*vector_sides(t), 4, exclude_self=True, **APPROXIMATE)


@query(
    "j9_recall_report",
    sql_approximate() + f""" SELECT count(*) AS wanted, count(near.chunk_id) AS found, count(near.chunk_id) / count(*)::DOUBLE AS
    recall FROM ({SQL_NEIGHBOURS}) truth LEFT JOIN near USING (query_id, chunk_id)""",
)
def _(t):
    sides = vector_sides(t)
    found = approx_top_k(*sides, 4, exclude_self=True, **APPROXIMATE)
    return recall_against(found, exact_top_k(*sides, 4, exclude_self=True))


# ---- comparison


@query(
    "j10_side_by_side",
    """SELECT source, arg_max(md5(text), n_chars * 1000000 + doc_id) FILTER (WHERE lang = 'en') AS en_text,
       arg_max(md5(text), n_chars * 1000000 + doc_id) FILTER (WHERE lang = 'fr') AS fr_text,
       count(*) FILTER (WHERE lang = 'en') > 0 AND count(*) FILTER (WHERE lang = 'fr') > 0 AS both_present
       FROM documents GROUP BY source""",
)
def _(t):
    return side_by_side(
        t.documents, "source", "lang", {"en": "en_text", "fr": "fr_text"}, F.md5("text"), "n_chars", "doc_id"
    )


@query(
    "j10_shared_values",
    """SELECT user_id, sum(l)::BIGINT AS left_values, sum(r)::BIGINT AS right_values, sum(l * r)::BIGINT AS shared_values
       FROM (SELECT user_id, json_extract_string(props, '$.k') AS k, max(CASE WHEN event_type = 'click' THEN 1 ELSE 0 END) AS l,
       max(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) AS r FROM events WHERE event_type IN ('click', 'purchase')
       GROUP BY 1, 2) GROUP BY user_id""",
)
def _(t):
    events = t.events.withColumn("k", F.get_json_object("props", "$.k"))
    return shared_values(events, "user_id", "event_type", ("click", "purchase"), "k")


@query(
    "j11_chunk_to_catalog",
    """SELECT s_suppkey, part AS source_part, n_regionkey::VARCHAR AS region FROM (SELECT s_suppkey,
       unnest(string_split(concat('nation ', s_nationkey, ' / Nation-', s_suppkey % 40), ' / ')) AS part FROM supplier)
       LEFT JOIN nation ON regexp_replace(upper(part), '[^A-Z0-9]', '', 'g') = regexp_replace(upper(n_name), '[^A-Z0-9]', '', 'g')""",
)
def _(t):
    source = F.concat(
        F.lit("nation "), F.col("s_nationkey").cast("string"), F.lit(" / Nation-"), (F.col("s_suppkey") % 40).cast("string")
    )
    chunks = t.supplier.select("s_suppkey", source.alias("source"))
    return to_catalog(chunks, "source", t.nation, "n_name", ["n_regionkey"]).select(
        "s_suppkey", "source_part", F.col("n_regionkey").cast("string").alias("region")
    )


@query(
    "j12_question_sources",
    """SELECT source, count(*) AS questions FROM (SELECT unnest(CASE WHEN o_orderstatus = 'P' THEN ['F', 'O']
       ELSE [o_orderstatus] END) AS source FROM orders) GROUP BY source""",
)
def _(t):
    expanded = t.orders.select(expand_sources(F.col("o_orderstatus"), "P", ["F", "O"]).alias("source"))
    return expanded.groupBy("source").agg(F.count(F.lit(1)).alias("questions"))


LANGUAGE_RULES = (
    Rule("de", (" der ", " und ", " nicht ")),
    Rule("fr", (" les ", " des ", " une ")),
    Rule("es", (" los ", " para ", " una ")),
    Rule("en", (" the ", " and ", " that ")),
)


@query(
    "a12_router_evaluation",
    "SELECT lang, count(*) AS questions, sum(CASE WHEN lang = routed THEN 1 ELSE 0 END)::BIGINT AS matched, "
    "sum(CASE WHEN lang = routed THEN 1 ELSE 0 END) / count(*)::DOUBLE AS accuracy FROM (SELECT lang, CASE"
    + "".join(
        " WHEN " + " OR ".join(f"contains(lower(text), '{w}')" for w in r.keywords) + f" THEN '{r.route}'"
        for r in LANGUAGE_RULES
    )
    + " ELSE 'default' END AS routed FROM documents) GROUP BY lang",
)
def _(t):
    routed = with_route(t.documents, "text", LANGUAGE_RULES, name="routed")
    return routing_accuracy(routed, "routed", "lang", ["lang"])

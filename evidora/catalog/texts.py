"""Text structure and grounding audit queries.

The given texts hold plain paragraphs only, so the markdown queries put markers around columns
of the part and document tables; their work still grows with those tables.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from evidora import constants as K
from evidora.catalog.aggregates import sentences, sql_sentences
from evidora.catalog.base import query
from evidora.catalog.projections import ACCENTED
from evidora.functions.language import detected_language
from evidora.functions.scores import insufficient
from evidora.operators.audit import (
    both_occur, cited, conflict_candidates, flag_agreement, invented, language_mismatch, missing_headings,
    normal_page, normal_strength, overcertain, phrase_hits, pregnancy_conflict, rank_tiers, refuses, source_tier, strength_shifts,
)
from evidora.operators.integrity import domain_violations
from evidora.operators.markdown import (
    chunk_by_section, headings_of, formatted_spans, inline_spans, lines_of, tables_of,
)


def part_pages(t, *, dealt: bool = False):
    """A markdown page per part; if dealt, by key, so that spans of a key meet without another exchange."""
    parts = t.part.repartition("p_partkey") if dealt else t.part
    size = F.col("p_size").cast("string")
    text = F.concat(
        F.lit("## "), "p_name", F.lit("\n**"), "p_brand", F.lit("**\n- type `"), "p_type", F.lit("` size **"), size,
        F.lit("**\n 12. ordered "), "p_name", F.lit("\n\n| name | size |\n|---|---|\n| "), "p_name", F.lit(" | "), size,
        F.lit(" |\n ## not a heading\n"), F.when(F.col("p_size") > 25, F.lit("---\n| tail |\n")).otherwise(F.lit("")),
        F.lit("• "), "p_brand", F.lit("\n### "), "p_type", F.lit("\nplain **"), "p_type", F.lit("** and `"), size, F.lit("`"),
    )
    return parts.select("p_partkey", text.alias("text"))


_PAGES = """(SELECT p_partkey, concat('## ', p_name, E'\\n**', p_brand, E'**\\n- type `', p_type, '` size **', p_size,
    E'**\\n 12. ordered ', p_name, E'\\n\\n| name | size |\\n|---|---|\\n| ', p_name, ' | ', p_size,
    E' |\\n ## not a heading\\n', CASE WHEN p_size > 25 THEN E'---\\n| tail |\\n' ELSE '' END, '• ', p_brand, E'\\n### ',
    p_type, E'\\nplain **', p_type, '** and `', p_size, '`') AS text FROM part)"""

_LINES = f"""(SELECT p_partkey, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1)
    AS line_no FROM {_PAGES})"""

_KIND = """CASE WHEN trim(line) IN ('---', '***', '___') THEN 'rule'
    WHEN starts_with(trim(line), '|') AND ends_with(trim(line), '|') THEN 'table'
    WHEN starts_with(line, '## ') OR starts_with(line, '### ') THEN 'heading'
    WHEN starts_with(trim(line), '**') AND ends_with(trim(line), '**') AND NOT contains(substr(trim(line), 3, greatest(length(trim(line)) - 4, 0)), '**')
      THEN 'bold_title'
    WHEN starts_with(trim(line), '- ') OR starts_with(trim(line), '• ') THEN 'bullet'
    WHEN regexp_matches(trim(line), '^[0-9]+[.][ ]') THEN 'ordered'
    WHEN trim(line) = '' THEN 'empty' ELSE 'paragraph' END"""


@query("m1_line_kinds", f"SELECT p_partkey, line_no, {_KIND} AS kind FROM {_LINES}")
def _(t):
    return lines_of(part_pages(t), "text", "p_partkey").select(
        "p_partkey", F.col("line_no").cast("bigint").alias("line_no"), "kind"
    )


@query(
    "m1_document_line_kinds",
    f"""SELECT lang, {_KIND} AS kind, count(*) AS lines FROM (SELECT lang, unnest(string_split(text, chr(10))) AS line FROM documents)
        GROUP BY 1, 2""",
)
def _(t):
    return lines_of(t.documents, "text", "lang").groupBy("lang", "kind").agg(F.count(F.lit(1)).alias("lines"))


@query(
    "m2_tables",
    f"""WITH l AS (SELECT *, {_KIND} = 'table' AS is_table FROM {_LINES}),
        g AS (SELECT *, line_no - row_number() OVER (PARTITION BY p_partkey ORDER BY line_no) AS island FROM l WHERE is_table),
        c AS (SELECT *, min(line_no) OVER (PARTITION BY p_partkey, island) AS first_line,
              list_transform(string_split(trim(line), '|')[2:-2], lambda c: trim(c)) AS cells FROM g)
        SELECT p_partkey, first_line, string_agg(array_to_string(cells, ','), ';' ORDER BY line_no)
          FILTER (WHERE line_no = first_line) AS header, coalesce(string_agg(array_to_string(cells, ','), ';' ORDER BY line_no)
          FILTER (WHERE line_no > first_line AND len(list_filter(cells, lambda c: NOT (contains(c, '---') OR c = ''))) > 0), '') AS body
        FROM c GROUP BY p_partkey, first_line""",
)
def _(t):
    found = part_pages(t).select("p_partkey", F.inline(tables_of(F.col("text"))))
    return found.select(
        "p_partkey", F.col("first_line").cast("bigint").alias("first_line"),
        F.array_join("header", ",").alias("header"),
        F.array_join(F.transform("body", lambda r: F.array_join(r, ",")), ";").alias("body"),
    )


@query(
    "m3_marker_free_text",
    f"""SELECT p_partkey, line_no, CASE {_KIND} WHEN 'heading' THEN regexp_replace(line, '^#+\\s*', '')
        WHEN 'bold_title' THEN replace(trim(line), '**', '') WHEN 'bullet' THEN regexp_replace(trim(line), '^[-•]\\s*', '')
        WHEN 'ordered' THEN regexp_replace(trim(line), '^[0-9]+[.]\\s*', '') ELSE line END AS content FROM {_LINES}""",
)
def _(t):
    lines = lines_of(part_pages(t), "text", "p_partkey")
    return lines.select("p_partkey", F.col("line_no").cast("bigint").alias("line_no"), "content")


@query(
    "m4_inline_spans",
    rf"""SELECT p_partkey, style, content, count(*) AS spans FROM (SELECT p_partkey, CASE WHEN starts_with(s, '**') THEN 'bold'
        ELSE 'code' END AS style, CASE WHEN starts_with(s, '**') THEN substr(s, 3, length(s) - 4) ELSE substr(s, 2, length(s) - 2)
        END AS content FROM (SELECT p_partkey, unnest(regexp_extract_all(text, '(\*\*.*?\*\*|`.*?`)', 1)) AS s FROM {_PAGES}))
        GROUP BY 1, 2, 3""",
)
def _(t):
    # Hardly a span repeats in a page: parts are dealt out before their spans, so that no scan task holds those of a whole file.
    spans = part_pages(t, dealt=True).select("p_partkey", F.inline(inline_spans(F.col("text"))))
    return spans.groupBy("p_partkey", "style", F.col("text").alias("content")).agg(F.count(F.lit(1)).alias("spans"))


@query(
    "m4_formatted_spans",
    rf"""SELECT p_partkey, line_no, style, content, count(*) AS spans FROM (SELECT p_partkey, line_no, CASE WHEN
        starts_with(s, '**') THEN 'bold' ELSE 'code' END AS style, CASE WHEN starts_with(s, '**') THEN substr(s, 3, length(s) - 4)
        ELSE substr(s, 2, length(s) - 2) END AS content FROM (SELECT p_partkey, line_no, unnest(regexp_extract_all(line,
        '(\*\*.*?\*\*|`.*?`)', 1)) AS s FROM (SELECT *, {_KIND} AS kind FROM {_LINES}) WHERE kind NOT IN ('heading', 'bold_title', 'rule'))) GROUP BY 1, 2, 3, 4""",
)
def _(t):
    spans = formatted_spans(part_pages(t), "text", "p_partkey")
    return spans.groupBy("p_partkey", F.col("line_no").cast("bigint").alias("line_no"), "style", F.col("text").alias("content")).agg(
        F.count(F.lit(1)).alias("spans")
    )


@query(
    "m5_section_chunks",
    r"""WITH lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line,
          generate_subscripts(string_split(text, chr(10)), 1) AS no FROM documents),
        placed AS (SELECT *, 1 + sum(CASE WHEN no > 1 AND length(line) BETWEEN 1 AND 39 THEN 1 ELSE 0 END) OVER
          (PARTITION BY doc_id ORDER BY no)::BIGINT AS section_no FROM lines),
        sections AS (SELECT doc_id, section_no, string_agg(line, chr(10) ORDER BY no) AS body FROM placed GROUP BY 1, 2),
        chunks AS (SELECT doc_id, section_no, string_split(body, chr(10))[1] AS section,
          regexp_extract_all(body, '(?s).{1,1000}(?:\n|\z)|[^\n]+(?:\n|\z)') AS parts FROM sections)
        SELECT doc_id, section_no, md5(section) AS section, unnest(generate_series(1, len(parts))) AS ordinal,
          md5(regexp_replace(unnest(parts), '\n\z', '')) AS content FROM chunks""",
)
def _(t):
    chunks = chunk_by_section(t.documents, "text", "doc_id", section_break=r"[^\n]{1,39}(?:\n|\z)", chunk_chars=1000)
    return chunks.select(
        "doc_id", F.col("section_no").cast("bigint").alias("section_no"), F.md5("section").alias("section"),
        F.col("ordinal").cast("bigint").alias("ordinal"), F.md5("content").alias("content"),
    )


@query(
    "m5_chunk_ids",
    r"""SELECT p_partkey, concat(p_partkey, ':', section_no, ':1') AS chunk_id, title FROM (SELECT p_partkey, 1 AS section_no,
          p_name AS title FROM part UNION ALL SELECT p_partkey, 2, p_brand FROM part UNION ALL
        SELECT p_partkey, 3, p_type FROM part)""",
)
def _(t):
    """A section before the first heading and two with one."""
    text = F.concat_ws("\n", "p_name", F.concat(F.lit("## "), "p_brand"), F.lit("a line"), F.concat(F.lit("###  "), "p_type"))
    pages = t.part.select("p_partkey", text.alias("text"))
    return chunk_by_section(pages, "text", "p_partkey").select("p_partkey", "chunk_id", "title")


# ---- audits


def _marked_answers(t):
    supplier = F.concat(F.lit("Supplier#"), F.col("l_suppkey").cast("string"))
    text = F.concat(
        F.lit("Offer it **["), supplier, F.lit(" — Line "), F.col("l_linenumber").cast("string"), F.lit(", p. "),
        F.col("l_partkey").cast("string"), F.lit("]** or [note] and ["), supplier, F.lit(", p. "),
        F.col("l_returnflag"), F.lit("]."),
    )
    return t.lineitem.select("l_orderkey", text.alias("text"))


@query(
    "g1_citation_marks",
    """SELECT l_orderkey, 1 AS mark_no, concat('Supplier#', l_suppkey) AS source, concat('Line ', l_linenumber) AS section,
       l_partkey::VARCHAR AS page FROM lineitem UNION ALL
       SELECT l_orderkey, 2, concat('Supplier#', l_suppkey), '', l_returnflag FROM lineitem""",
)
def _(t):
    return cited(_marked_answers(t), "text", "l_orderkey")


@query(
    "g1_marks_of_many_forms",
    """SELECT l_orderkey, l_linenumber, 1 AS mark_no, concat('Source ', l_suppkey) AS source,
         CASE WHEN l_linenumber % 4 < 2 THEN concat('Lipids, statins and risk ', l_linenumber) ELSE '' END AS section,
         CASE l_linenumber % 4 WHEN 0 THEN concat(l_partkey, ', Table ', l_linenumber) WHEN 2 THEN l_partkey::VARCHAR END AS page
       FROM lineitem WHERE l_linenumber % 4 < 3""",
)
def _(t):
    """Sections and pages with commas, marks without a page or section, and brackets that cite nothing."""
    number, source = F.col("l_linenumber").cast("string"), F.concat(F.lit("Source "), F.col("l_suppkey").cast("string"))
    section, page = F.concat(F.lit(" — Lipids, statins and risk "), number), F.col("l_partkey").cast("string")
    form = F.col("l_linenumber") % 4
    mark = (
        F.when(form == 0, F.concat(source, section, F.lit(", p. "), page, F.lit(", Table "), number))
        .when(form == 1, F.concat(source, section))
        .when(form == 2, F.concat(source, F.lit(", p."), page))
        .otherwise(source)
    )
    answers = t.lineitem.select("l_orderkey", "l_linenumber", F.concat(F.lit("See ["), mark, F.lit("] [note].")).alias("text"))
    return cited(answers, "text", "l_orderkey", "l_linenumber")


@query(
    "g2_invented_per_answer",
    """SELECT l_orderkey, concat('Source ', l_suppkey) AS source, l_partkey::VARCHAR AS page, count(*) AS citations FROM lineitem c
       WHERE NOT EXISTS (SELECT 1 FROM lineitem r WHERE r.l_returnflag <> 'N' AND r.l_orderkey = c.l_orderkey
       AND r.l_suppkey = c.l_suppkey AND r.l_partkey = c.l_partkey) GROUP BY ALL""",
)
def _(t):
    """Marks read from each answer against the chunks retrieved for that answer, pages in one form."""
    source, page = F.concat(F.lit("Source "), F.col("l_suppkey").cast("string")), F.col("l_partkey").cast("string")
    text = F.concat(F.lit("Given ["), source, F.lit(" — Part, p. "), page, F.lit("]."))
    marks = cited(t.lineitem.select("l_orderkey", text.alias("text")), "text", "l_orderkey")
    retrieved = t.lineitem.filter("l_returnflag <> 'N'").select(
        "l_orderkey", source.alias("source"), normal_page(F.concat(F.lit("p. "), page)).alias("page")
    )
    lost = invented(marks, retrieved, ["l_orderkey", "source", "page"])
    return lost.groupBy("l_orderkey", "source", "page").agg(F.count(F.lit(1)).alias("citations"))


@query(
    "g2_invented_citations",
    f"""SELECT item_id, sentence FROM {sql_sentences('benchmark', 'item_id')} WHERE sentence NOT IN
        (SELECT sentence FROM {sql_sentences('documents', 'doc_id')})""",
)
def _(t):
    claims = sentences(t.benchmark, "text", "item_id")
    return invented(claims, sentences(t.documents, "text", "doc_id"), ["sentence"])


@query(
    "g2_invented_sources",
    """SELECT l_suppkey, l_partkey, count(*) AS citations FROM lineitem c WHERE NOT EXISTS (SELECT 1 FROM lineitem r
       WHERE r.l_returnflag = 'R' AND r.l_suppkey = c.l_suppkey AND r.l_partkey = c.l_partkey) GROUP BY 1, 2""",
)
def _(t):
    retrieved = t.lineitem.filter("l_returnflag = 'R'").select("l_suppkey", "l_partkey")
    lost = invented(t.lineitem.select("l_suppkey", "l_partkey"), retrieved, ["l_suppkey", "l_partkey"])
    return lost.groupBy("l_suppkey", "l_partkey").agg(F.count(F.lit(1)).alias("citations"))


# Phrases that do occur in the given texts stand in for the fixed lists in one query each.
_CERTAIN = ["all rights reserved", "licensed under", "the that"]


@query(
    "g3_overcertain_phrases",
    "SELECT doc_id, " + " + ".join(f"CASE WHEN contains(lower(text), '{p}') THEN 1 ELSE 0 END" for p in _CERTAIN)
    + " AS listed, " + " + ".join(rf"CASE WHEN regexp_matches(lower(text), '\b{p}\b') THEN 1 ELSE 0 END" for p in K.OVERCERTAIN_PHRASES)
    + " AS fixed_list FROM documents",
)
def _(t):
    return t.documents.select(
        "doc_id", phrase_hits(F.col("text"), _CERTAIN).alias("listed"), overcertain(F.col("text")).alias("fixed_list")
    )


@query(
    "g4_refusals",
    """SELECT role, count(*) AS messages, sum(CASE WHEN contains(lower(text), ' ion') OR contains(lower(text), 'the and')
       THEN 1 ELSE 0 END)::BIGINT AS refusals FROM conversations GROUP BY role""",
)
def _(t):
    return t.conversations.groupBy("role").agg(
        F.count(F.lit(1)).alias("messages"), F.count_if(refuses(F.col("text"), [" ion", "the and"])).alias("refusals")
    )


@query(
    "g5_refusal_agreement",
    "SELECT quality = 0 AS refused, toxic = 1 AS flagged, count(*) AS answers FROM labels GROUP BY 1, 2",
)
def _(t):
    refusal = F.lit(K.REFUSAL_PHRASES[0].capitalize() + ".")
    answers = t.documents.join(t.labels, "doc_id").select(
        F.when(F.col("quality") == 0, refusal).otherwise(F.col("text")).alias("answer"), "toxic"
    )
    return flag_agreement(answers, refuses(F.col("answer")), F.col("toxic") == 1)


# Answers of each kind are planted by id inside the given texts: a fixed sentence in three spellings, a near miss (a word is
# left out), and over-certain wording. The flag they are compared with follows from the evidence score alone.
_PLANTED = [
    K.REFUSAL_PHRASES[0].capitalize(), K.REFUSAL_PHRASES[1].upper(), K.REFUSAL_PHRASES[2].title(),
    K.REFUSAL_PHRASES[0].replace(" enough", ""), K.REFUSAL_PHRASES[1].replace(" current", ""), f"This is {K.OVERCERTAIN_PHRASES[0]} so",
]
_SQL_PLANTED = (
    "(SELECT doc_id, lang, n_chars / (n_chars + 1000.0::DOUBLE) < 0.65 AS flagged, CASE doc_id % 9 "
    + " ".join(f"""WHEN {i} THEN concat(substr(text, 1, 40), ' {p.replace("'", "''")}. ', substr(text, 41))""" for i, p in enumerate(_PLANTED))
    + " ELSE text END AS answer FROM documents)"
)
_SQL_REFUSED = "(" + " OR ".join(
    f"""contains(lower(answer), '{p.replace("'", "''")}')""" for p in K.REFUSAL_PHRASES
) + ")"


def planted_answers(t):
    def planted(phrase):
        return F.concat(F.substring("text", 1, 40), F.lit(f" {phrase}. "), F.substring("text", F.lit(41), F.length("text")))

    answer = F.col("text")
    for i, phrase in enumerate(_PLANTED):
        answer = F.when(F.col("doc_id") % 9 == i, planted(phrase)).otherwise(answer)
    score = F.col("n_chars") / (F.col("n_chars") + F.lit(1000.0))
    return t.documents.select("doc_id", "lang", insufficient(score).alias("flagged"), answer.alias("answer"))


@query(
    "g4_fixed_refusals",
    f"""SELECT lang, count(*) AS answers, count(*) FILTER (WHERE {_SQL_REFUSED}) AS refusals,
        count(*) FILTER (WHERE doc_id % 9 IN (0, 1, 2)) AS planted FROM {_SQL_PLANTED} GROUP BY lang""",
)
def _(t):
    return planted_answers(t).groupBy("lang").agg(
        F.count(F.lit(1)).alias("answers"), F.count_if(refuses(F.col("answer"))).alias("refusals"),
        F.count_if((F.col("doc_id") % 9).isin(0, 1, 2)).alias("planted"),
    )


@query(
    "g5_agreement_with_evidence",
    f"SELECT {_SQL_REFUSED} AS refused, flagged, count(*) AS answers FROM {_SQL_PLANTED} GROUP BY 1, 2",
)
def _(t):
    return flag_agreement(planted_answers(t), refuses(F.col("answer")), F.col("flagged"))


_TIERS = [("src1", 1), ("src2", 2)]


@query(
    "g6_source_tiers",
    """SELECT lang, tier, count(*) AS chunks, dense_rank() OVER (PARTITION BY lang ORDER BY tier) AS tier_rank FROM (SELECT lang,
       CASE WHEN starts_with(source, 'src1') THEN 1 WHEN starts_with(source, 'src2') THEN 2 ELSE 3 END AS tier FROM documents)
       GROUP BY lang, tier""",
)
def _(t):
    return rank_tiers(t.documents, ["lang"], source_tier(F.col("source"), _TIERS))


@query(
    "g7_strength_domain",
    """SELECT value, violations, CASE WHEN starts_with(value, 'Strong') THEN 'Strong' END AS nearest FROM (SELECT
       concat('Strong ', p_type) AS value, count(*) AS violations FROM part WHERE p_size > 40 GROUP BY 1
       UNION ALL SELECT concat('Weak ', p_type), count(*) FROM part WHERE p_size <= 10 GROUP BY 1)""",
)
def _(t):
    strength = (
        F.when(F.col("p_size") > 40, F.concat(F.lit("Strong "), "p_type"))
        .when(F.col("p_size") <= 10, F.concat(F.lit("Weak "), "p_type"))
        .otherwise("Conditional")
    )
    found = domain_violations(t.part.select(strength.alias("strength")), "strength", K.STRENGTHS)
    return found.withColumn("nearest", normal_strength(F.col("value")))


@query(
    "g8_strength_shifts",
    """SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' AND o_orderpriority = '1-URGENT' THEN 'offer>must'
       WHEN o_orderstatus = 'P' AND o_orderpriority = '2-HIGH' THEN 'may>should' ELSE '' END AS shifts FROM orders""",
)
def _(t):
    evidence = F.when(F.col("o_orderstatus") == "F", "Offer the drug.").when(
        F.col("o_orderstatus") == "P", "It may help."
    ).otherwise("No wording.")
    answer = F.when(F.col("o_orderpriority") == "1-URGENT", "You must take it.").when(
        F.col("o_orderpriority") == "2-HIGH", "You should take it."
    ).otherwise("They offered it; it may help.")
    return t.orders.select("o_orderkey", F.array_join(strength_shifts(evidence, answer), ",").alias("shifts"))


@query(
    "g9_conflict_candidates",
    """SELECT l_orderkey, count(DISTINCT l_suppkey) AS organizations, count(*) AS chunks FROM lineitem GROUP BY l_orderkey
       HAVING count(DISTINCT l_suppkey) >= 2""",
)
def _(t):
    return conflict_candidates(t.lineitem, "l_orderkey", "l_suppkey")


@query(
    "g10_contraindication",
    """SELECT doc_id, contains(lower(text), 'who') AND (contains(lower(text), 'arb') OR contains(lower(text), 'statin')) AS both_terms,
       (contains(lower(text), 'pregnan') OR contains(lower(text), 'breastfeeding') OR contains(lower(text), 'conception') OR
        contains(lower(text), 'حمل')) AND (contains(lower(text), 'ace inhibitor') OR contains(lower(text), 'acei') OR
        contains(lower(text), 'angiotensin receptor blocker') OR contains(lower(text), 'arb') OR contains(lower(text), 'statin'))
       AS pregnancy FROM documents""",
)
def _(t):
    return t.documents.select(
        "doc_id", both_occur(F.col("text"), ["who"], ["arb", "statin"]).alias("both_terms"),
        pregnancy_conflict(F.col("text")).alias("pregnancy"),
    )


@query(
    "g11_section_check",
    """SELECT p_partkey, concat(p_name, '|', p_type) AS headings, array_to_string(list_filter(['red widget', 'PROMO', 'Sources'],
       lambda h: h <> p_name AND h <> p_type), '|') AS missing FROM part""",
)
def _(t):
    text = F.col("text")
    return part_pages(t).select(
        "p_partkey", F.array_join(headings_of(text), "|").alias("headings"),
        F.array_join(missing_headings(text, ["red widget", "PROMO", "Sources"]), "|").alias("missing"),
    )


@query(
    "g12_answer_language",
    r"""SELECT lang, count(*) AS answers, sum(wrong)::BIGINT AS mismatched, sum(wrong) / count(*)::DOUBLE AS mismatch_rate FROM
        (SELECT lang, CASE WHEN (CASE WHEN regexp_matches(text, '[\x{00C0}-\x{00FF}]') THEN 'ar' ELSE 'en' END) <>
        (CASE WHEN lang = 'en' THEN 'en' ELSE 'ar' END) THEN 1 ELSE 0 END AS wrong FROM documents) GROUP BY lang""",
)
def _(t):
    answers = t.documents.withColumn("wanted", F.when(F.col("lang") == "en", "en").otherwise("ar"))
    return language_mismatch(answers, "text", "wanted", ["lang"], detected_language(F.col("text"), ACCENTED))

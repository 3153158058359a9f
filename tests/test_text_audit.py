import pytest
from pyspark.sql import functions as F

from evidora import constants as K
from evidora.operators import audit, markdown
from evidora.operators.comparison import normal_code, shared_values, side_by_side, to_catalog

PAGE = "\n".join(
    [
        "## Title", "  ---  ", "***", "| a | b |", "|---|---|", "| 1 | x|y |", "|  |  |", "plain **bold** and `code`", "",
        "### Sub", " ## indented", "**Only bold**", "**two** and **three**", "- one", "• two", "-three", "12. step", "1.step",
        "|", "# top", "||", "| last |",
    ]
)
KINDS = (
    "heading rule rule table table table table paragraph empty heading paragraph bold_title paragraph bullet bullet paragraph "
    "ordered paragraph table paragraph table table"
).split()


def test_line_kinds(spark):
    rows = markdown.lines_of(spark.createDataFrame([(1, PAGE)], "id int, text string"), "text", "id").orderBy("line_no").collect()
    assert [r.kind for r in rows] == KINDS
    assert [r.content for r in rows if r.kind in ("heading", "bold_title", "bullet", "ordered")] == [
        "Title", "Sub", "Only bold", "one", "two", "step",
    ]


def test_tables(spark):
    found = spark.createDataFrame([(PAGE,)], "text string").select(markdown.tables_of(F.col("text")).alias("t")).first().t
    assert [t.first_line for t in found] == [4, 19, 21]
    assert found[0].header == ["a", "b"] and found[0].body == [["1", "x", "y"]]
    assert found[1].header == [] and found[1].body == []
    assert found[2].header == [""] and found[2].body == [["last"]]


@pytest.mark.parametrize("text", ["", "no table", "a\nb"])
def test_no_tables(spark, text):
    assert spark.createDataFrame([(text,)], "t string").select(markdown.tables_of(F.col("t")).alias("x")).first().x == []


def test_long_table_stays_linear(spark):
    text = "\n".join(f"| {i} |" for i in range(20000))
    found = spark.createDataFrame([(text,)], "t string").select(F.size(markdown.tables_of(F.col("t"))[0]["body"]).alias("n"))
    assert found.first().n == 19999


def test_inline_spans(spark):
    text = "a **b `c`** `d **e**` **** x"
    spans = spark.createDataFrame([(text,)], "t string").select(markdown.inline_spans(F.col("t")).alias("s")).first().s
    assert [(s.style, s.text) for s in spans] == [("bold", "b `c`"), ("code", "d **e**"), ("bold", "")]


def test_chunks_keep_sections_and_lose_nothing(spark):
    text = "intro\n## A\n" + "\n".join("w" * 30 for _ in range(5)) + "\n" + "v" * 120 + "\n## B\nend\n"
    rows = markdown.chunk_by_section(spark.createDataFrame([(1, text)], "id int, text string"), "text", "id", chunk_chars=70)
    rows = rows.orderBy("section_no", "ordinal").collect()
    assert "\n".join(r.content for r in rows) == text.rstrip("\n")
    assert [r.section for r in rows][0] == "intro" and {r.section for r in rows} == {"intro", "## A", "## B"}
    assert all(len(r.content) <= 70 or "\n" not in r.content for r in rows)


def test_citation_marks(spark):
    text = "x **[NICE NG238 — Risk Assessment, p. 25]** y [WHO Guideline, p. 18] [no page] [a — b, p.3]"
    rows = audit.cited(spark.createDataFrame([(1, text)], "id int, t string"), "t", "id").collect()
    assert [(r.source, r.section, r.page) for r in rows] == [
        ("NICE NG238", "Risk Assessment", "25"), ("WHO Guideline", "", "18"), ("a", "b", "3"),
    ]


def test_marks_without_page_and_with_commas(spark):
    text = "[NICE NG238 — Lipids, statins and risk, p. 9] [S — Only a section] [S, p. p. 14, Table 1] [note] [a, b]"
    rows = audit.cited(spark.createDataFrame([(1, text)], "id int, t string"), "t", "id").collect()
    assert [(r.source, r.section, r.page) for r in rows] == [
        ("NICE NG238", "Lipids, statins and risk", "9"), ("S", "Only a section", None), ("S", "", "14, Table 1"),
    ]
    pages = spark.createDataFrame([("p. 14, Table 1",), ("pp. 3-4",), (" 7 ",), ("p. ",), (None,)], "p string")
    assert [r.p for r in pages.select(audit.normal_page(F.col("p")).alias("p")).collect()] == ["14, Table 1", "3-4", "7", None, None]


def test_whole_words_only(spark):
    df = spark.createDataFrame([("indefinitely, uncertainly",), ("You definitely have it, certainly; definitely.",)], "t string")
    assert [r.o for r in df.select(audit.overcertain(F.col("t")).alias("o")).collect()] == [0, 3]


def test_invented_citations(spark):
    cited = spark.createDataFrame([(1, "S", "3"), (1, "S", "4"), (2, "S", "3")], "a int, source string, page string")
    retrieved = spark.createDataFrame([(1, "S", "3"), (1, "S", "3"), (2, "T", "3")], "a int, source string, page string")
    got = audit.invented(cited, retrieved, ["a", "source", "page"])
    assert sorted(map(tuple, got.select("a", "source", "page").collect())) == [(1, "S", "4"), (2, "S", "3")]


def test_phrases(spark):
    rows = [(K.REFUSAL_PHRASES[0].capitalize() + ".",), ("This proves it, definitely.",), ("You definitely have it",), ("fine",)]
    df = spark.createDataFrame(rows, "t string")
    got = df.select(audit.refuses(F.col("t")).alias("r"), audit.overcertain(F.col("t")).alias("o")).collect()
    assert [tuple(r) for r in got] == [(True, 0), (False, 2), (False, 1), (False, 0)]


@pytest.mark.parametrize(
    "evidence, answer, shifts",
    [
        ("We recommend it", "Consider it", ["recommend>consider"]),
        ("It may help", "It should help", ["may>should"]),
        ("Offer it", "It must be given", ["offer>must"]),
        ("Offer it", "They offered it, it must", []),
        ("You should", "You must", ["should>must"]),
        ("mayor", "shoulder", []),
        ("Consider", "Considered and recommended", []),
    ],
)
def test_strength_shifts(spark, evidence, answer, shifts):
    df = spark.createDataFrame([(evidence, answer)], "e string, a string")
    assert df.select(audit.strength_shifts(F.col("e"), F.col("a")).alias("s")).first().s == shifts


def test_strength_domain(spark):
    df = spark.createDataFrame([("Strong",), ("Strong (Do Not Offer)",), ("Strong Contraindication",), ("Odd",), (None,)], "s string")
    outside = {r.s for r in df.filter(~F.col("s").isin(K.STRENGTHS)).collect()}
    assert outside == {"Strong (Do Not Offer)", "Strong Contraindication", "Odd"}
    assert [r.n for r in df.select(audit.normal_strength(F.col("s")).alias("n")).collect()] == ["Strong"] * 3 + [None, None]


def test_pregnancy_and_headings_and_tiers(spark):
    df = spark.createDataFrame([("ACEi in pregnancy",), ("ACEi alone",), ("pregnant",)], "t string")
    assert [r.x for r in df.select(audit.pregnancy_conflict(F.col("t")).alias("x")).collect()] == [True, False, False]
    page = spark.createDataFrame([("### Direct Answer\nx\n### Sources\n",)], "t string")
    assert page.select(audit.missing_headings(F.col("t"), K.DIRECT_HEADINGS).alias("m")).first().m == ["Explanation", "Evidence"]
    tiers = spark.createDataFrame([("NICE NG1",), ("WHO 2021",), ("Evidence review A",), ("Blog",)], "s string")
    assert [r.t for r in tiers.select(audit.source_tier(F.col("s")).alias("t")).collect()] == [1, 1, 2, 3]
    ranked = audit.rank_tiers(spark.createDataFrame([("q", 1), ("q", 3), ("r", 2)], "k string, t int"), ["k"], F.col("t"))
    assert {(r.k, r.tier, r.tier_rank) for r in ranked.collect()} == {("q", 1, 1), ("q", 3, 2), ("r", 2, 1)}


def test_conflicts_language_and_flags(spark):
    df = spark.createDataFrame([("t", "WHO"), ("t", "NICE"), ("u", "WHO"), ("u", "WHO")], "topic string, org string")
    assert [r.topic for r in audit.conflict_candidates(df, "topic", "org").collect()] == ["t"]
    answers = spark.createDataFrame([("كلمة", "ar"), ("word", "ar"), ("word", "en")], "t string, want string")
    got = {r.want: r.mismatch_rate for r in audit.language_mismatch(answers, "t", "want", ["want"]).collect()}
    assert got == {"ar": 0.5, "en": 0.0}
    flags = spark.createDataFrame([(True, True), (True, False)], "r boolean, f boolean")
    assert audit.flag_agreement(flags, F.col("r"), F.col("f")).count() == 2


def test_comparison(spark):
    rows = [(1, "t", "WHO", "w1", 0.5), (2, "t", "WHO", "w2", 0.9), (3, "t", "NICE", "n1", 0.1), (4, "u", "ESC", "e", 0.4)]
    df = spark.createDataFrame(rows, "id int, topic string, org string, content string, score double")
    got = {r.topic: r for r in side_by_side(df, "topic", "org", {"WHO": "who", "NICE": "nice"}, F.col("content"), "score", "id").collect()}
    assert (got["t"].who, got["t"].nice, got["t"].both_present) == ("w2", "n1", True)
    assert (got["u"].who, got["u"].nice, got["u"].both_present) == (None, None, False)
    shared = shared_values(spark.createDataFrame([("t", "a", 1), ("t", "b", 1), ("t", "b", 2)], "t string, o string, v int"), "t", "o", ("a", "b"), "v")
    assert shared.first()[1:] == (1, 2, 1)


def test_catalog_lookup(spark):
    chunks = spark.createDataFrame([(1, "NICE NG136 / NG238"), (2, "Other")], "id int, source string")
    catalog = spark.createDataFrame([("nice-ng136", 2022), ("NG238", 2023)], "code string, year int")
    got = {(r.id, r.source_part, r.year) for r in to_catalog(chunks, "source", catalog, "code", ["year"]).collect()}
    assert got == {(1, "NICE NG136", 2022), (1, "NG238", 2023), (2, "Other", None)}
    assert catalog.select(normal_code(F.col("code")).alias("c")).first().c == "NICENG136"

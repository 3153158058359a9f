import hashlib
import random

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from evidora import constants as K
from evidora import schemas
from evidora.functions.text import fold, trim_all
from evidora.operators.evidence import context_of, evidence_per_route, within_budget
from evidora.operators.routing import DEFAULT_RULES, Rule, expand_sources, route, routing_accuracy, rules_from_table, with_route_from_table
from evidora.operators.translation import translate
from evidora.plans.answer_batch import answer_batch, answer_messages
from evidora.plans.keyword_evidence import keyword_evidence
from evidora.plans.vector_evidence import vector_evidence

# Scores per route, in list order.
SCORES = {
    "hypertension_first_line": [0.94, 0.92],
    "statins_intensity": [0.96],
    "pregnancy_contraindications": [0.95, 0.91],
    "task_shifting_who": [0.93],
}
GROUNDED = {
    "hypertension_first_line": 0.93, "statins_intensity": 0.96, "pregnancy_contraindications": 0.93,
    "task_shifting_who": 0.93, "default": 0.94,
}


@pytest.fixture(scope="module")
def chunks(spark):
    rows = []
    for name, listed in SCORES.items():
        for i, score in enumerate(listed):
            strength = {0: None, 1: "Strong Contraindication"}[i]
            rows.append((f"{name}-{i}", name, i, "t", f"text {name} {i} " + "x" * 150, f"src{i}", "sec", f"p. {i}", score, strength))
    return spark.createDataFrame(
        rows,
        "id string, route string, ord int, title string, content string, source string, section string, page string, "
        "similarity_score double, recommendation_strength string",
    )


@pytest.mark.parametrize(
    "question, expected",
    [
        ("Which three drug groups?", "hypertension_first_line"),
        ("FIRST-LINE and statin", "hypertension_first_line"),
        ("statin for pregnant women", "statins_intensity"),
        ("pregnant women", "pregnancy_contraindications"),
        ("the right place", "pregnancy_contraindications"),
        ("a whole meal", "task_shifting_who"),
        ("non-physician staff", "task_shifting_who"),
        ("علاج ضغط الدم", "hypertension_first_line"),
        ("شدة الدواء", "statins_intensity"),
        ("حمل", "pregnancy_contraindications"),
        ("صيادلة", "task_shifting_who"),
        ("nothing to see", "default"),
        ("", "default"),
    ],
)
def test_route_rules(spark, question, expected):
    df = spark.createDataFrame([(question,)], "q string")
    assert df.select(route(F.col("q")).alias("r")).first().r == expected


def test_word_boundary_is_optional(spark):
    df = spark.createDataFrame([("the right place",), ("ask who knows",), ("whoever",)], "q string")
    got = [r.r for r in df.select(route(F.col("q"), word_boundary=True).alias("r")).collect()]
    assert got == ["default", "task_shifting_who", "default"]


@pytest.mark.parametrize("word_boundary", [False, True])
def test_long_rule_lists_give_the_same_routes(spark, word_boundary):
    filler = Rule("never", tuple(f"zz{i}zz" for i in range(300)))
    df = spark.createDataFrame([("statin place",), ("place",), ("who",), ("none",), ("ZZ7ZZ",)], "q string")
    short = df.select(route(F.col("q"), DEFAULT_RULES, word_boundary=word_boundary)).collect()
    long = df.select(route(F.col("q"), (*DEFAULT_RULES, filler), word_boundary=word_boundary)).collect()
    assert [r[0] for r in long[:4]] == [r[0] for r in short[:4]]
    assert long[4][0] == "never"


def test_rules_from_table_keep_priority(spark):
    table = spark.createDataFrame([(2, "b", "x"), (1, "a", "y"), (1, "a", "z")], "priority int, route string, keyword string")
    assert rules_from_table(table) == (Rule("a", ("y", "z")), Rule("b", ("x",)))


def test_evidence_per_route(chunks):
    got = {r.route: r for r in evidence_per_route(chunks).collect()}
    assert {k: r.grounded_score for k, r in got.items()} == GROUNDED
    assert not any(r.is_insufficient_evidence for r in got.values())
    assert [c.id for c in got["default"].chunks] == ["hypertension_first_line-0", "hypertension_first_line-1", "statins_intensity-0"]
    citation = got["pregnancy_contraindications"].citations[1]
    assert citation.strength == "Strong Contraindication" and citation.quote.endswith("...") and len(citation.quote) == 123
    assert got["statins_intensity"].citations[0].strength == "Strong"


def test_default_route_with_small_k(chunks):
    by_list = {r.route: r for r in evidence_per_route(chunks, k=2).collect()}
    assert by_list["default"].grounded_score == 0.93
    by_score = {r.route: r for r in evidence_per_route(chunks, k=2, order_by="score").collect()}
    assert by_score["default"].grounded_score == 0.95


def test_no_chunks_means_insufficient(spark, chunks):
    asked = spark.createDataFrame([("who",), ("else",), ("  ",)], "q string")
    rows = keyword_evidence(asked, chunks, "q", k=0).collect()
    assert len(rows) == 2
    assert all(r.grounded_score == 0.0 and r.is_insufficient_evidence for r in rows)


def test_comparison_goes_with_its_route(spark, chunks):
    side = spark.createDataFrame([("hypertension_first_line", ("w", "n", "c"))],
                                 "route string, comparison struct<who_stance: string, nice_stance: string, consensus: string>")
    asked = spark.createDataFrame([("classes",), ("statin",)], "q string")
    rows = {r.q: r for r in keyword_evidence(asked, chunks, "q", comparison=side).collect()}
    assert rows["classes"].comparison.consensus == "c" and rows["statin"].comparison is None


def test_records_are_broadcast_and_questions_not_shuffled(spark, chunks):
    asked = spark.range(1000).select(F.concat(F.lit("who"), F.col("id").cast("string")).alias("q"), "id")
    plan = keyword_evidence(asked, chunks, "q")._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan


def test_many_rules_join_instead_of_broadcast(spark, chunks):
    rules = (*DEFAULT_RULES, *[Rule(f"route{i}", (f"zz{i}zz",)) for i in range(1200)])
    asked = spark.createDataFrame([("statin",), ("zz7zz",), ("else",)], "q string")
    few = {r.q: r.grounded_score for r in keyword_evidence(asked, chunks, "q").collect()}
    many = {r.q: r.grounded_score for r in keyword_evidence(asked, chunks, "q", rules=rules).collect()}
    assert many == {"statin": few["statin"], "else": few["else"], "zz7zz": 0.0}


def test_context_and_budget(spark, chunks):
    record = evidence_per_route(chunks).filter("route = 'default'")
    text = record.select(context_of(F.col("chunks")).alias("c")).first().c
    assert text.count("\n---\n") == 2
    assert text.startswith("[Evidence Document 1]:\nSource: src0 (sec, p. 0)\nContent: text hypertension_first_line 0 ")
    used = within_budget(record, "chunks", "content", F.lit(100), lambda c: F.lit(40).cast("bigint")).first()
    assert (used.chunks_used, used.tokens_used, used.running_tokens) == (2, 80, [40, 80, 120])
    none = within_budget(record, "chunks", "content", F.lit(10), lambda c: F.lit(40).cast("bigint")).first()
    assert (none.chunks_used, none.tokens_used) == (0, 0)


def test_translation_labels(spark):
    memory = spark.createDataFrame([("سؤال", "question"), ("فارغ", "")], "original string, translated string")
    asked = spark.createDataFrame([("hello", "en"), ("سؤال", "ar"), ("آخر", "ar"), ("فارغ", "ar")], "q string, detected_lang string")
    rows = {r.q: (r.translated_query, r.translation_model) for r in translate(asked, "q", memory, model="m").collect()}
    assert rows == {"hello": ("hello", "direct"), "سؤال": ("question", "m"), "آخر": ("آخر", "fallback"), "فارغ": ("فارغ", "m")}


def test_answer_batch_routes_the_translation_and_prompts_the_original(spark, chunks):
    memory = spark.createDataFrame([("سؤال", "which statin")], "original string, translated string")
    asked = spark.createDataFrame([(" سؤال ",), ("\n",)], "q string")
    rows = answer_batch(asked, memory, chunks, "q", translation_model="m", context_window=8192).collect()
    assert len(rows) == 1
    row = rows[0]
    assert row.route == "statins_intensity" and row.prompt.endswith("Clinical Question:\nسؤال") and row.fits_window


def test_answer_messages_with_failures(spark, chunks):
    memory = spark.createDataFrame([], "original string, translated string")
    asked = spark.createDataFrame([(1, "which statin"), (2, "who"), (3, "classes")], "n int, q string")
    batch = answer_batch(asked, memory, chunks, "q", translation_model="m", context_window=8192)
    answers = spark.createDataFrame(
        [(1, "Use it.", 0, None, 5, 6, 11), (2, None, None, "Server error 500", None, None, None)],
        "n int, content string, tokens_used bigint, error string, retrieval_ms bigint, generation_ms bigint, total_ms bigint",
    )
    made = answer_messages(batch, answers, ["n"], llm_model="l", embedding_model="e", batch_time=F.lit(9))
    assert made.columns == ["n", *schemas.MESSAGE.names]
    rows = {r.n: r for r in made.collect()}
    assert rows[1].content == "Use it." and rows[1].metrics.tokens_used == 350 and rows[1].metrics.total_latency_ms == 11
    assert rows[1].confidence_score == 0.96 and not rows[1].is_insufficient_evidence and len(rows[1].citations) == 1
    assert rows[2].content.endswith("query:\nServer error 500") and rows[2].is_insufficient_evidence
    assert rows[1].id.startswith("msg_") and not rows[1].id.startswith("msg_err_") and rows[1].translation.latency_ms == 0
    assert rows[2].id.startswith("msg_err_") and rows[2].timestamp == 9 and rows[2].comparison is None
    assert rows[3].content.endswith("Failed to communicate with AI provider.") and rows[3].citations is None


def test_vector_evidence_of_a_query_without_chunks(spark):
    q = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], "query_id int, query_vec array<double>")
    c = spark.createDataFrame([(7, [1.0, 0.1])], "chunk_id int, chunk_vec array<double>")
    rows = {r.query_id: r for r in vector_evidence(q, c, chunk_threshold=0.7).collect()}
    assert not rows[1].is_insufficient_evidence and len(rows[1].chunks) == 1
    assert rows[2].is_insufficient_evidence and rows[2].chunks == [] and rows[2].grounded_score == 0.0


def test_expected_sources_and_accuracy(spark):
    df = spark.createDataFrame([("Both", "a"), ("NICE", "a"), ("WHO", "b")], "g string, c string")
    got = df.select("c", expand_sources(F.col("g"), "Both", ["NICE", "WHO"]).alias("s"))
    assert sorted(map(tuple, got.collect())) == [("a", "NICE"), ("a", "NICE"), ("a", "WHO"), ("b", "WHO")]
    accuracy = routing_accuracy(df.withColumn("r", F.lit("WHO")), "r", "g", ["c"])
    assert {r.c: r.accuracy for r in accuracy.collect()} == {"a": 0.0, "b": 1.0}


def test_blank_term_suggests_nothing(spark):
    from evidora.catalog.lookups import suggestions

    df = spark.createDataFrame([("What is it?",), ("How?",)], "q string")
    assert suggestions(df, "q", "   ").count() == 0
    assert suggestions(df, "q", " WHAT ").count() == 1
    assert df.filter(fold(F.col("q")).contains("")).count() == 2
    assert df.select(trim_all(F.lit("  "))).first()[0] == ""


def test_domain_constants():
    assert sum(len(words) for _, words in K.ROUTE_KEYWORDS) == 22
    assert K.TOP_K == 4 and K.EVIDENCE_THRESHOLD == 0.65 and K.CHUNK_THRESHOLD == 0.70


def test_rule_table_as_a_join(spark):
    rng = random.Random(4)
    letters = "abé ?.\n"

    def some(n):
        return "".join(rng.choice(letters) for _ in range(n))

    words = [(rng.randint(1, 9), f"r{rng.randint(1, 30)}", some(rng.randint(1, 6)).upper()) for _ in range(60)]
    words += [(5, "none", None), (8, "z", "zz"), (8, "y", "ZZ")]
    texts = [(i % 40, some(rng.randint(0, 12))) for i in range(200)] + [(1, None), (1, ""), (2, "x zZ"), (2, "x zZ")]
    rules = spark.createDataFrame(words, "priority int, route string, keyword string")
    df = spark.createDataFrame(texts, "n int, t string").repartition(4)

    def wanted(text, table):
        hits = [(p, r) for p, r, k in table if k is not None and text is not None and k.lower() in text.lower()]
        return min(hits)[1] if hits else K.DEFAULT_ROUTE

    for table in (words, [*words, (10, "all", "")], []):
        known = spark.createDataFrame(table, rules.schema)
        got = with_route_from_table(df, "t", known).collect()
        assert sorted(map(str, got)) == sorted(str(Row(n=n, t=t, route=wanted(t, table))) for n, t in texts)
    chain = df.select("n", "t", route(F.col("t"), rules_from_table(rules.filter("keyword IS NOT NULL"))).alias("route"))
    assert sorted(map(str, with_route_from_table(df, "t", rules).collect())) == sorted(map(str, chain.collect()))


def test_hundred_thousand_keywords(spark):
    rules = spark.range(100_000).selectExpr("id AS priority", "'r' || id AS route", "md5(string(id)) AS keyword")
    df = spark.createDataFrame([(1, "x" + hashlib.md5(b"77777").hexdigest() + "y"), (2, "no keyword"), (3, None)], "n int, t string")
    routed = with_route_from_table(df, "t", rules)
    plan = routed._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert {r.n: r.route for r in routed.collect()} == {1: "r77777", 2: K.DEFAULT_ROUTE, 3: K.DEFAULT_ROUTE}


def test_texts_that_hold_a_leading_keyword_are_settled_without_a_join(spark):
    rules = [(n % 7, f"r{n % 7}", f"Key{n:03d}x") for n in range(150)]
    table = spark.createDataFrame(rules, "priority int, route string, keyword string")
    texts = [(1, "a KEY003X and key007x"), (2, "nothing"), (3, None), (4, "key006x")]
    got = with_route_from_table(spark.createDataFrame(texts, "id int, text string"), "text", table)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Exchange" not in plan
    assert {r.id: r.route for r in got.collect()} == {1: "r0", 2: "default", 3: "default", 4: "r6"}


def test_leading_and_other_keywords_give_the_first_rule(spark):
    rules = [(n // 2, f"r{n // 2:03d}", f"w{n:03d}.") for n in range(600)] + [(900, "late", "w000."), (5, None, "nul"), (901, "end", "zz")]
    table = spark.createDataFrame(rules, "priority int, route string, keyword string")
    texts = [(n, f"w{n:03d}. w{(n * 7) % 600:03d}.") for n in range(600)] + [(1000, "nul zz"), (1001, "zz"), (1002, ""), (1003, None)]
    got = with_route_from_table(spark.createDataFrame(texts, "id int, text string"), "text", table)
    want = {n: f"r{min(n, (n * 7) % 600) // 2:03d}" for n in range(600)}
    assert {r.id: r.route for r in got.collect()} == want | {1000: "default", 1001: "end", 1002: "default", 1003: "default"}

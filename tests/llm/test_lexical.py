"""Ranked search against scores of all documents in plain Python."""

import math
import random
import re
from collections import Counter

import numpy as np
from conftest import SF
from evidora.llm import lexical
from pyspark.sql import functions as F
from tests_llm_oracle import check_query

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return re.findall(lexical.TERM, (text or "").translate(LOWER))


def brute(docs, items, most=20):
    split = [(doc_id, terms(text)) for doc_id, text in docs]
    n_docs, n_terms = sum(bool(t) for _, t in split), sum(len(t) for _, t in split)
    df = Counter(w for _, t in split for w in set(t))
    out = []
    for item_id, text in set(items):
        scores = []
        for doc_id, own in split:
            tf, size = Counter(own), len(own)
            score = sum(
                math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[w] + 1)))
                * ((10**9 * tf[w]) // (1000 * tf[w] + 12 * (75 + (25 * size * n_docs) // n_terms)))
                for w in terms(text)
                if tf[w]
            )
            if score > 0:
                scores.append((-score, doc_id is not None, doc_id or 0, doc_id))
        out += [(item_id, i + 1, s[3], -s[0]) for i, s in enumerate(sorted(scores)[:most])]
    return sorted(out, key=str)


def found(docs, items, **options):
    rows = lexical.search(docs, items, **options).select("item_id", "rank", "doc_id", "score").collect()
    return sorted(map(tuple, rows), key=str)


def test_query_equals_its_sql(spark):
    rows = check_query(spark, "op12_ranked_search", SF)
    assert {r[-1] for r in rows} > {"1", "20"} or len(rows) > 20


def test_random_tables(spark, make, monkeypatch):
    monkeypatch.setattr(lexical, "PIECE_DOCS", 40)
    monkeypatch.setattr(lexical, "PIECE_BYTES", 4000)
    monkeypatch.setattr(lexical, "BLOCK_BYTES", 300)
    rng = random.Random(3)
    words = [f"w{i}" for i in range(60)] + ["Über", "été", "ГОД", "日本語", "x-y", "a_b", "don’t"]
    weights = [1 / (i + 1) for i in range(len(words))]
    text = lambda n: rng.choice([" ", ", ", "\n"]).join(rng.choices(words, weights, k=n))
    docs = [(i, text(rng.choice([1, 3, 30, 200]))) for i in range(400)]
    items = [(i, text(rng.choice([1, 2, 5, 12, 80]))) for i in range(30)]
    assert found(make(docs), make(items, "item_id long, text string")) == brute(docs, items)


def test_item_of_more_terms_than_a_machine_word(spark, make):
    rng = random.Random(4)
    words = [f"t{i}" for i in range(300)]
    docs = [(i, " ".join(rng.sample(words, 40))) for i in range(200)]
    items = [(1, " ".join(words)), (2, " ".join(words[:65] * 2)), (3, " ".join(words[100:164]))]
    assert found(make(docs), make(items, "item_id long, text string")) == brute(docs, items)


def test_ties_go_by_id(spark, make):
    docs = [(i, "same words here") for i in range(3000, 0, -1)] + [(None, "same words here")] * 2
    docs += [(9000, "none")] * 3000
    items = [(1, "words"), (2, "WORDS same words"), (2, "other"), (1, "words")]
    got = found(make(docs), make(items, "item_id long, text string"))
    assert got == brute(docs, items)
    assert [r[2] for rank in (1, 2, 3) for r in got if r[:2] == (1, rank)] == [None, None, 1]


def test_a_term_of_all_documents_scores_nothing(spark, make):
    docs = [(i, "all " + "rare " * (i == 7)) for i in range(2000)]
    assert found(make(docs), make([(1, "all"), (2, "all rare")], "item_id long, text string")) == brute(
        docs, [(1, "all"), (2, "all rare")]
    )


def test_nulls_empties_long_texts_and_clashing_names(spark, make):
    long = "needle " + "hay " * 60_000
    docs = [(1, None), (2, ""), (3, " .,- "), (4, long), (5, "needle"), (None, "needle Ä"), (4, "needle twice needle")]
    items = [(1, "needle"), (None, "Ä needle"), (2, None), (3, ""), (4, "…"), (5, "absent")]
    clash = {c: F.lit("9") for c in ("rank", "score", "terms", "weights", "block", "words", "term", "ids")}
    got = found(make(docs).withColumns(clash), make(items, "item_id long, text string").withColumns(clash))
    assert got == brute(docs, items)


def test_empty_tables(spark, make):
    schema = "item_id long, text string"
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert found(empty, make([(1, "a")], schema)) == []
    assert found(make([(1, "a")]), spark.createDataFrame([], schema)) == []
    assert found(make([(1, None)]), make([(1, "a")], schema)) == []


def test_groups_are_the_distinct_masks():
    bits = np.random.default_rng(0).random((70, 500)) < 0.02
    masks, group = lexical._groups(bits)
    assert (masks[:, group] == bits).all()
    assert len({m.tobytes() for m in masks.T}) == masks.shape[1]


def test_fewer_results_can_be_asked_for(spark, make):
    docs = [(i, "a " * (i + 1) + "b") for i in range(50)]
    items = [(1, "a b")]
    assert found(make(docs), make(items, "item_id long, text string"), most=3) == brute(docs, items, most=3)

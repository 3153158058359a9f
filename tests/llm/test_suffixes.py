"""Removal of repeated byte strings against a table of all strings in plain Python."""

import random
from collections import Counter

import numpy as np
import pytest
from conftest import SF
from evidora.llm import suffixes
from pyspark.sql import functions as F
from tests_llm_oracle import check_query


def brute(rows, length):
    texts = [(doc_id, (text or "").encode()) for doc_id, text in rows]
    seen = Counter(t[i : i + length] for _, t in texts for i in range(len(t) - length + 1))
    out = []
    for doc_id, t in texts:
        gone = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        kept = bytes(c for c, g in zip(t, gone) if not g)
        out.append((str(doc_id), len(t), sum(gone), bytes(gone).replace(b"\0", b" ").split().__len__(), kept))
    return sorted(out)


def result(df, length):
    rows = suffixes.repeats_removed(df, length=length).collect()
    assert all(sum(s["end"] - s["start"] for s in r.removed) == r.n_removed for r in rows)
    return sorted((str(r.doc_id), r.n_bytes, r.n_removed, len(r.removed), bytes(r.kept)) for r in rows)


def words(rng, n):
    return " ".join(rng.choice(["alpha", "beta", "gamma", "straße", "日本", "x"]) + str(rng.randrange(999)) for _ in range(n))


def test_query_equals_its_sql(spark):
    rows = check_query(spark, "op13_suffix_dedup", SF)
    assert sum(int(r[3]) > 0 for r in rows) > 20


@pytest.mark.parametrize("length", [80, 100, 129])
def test_random_texts_with_shared_passages(spark, make, monkeypatch, length):
    monkeypatch.setattr(suffixes, "BUCKET_BYTES", 3000)
    rng = random.Random(length)
    passages = [words(rng, rng.choice([8, 14, 15, 20, 60])) for _ in range(12)]
    rows = []
    for i in range(150):
        parts = [words(rng, rng.randrange(1, 12)) for _ in range(rng.randrange(1, 4))]
        for passage in rng.sample(passages, rng.randrange(0, 3)):
            cut = rng.randrange(0, 30)
            parts.insert(rng.randrange(len(parts) + 1), passage[cut : len(passage) - rng.randrange(0, 30)])
        rows.append((i, rng.choice([" ", ""]).join(parts)))
    assert result(make(rows), length) == brute(rows, length)


def test_one_passage_in_very_many_texts(spark, make):
    rng = random.Random(2)
    passage = words(rng, 30)
    rows = [(i, words(rng, 6) + passage + words(rng, 6)) for i in range(600)]
    got = result(make(rows), 100)
    assert got == brute(rows, 100)
    common = suffixes._common_strings(suffixes._texts(make(rows), "doc_id", "text"), 100)
    assert isinstance(common, np.ndarray)


def test_common_strings_do_not_change_the_result(spark, make, monkeypatch):
    monkeypatch.setattr(suffixes, "SAMPLE", 1.0)
    rng = random.Random(3)
    passage = words(rng, 30)
    rows = [(i, words(rng, 6) + passage[i % 40 :] + words(rng, 6)) for i in range(120)]
    assert len(suffixes._common_strings(suffixes._texts(make(rows), "doc_id", "text"), 100))
    assert result(make(rows), 100) == brute(rows, 100)


def test_periodic_and_long_texts(spark, make):
    rng = random.Random(4)
    rows = [(1, "a" * 3000), (2, "ab" * 90), (3, "ab" * 45 + "c"), (4, words(rng, 3000)), (5, "é" * 60 + "z" * 99), (6, "b" * 79)]
    rows.append((7, rows[3][1][5000:5300]))
    assert result(make(rows), 100) == brute(rows, 100)


def test_nulls_empties_repeated_rows_and_clashing_names(spark, make):
    rng = random.Random(5)
    long = words(rng, 40)
    rows = [(None, None), (1, ""), (None, long), (None, long[:150] + "!"), (2, "short"), (2, "short"), (3, long[20:] + "?")]
    rows += [(4, words(rng, 30))] * 2 + [(5, words(rng, 30))]
    clash = {c: F.lit("1") for c in ("begin", "gram", "context", "size", "wanted", "found", "kept", "removed", "parts")}
    assert result(make(rows).withColumns(clash), 100) == brute(rows, 100)


def test_empty_table(spark):
    assert result(spark.createDataFrame([], "doc_id long, text string"), 100) == []


def test_suffix_arrays():
    rng = np.random.default_rng(0)
    for _ in range(400):
        s = rng.integers(1, rng.integers(2, 6), rng.integers(0, 40))
        assert suffixes.suffix_array(s).tolist() == sorted(range(len(s)), key=lambda i: s[i:].tolist())
    large = rng.integers(1, 1 << 40, 200)
    large[100:] = large[:100]
    ranks = np.unique(large, return_inverse=True)[1] + 1
    assert suffixes.suffix_array(ranks).tolist() == sorted(range(200), key=lambda i: ranks[i:].tolist())

import hashlib
import re

import pyarrow as pa
import pytest
from evidora.llm import substring

from tests_llm_oracle import check_query


def brute(rows, window):
    """rows: (doc_id, text) with distinct ids."""
    words = {d: re.findall("[^\x20\x09-\x0d]+", t or "") for d, t in rows}
    seen, gone = set(), {d: set() for d in words}
    for d in sorted(words):
        for i in range(len(words[d]) - window + 1):
            key = tuple(words[d][i : i + window])
            if key in seen:
                gone[d].update(range(i, i + window))
            seen.add(key)
    return {
        d: (len(w), len(gone[d]), hashlib.sha256(" ".join(x for i, x in enumerate(w) if i not in gone[d]).encode()).hexdigest())
        for d, w in words.items()
    }


def digest(df):
    out = {}
    for r in df.collect():
        spans = [(s.start, s.end) for s in r.removed]
        assert sum(b - a for a, b in spans) == r.n_removed and all(a < b for a, b in spans)
        assert all(x[1] < y[0] for x, y in zip(spans, spans[1:]))
        out.setdefault(r.doc_id, []).append((r.n_words, r.n_removed, hashlib.sha256(r.kept_text.encode()).hexdigest()))
    return out


def test_query_against_sql(spark):
    check_query(spark, "op1_substring_dedup", "/root/testdata/sf0.001")


@pytest.mark.parametrize("piece", [200, 8 << 20])
def test_edges(make, monkeypatch, piece):
    passage = " ".join(f"p{i}" for i in range(9))
    rows = [
        (1, None), (2, ""), (3, " \n\t "), (4, passage), (5, f"x {passage} y"), (6, "a " * 40), (7, passage + " é\x0b" + passage),
        (8, " ".join(f"w{i % 701}" for i in range(9000))), (9, f"{passage}\n{passage[:-3]}"), (10, "a a a a a"),
    ]
    want = brute(rows, 5)
    df = make(rows)
    sent = substring._send
    monkeypatch.setattr(substring, "_send", lambda b, w, s, n, c: sent(b, w, s, n, c))
    monkeypatch.setattr(substring, "PIECE_BYTES", piece)
    got = digest(substring.substring_dedup(df, window=5, seed=2, buckets=3))
    assert {d: v[0] for d, v in got.items()} == want


def test_repeated_rows_and_null_ids(make):
    text = " ".join(f"w{i}" for i in range(30))
    rows = [(None, text), (3, text), (3, text), (4, text), (5, "z " + text)]
    got = digest(substring.substring_dedup(make(rows), window=10))
    assert [v[1] for v in got[None]] == [0] and [v[1] for v in got[3]] == [30, 30]
    assert got[4][0][1] == 30 and got[5][0][1] == 30
    alone = digest(substring.substring_dedup(make([(3, text), (3, text)]), window=10))
    assert [v[1] for v in alone[3]] == [0, 0]


def test_empty(make):
    assert substring.substring_dedup(make([])).collect() == []


def test_common_runs_do_not_change_the_result(spark, monkeypatch):
    shared = " ".join(f"s{i}" for i in range(40))
    rows = [(i, f"b{i} c{i} d{i} {shared} e{i} f{i} g{i}") for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    monkeypatch.setattr(substring, "SAMPLE", 1.0)
    assert {d: v[0] for d, v in digest(substring.substring_dedup(df)).items()} == brute(rows, 20)


def test_pieces_are_small_beside_the_memory_of_a_worker():
    texts = ["word " * 20_000] * 60  # 6 MB
    batch = pa.RecordBatch.from_arrays([pa.array(texts)], ["text"])
    pieces = list(substring.tx.text_pieces(iter([batch]), "text", substring.PIECE_BYTES))
    assert len(pieces) > 1 and sum(p.num_rows for p in pieces) == len(texts)

import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from evidora.llm import mixing_lm as m
from pyspark.sql import functions as F


def words(text):
    return re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda x: x[0].lower(), text or ""))


def check(rows, train, got):
    counts = Counter()
    for (_, text), t in zip(rows, train):
        if t:
            counts.update([*words(text), None])
    total, types = sum(counts.values()), len(counts)
    want = sorted(
        (str(doc), not t, len(words(text)) + 1, sum(counts[w] > 0 for w in [*words(text), None]), total,
         round(sum(math.log10((counts[w] + 0.1) / (total + 0.1 * (types + 1))) for w in [*words(text), None]), 6))
        for (doc, text), t in zip(rows, train)
    )
    have = sorted((str(r[0]), r[1], r[2], r[3], r[4], round(r[5], 6)) for r in got)
    assert have == want
    assert all(r.score <= 0 and math.isfinite(r.score) for r in got)


def test_documents(spark, monkeypatch):
    monkeypatch.setattr(m, "DRAWS", 60_000)
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()]
    got = m.op7_mixing_lm(spark, "/root/testdata/sf0.01").collect()
    check(rows, [zlib.crc32(str(d).encode()) % 10 != 0 for d, _ in rows], got)
    held = [r for r in got if r.held_out]
    size = {d: len((t or "").encode()) for d, t in rows}
    bits = -sum(r.score for r in held) / math.log10(2) / sum(size[r.doc_id] for r in held)
    assert bits < 2.6  # bits per byte of unseen texts


def test_edges(make, monkeypatch):
    monkeypatch.setattr(m, "DRAWS", 2_000)
    rows = [(1, None), (2, ""), (3, " \n"), (4, "One one TWO"), (4, "One one TWO"), (None, "two é\x0b你好"), (5, "w " * 30_000), (6, "never")]
    train = [True, False, True, True, True, False, True, False]
    df = make(rows).withColumn("train", F.expr("text is null or text like '% %' and doc_id is not null"))
    for limit in (6 << 20, 10):
        monkeypatch.setattr(m, "PIECE_BYTES", limit)
        got = m.scores(df, F.col("train")).collect()
        check(rows, train, got)
    assert len({r.score for r in got if r.doc_id == 4}) == 1


def test_nothing_to_learn_from(make):
    rows = [(1, "a b"), (2, None)]
    got = m.scores(make(rows), F.lit(None).cast("boolean")).collect()
    check(rows, [False, False], got)
    assert m.scores(make([]), F.lit(True)).collect() == []


def test_spellings_are_a_distribution():
    tree = m.code_tree(np.bincount(np.frombuffer(b"abracadabra ", np.uint8), minlength=256))
    size = int(m._OFFSETS[-1])
    zeros, ones = np.zeros(size, np.uint16), np.zeros(size, np.uint16)
    list_ = [b"abra ", b"cad ", b"abra "]
    starts = np.concatenate([[0], np.cumsum([len(x) for x in list_])])
    bits = m.spelled(np.frombuffer(b"".join(list_), np.uint8), starts, tree)
    for slots in bits.slots:
        np.add.at(zeros, slots[bits.bit == 0], m.COUNT_SCALE)
        np.add.at(ones, slots[bits.bit == 1], m.COUNT_SCALE)
    model = m.learn(tree, zeros, ones, [b"abra ", b"cad "], np.array([2.0, 1.0]), 3)
    # All bytes that can follow a beginning have chances that add up to 1.
    for begin in (b"", b"ab", b"zz"):
        texts = [begin + bytes([b]) for b in range(256)]
        starts = np.concatenate([[0], np.cumsum([len(x) for x in texts])])
        last = model.word_scores(np.frombuffer(b"".join(texts), np.uint8), starts)
        if begin:
            one = model.word_scores(np.frombuffer(begin, np.uint8), np.array([0, len(begin)]))
            last = last - one[0]
        assert (10.0**last).sum() == pytest.approx(1, abs=1e-3)


def test_counts_beyond_32_bits_do_not_wrap():
    tree = m.code_tree(np.bincount(np.frombuffer(b"the of ", np.uint8), minlength=256))
    words, counts = m._pack(np.frombuffer(b"the of ", np.uint8)), m._pack(np.array([5_000_000_000, 7], np.int64))
    batch = pa.RecordBatch.from_arrays([pa.array([words], pa.binary()), pa.array([counts], pa.binary())], ["words", "counts"])
    whole, steps = 0, 0
    for part in m._tables(iter([batch]), tree):
        both = m._unpack(part.column("counts")[0].as_py(), np.int64)
        whole = max(whole, both.max())
        codes = m._unpack(m._add(pa.Table.from_batches([part, part])).column("counts")[0].as_py(), np.uint16)
        steps = max(steps, m._COUNT_OF[codes].max())
    assert 5_000_000_000 <= whole <= 5_000_000_007 and abs(steps / (2 * whole) - 1) < 2 ** (1 / m.COUNT_SCALE) - 1


def test_weights_refinement_and_share_come_from_all_words(spark, monkeypatch):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    found = []
    for words, draws in ((4096, 20_000), (16, 300)):
        monkeypatch.setattr(m, "SAMPLE_WORDS", words)
        monkeypatch.setattr(m, "DRAWS", draws)
        got = m.scores(df, F.col("doc_id") % 10 != 0).collect()
        found.append({r.doc_id: r.score for r in got})
    assert len(found[0]) > 100
    assert all(found[1][d] == pytest.approx(x, rel=1e-3) for d, x in found[0].items())

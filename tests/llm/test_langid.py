import itertools
import tracemalloc
import zlib

import numpy as np
import pyarrow as pa
import pytest
from evidora.llm import langid
from evidora.llm import text as tx


@pytest.fixture(scope="module")
def field(spark):
    return langid.trained(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))


def test_forward_backward_against_all_paths():
    rng = np.random.default_rng(0)
    field = langid.Field(["a", "b", "c"], np.zeros((1, 3)), rng.random((3, 3)) + 0.1, np.array([0.3, 0.3, 0.4]))
    emission = rng.normal(size=(7, 3))
    codes = rng.integers(0, 7, 6)
    old = langid.BLOCK
    for block in (2, 4, 128):
        langid.BLOCK = block
        try:
            got = langid.word_posteriors(codes, np.array([0, 6]), emission, field)
        finally:
            langid.BLOCK = old
        factor, want = np.exp(emission), np.zeros((6, 3))
        entry = np.linalg.lstsq((field.transitions / field.transitions.max()).T, field.start, rcond=None)[0].clip(1e-9)
        start = entry @ (field.transitions / field.transitions.max())
        for path in itertools.product(range(3), repeat=6):
            p = start[path[0]] * factor[codes[0], path[0]]
            for t in range(1, 6):
                p *= field.transitions[path[t - 1], path[t]] * factor[codes[t], path[t]]
            for t in range(6):
                want[t, path[t]] += p
        np.testing.assert_allclose(got, want / want.sum(axis=1, keepdims=True), rtol=1e-6, atol=1e-9)


def test_held_out_accuracy(spark):
    got = langid.op6_language_id(spark, "/root/testdata/sf0.01").toPandas().set_index("doc_id")
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang").toPandas().set_index("doc_id")
    assert sorted(got.index) == sorted(docs.index)
    assert all(h == (zlib.crc32(str(d).encode()) % 4 == 2) for d, h in got.held_out.items())
    own = got[got.held_out]
    assert (own.lang_pred == docs.lang.loc[own.index]).mean() > 0.98
    assert got.score.between(0, 1).all()


def test_switches_inside_a_text(field, spark):
    rows = {r.lang: r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").orderBy("doc_id").collect()}
    parts = [" ".join(rows[k].split()[:40]) for k in ("de", "en", "fr")]
    df = spark.createDataFrame([(1, " ".join(parts))], "doc_id long, text string")
    spans = langid.labelled(df, field).collect()[0].language.spans
    words = [s.lang for s in spans for _ in range(s.end - s.start)]
    want = ["de"] * 40 + ["en"] * 40 + ["fr"] * 40
    assert sum(a == b for a, b in zip(words, want, strict=True)) >= 110


def test_edges(make, field):
    rows = [
        (1, None), (2, ""), (3, " 12 34 !? \n"), (4, "the of and"), (4, "the of and"), (None, "der die das und"), (5, "你好 мир"),
        (6, "und der die " * 15_000), (7, "🎉 🎉"), (8, "THE OF AND"),
    ]
    df = make(rows)
    got = langid.labelled(df, field)
    assert got.columns == [*df.columns, "language"]
    found = {r.doc_id: r.language for r in got.collect()}
    assert got.count() == len(rows)
    assert all(found[d].lang == "und" and found[d].score == 0 and found[d].spans == [] for d in (1, 2, 3, 7))
    assert found[4].lang == found[8].lang == "en" and found[None].lang == found[6].lang == "de"
    assert found[5].lang in field.languages
    assert found[6].spans[-1].end == 45_000 and found[6].score > 0.9


def test_sample_is_bounded_and_spread(make, monkeypatch):
    monkeypatch.setattr(langid, "SAMPLE_DOCS", 20)
    rows = [(None, f"text {i} of no id", "en") for i in range(400)] + [(7, f"text {i} of one id", "de") for i in range(400)]
    rows += [(None, "the same", "fr")] * 300 + [(9, "other", "fr")]
    df = make(rows, "doc_id long, text string, lang string")
    sizes = []
    collect = type(df).collect
    monkeypatch.setattr(type(df), "collect", lambda self: [sizes.append(len(x := collect(self))), x][1])
    got = langid.sample(df, "text", "lang", "doc_id")
    assert max(sizes) <= 3 * 20
    assert [sum(lang == x for _, lang in got) for x in ("en", "de", "fr")] == [20, 20, 2]
    assert len(set(got)) == 42 and got == langid.sample(df.repartition(5), "text", "lang", "doc_id")
    long = " ".join(f"w{i}" for i in range(20_000))
    words = langid.sample(make([(1, long, "en")], "doc_id long, text string, lang string"), "text", "lang", "doc_id")[0][0].split()
    assert len(" ".join(words)) <= langid.SAMPLE_CHARS + langid.SAMPLE_PASSAGES
    at = [int(w[1:]) for w in words]
    assert set(words) <= set(long.split()) and at[0] == 0 and at[-1] == 19_999 and sum(9_000 < i < 15_000 for i in at) > 50


def test_nothing_to_learn_from(make):
    df = make([(1, "some text", None), (2, None, "en")], "doc_id long, text string, lang string")
    field = langid.trained(df)
    assert field.languages == []
    assert [r.language.lang for r in langid.labelled(df, field).collect()] == ["und", "und"]
    one = langid.trained(make([(1, "a b c", "en")], "doc_id long, text string, lang string"))
    assert [r.language.lang for r in langid.labelled(make([(1, "x y"), (2, "7")]), one).orderBy("doc_id").collect()] == ["en", "und"]
    assert langid.labelled(make([]), one).collect() == []


def test_features_stay_inside_words():
    words = tx.words_of(pa.array(["ab cd ", "ab "]))
    a, _ = langid._features(words.codes()[1])
    b, owner = langid._features(tx.words_of(pa.array(["cd ab "])).codes()[1])
    assert sorted(a) == sorted(b) and set(owner) == {0, 1}


def test_training_holds_little_on_the_driver():
    rng = np.random.default_rng(3)
    signs = rng.integers(97, 123, (60_000, 9)).astype(np.uint8)
    words = [w.tobytes().decode() for w in signs]
    texts = [" ".join(words[i : i + 300]) for i in range(0, len(words), 300)]
    vocabulary = pa.array([f"{w} ".encode() for w in words[:10_000]], pa.large_binary())
    feature, owner = langid._features(vocabulary)
    by_word, count = langid._features_by_word(vocabulary)
    assert np.array_equal(by_word, feature[np.argsort(owner, kind="stable")])
    assert np.array_equal(count, np.bincount(owner))
    tracemalloc.start()
    try:
        langid.fit(texts, ["en", "de"] * 100)
        _, peak = tracemalloc.get_traced_memory()
    finally:
        tracemalloc.stop()
    assert peak < 80e6

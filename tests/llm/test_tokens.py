import random

import pyarrow as pa
import pytest
import sentencepiece
from evidora.llm import tokens

PATH = tokens.vocabulary("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library():
    model = sentencepiece.SentencePieceProcessor(model_file=PATH)
    return lambda texts: [len(x) for x in model.encode(texts)]


def counts(texts, machine=None):
    prepared = [" " + t.replace("▁", " ") if t else t for t in texts]
    return tokens.chunk_counts(pa.array(prepared, pa.string()), machine or tokens.transducer(PATH)).tolist()


def test_strange_texts(library):
    rng = random.Random(4)
    signs = "abcdefghijklmnop ABC  \n\t.,;:0123456789éüñ你好мир🎉ﬁ▁</s>'\"()[]{}_-=+*&^%$#@!\\\x00"
    texts = ["".join(rng.choice(signs) for _ in range(rng.randint(0, 70))) for _ in range(4000)]
    texts += [" " * k for k in range(40)] + ["a" + " " * k + "b" for k in range(40)]
    texts += ["", "<0x0A>", "<s> </s> <unk>", "▁" * 5, "=" * 100, "a" * 3000, "\x00a", "你好" * 500]
    assert counts(texts) == library(texts)


def test_full_table(library, monkeypatch):
    monkeypatch.setattr(tokens, "MOST_STATES", 50)
    texts = ["several words that make more states than are kept", "and others, too"]
    assert counts(texts, tokens.Transducer(PATH)) == library(texts)


def test_documents(spark, library):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = df.select("doc_id", "text").collect()
    want = dict(zip([r.doc_id for r in rows], library([r.text for r in rows])))
    got = tokens.op9_token_counts(spark, "/root/testdata/sf0.01").collect()
    assert {r.doc_id: r.n_tokens for r in got} == want
    assert all(r.over_limit == (r.n_tokens > 4096) for r in got)
    assert {r.doc_id: r.n_bytes for r in got} == {r.doc_id: len(r.text.encode()) for r in rows}


def test_edges(make, library):
    long = "lang und länger " * 20_000
    rows = [(1, None), (2, ""), (3, "x"), (3, "x"), (None, "é 🎉"), (4, long)]
    got = [(r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in tokens.token_counts(make(rows), PATH).collect()]
    want = [(d, len((t or "").encode()), *library([t or ""]), library([t or ""])[0] > 4096) for d, t in rows]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert tokens.token_counts(make([]), PATH).collect() == []

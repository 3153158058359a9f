import itertools
import random
import re
import tracemalloc

import pyarrow as pa
from evidora.llm import decontamination as d
from pyspark.sql import functions as F
from tests_llm_oracle import check_query


def test_query_against_sql(spark):
    assert len(check_query(spark, "op3_benchmark_overlaps", "/root/testdata/sf0.01"))


def test_masks_miss_no_pattern():
    for pattern in itertools.combinations(range(d.WINDOW), d.WINDOW - (d.WINDOW - d.WINDOW // d.DIFFERS)):
        assert any(
            all(start + k not in pattern for k in mask) for mask in d.MASKS for start in range(d.WINDOW - mask[-1])
        )
    for n in range(d.EXACT_BELOW, d.WINDOW):
        for pattern in itertools.combinations(range(n), n // d.DIFFERS):
            assert any(all(start + k not in pattern for k in d.SHORT_MASKS[0]) for start in range(n - 2))


def brute(docs, items):
    def words(t):
        spaced = re.sub("([\u0e00-\u0eff\u3040-\u30ff\u4e00-\u9fff])", r" \1 ", (t or "").lower())
        return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f«»\u2000-\u206f]+", spaced)

    out = []
    for doc, text in docs:
        w = words(text)
        for item, item_text in items:
            b = words(item_text)
            n = min(len(b), d.WINDOW)
            if not b:
                continue
            least = n if n < d.EXACT_BELOW else n - n // d.DIFFERS
            for origin in range(-len(b) + 1, len(w)):
                good = [
                    i
                    for i in range(len(b) - n + 1)
                    if origin + i >= 0
                    and origin + i + n <= len(w)
                    and sum(w[origin + i + k] == b[i + k] for k in range(n)) >= least
                ]
                if good:
                    lo, hi = good[0], good[-1] + n
                    equal = sum(0 <= origin + i < len(w) and w[origin + i] == b[i] for i in range(lo, hi))
                    out.append((doc, item, origin + lo, origin + hi, lo, equal))
    return out


def test_substitutions_and_edges(make, monkeypatch):
    rng = random.Random(2)
    vocabulary = [f"v{i}" for i in range(60)] + ["the", "of", "é"]
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(n))) for i, n in enumerate([14, 30, 8, 12, 7, 60, 13, 13])]
    items += [(100, None), (101, ""), (None, " ".join(f"n{i}" for i in range(20))), (6, items[6][1])]
    docs = []
    for i in range(120):
        words = [rng.choice(vocabulary) for _ in range(rng.randint(0, 40))]
        passage = items[i % 8][1].split()
        for k in range(len(passage)):
            if rng.random() < 0.12:
                passage[k] = "changed"
        text = " ".join(words[: len(words) // 2] + passage + words[len(words) // 2 :])
        docs.append((i, rng.choice([text, text.upper(), text.replace(" ", ",\n"), text.replace(" ", "” “")])))
    docs += [(200, None), (201, ""), (202, "..."), (None, items[1][1]), (203, items[5][1]), (203, items[5][1])]
    docs.append((204, "filler " * 20_000 + items[1][1]))
    want = sorted(brute([x for x in docs if x[0] != 204], items), key=str)
    want += [x for x in brute([(204, "filler " * 100 + items[1][1])], items)]
    want[-1] = (204, 1, 20_000, 20_030, 0, 30)
    assert len(want) > 60
    for limit in (200_000, 40):
        monkeypatch.setattr(d, "BLOCK_WORDS", limit)
        got = d.overlaps(make(docs), make(items, "item_id long, text string")).collect()
        assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    dirty = {str(x[0]) for x in want}
    kept = d.clean(make(docs), make(items, "item_id long, text string"))
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(i) for i, _ in docs if str(i) not in dirty)


def test_empty(make):
    item = make([(1, "a b c d e f g h i j k l m n")], "item_id long, text string")
    none = make([], "item_id long, text string")
    doc = make([(1, "a b c d e f g h i j k l m n")])
    assert d.overlaps(make([]), item).collect() == [] and d.overlaps(doc, none).collect() == []
    assert d.clean(doc, none).count() == 1 and d.clean(make([]), item).count() == 0
    assert d.clean(doc, item).count() == 0 and d.clean(doc.withColumn("text", F.lit(None).cast("string")), item).count() == 1


def test_short_items_and_scripts_without_blanks(make, monkeypatch):
    items = [(1, "which river runs through rome"), (2, "Tiber"), (3, "the river"), (4, "哪条河流经过罗马城"), (5, "ローマ"), (6, "")]
    docs = [
        (1, "He asked: Which river runs through Rome? It is the Tiber, the river of Rome."), (2, "which river runs across rome"),
        (3, "考试问：哪条河流经过罗马城？答案"), (4, "哪条河流流过罗马城"), (5, "ここはローマです"), (6, None), (7, "the\nriver"),
    ]
    want = sorted(brute(docs, items), key=str)
    assert {(w[0], w[1]) for w in want} == {(1, 1), (1, 2), (1, 3), (3, 4), (4, 4), (5, 5), (7, 3)}
    got = d.overlaps(make(docs), make(items, "item_id long, text string")).collect()
    assert sorted(map(tuple, got), key=str) == want
    kept = d.clean(make(docs), make(items, "item_id long, text string")).collect()
    assert sorted(r.doc_id for r in kept) == [2, 5, 6, 7]


def test_a_repeated_word_in_both(make, monkeypatch):
    monkeypatch.setattr(d, "CELLS", 5_000)
    docs, items = [(1, "na " * 300), (2, "other " + "na " * 40)], [(1, "na " * 60), (2, "na na")]
    got = d.overlaps(make(docs), make(items, "item_id long, text string")).collect()
    assert sorted(map(tuple, got)) == sorted(brute(docs, items))
    long = pa.array(["na " * 20_000])
    tracemalloc.start()
    found = d._overlaps(long, d._block(["na " * 300], 0, 1))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(found[0]) == 20_000 + 300 - 2 * d.WINDOW + 1 and peak < 200 << 20

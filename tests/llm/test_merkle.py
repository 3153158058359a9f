"""The manifest against a tree built in plain Python."""

import hashlib
import random

from conftest import SF
from evidora.llm import merkle
from pyspark.sql import functions as F
from tests_llm_oracle import check_query


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def enc(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def climb(nodes):
    """Root of a list of nodes, and of each its siblings by level as (before, behind)."""
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for path, i in zip(paths, at):
            run = i // 16 * 16
            path.append(("".join(nodes[run:i]), "".join(nodes[i + 1 : run + 16])))
        at = [i // 16 for i in at]
        nodes = [h(*nodes[i : i + 16]) for i in range(0, len(nodes), 16)]
    return nodes[0], paths


def brute(rows):
    sources = {}
    for doc_id, source, *rest in rows:
        leaf = h(*(enc(v) for v in (doc_id, source, *rest)))
        sources.setdefault(source, []).append(((doc_id is not None, doc_id or 0, leaf), doc_id, leaf))
    order = sorted(sources, key=lambda s: (s is not None, (s or "").encode()))
    inner = {s: climb([leaf for *_, leaf in sorted(sources[s])]) for s in order}
    root, tops = climb([inner[s][0] for s in order])
    return sorted(
        (str(doc_id), leaf, inner[s][0], root, str(path + top))
        for s, top in zip(order, tops)
        for (_, doc_id, leaf), path in zip(sorted(sources[s]), inner[s][1])
    )


def result(df):
    rows = merkle.manifest(df).collect()
    return sorted(
        (str(r.doc_id), r.leaf, r.subroot, r.root, str([(s["left"], s["right"]) for s in r.path])) for r in rows
    )


SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"


def test_query_equals_its_sql(spark):
    rows = check_query(spark, "op11_merkle_manifest", SF)
    assert len(rows) == 200


def test_sizes_around_runs_and_blocks(spark, make):
    rng = random.Random(1)
    sizes = {"a": 1, "b": 2, "ä": 16, "Z": 17, None: 256, "": 257, "hot": 4096 + 300}
    rows = [(i * 7 - 50, s, "en", i, f"text {i}") for s, n in sizes.items() for i in range(n)]
    rng.shuffle(rows)
    assert result(make(rows, SCHEMA)) == brute(rows)


def test_more_rounds_with_missing_partners(spark, monkeypatch):
    """Blocks of one run, so that a tree of 16^3 leaves and some takes three rounds."""
    monkeypatch.setattr(merkle, "LEVELS", 1)
    monkeypatch.setattr(merkle, "BLOCK", 16)
    for n in (16**3 + 1, 16**3 + 16 * 20 + 5, 9000):
        rows = [(i, "s", None, i, "x") for i in range(n)]
        assert result(spark.createDataFrame(rows, SCHEMA)) == brute(rows)


def test_many_sources(spark):
    rows = [(i, f"s{i % 300}", None, i, "x") for i in range(700)]
    assert result(spark.createDataFrame(rows, SCHEMA)) == brute(rows)


def test_nulls_empties_repeats_and_clashing_names(spark, make):
    long = "wörd " * 40_000
    rows = [
        (None, None, None, None, None),
        (None, None, None, None, ""),
        (None, "s", "", 0, "-"),
        (1, "s", "de", 3, long),
        (1, "s", "de", 3, "other text, same id"),
        *[(2, "s", "en", 1, "again")] * 40,
    ]
    df = make(rows, SCHEMA).withColumns({c: F.lit("clash") for c in ("tree", "leaf", "path", "root", "rank", "rows", "at")})
    assert result(df) == brute(rows)


def test_one_row_and_no_row(spark):
    rows = [(5, "s", "en", 1, "a")]
    assert result(spark.createDataFrame(rows, SCHEMA)) == brute(rows)
    assert result(spark.createDataFrame([], SCHEMA)) == []


def test_folding_finds_a_changed_leaf(spark, make):
    rows = [(i, "s", "en", i, "T") for i in range(40)]
    held = F.when(F.col("doc_id") == 7, F.sha2(F.lit("x"), 256))
    got = merkle.manifest(make(rows, SCHEMA), carry={"held": held})
    wrong = got.where(merkle.folded(F.col("path"), F.coalesce("held", "leaf")) != F.col("root")).collect()
    assert [r.doc_id for r in wrong] == [7]

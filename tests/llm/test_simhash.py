import importlib
import re
from collections import defaultdict

import numpy as np
import pytest
import xxhash
from evidora.llm import simhash
from evidora.llm.components import components


def brute(rows):
    prints = []
    for _, text in rows:
        words = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        grams = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
        hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
        prints.append(sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)))
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 3:
                parent[find(i)] = find(j)
    ids = defaultdict(list)
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            ids[find(i)].append(doc)
    return sorted(
        (str(doc), f"{p:016x}", str(min(ids[find(i)], default=None))) for i, ((doc, _), p) in enumerate(zip(rows, prints))
    )


def similar(rows):
    """Smallest id of each component of texts alike at Jaccard 0.8, as text."""
    sets = [shingle_set(text) for _, text in rows]
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if jaccard(sets[i], sets[j]) >= 0.8:
                parent[find(i)] = find(j)
    ids = defaultdict(list)
    for i, (doc, _) in enumerate(rows):
        ids[find(i)].append(doc)
    return {str(min(v)) for v in ids.values()}


def got(df):
    result = simhash.near_copies(df)
    return sorted((str(r.doc_id), f"{r.fp % (1 << 64):016x}", str(r.component_id)) for r in result.collect())


def test_documents_against_brute_force(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r.doc_id, r.text) for r in df.collect()]
    assert got(df) == brute(rows)


def test_edges(make):
    long = " ".join(f"w{i % 977}" for i in range(30_000))
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "One"), (5, "one"), (6, "a b"), (7, long), (7, long), (None, long + " x")]
    rows += [(None, "alone in here"), (9, "É è\x0bÇ z z q"), (10, long.upper())]
    assert got(make(rows)) == brute(rows)


def test_empty(make):
    assert got(make([])) == []


@pytest.mark.parametrize("limit", [2, 1024])
def test_links_by_pairs_and_by_probing(spark, monkeypatch, limit):
    rng = np.random.default_rng(5)
    base = rng.integers(0, 1 << 63, 12, dtype=np.uint64)
    prints = set()
    for b in base:
        for _ in range(60):
            x = int(b)
            for bit in rng.choice(64, rng.integers(0, 7), replace=False):
                x ^= 1 << int(bit)
            prints.add(x)
    prints = sorted(prints)
    signed = np.array(prints, np.uint64).view(np.int64).tolist()
    monkeypatch.setattr(simhash, "PROBE_FROM", limit)
    monkeypatch.setattr(simhash, "BLOCK_ROWS", 100)
    links = []
    values = np.array(signed, np.int64)
    rows = []
    for wild in range(64):
        half = values.view(np.uint64) & np.uint64(0xFFFFFFFF) if wild < 32 else values.view(np.uint64) >> np.uint64(32)
        key = (half & ~np.uint64(1 << wild % 32)).astype(np.int64) + (wild << 32)
        rows += list(zip(key.tolist(), signed))
    rows.sort()
    import pyarrow as pa

    def batches():
        for lo in range(0, len(rows), 37):
            part = rows[lo : lo + 37]
            yield pa.RecordBatch.from_arrays([pa.array([r[1] for r in part]), pa.array([r[0] for r in part])], ["fp", "variant"])

    for batch in simhash._meet(batches()):
        links += list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()))
    parent = {x: x for x in signed}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        parent[max(find(a), find(b))] = min(find(a), find(b))
    want = {x: x for x in signed}

    def root(x):
        while want[x] != x:
            x = want[x]
        return x

    for i, a in enumerate(signed):
        for b in signed[:i]:
            if ((a ^ b) % (1 << 64)).bit_count() <= 3:
                want[max(root(a), root(b))] = min(root(a), root(b))
    assert [find(x) for x in signed] == [root(x) for x in signed]


def test_components(spark):
    chain = [(i, i + 1) for i in range(20)] + [(100, 200), (200, 300), (500, 500), (7, None)] + [(1000, 1001 + i) for i in range(50)]
    result = {r.node: r.root for r in components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert result == {**{i: 0 for i in range(21)}, 100: 100, 200: 100, 300: 100, 500: 500, **{1000 + i: 1000 for i in range(51)}}
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_components_spend_no_round_on_what_is_settled(spark, monkeypatch):
    module = importlib.import_module("evidora.llm.components")
    made, plain = [], module.stored

    def counted(df, name):
        made.append(name)
        return plain(df, name)

    monkeypatch.setattr(module, "stored", counted)
    stars = [(1, 0), (2, 0), (3, 0), (11, 10), (12, 10), (20, 20)]
    found = components(spark.createDataFrame(stars, "a long, b long"), "merge").collect()
    assert sorted(map(tuple, found)) == [(0, 0), (1, 0), (2, 0), (3, 0), (10, 10), (11, 10), (12, 10), (20, 20)]
    assert len(made) == 2  # the links themselves, and one round


def test_components_of_random_links(spark):
    rng = np.random.default_rng(5)
    for n, m in ((40, 30), (300, 260)):
        pairs = [(int(a), int(b)) for a, b in rng.integers(0, n, (m, 2))]
        want = {x: x for p in pairs for x in p}
        for _ in range(n):
            for a, b in pairs:
                want[a] = want[b] = min(want[a], want[b])
        found = components(spark.createDataFrame(pairs, "a long, b long"), "merge").collect()
        assert len(found) == len(want) and {r.node: r.root for r in found} == want


def test_texts_with_few_changes_are_similar(spark, monkeypatch):
    rng = np.random.default_rng(8)
    monkeypatch.setattr(simhash, "BLOCK_ROWS", 3000)
    rows = []
    for group in range(40):
        words = [f"w{x}" for x in rng.integers(0, 5000, 300)]
        for copy in range(6):
            own = list(words)
            for at in rng.choice(300, copy, replace=False):
                own[at] = f"changed{group}{copy}"
            rows.append((group * 10 + copy, " ".join(own)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    kept = {str(r.doc_id) for r in simhash.first_of_each(df).collect()}
    assert kept == similar(rows)
    assert {str(g * 10) for g in range(40)} <= kept and len(kept) < 90


def test_very_large_group_of_near_copies(spark):
    rng = np.random.default_rng(9)
    base = [f"w{x}" for x in rng.integers(0, 5000, 120)]
    rows = []
    for i in range(5000):
        own = list(base)
        own[int(rng.integers(0, 120))] = f"changed{i}"
        rows.append((i, " ".join(own)))
    assert [r.doc_id for r in simhash.first_of_each(spark.createDataFrame(rows, "doc_id long, text string")).collect()] == [0]


def shingle_set(text):
    words = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def pairs_by_similarity(n, seed, bands):
    """Pairs of texts, each of its own words, in which enough words are changed for a similarity inside its band."""
    rng = np.random.default_rng(seed)
    rows, pairs = [], []
    for low, high in bands:
        for _ in range(n):
            words = [f"w{x}" for x in rng.integers(0, 1 << 40, 200)]
            own = list(words)
            for at in rng.permutation(200):
                own[at] = f"changed{at}"
                value = jaccard(shingle_set(" ".join(words)), shingle_set(" ".join(own)))
                if value < high:
                    break
            if value < low:
                continue
            pairs.append((len(rows), len(rows) + 1, low))
            rows += [(len(rows), " ".join(words)), (len(rows) + 1, " ".join(own))]
    return rows, pairs


def test_recall_of_similar_texts_by_band_and_no_false_link(spark):
    bands = {0.8: 0.97, 0.84: 0.98, 0.88: 0.99, 0.92: 0.99}
    wide = [(0.7, 0.75), (0.75, 0.8), (0.8, 0.84), (0.84, 0.88), (0.88, 0.92), (0.92, 1.0)]
    rows, pairs = pairs_by_similarity(150, 21, wide)
    sets = [shingle_set(t) for _, t in rows]
    roots = {r.doc_id: r.root for r in simhash.similar_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    found = defaultdict(list)
    for a, b, low in pairs:
        alike = jaccard(sets[a], sets[b]) >= 0.8
        assert alike == (low >= 0.8)
        found[low].append(roots[a] == roots[b])
    assert all(len(v) > 100 for v in found.values())
    print({low: (sum(v), len(v)) for low, v in found.items()})
    assert not any(found[0.7]) and not any(found[0.75])
    for low, least in bands.items():
        assert np.mean(found[low]) >= least - 0.03


def test_large_group_against_jaccard(spark, monkeypatch):
    rng = np.random.default_rng(3)
    monkeypatch.setattr(simhash, "BLOCK_ROWS", 3000)
    base = [f"w{x}" for x in rng.integers(0, 5000, 300)]
    rows = [(1000, "a b c"), (1001, "A b  c"), (1002, None), (1003, ""), (1004, "x y x y x y x y x y x y"), (1005, "x y x y x y x y")]
    for i in range(120):
        own = list(base)
        for at in rng.choice(300, rng.integers(0, 4), replace=False):
            own[at] = f"changed{i}"
        rows.append((i, " ".join(own)))
    sets = [shingle_set(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if jaccard(sets[i], sets[j]) >= 0.8:
                parent[find(i)] = find(j)
    got = {r.doc_id: r.root for r in simhash.similar_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i in range(len(rows)):
        for j in range(i):
            assert (got[rows[i][0]] == got[rows[j][0]]) == (find(i) == find(j))


def test_candidates_of_a_group_of_half_alike_texts_do_not_grow_with_its_square(spark, monkeypatch):
    rng = np.random.default_rng(4)
    base = [f"w{x}" for x in rng.integers(0, 1 << 40, 300)]
    rows = []
    for i in range(240):
        own = list(base)
        for at in rng.choice(300, 10, replace=False):
            own[at] = f"changed{i}"
        rows.append((i, " ".join(own)))
    made, stored = [], simhash.stored

    def counted(df, name):
        table, path = stored(df, name)
        if name == "candidates":
            made.append(table.count())
        return table, path

    monkeypatch.setattr(simhash, "stored", counted)
    kept = {str(r.doc_id) for r in simhash.first_of_each(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert kept == similar(rows)
    assert sum(made) < 10 * len(rows)


def test_pairs_just_below_the_threshold_are_not_written_one_by_one(spark, monkeypatch):
    rng = np.random.default_rng(12)
    base = [f"w{x}" for x in rng.integers(0, 1 << 40, 300)]
    rows = []
    for i in range(480):
        own = list(base)
        for at in rng.choice(300, 4, replace=False):
            own[at] = f"changed{i}"
        rows.append((i, " ".join(own)))
    made, stored = [], simhash.stored

    def counted(df, name):
        table, path = stored(df, name)
        if name in ("candidates", "links"):
            made.append(table.count())
        return table, path

    monkeypatch.setattr(simhash, "stored", counted)
    kept = {str(r.doc_id) for r in simhash.first_of_each(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert kept == similar(rows)
    print(made)
    assert sum(made) < 60 * len(rows)


def test_blocks_of_a_large_root_and_of_the_rest_find_all_links(spark, monkeypatch):
    rng = np.random.default_rng(13)
    monkeypatch.setattr(simhash, "TILE_SHINGLES", 3000)
    monkeypatch.setattr(simhash, "FIRST_CANDIDATES", 1)
    base = [f"w{x}" for x in rng.integers(0, 1 << 40, 300)]
    rows = []
    for i in range(150):
        own = list(base)
        for at in rng.choice(300, 1 if i < 60 else 4, replace=False):
            own[at] = f"changed{i}"
        rows.append((i, " ".join(own)))
    kept = {str(r.doc_id) for r in simhash.first_of_each(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert kept == similar(rows)


def test_fingerprints_by_planes_are_majorities():
    rng = np.random.default_rng(6)
    number = np.array([0, 1, 2, 3, 7, 0, 500, 33])
    hashes = rng.integers(0, 1 << 63, number.sum(), dtype=np.uint64)
    salts = simhash.tx.mixed(np.arange(1, simhash.SIMILAR_PRINTS + 1))
    wanted = [simhash._majority(simhash.tx.mixed(hashes ^ salt), number).view(np.uint64) for salt in salts]
    assert (simhash._majorities(hashes, number) == np.stack(wanted, axis=1)).all()

"""SimHash near-dedup with deletion-variant signatures.

Fingerprints of 64 bits link at three or fewer differing bits. Cut into two halves, one half then differs by at most one
bit. For each half and each of its bits a variant is indexed in which that bit is a wildcard: 64 rows for each distinct
fingerprint. Linked fingerprints meet in a variant by equality; whole fingerprints are compared there.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from evidora.llm import text as tx
from evidora.llm.components import components, remove, stored, united

SHINGLE = 3
SEED = 42
MOST_BITS = 3
PIECE_BYTES = 2 << 20
#: Rows of variants that a task looks at together; a longer run of one variant is taken whole.
BLOCK_ROWS = 1 << 18
#: A variant of more fingerprints is searched by probing all patterns of differing bits instead of by pairs; same links.
PROBE_FROM = 1024


def _shingles(array: pa.Array, shingle: int, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the shingles of all texts, one text after the other, and how many each text has."""
    words = tx.words_of(array)
    joined = words.joined.copy()
    upper = (joined >= 65) & (joined <= 90)
    joined[upper] += 32
    counts = np.diff(words.first)
    number = np.where(counts >= shingle, counts - shingle + 1, np.minimum(counts, 1))
    begin = tx.ranges(words.first[:-1], number)
    length = np.repeat(np.minimum(counts, shingle), number)
    data, digest = joined.tobytes(), xxhash.xxh64_intdigest
    spans = zip(words.starts[begin].tolist(), (words.starts[begin + length] - 1).tolist(), strict=True)
    return np.fromiter((digest(data[a:b], seed) for a, b in spans), np.uint64, len(begin)), number


def _majority(hashes: np.ndarray, number: np.ndarray) -> np.ndarray:
    """The bits that most of each text's hashes have; 0 for texts without any."""
    bits = np.unpackbits(hashes.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
    ends = np.cumsum(number)
    out = np.zeros((len(number), 64), np.uint8)
    for i, (end, n) in enumerate(zip(ends.tolist(), number.tolist(), strict=True)):
        if n:
            out[i] = bits[end - n : end].sum(axis=0, dtype=np.int64) * 2 > n
    return np.packbits(out, axis=1).view(">u8").astype(np.int64).ravel()


def _fingerprint_rows(batches: Iterator[pa.RecordBatch], shingle: int) -> Iterator[pa.RecordBatch]:
    for batch in tx.text_pieces(batches, "text", PIECE_BYTES):
        prints = _majority(*_shingles(batch.column("text"), shingle))
        columns = [batch.column("doc_id"), batch.column("copy"), pa.array(prints)]
        yield pa.RecordBatch.from_arrays(columns, ["doc_id", "copy", "fp"])


def fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """`doc_id` (long), `copy` (hash of the text) and `fp` (long, the 64 bits) of every row; texts without words get 0."""
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.xxhash64(F.col(text_col).cast("string")).alias("copy"),
        tx.closed_text(F.col(text_col)).alias("text"),
    )
    return rows.mapInArrow(lambda batches: _fingerprint_rows(batches, shingle), "doc_id long, copy long, fp long")


def near_copies(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE
) -> DataFrame:
    """`doc_id`, `copy`, `fp`, `root` (a fingerprint that names the component) and `component_id` (smallest id reachable by
    links), one row per input row.

    Texts are compared with A-Z in lower case by shingles of `shingle` words, repeats included; shorter texts are one
    shingle. Null and empty texts have fingerprint zero and link like any other. Equal fingerprints are one node, however
    many documents have it. Rows with a null id take part in links but are never a component's id: a component of such rows
    alone has a null `component_id`. Repeated rows get the same result. An empty table gives an empty result. Columns
    besides id and text are not looked at.
    """
    prints, _ = stored(fingerprints(docs, id_col=id_col, text_col=text_col, shingle=shingle), "fingerprints")
    groups = prints.groupBy("fp").agg(F.min("doc_id").alias("smallest"))
    roots = components(_links(groups.select("fp")))
    classes = groups.join(roots, groups.fp == roots.node, "left").select(
        "fp", "smallest", F.coalesce("root", "fp").alias("root")
    )
    ids = classes.groupBy("root").agg(F.min("smallest").alias("component_id"))
    members = classes.join(ids, "root").select("fp", "root", "component_id")
    return prints.join(members, "fp").select("doc_id", "copy", "fp", "root", "component_id")


#: Similar texts: words of a shingle, least Jaccard similarity of the sets of shingles (a fraction), and independent fingerprints.
SIMILAR_SHINGLE, SIMILAR, SIMILAR_PRINTS = 5, (4, 5), 14
#: Small, so that the planes of a piece stay in the processor's cache.
SIMILAR_PIECE_BYTES = 128 << 10
#: Segments of 16 bits that texts meet in; those of the first search, and how many are dealt out at a time.
SEGMENTS, FIRST_SEGMENTS, DEALT_SEGMENTS = 4 * SIMILAR_PRINTS, 12, 28
#: Candidates differ in at most so many of the first 128 bits and of all 896, or of all where a set is small and its bits are
#: coarse. Texts at a Jaccard similarity of 0.8 differ in 19 of 128 (deviation 4) and 136 of 896 (deviation 11) on average, small
#: sets in up to 24 and 168; texts at 0.6 differ in 206.
FEW_BITS, SIMILAR_BITS, SMALL_BITS, SMALL = 34, 170, 200, 16
#: Candidates of a text in one segment that the first search takes.
FIRST_CANDIDATES = 4
#: Shingles of the texts in a block; two blocks are compared by one task.
TILE_SHINGLES = 1 << 20


def _shingle_sets(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes of the shingles of all texts, in order, one text after the other, and how many each text has."""
    hashes, number = _shingles(array, SIMILAR_SHINGLE)
    row = np.repeat(np.arange(len(number)), number)
    by = np.lexsort((hashes, row))
    hashes, row = hashes[by], row[by]
    new = np.ones(len(row), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (row[1:] != row[:-1])
    return hashes[new], np.bincount(row[new], minlength=len(number))


def _set_array(hashes: np.ndarray, number: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(
        pa.array(np.concatenate([[0], np.cumsum(number)]), pa.int32()), pa.array(hashes.view(np.int64))
    )


def _majorities(hashes: np.ndarray, number: np.ndarray) -> np.ndarray:
    """Fingerprints (text by print) as `_majority` has them, of the hashes mixed anew for each print; 0 for texts without any.

    The counts of all bits lie in planes, plane p with bit p of every count, and are added up in pairs of a text's hashes."""
    planes = [tx.mixed(hashes[:, None] ^ tx.mixed(np.arange(1, SIMILAR_PRINTS + 1)))]
    left = number.astype(np.int64)
    while left.max(initial=0) > 1:
        half = (left + 1) // 2
        a = 2 * tx.ranges(np.zeros(len(half), np.int64), half) + np.repeat(np.cumsum(left) - left, half)
        alone = a + 1 == np.repeat(np.cumsum(left), half)
        b = np.where(alone, a, a + 1)
        carry = np.zeros((len(a), SIMILAR_PRINTS), np.uint64)
        for p, plane in enumerate(planes):
            one, other = plane[a], plane[b]
            other[alone] = 0
            odd = one ^ other
            planes[p] = odd ^ carry
            carry = one & other | odd & carry
        planes.append(carry)
        left = half
    some = number > 0
    need = number[some] // 2
    more, same = np.zeros_like(planes[0]), ~np.zeros_like(planes[0])
    for p in reversed(range(len(planes))):
        bit = np.where(need >> p & 1, ~np.uint64(0), np.uint64(0))[:, None]
        more |= same & planes[p] & ~bit
        same &= ~(planes[p] ^ bit)
    out = np.zeros((len(number), SIMILAR_PRINTS), np.uint64)
    out[some] = more
    return out


def _similar_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in tx.text_pieces(batches, "text", SIMILAR_PIECE_BYTES):
        hashes, number = _shingle_sets(batch.column("text"))
        data, ends, digest = hashes.tobytes(), 8 * np.cumsum(number), xxhash.xxh64_intdigest
        spans = zip((ends - 8 * number).tolist(), ends.tolist(), strict=True)
        node = np.fromiter((digest(data[a:b], SEED) for a, b in spans), np.uint64, len(number)).view(np.int64)
        prints = [row.tobytes() for row in _majorities(hashes, number).astype(">u8")]
        columns = [batch.column("doc_id"), batch.column("copy"), pa.array(node), pa.array(number.astype(np.int32))]
        columns.append(pa.array(prints, pa.binary()))
        yield pa.RecordBatch.from_arrays(columns, ["doc_id", "copy", "node", "size", "prints"])


def _set_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in tx.text_pieces(batches, "text", SIMILAR_PIECE_BYTES):
        sets = _set_array(*_shingle_sets(batch.column("text")))
        yield pa.RecordBatch.from_arrays([batch.column("node"), sets], ["node", "shingles"])


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def _stored_alone(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """The table written to the shared folder; the files of the shuffles that made it go as soon as it is written."""
    conf = df.sparkSession.conf
    before = conf.get(_CLEANUP)
    conf.set(_CLEANUP, "true")
    try:
        return stored(df, name)
    finally:
        conf.set(_CLEANUP, before)


def similar_copies(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`doc_id`, `copy` and `root` (names the component) of texts whose sets of five-word shingles are alike at Jaccard 0.8.

    Many independent fingerprints of the set are cut into segments: texts with an equal segment meet there, and are close
    if few bits differ in all fingerprints and their numbers of shingles allow the similarity. Only the sets themselves, made
    again from the texts that are close to others, decide, so no link is false. Equal sets are one node. A first search takes few
    candidates of each text. A second one notes which of the components found are close, as a forest and not pair by pair;
    what hangs together so is compared by its sets in blocks of bounded size, and a task writes a forest of the links. So no
    table of pairs grows with the square of a group.

    Null and empty texts have the same, empty set. Rows with a null id are compared like others; repeated rows get the same
    result. An empty table gives an empty result. Columns besides id and text are not looked at."""
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.xxhash64(F.col(text_col).cast("string")).alias("copy"),
        tx.closed_text(F.col(text_col)).alias("text"),
    )
    made = rows.mapInArrow(_similar_rows, "doc_id long, copy long, node long, size int, prints binary")
    prints, _ = _stored_alone(made, "fingerprints")
    nodes = prints.select("node", "size", "prints").dropDuplicates(["node"]).withColumn("root", F.col("node"))
    links, path = _verified(_candidates(nodes, 0, FIRST_SEGMENTS, FIRST_CANDIDATES), prints, rows)
    known = components(links, "merge").withColumnRenamed("root", "known")
    nodes = nodes.join(known, "node", "left").withColumn("root", F.coalesce("known", "node")).drop("known")
    parts = [_candidates(nodes, at, at + DEALT_SEGMENTS, None) for at in range(0, SEGMENTS, DEALT_SEGMENTS)]
    found = [_stored_alone(part, "candidates") for part in parts]
    clouds = components(functools.reduce(DataFrame.union, (table for table, _ in found)), "merge")
    clouds = clouds.select(F.col("node").alias("root"), F.col("root").alias("cloud"))
    more, other = _verified_blocks(nodes.join(clouds, "root"), prints, rows)
    roots = components(known.select(F.col("node").alias("a"), F.col("known").alias("b")).union(more), "merge")
    for stale in (path, other, *(at for _, at in found)):
        remove(docs.sparkSession, stale)
    return prints.select("doc_id", "copy", "node").join(roots, "node", "left").select(
        "doc_id", "copy", F.coalesce("root", "node").alias("root")
    )


def _candidates(nodes: DataFrame, first: int, last: int, most: int | None) -> DataFrame:
    """Pairs `a`, `b` of nodes under different roots that are close and meet in one of these segments, at most `most` of a node
    in each. Without such a bound, a forest over the roots of all these pairs."""
    segment = F.expr("substring(prints, 2 * segment + 1, 2)")
    dealt = nodes.select(
        "node", "root", "size", "prints", F.explode(F.sequence(F.lit(first), F.lit(last - 1))).alias("segment")
    ).repartition("segment", segment)
    dealt = dealt.sortWithinPartitions("segment", segment, "root")
    pairs = dealt.mapInArrow(lambda batches: _meet_similar(batches, most), "a long, b long")
    return pairs if most is None else pairs.distinct()


def _sets(wanted: DataFrame, prints: DataFrame, rows: DataFrame) -> DataFrame:
    """`node` and `shingles` of the nodes in `wanted`, made from one text of each."""
    one = prints.join(wanted, "node", "left_semi").groupBy("node").agg(F.min(F.struct("doc_id", "copy")).alias("one"))
    one = one.select("node", "one.doc_id", "one.copy").alias("o")
    same = F.col("r.doc_id").eqNullSafe(F.col("o.doc_id")) & (F.col("r.copy") == F.col("o.copy"))
    texts = rows.alias("r").join(one, same).select("o.node", "r.text")
    return texts.mapInArrow(_set_rows, "node long, shingles array<long>").dropDuplicates(["node"])


def _verified(search: DataFrame, prints: DataFrame, rows: DataFrame) -> tuple[DataFrame, str]:
    """The pairs found whose sets of shingles are alike, and where they are stored."""
    pairs, pairs_path = _stored_alone(search, "candidates")
    wanted = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    sets, sets_path = _stored_alone(_sets(wanted, prints, rows), "shingles")
    first = sets.select(F.col("node").alias("a"), F.col("shingles").alias("one"))
    other = sets.select(F.col("node").alias("b"), F.col("shingles").alias("other"))
    share, whole = SIMILAR
    both = F.size(F.array_intersect("one", "other"))
    alike = both * whole >= (F.size("one") + F.size("other") - both) * share
    links = _stored_alone(pairs.join(first, "a").join(other, "b").where(alike).select("a", "b"), "links")
    for path in (sets_path, pairs_path):
        remove(prints.sparkSession, path)
    return links


def _verified_blocks(nodes: DataFrame, prints: DataFrame, rows: DataFrame) -> tuple[DataFrame, str]:
    """A forest `a`, `b` of the alike nodes of each cloud under different roots, and where it is stored.

    A cloud's nodes are cut into blocks: a large root has blocks of its own, which are not compared with each other; the small
    ones share blocks, whole. Each pair of blocks is a tile that one task compares, so a large root meets the rest of its cloud
    without being copied for each of its own blocks."""
    spark = prints.sparkSession
    nodes, nodes_path = _stored_alone(nodes.select("cloud", "root", "node", "size", "prints"), "clouds")
    sums = nodes.groupBy("cloud", "root").agg(F.sum("size").alias("own"))
    sums = sums.withColumn("large", F.col("own") > TILE_SHINGLES // 2)
    rest = sums.where("not large").groupBy("cloud").agg(F.sum("own").alias("rest"))
    sums = sums.join(rest.hint("merge"), "cloud", "left")
    number = (1 + F.when(F.col("large"), F.col("own")).otherwise(F.col("rest")) / TILE_SHINGLES).cast("long")
    sums = sums.select(
        "cloud", "root", "large", F.when(F.col("large"), F.col("root")).otherwise(F.col("cloud")).alias("owner"),
        number.alias("parts"),
    )
    dealt = F.xxhash64(F.when(F.col("large"), F.col("node")).otherwise(F.col("root")))
    placed = nodes.join(sums.hint("merge"), ["cloud", "root"])
    placed = placed.withColumn("block", F.struct("large", "owner", F.pmod(dealt, "parts").alias("part")))
    blocks = placed.select("cloud", "block").distinct()
    x, y = blocks.withColumnRenamed("block", "x"), blocks.withColumnRenamed("block", "y")
    met = x.join(y.hint("merge"), "cloud").where(
        "x < y and not (x.large and y.large and x.owner = y.owner) or x = y and not x.large"
    )
    sides = F.expr("if(x = y, array((x as block, 2 as side)), array((x as block, 0 as side), (y as block, 1 as side)))")
    tiles = met.select("cloud", F.xxhash64("cloud", "x", "y").alias("tile"), F.inline(sides).alias("block", "side"))
    sets, sets_path = _stored_alone(_sets(nodes.select("node"), prints, rows), "shingles")
    sent = placed.join(tiles.hint("merge"), ["cloud", "block"]).join(sets, "node")
    sent = sent.select("tile", "side", "root", "node", "size", "prints", "shingles")
    sent = sent.repartition("tile").sortWithinPartitions("tile", "root")
    links = _stored_alone(sent.mapInArrow(_meet_tiles, "a long, b long"), "links")
    for path in (nodes_path, sets_path):
        remove(spark, path)
    return links


def _meet_tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        held.append(batch)
        size += len(batch.column("shingles").flatten())
        if size < 2 * TILE_SHINGLES:
            continue
        table = pa.Table.from_batches(held)
        tile = table.column("tile").to_numpy()
        cut = int(np.argmax(tile == tile[-1]))  # the last tile may go on in the next batch
        if cut:
            yield from _tile_links(table.slice(0, cut))
        held = table.slice(cut).combine_chunks().to_batches()
        size = sum(len(b.column("shingles").flatten()) for b in held) if cut else 0
    if held:
        yield from _tile_links(pa.Table.from_batches(held))


def _tile_links(table: pa.Table) -> Iterator[pa.RecordBatch]:
    """Links of whole tiles; rows come by tile and root, and only what is under different roots by now is compared."""
    if not len(table):
        return
    tile, side, root, node, size = (table.column(c).to_numpy() for c in ("tile", "side", "root", "node", "size"))
    prints = tx.text_bytes(table.column("prints").combine_chunks())[0].reshape(-1, 8 * SIMILAR_PRINTS).view(np.uint64)
    sets = table.column("shingles").combine_chunks()
    values = sets.flatten().to_numpy().view(np.uint64)
    ends = np.cumsum(sets.value_lengths().to_numpy())
    begins = ends - sets.value_lengths().to_numpy()
    share, whole = SIMILAR
    group = np.unique(root, return_inverse=True)[1]
    parent = np.arange(group.max() + 1)
    first, last = tx.runs((np.diff(tile, prepend=tile[0]) != 0) | (np.arange(len(tile)) == 0))
    end = np.repeat(last, last - first)
    new = np.ones(len(node), bool)
    new[1:] = (tile[1:] != tile[:-1]) | (root[1:] != root[:-1])
    first, last = tx.runs(new)
    at, next_ = np.arange(len(node)), np.repeat(last, last - first)
    links: list[tuple[int, int]] = []

    def top(x: int) -> int:
        while parent[x] != x:
            x = parent[x]
        return x

    while True:
        keep = next_ < end[at]
        at, next_ = at[keep], next_[keep]
        if not len(at):
            break
        some = np.flatnonzero(((side[at] == 2) | (side[at] != side[next_])) & (parent[group[at]] != parent[group[next_]]))
        some = some[_close(size, prints, at[some], next_[some])]
        merged = False
        for a, b in zip(at[some].tolist(), next_[some].tolist(), strict=True):
            u, v = top(group[a]), top(group[b])
            if u == v:
                continue
            one, other = values[begins[a] : ends[a]], values[begins[b] : ends[b]]
            found = np.searchsorted(one, other)
            found[found == len(one)] = 0
            both = int(np.count_nonzero(one[found] == other)) if len(one) else 0
            if both * whole >= (len(one) + len(other) - both) * share:
                parent[max(u, v)] = min(u, v)
                links.append((node[a], node[b]))
                merged = True
        while merged and not np.array_equal(up := parent[parent], parent):
            parent[:] = up
        next_ = next_ + 1
    if links:
        pairs = np.array(links, np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])


def _similar_columns(batch: pa.RecordBatch) -> list[np.ndarray]:
    """Node, root, size, fingerprints and the segment with its value."""
    node, root, size, prints, segment = batch.columns
    raw = tx.text_bytes(prints)[0].reshape(-1, 8 * SIMILAR_PRINTS)
    segment = segment.to_numpy().astype(np.int64)
    value = raw.view(">u2")[np.arange(len(segment)), segment].astype(np.int64)
    return [node.to_numpy(), root.to_numpy(), size.to_numpy(), raw.view(np.uint64), segment << 16 | value]


def _meet_similar(batches: Iterator[pa.RecordBatch], most: int | None) -> Iterator[pa.RecordBatch]:
    held: list[list[np.ndarray]] = []
    size = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(_similar_columns(batch))
        size += batch.num_rows
        if size < BLOCK_ROWS // 4:
            continue
        columns = [np.concatenate(x) for x in zip(*held, strict=True)]
        cut = int(np.searchsorted(columns[-1], columns[-1][-1]))  # the last run may go on in the next batch
        if cut:
            yield from _similar_pairs([c[:cut] for c in columns], most)
        held = [[c[cut:] for c in columns]]
        size = len(columns[-1]) - cut if cut else 0
    if held:
        yield from _similar_pairs([np.concatenate(x) for x in zip(*held, strict=True)], most)


def _close(size: np.ndarray, prints: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Places of the pairs of rows a, b that may be alike."""
    share, whole = SIMILAR
    less, more = np.minimum(size[a], size[b]), np.maximum(size[a], size[b])
    some = np.flatnonzero(less * whole >= more * share)
    for first, last, bound in ((0, 2, FEW_BITS), (2, SIMILAR_PRINTS, None)):
        bits = sum(np.bitwise_count(prints[a[some], k] ^ prints[b[some], k]).astype(np.int64) for k in range(first, last))
        whole_bits = bits if not first else bits + before
        limit = np.where(less[some] < SMALL, SMALL_BITS, SIMILAR_BITS) if bound is None else bound
        keep = whole_bits <= limit
        some, before = some[keep], whole_bits[keep]
    return some


def _similar_pairs(columns: list[np.ndarray], most: int | None) -> Iterator[pa.RecordBatch]:
    """Pairs of one segment, or a forest over their roots if `most` is None; rows come by segment and root, and a row is compared
    with those behind the rows of its root."""
    node, root, size, prints, variant = columns
    named = root if most is None else node
    first, last = tx.runs(np.diff(variant, prepend=-1) != 0)
    end = np.repeat(last, last - first)
    begins = np.ones(len(node), bool)
    begins[1:] = (variant[1:] != variant[:-1]) | (root[1:] != root[:-1])
    first, last = tx.runs(begins)
    at, next_ = np.arange(len(node)), np.repeat(last, last - first)
    met = np.zeros(len(node), np.int64)
    pairs: list[np.ndarray] = []
    held = 0

    def held_pairs() -> np.ndarray:
        every = np.concatenate(pairs)
        if most is not None:
            return np.unique(every, axis=0)
        values, tops = united(every[:, 0], every[:, 1])
        return np.stack([tops, values], axis=1)[tops != values]

    def batch() -> pa.RecordBatch:
        distinct = held_pairs()
        return pa.RecordBatch.from_arrays([pa.array(distinct[:, 0]), pa.array(distinct[:, 1])], ["a", "b"])

    while True:
        keep = next_ < end[at]
        if most is not None:
            keep &= met[at] < most
        at, next_ = at[keep], next_[keep]
        if not len(at):
            break
        close = _close(size, prints, at, next_)
        if len(close):
            met[at[close]] += 1
            a, b = (named[x] for x in (at[close], next_[close]))
            pairs.append(np.stack([np.minimum(a, b), np.maximum(a, b)], axis=1))
            held += len(a)
        if held >= BLOCK_ROWS and most is None:
            pairs, held = [held_pairs()], 0
        elif held >= BLOCK_ROWS:
            yield batch()
            pairs, held = [], 0
        next_ += 1
    if pairs:
        yield batch()


def first_of_each(docs: DataFrame) -> DataFrame:
    """The row of `docs` (doc_id, text, any others) with the smallest id of each component of similar texts, null ids last.

    Of rows with the same id and text one stays; of rows with one id and different texts in a component, one by a hash."""
    classes = similar_copies(docs)
    first = classes.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "copy")).alias("first"))
    first = first.select(
        F.xxhash64("first.doc_id", "first.copy").alias("first_key"),
        F.col("first.copy").alias("first_copy"),
        F.col("first.doc_id").alias("first_id"),
    )
    copy, key, number = (tx.fresh(name, docs.columns) for name in ("own_copy", "own_key", "own_number"))
    own = docs.withColumn(copy, F.xxhash64(F.col("text").cast("string")))
    own = own.withColumn(key, F.xxhash64(F.col("doc_id").cast("long"), copy))
    same = (
        (own[key] == first.first_key)
        & (own[copy] == first.first_copy)
        & own.doc_id.cast("long").eqNullSafe(first.first_id)
    )
    numbered = Window.partitionBy(key, copy).orderBy("doc_id")
    kept = own.join(first, same, "left_semi").withColumn(number, F.row_number().over(numbered))
    return kept.where(F.col(number) == 1).select(*docs.columns)


def _links(distinct: DataFrame) -> DataFrame:
    """Spanning links `a`, `b` between distinct fingerprints that differ in at most three bits."""
    low = F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF))
    high = F.shiftrightunsigned("fp", 32)
    masked = F.expr("half & ~shiftleft(1L, wild % 32)")
    variants = (
        distinct.select("fp", F.explode(F.sequence(F.lit(0), F.lit(63))).alias("wild"))
        .select("fp", "wild", F.when(F.col("wild") < 32, low).otherwise(high).alias("half"))
        .select("fp", (F.shiftleft(F.col("wild").cast("long"), 32) + masked).alias("variant"))
    )
    dealt = variants.repartition("variant").sortWithinPartitions("variant")
    return dealt.mapInArrow(_meet, "a long, b long")


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[tuple[np.ndarray, np.ndarray]] = []
    size = 0
    for batch in batches:
        held.append((batch.column(0).to_numpy(), batch.column(1).to_numpy()))
        size += batch.num_rows
        if size < BLOCK_ROWS:
            continue
        fp, variant = (np.concatenate(x) for x in zip(*held, strict=True))
        cut = int(np.searchsorted(variant, variant[-1]))  # the last run may go on in the next batch
        if cut:
            yield from _linked(fp[:cut], variant[:cut])
        held, size = [(fp[cut:], variant[cut:])], len(fp) - cut
        if not cut:
            size = 0  # one long run: look again after as many more rows
    if held:
        yield from _linked(*(np.concatenate(x) for x in zip(*held, strict=True)))


def _linked(fp: np.ndarray, variant: np.ndarray) -> Iterator[pa.RecordBatch]:
    fp = fp.view(np.uint64)
    begins = np.ones(len(fp), bool)
    begins[1:] = variant[1:] != variant[:-1]
    first, last = tx.runs(begins)
    length = last - first
    some = (length > 1) & (length <= PROBE_FROM)
    at = tx.ranges(first[some], length[some])
    end = np.repeat(last[some], length[some])
    pairs: list[tuple[np.ndarray, np.ndarray]] = []
    step = 1
    while len(at := at[(keep := at + step < end)]):
        end = end[keep]
        a, b = fp[at], fp[at + step]
        hit = np.flatnonzero(np.bitwise_count(a ^ b) <= MOST_BITS)
        pairs.append((a[hit], b[hit]))
        step += 1
    for lo, hi in zip(first[length > PROBE_FROM], last[length > PROBE_FROM], strict=True):
        pairs += _probed(np.sort(fp[lo:hi]), int(variant[lo]) >> 32)
    if pairs:
        a, b = (np.concatenate(x) for x in zip(*pairs, strict=True))
        values, roots = united(a, b)
        linked = values != roots
        yield pa.RecordBatch.from_arrays(
            [pa.array(values[linked].view(np.int64)), pa.array(roots[linked].view(np.int64))], ["a", "b"]
        )


def _probed(fp: np.ndarray, wild: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Links of one variant, by asking for each fingerprint with each pattern of bits flipped: linear in the rows."""
    free = [np.uint64(1 << k) for k in (range(32, 64) if wild < 32 else range(32))]
    own = np.uint64(1 << wild)
    out: list[tuple[np.ndarray, np.ndarray]] = []
    held = 0
    for n in range(MOST_BITS + 1):
        for bits in combinations(free, n):
            flip = np.bitwise_xor.reduce(np.array(bits, np.uint64)) if bits else np.uint64(0)
            for mask in (flip, flip ^ own) if n < MOST_BITS else (flip,):
                if not mask:
                    continue
                wanted = fp ^ mask
                at = np.minimum(np.searchsorted(fp, wanted), len(fp) - 1)
                hit = (fp[at] == wanted) & (fp < wanted)
                if hit.any():
                    out.append((fp[hit], wanted[hit]))
                    held += int(hit.sum())
        if held > 4 * len(fp):
            out = [united(*(np.concatenate(x) for x in zip(*out, strict=True)))]
            held = len(out[0][0])
    return out


def op4_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints and components of all documents."""
    result = near_copies(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    hexadecimal = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return result.select("doc_id", hexadecimal.alias("fingerprint"), "component_id")

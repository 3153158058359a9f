"""Removal of repeated byte strings by suffix arrays built with the difference cover of period three.

A window is `LENGTH` consecutive bytes of one text. Its minimiser is the smallest hash among its `GRAM`-byte strings, the leftmost
of equals. Consecutive windows with one minimiser make a context: the bytes they cover. Equal windows have equal minimisers, so
only contexts with one minimiser can hold them. Contexts are counted first: equal ones are one, and where a minimiser has a
single context, its count says whether its windows repeat. Of minimisers with several different contexts one copy of each
context goes to the minimiser's bucket. There a suffix array of the bucket's text is built: sort the sampled triples, recurse
on their names, merge the remaining suffixes; neighbours in the array that agree in `LENGTH` bytes are repeats.

Windows on the border of a passage that very many texts share differ in all of them, but would share its minimisers. Strings that
many texts of a sample hold therefore rank last, and such windows go by the bytes beside the passage. The sample decides
where windows meet, never which are equal.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidora.llm import text as tx
from evidora.llm.components import stored

LENGTH = 400
GRAM = 64
#: Bytes of contexts in a bucket; a suffix array takes about a hundred times as much memory.
BUCKET_BYTES = 1 << 20
#: Share of texts looked at to find common strings, the share of those that makes a string common, and how many are kept.
SAMPLE, COMMON, COMMON_MOST = 1 / 32, 1 / 500, 1 << 18
#: Texts of the sample that a task looks at.
SAMPLE_TASK = 256

_COMMON = np.uint64(1 << 63)
_POSITION = np.uint64(0xFFFFFFFF)


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("copy"), text.alias("text"))


def _gram_hashes(raw: np.ndarray) -> np.ndarray:
    at = np.arange(max(0, len(raw) - GRAM + 1))
    return tx.range_hashes(raw.astype(np.uint64) + np.uint64(1), at, at + GRAM, tx._BYTES)


def _smallest(values: np.ndarray, width: int) -> np.ndarray:
    """The smallest of each `width` neighbouring values."""
    out, span = values, 1
    while span * 2 <= width:
        out = np.minimum(out[:-span], out[span:])
        span *= 2
    rest = width - span
    return np.minimum(out[: len(out) - rest], out[rest:]) if rest else out


def _common_strings(rows: DataFrame, length: int) -> np.ndarray:
    """Hashes of strings that many texts of a sample hold, of the positions that some window could choose."""
    sample = rows.sample(SAMPLE, seed=7).select("text")

    def held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tx.text_pieces(batches, "text", tx.CHUNK_BYTES // 2):
            raw, offsets = tx.text_bytes(batch.column("text"))
            hashes = _gram_hashes(raw)
            doc = np.searchsorted(offsets, np.arange(len(hashes)), side="right") - 1
            inside = np.arange(len(hashes)) + GRAM <= offsets[1:][doc] if len(hashes) else np.zeros(0, bool)
            hashes, doc = hashes[inside], doc[inside]
            by = np.lexsort((doc, hashes))
            hashes, doc = hashes[by], doc[by]
            first = np.ones(len(hashes), bool)
            first[1:] = (hashes[1:] != hashes[:-1]) | (doc[1:] != doc[:-1])
            value, count = np.unique(hashes[first], return_counts=True)
            # A string held once in the piece and common nonetheless would need as many pieces as texts.
            keep = count > 1 if batch.num_rows > 8 else slice(None)
            yield pa.RecordBatch.from_arrays(
                [pa.array(value[keep].view(np.int64)), pa.array(count[keep].astype(np.int64))], ["gram", "n"]
            )

    total = sample.count()
    # Few tasks with many texts each: only what several of their texts hold is sent on.
    counted = sample.coalesce(1 + total // SAMPLE_TASK).mapInArrow(held, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))
    common = counted.where(F.col("n") >= max(4, int(total * COMMON))).orderBy(F.desc("n"), "gram").limit(COMMON_MOST)
    found = np.array([r.gram for r in common.select("gram").toLocalIterator()], dtype=np.int64)
    return np.sort(found.view(np.uint64))


def _contexts(batches: Iterator[pa.RecordBatch], length: int, common: np.ndarray) -> Iterator[pa.RecordBatch]:
    """One row per context: where it begins, how many windows it has, hashes of its minimiser and of its bytes."""
    for batch in tx.text_pieces(batches, "text"):
        raw, offsets = tx.text_bytes(batch.column("text"))
        sizes = np.diff(offsets)
        windows = np.maximum(sizes - length + 1, 0)
        at = tx.ranges(offsets[:-1], windows)
        if not len(at):
            continue
        hashes = _gram_hashes(raw)
        rank = hashes >> np.uint64(1)
        if len(common):
            rank[common[np.minimum(np.searchsorted(common, hashes), len(common) - 1)] == hashes] |= _COMMON
        rank = (rank & ~_POSITION) | np.arange(len(rank), dtype=np.uint64)
        chosen = (_smallest(rank, length - GRAM + 1)[at] & _POSITION).astype(np.int64)
        del rank
        first, last = tx.runs(np.diff(chosen, prepend=-1) != 0)
        begin, end = at[first], at[last - 1] + length
        doc = np.repeat(np.arange(len(sizes)), windows)[first]
        whole = tx.range_hashes(tx.mixed(raw.astype(np.uint64) + np.uint64(7)), begin, end)
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("doc_id").take(pa.array(doc)),
                batch.column("copy").take(pa.array(doc)),
                pa.array(begin - offsets[doc]),
                pa.array(end - begin),
                pa.array(hashes[chosen[first]].view(np.int64)),
                pa.array(whole.view(np.int64)),
            ],
            ["doc_id", "copy", "begin", "size", "gram", "context"],
        )


def _cut(batches: Iterator[pa.RecordBatch], buckets: int) -> Iterator[pa.RecordBatch]:
    """The bytes of the listed contexts, packed by bucket of their minimiser."""
    pack = zstandard.ZstdCompressor(level=3).compress
    for batch in tx.text_pieces(batches, "text"):
        raw, offsets = tx.text_bytes(batch.column("text"))
        lists = batch.column("wanted")
        flat, owner = lists.flatten(), pa.compute.list_parent_indices(lists).to_numpy(zero_copy_only=False)
        begin, size, gram, context = (
            flat.field(name).to_numpy(zero_copy_only=False) for name in ("begin", "size", "gram", "context")
        )
        target = (tx.mixed(gram.view(np.uint64)) % np.uint64(buckets)).astype(np.int64)
        by = np.argsort(target, kind="stable")
        rows = []
        for lo, hi in zip(*tx.runs(np.diff(target[by], prepend=-1) != 0), strict=True) if len(by) else ():
            own = by[lo:hi]
            meta = np.column_stack([gram[own], context[own], size[own]])
            data = raw[tx.ranges(begin[own] + offsets[owner[own]], size[own])]
            rows.append((int(target[own[0]]), pack(meta.tobytes()), pack(data.tobytes())))
        for lo in range(0, len(rows), 64):
            some = list(zip(*rows[lo : lo + 64], strict=True))
            kinds = (pa.int32(), pa.binary(), pa.binary())
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(c), kind) for c, kind in zip(some, kinds, strict=True)], ["bucket", "meta", "bytes"]
            )


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Start positions of all suffixes of a sequence of positive numbers, in order.

    Triples at positions that are not multiples of three are sorted and named. Where names repeat, the string of the names is
    sorted by the same way. The other suffixes follow from their first number and the rank of the next suffix, and are merged
    in by counting the sampled suffixes before them.
    """
    n = len(text)
    if n < 3:
        return np.array(sorted(range(n), key=lambda i: text[i:].tolist()), np.int64)
    s = np.concatenate([text.astype(np.int64), np.zeros(3, np.int64)])
    top = int(s.max()) + 1
    ones = np.arange(1, n + (n % 3 == 1), 3)  # with one place behind the end, if that closes the last triple
    twos = np.arange(2, n, 3)
    sampled = np.concatenate([ones, twos])
    if top < 1 << 20:
        key = (s[sampled] * top + s[sampled + 1]) * top + s[sampled + 2]
        order = np.argsort(key, kind="stable")
        new = np.diff(key[order], prepend=-1) != 0
    else:
        order = np.lexsort((s[sampled + 2], s[sampled + 1], s[sampled]))
        triples = np.stack([s[sampled + d] for d in range(3)])[:, order]
        new = np.ones(len(order), bool)
        new[1:] = (triples[:, 1:] != triples[:, :-1]).any(axis=0)
    names = np.empty(len(sampled), np.int64)
    names[order] = np.cumsum(new)
    if not new.all():
        order = suffix_array(names)
    rank = np.zeros(n + 4, np.int64)
    rank[sampled[order]] = np.arange(1, len(order) + 1)
    ordered = sampled[order]
    ordered = ordered[ordered < n]

    others = np.arange(0, n, 3)
    wide = np.int64(len(sampled) + 2)
    others = others[np.argsort(s[others] * wide + rank[others + 1], kind="stable")]
    is_one = ordered % 3 == 1
    first, second = ordered[is_one], ordered[~is_one]
    before = np.searchsorted(s[first] * wide + rank[first + 1], s[others] * wide + rank[others + 1])
    pair = _ranked_pairs(s, top)
    before += np.searchsorted(pair(second) * wide + rank[second + 2], pair(others) * wide + rank[others + 2])
    out = np.empty(n, np.int64)
    place = np.arange(len(others)) + before
    out[place] = others
    rest = np.ones(n, bool)
    rest[place] = False
    out[rest] = ordered
    return out


def _ranked_pairs(s: np.ndarray, top: int):
    """A number for each position that orders as the two values there."""
    if top < 1 << 20:
        return lambda at: s[at] * top + s[at + 1]
    both = s[:-1] * np.int64(top) + s[1:]
    ranks = np.unique(both, return_inverse=True)[1].astype(np.int64)
    return lambda at: ranks[at]


def _agree(data: np.ndarray, a: np.ndarray, b: np.ndarray, length: int) -> np.ndarray:
    """Which strings of the length at a and b are equal, by their bytes."""
    hashed = tx.range_hashes(tx.mixed(data.astype(np.uint64) + np.uint64(3)), *_both(a, length))
    same = hashed == tx.range_hashes(tx.mixed(data.astype(np.uint64) + np.uint64(3)), *_both(b, length))
    at = np.flatnonzero(same)
    step = np.arange(length)
    for lo in range(0, len(at), 16384):
        some = at[lo : lo + 16384]
        same[some] = (data[a[some, None] + step] == data[b[some, None] + step]).all(axis=1)
    return same


def _both(at: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    return at, at + length


def _repeated(table: pa.Table, length: int) -> pa.Table:
    """Of the contexts in a bucket, the ranges of bytes covered by windows that some other place holds too."""
    unpack = zstandard.ZstdDecompressor().decompress
    meta = np.concatenate(
        [np.frombuffer(unpack(m), np.int64).reshape(-1, 3) for m in table.column("meta").to_pylist()]
    )
    data = np.frombuffer(b"".join(unpack(b) for b in table.column("bytes").to_pylist()), np.uint8)
    sizes = meta[:, 2]
    ends = np.cumsum(sizes)
    # One place more behind each context keeps strings from going on in the next.
    owner = np.repeat(np.arange(len(sizes)), sizes + 1)
    text = np.ones(len(data) + len(sizes), np.int64)
    inside = np.ones(len(text), bool)
    inside[ends + np.arange(len(sizes))] = False
    text[inside] = data.astype(np.int64) + 2
    stop = (ends + np.arange(len(sizes)))[owner]
    order = suffix_array(text)
    order = order[order + length <= stop[order]]
    same = _agree(text, order[:-1], order[1:], length) if len(order) > 1 else np.zeros(0, bool)
    hit = np.zeros(len(text), bool)
    hit[order[:-1][same]] = True
    hit[order[1:][same]] = True
    at = np.flatnonzero(hit)
    begins = np.ones(len(at), bool)
    begins[1:] = (owner[at[1:]] != owner[at[:-1]]) | (at[1:] > at[:-1] + length)
    a, b = tx.runs(begins) if len(at) else (np.zeros(0, np.int64),) * 2
    of = owner[at[a]]
    base = ends[of] - sizes[of] + of
    return pa.table(
        {
            "gram": meta[of, 0],
            "context": meta[of, 1],
            "start": at[a] - base,
            "end": at[b - 1] + length - base,
        }
    )


def _keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in tx.text_pieces(batches, "text"):
        raw, offsets = tx.text_bytes(batch.column("text"))
        lists = batch.column("found")
        flat, owner = lists.flatten(), pa.compute.list_parent_indices(lists).to_numpy(zero_copy_only=False)
        step = np.zeros(len(raw) + 1, np.int64)
        np.add.at(step, flat.field("start").to_numpy(zero_copy_only=False) + offsets[owner], 1)
        np.add.at(step, flat.field("end").to_numpy(zero_copy_only=False) + offsets[owner], -1)
        gone = np.cumsum(step)[:-1] > 0
        doc = np.repeat(np.arange(batch.num_rows), np.diff(offsets))
        edge = np.ones(len(gone), bool)
        edge[1:] = (gone[1:] != gone[:-1]) | (doc[1:] != doc[:-1])
        a, b = tx.runs(edge) if len(gone) else (np.zeros(0, np.int64),) * 2
        a, b = a[gone[a]], b[gone[a]]
        spans = pa.StructArray.from_arrays([pa.array(a - offsets[doc[a]]), pa.array(b - offsets[doc[a]])], ["start", "end"])
        ends = np.concatenate([[0], np.cumsum(np.bincount(doc[a], minlength=batch.num_rows))])
        left = np.concatenate([[0], np.cumsum(np.bincount(doc[~gone], minlength=batch.num_rows))])
        kept = pa.LargeBinaryArray.from_buffers(
            pa.large_binary(),
            batch.num_rows,
            [None, pa.py_buffer(left.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(raw[~gone]))],
        )
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("doc_id"),
                pa.array(np.diff(offsets)),
                pa.array(np.bincount(doc[gone], minlength=batch.num_rows)),
                pa.ListArray.from_arrays(pa.array(ends, pa.int32()), spans),
                kept.cast(pa.binary()),
            ],
            ["doc_id", "n_bytes", "n_removed", "removed", "kept"],
        )


def repeats_removed(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH
) -> DataFrame:
    """Remove every byte covered by a string of `length` bytes that starts anywhere else too, in the same text or another.

    Returns `doc_id` (long), `n_bytes`, `n_removed`, `removed` (array of byte ranges `{start, end}`, end exclusive, not touching
    each other) and `kept` (binary: what is left; it may cut characters), one row per input row.

    Null and empty texts have no bytes; shorter texts than `length` keep all. Rows with a null id and rows that repeat an id or
    a whole row are texts of their own: two rows with one text of at least `length` bytes lose all of it. An empty table gives
    an empty result. Columns besides id and text are not looked at. `length` must be greater than `GRAM`.
    """
    rows = _texts(docs, id_col, text_col)
    common = _common_strings(rows, length)
    schema = "doc_id long, copy long, begin long, size long, gram long, context long"
    placed, _ = stored(rows.mapInArrow(lambda batches: _contexts(batches, length, common), schema), "contexts")
    kinds = placed.groupBy("gram", "context").agg(
        F.count("*").alias("n"), F.min(F.struct("doc_id", "copy", "begin", "size")).alias("one")
    )
    kinds, _ = stored(kinds, "kinds")
    several = kinds.groupBy("gram").agg(F.count("*").alias("kinds")).where("kinds > 1").select("gram")
    mixed, _ = stored(kinds.join(several, "gram", "left_semi").select("gram", "context", "one.*"), "mixed")
    total = mixed.agg(F.sum("size")).first()[0] or 0
    buckets = 1 + total // BUCKET_BYTES
    wanted = mixed.groupBy("doc_id", "copy").agg(F.collect_set(F.struct("begin", "size", "gram", "context")).alias("wanted"))
    # One row of each text that is asked for; rows may repeat.
    asked = rows.alias("r").join(wanted.alias("w"), _same_text("w")).select("r.doc_id", "r.copy", "r.text", "w.wanted")
    sent = asked.mapInArrow(lambda batches: _cut(batches, buckets), "bucket int, meta binary, bytes binary")
    found = sent.groupBy("bucket").applyInArrow(
        lambda table: _repeated(table, length), "gram long, context long, start long, end long"
    )
    whole = kinds.where("n > 1").select("gram", "context", F.lit(0).cast("long").alias("start"), F.col("one.size").alias("end"))
    parts, _ = stored(
        found.union(whole).groupBy("gram", "context").agg(F.collect_set(F.struct("start", "end")).alias("parts")), "parts"
    )
    hits = placed.join(parts, ["gram", "context"])
    moved = F.transform("parts", lambda x: F.struct((x["start"] + F.col("begin")).alias("start"), (x["end"] + F.col("begin")).alias("end")))
    per_doc = hits.groupBy("doc_id", "copy").agg(F.flatten(F.collect_list(moved)).alias("found"))
    joined = rows.alias("r").join(per_doc.alias("w"), _same_text("w"), "left").select("r.doc_id", "r.text", "w.found")
    return joined.mapInArrow(
        _keep, "doc_id long, n_bytes long, n_removed long, removed array<struct<start: long, end: long>>, kept binary"
    )


def _same_text(other: str):
    return F.col("r.doc_id").eqNullSafe(F.col(f"{other}.doc_id")) & (F.col("r.copy") == F.col(f"{other}.copy"))


def op13_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digest of the removal of repeated 400-byte strings from all documents."""
    result = repeats_removed(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return result.select(
        "doc_id",
        "n_bytes",
        "n_removed",
        F.size("removed").cast("long").alias("n_spans"),
        F.sha2(F.col("kept"), 256).alias("kept_sha256"),
    )


OP13_SQL = """
WITH docs AS (
  SELECT row_number() OVER () AS d, doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents
), windows AS (
  SELECT d, i, md5(substr(x, 2 * i + 1, 800)) AS h
  FROM (SELECT d, x, unnest(range(0, len(x) // 2 - 399)) AS i FROM docs WHERE len(x) >= 800)
), again AS (
  SELECT d, i FROM windows QUALIFY count(*) OVER (PARTITION BY h) > 1
), marked AS (
  SELECT d, i, CASE WHEN i <= lag(i) OVER (PARTITION BY d ORDER BY i) + 400 THEN 0 ELSE 1 END AS new FROM again
), numbered AS (
  SELECT d, i, sum(new) OVER (PARTITION BY d ORDER BY i) AS span FROM marked
), spans AS (
  SELECT d, span, min(i) AS a, max(i) + 400 AS b FROM numbered GROUP BY d, span
), before AS (
  SELECT d, a, b, coalesce(lag(b) OVER (PARTITION BY d ORDER BY a), 0) AS z FROM spans
), joined AS (
  SELECT s.d, count(*) AS n_spans, sum(b - a) AS n_removed, max(b) AS last,
    string_agg(substr(x, 2 * z + 1, 2 * (a - z)), '' ORDER BY a) AS kept
  FROM before s JOIN docs USING (d) GROUP BY s.d
)
SELECT doc_id, CAST(len(x) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed,
  CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans,
  sha256(from_hex(CASE WHEN j.d IS NULL THEN x ELSE kept || substr(x, 2 * last + 1) END)) AS kept_sha256
FROM docs LEFT JOIN joined j USING (d)
"""

"""Substring dedup by super-k-mers.

A window is `window` consecutive words of one document. Its minimiser is the smallest hash among its runs of `seed`
words. Consecutive windows with the same minimiser travel as one packed string to the minimiser's bucket. A bucket holds
every copy of each of its windows, so sorting its windows shows which of them start earlier elsewhere.

Before a task sends anything it collapses equal windows of its own piece of the corpus: only the earliest is sent, so a
passage that a third of the documents share reaches its bucket once per piece. Windows on the border of such a passage all
differ but would share its minimisers; runs of words that many documents of a sample hold therefore rank last as
minimisers, and border windows go by the words beside the passage. The sample decides where windows meet, never which
are equal: windows with the same words have the same minimiser whatever the ranks are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidora.llm import text as tx

WINDOW = 20
SEED = 3
#: Bytes of text whose equal windows are collapsed before anything is sent.
PIECE_BYTES = 4 << 20
#: Share of documents looked at to find common runs, the share of those that makes a run common, and how many are kept.
SAMPLE, COMMON, COMMON_MOST = 1 / 32, 1 / 500, 1 << 18
#: Buckets for each shuffle partition, so that one bucket is a small part of a task's memory.
BUCKETS = 4

_TOP = np.uint64(1 << 63)


def substring_dedup(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    window: int = WINDOW,
    seed: int = SEED,
    buckets: int | None = None,
) -> DataFrame:
    """Remove words covered by a window that also starts earlier, in a smaller id or before in the same document.

    Returns `doc_id` (long), `n_words`, `n_removed`, `removed` (array of word ranges `{start, end}`, end exclusive, not
    touching each other) and `kept_text` (kept words joined by one blank), one row per input row.

    Null and empty texts have no words. Rows with a null id count as one smallest id. Rows with the same id and text are
    one document and get the same result; rows with the same id and different texts are different documents, ordered by a
    hash of the text. An empty table gives an empty result. Columns besides id and text are not looked at.
    """
    spark = docs.sparkSession
    buckets = buckets or BUCKETS * int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.xxhash64(F.col(text_col).cast("string")).alias("copy"),
        tx.closed_text(F.col(text_col)).alias("text"),
    )
    common = _common_runs(rows, seed)
    sent = rows.mapInArrow(
        lambda batches: _send(batches, window, seed, buckets, common), "bucket int, meta binary, words binary"
    )
    found = sent.groupBy("bucket").applyInArrow(
        lambda table: _settle(table, window), "doc_id long, copy long, start long, end long"
    )
    per_doc = found.groupBy("doc_id", "copy").agg(F.collect_list(F.struct("start", "end")).alias("found"))
    joined = rows.alias("r").join(
        per_doc.alias("f"),
        F.col("r.doc_id").eqNullSafe(F.col("f.doc_id")) & (F.col("r.copy") == F.col("f.copy")),
        "left",
    )
    return joined.select("r.doc_id", "r.text", "f.found").mapInArrow(
        _keep,
        "doc_id long, n_words long, n_removed long, removed array<struct<start: long, end: long>>, kept_text string",
    )


def _common_runs(rows: DataFrame, seed: int) -> np.ndarray:
    """Hashes of word runs that many documents of a sample hold; at most COMMON_MOST of them."""
    sample = rows.sample(SAMPLE, seed=7).select("text")

    def held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tx.text_pieces(batches, "text"):
            words = tx.words_of(batch.column(0))
            hashes, doc = _seed_hashes(words, seed)
            if not len(hashes):
                continue
            pairs = np.unique(np.stack([hashes, doc.astype(np.uint64)], axis=1), axis=0)[:, 0]
            value, count = np.unique(pairs, return_counts=True)
            # A run held once in the piece and common nonetheless would need as many pieces as documents.
            keep = count > 1 if batch.num_rows > 64 else slice(None)
            yield pa.RecordBatch.from_arrays(
                [pa.array(value[keep].view(np.int64)), pa.array(count[keep].astype(np.int64))], ["run", "n"]
            )

    total = sample.count()
    counted = sample.mapInArrow(held, "run long, n long").groupBy("run").agg(F.sum("n").alias("n"))
    common = (
        counted.where(F.col("n") >= max(4, int(total * COMMON))).orderBy(F.desc("n"), "run").limit(COMMON_MOST)
    )
    found = np.array([r.run for r in common.select("run").toLocalIterator()], dtype=np.int64)
    return np.sort(found.view(np.uint64))


def _seed_hashes(words: tx.Words, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each run of `seed` words inside a document, and its document."""
    codes, vocabulary = words.codes()
    hashes = tx.value_hashes(vocabulary)[codes] if len(codes) else np.empty(0, np.uint64)
    doc = np.repeat(np.arange(len(words.first) - 1), np.diff(words.first))
    inside = np.arange(len(hashes)) + seed <= words.first[1:][doc] if len(hashes) else np.empty(0, bool)
    at = np.flatnonzero(inside)
    return tx.range_hashes(hashes, at, at + seed), doc[at]


def _sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    out, span = values, 1
    while span * 2 <= width:
        out = np.minimum(out[:-span], out[span:])
        span *= 2
    rest = width - span
    return np.minimum(out[: len(out) - rest], out[rest:]) if rest else out


def _first_equal(hashes: np.ndarray, codes: np.ndarray, at: np.ndarray, window: int) -> np.ndarray:
    """For each window (in order of preference) the index of the first window with the same words."""
    order = np.argsort(hashes, kind="stable")
    ordered = hashes[order]
    new = np.ones(len(order), bool)
    new[1:] = ordered[1:] != ordered[:-1]
    first = np.empty(len(order), np.int64)
    first[order] = order[np.flatnonzero(new)[np.cumsum(new) - 1]] if len(order) else 0
    later = np.flatnonzero(first != np.arange(len(first)))
    same = np.ones(len(later), bool)
    for step in range(window):
        same &= codes[at[later] + step] == codes[at[first[later]] + step]
    for clash in np.unique(hashes[later[~same]]):  # equal hashes of different words: by the words themselves
        seen: dict[bytes, int] = {}
        for i in np.flatnonzero(hashes == clash):
            first[i] = seen.setdefault(codes[at[i] : at[i] + window].tobytes(), int(i))
    return first


def _send(
    batches: Iterator[pa.RecordBatch], window: int, seed: int, buckets: int, common: np.ndarray
) -> Iterator[pa.RecordBatch]:
    """One row for each bucket and piece: packed super-k-mers, and as bucket of the document what is settled already."""
    pack = zstandard.ZstdCompressor(level=3).compress
    for batch in tx.text_pieces(batches, "text", PIECE_BYTES):
        table = pa.Table.from_batches([batch])
        known = table.column("doc_id").is_valid().to_numpy().astype(np.int64)
        doc_id = table.column("doc_id").combine_chunks().fill_null(0).to_numpy(zero_copy_only=False)
        copy = table.column("copy").combine_chunks().to_numpy(zero_copy_only=False)
        order = np.lexsort((copy, doc_id, known))
        same = np.zeros(len(order), bool)
        if len(order) > 1:
            a, b = order[1:], order[:-1]
            same[1:] = (doc_id[a] == doc_id[b]) & (copy[a] == copy[b]) & (known[a] == known[b])
        order = order[~same]
        words = tx.words_of(table.column("text").combine_chunks().take(pa.array(order)))
        doc_id, copy, known = doc_id[order], copy[order], known[order]
        counts = np.diff(words.first)
        doc = np.repeat(np.arange(len(counts)), counts)
        at = np.flatnonzero(np.arange(len(words)) + window <= words.first[1:][doc]) if len(doc) else np.empty(0, int)
        if not len(at):
            continue
        codes, vocabulary = words.codes()
        hashes = tx.value_hashes(vocabulary)[codes]
        last = np.arange(len(hashes) - seed + 1)
        seeds = tx.range_hashes(hashes, last, last + seed)
        rank = seeds >> np.uint64(1)
        if len(common):
            rank[common[np.minimum(np.searchsorted(common, seeds), len(common) - 1)] == seeds] |= _TOP
        lowest = _sliding_min(rank, window - seed + 1)[at]
        first = _first_equal(tx.range_hashes(hashes, at, at + window), codes, at, window)
        sent = first == np.arange(len(first))
        start = at - words.first[doc[at]]
        del rank, seeds, hashes

        # Windows that are settled here: runs of neighbours become one range of words.
        after = np.zeros(len(at), bool)
        after[1:] = (at[1:] == at[:-1] + 1) & (doc[at[1:]] == doc[at[:-1]])
        out: list[tuple[int, bytes, bytes]] = []
        i = np.flatnonzero(~sent)
        if len(i):
            begins = np.ones(len(i), bool)
            begins[1:] = ~(after[i[1:]] & (i[1:] == i[:-1] + 1))
            a, b = tx.runs(begins)
            d = doc[at[i[a]]]
            settled = np.stack([known[d], doc_id[d], copy[d], start[i[a]], start[i[b - 1]] + window], axis=1)
            target = (tx.mixed(settled[:, 1]) % np.uint64(buckets)).astype(np.int64)
            by = np.argsort(target, kind="stable")
            for lo, hi in zip(*tx.runs(np.diff(target[by], prepend=-1) != 0), strict=True):
                out.append((int(target[by[lo]]), settled[by[lo:hi]].tobytes(), b""))
        # Super-k-mers: neighbours with the same minimiser.
        i = np.flatnonzero(sent)
        begins = np.ones(len(i), bool)
        begins[1:] = ~(after[i[1:]] & (i[1:] == i[:-1] + 1) & (lowest[i[1:]] == lowest[i[:-1]]))
        a, b = tx.runs(begins)
        target = (tx.mixed(lowest[i[a]]) % np.uint64(buckets)).astype(np.int64)
        by = np.argsort(target, kind="stable")
        a, b, target = a[by], b[by], target[by]
        d, lengths = doc[at[i[a]]], b - a + window - 1
        meta = np.stack([known[d], doc_id[d], copy[d], start[i[a]], lengths], axis=1)
        every = words.array()
        for lo, hi in zip(*tx.runs(np.diff(target, prepend=-1) != 0), strict=True):
            part = every.take(pa.array(tx.ranges(at[i[a[lo:hi]]], lengths[lo:hi])))
            out.append((int(target[lo]), meta[lo:hi].tobytes(), pack(tx.text_bytes(part)[0].tobytes())))
        for lo in range(0, len(out), 64):
            some = out[lo : lo + 64]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([x[0] for x in some], pa.int32()),
                    pa.array([pack(x[1]) for x in some], pa.binary()),
                    pa.array([x[2] for x in some], pa.binary()),
                ],
                ["bucket", "meta", "words"],
            )


def _settle(table: pa.Table, window: int) -> pa.Table:
    """Ranges of words to remove, from all super-k-mers of one bucket."""
    unpack = zstandard.ZstdDecompressor().decompress
    metas, texts, settled = [], [], []
    for meta, packed in zip(table.column("meta").to_pylist(), table.column("words").to_pylist(), strict=True):
        rows = np.frombuffer(unpack(meta), np.int64).reshape(-1, 5)
        if packed:
            metas.append(rows)
            texts.append(unpack(packed))
        else:
            settled.append(rows)
    if metas:
        meta = np.concatenate(metas)
        joined = np.frombuffer(b"".join(texts), np.uint8)
        del metas, texts
        starts = np.concatenate([[0], np.flatnonzero(joined == 0x20) + 1]).astype(np.int64)
        coded = tx.blank_ended(joined, starts).dictionary_encode()
        codes = coded.indices.to_numpy(zero_copy_only=False)
        offset = np.concatenate([[0], np.cumsum(meta[:, 4])[:-1]])
        by = np.lexsort((meta[:, 3], meta[:, 2], meta[:, 1], meta[:, 0]))
        meta, offset = meta[by], offset[by]
        windows = meta[:, 4] - window + 1
        at, owner = tx.ranges(offset, windows), np.repeat(np.arange(len(meta)), windows)
        values = tx.mixed(codes.astype(np.uint64) + np.uint64(1))
        first = _first_equal(tx.range_hashes(values, at, at + window), codes, at, window)
        start = meta[owner, 3] + at - offset[owner]
        key, head = meta[owner, :3], meta[owner[first], :3]
        i = np.flatnonzero((first != np.arange(len(first))) & ((key != head).any(axis=1) | (start != start[first])))
        if len(i):
            begins = np.ones(len(i), bool)
            begins[1:] = (owner[i[1:]] != owner[i[:-1]]) | (i[1:] != i[:-1] + 1)
            a, b = tx.runs(begins)
            settled.append(np.column_stack([key[i[a]], start[i[a]], start[i[b - 1]] + window]))
    rows = np.concatenate(settled) if settled else np.empty((0, 5), np.int64)
    return pa.table(
        {
            "doc_id": pa.array(rows[:, 1], mask=rows[:, 0] == 0),
            "copy": pa.array(rows[:, 2]),
            "start": pa.array(rows[:, 3]),
            "end": pa.array(rows[:, 4]),
        }
    )


def _keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in tx.text_pieces(batches, "text"):
        words = tx.words_of(batch.column("text"))
        found = batch.column("found")
        flat = found.flatten()
        owner = pa.compute.list_parent_indices(found).to_numpy(zero_copy_only=False)
        base = words.first[owner]
        step = np.zeros(len(words) + 1, np.int64)
        np.add.at(step, base + flat.field("start").to_numpy(zero_copy_only=False), 1)
        np.add.at(step, base + flat.field("end").to_numpy(zero_copy_only=False), -1)
        gone = np.cumsum(step)[:-1] > 0
        doc = np.repeat(np.arange(batch.num_rows), np.diff(words.first))
        kept = words.array().filter(pa.array(~gone))
        raw, offsets = tx.text_bytes(kept)
        ends = np.concatenate([[0], np.cumsum(np.bincount(doc[~gone], minlength=batch.num_rows))])
        data = raw.tobytes()
        texts = [data[offsets[a] : max(offsets[a], offsets[b] - 1)] for a, b in zip(ends, ends[1:], strict=False)]
        edge = np.zeros(len(gone), bool)
        if len(gone):
            edge[0] = True
            edge[1:] = (gone[1:] != gone[:-1]) | (doc[1:] != doc[:-1])
        a, b = tx.runs(edge)
        a, b = a[gone[a]], b[gone[a]]
        lists = np.concatenate([[0], np.cumsum(np.bincount(doc[a], minlength=batch.num_rows))])
        spans = pa.StructArray.from_arrays(
            [pa.array(a - words.first[doc[a]]), pa.array(b - words.first[doc[a]])], ["start", "end"]
        )
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("doc_id"),
                pa.array(np.diff(words.first)),
                pa.array(np.bincount(doc[gone], minlength=batch.num_rows)),
                pa.ListArray.from_arrays(pa.array(lists, pa.int32()), spans),
                pa.array(texts, pa.binary()).cast(pa.string()),
            ],
            ["doc_id", "n_words", "n_removed", "removed", "kept_text"],
        )


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digest of the 20-word dedup of all documents."""
    result = substring_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return result.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text"), 256).alias("kept_sha256"))


OP1_SQL = r"""
WITH docs AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents
), windows AS (
  SELECT doc_id, i AS start, array_to_string(words[i:i + 19], ' ') AS seq
  FROM (SELECT doc_id, words, unnest(range(1, len(words) - 18)) AS i FROM docs)
), later AS (
  SELECT doc_id, start FROM windows
  QUALIFY row_number() OVER (PARTITION BY seq ORDER BY doc_id, start) > 1
), gone AS (
  SELECT DISTINCT doc_id, unnest(range(start, start + 20)) AS i FROM later
), one AS (
  SELECT doc_id, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS i FROM docs
), kept AS (
  SELECT o.doc_id, count(g.i) AS n_removed, string_agg(o.word, ' ' ORDER BY o.i) FILTER (WHERE g.i IS NULL) AS text
  FROM one o LEFT JOIN gone g ON o.doc_id = g.doc_id AND o.i = g.i GROUP BY o.doc_id
)
SELECT d.doc_id, CAST(len(d.words) AS BIGINT) AS n_words, CAST(coalesce(k.n_removed, 0) AS BIGINT) AS n_removed,
  sha256(coalesce(k.text, '')) AS kept_sha256
FROM docs d LEFT JOIN kept k ON d.doc_id = k.doc_id
"""

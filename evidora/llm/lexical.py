"""Ranked lexical search by presence masks.

Documents are indexed in pieces: for each term of a piece, the documents that hold it and how often. A set of items is looked
up in every piece. Each term of an item is a bitmap over the piece's documents; the bits of one document across those bitmaps
are its mask, the set of the item's terms it holds. Documents are grouped by mask. The largest contributions of the terms in a
mask add up to the most that a document of the group can score, so the groups are scored by descending maximum until none that
is left can reach the twentieth score found so far, which a task keeps from piece to piece.

Items are a query set that is looked up against all documents in blocks of bounded size; an item's candidates are ranked first
within parts, then in whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from evidora.llm import text as tx
from evidora.llm.components import stored

MOST = 20
#: A term is a run of ASCII letters and digits and of all characters beyond ASCII.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: A piece of the index ends at so many bytes of text or so many documents, a block of items at about so many bytes of text.
PIECE_BYTES, PIECE_DOCS, BLOCK_BYTES = 2 << 20, 4096, 256 << 10
#: Parts in which an item's candidates are ranked before they meet.
PARTS = 64
#: Fixed numbers of the scoring rule.
SCALE, FLAT, SLOPE, RISE = 1_000_000_000, 75, 25, 12

_IN_TERM = np.zeros(256, bool)
_IN_TERM[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32


def terms_of(text: Column) -> Column:
    """The terms of a text in order, with repeats."""
    return F.regexp_extract_all(tx.lower_ascii(text), F.lit(TERM), F.lit(0))


def _terms(array: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Terms (blank-ended) of texts made by `closed_text`, and the number of each one's text."""
    raw, offsets = tx.text_bytes(array)
    raw = _LOWER[raw]
    inside = _IN_TERM[raw]
    end = np.zeros(len(raw), bool)
    end[1:] = inside[:-1] & ~inside[1:]
    joined = raw[inside | end]
    joined[end[inside | end]] = 0x20
    starts = np.concatenate([[0], np.flatnonzero(joined == 0x20) + 1]).astype(np.int64)
    number = np.searchsorted(offsets, np.flatnonzero(end), side="right") - 1
    return tx.blank_ended(joined, starts), number


def _index_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    pack = zstandard.ZstdCompressor(level=1).compress
    for batch in batches:
        for own in _small_pieces(batch):
            array, doc = _terms(own.column("text"))
            coded = array.dictionary_encode()
            codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
            sizes = np.bincount(doc, minlength=own.num_rows)
            pair, times = np.unique(codes * own.num_rows + doc, return_counts=True)
            code = pair // own.num_rows
            ends = np.searchsorted(code, np.arange(len(coded.dictionary)), side="right")
            words, starts = tx.text_bytes(coded.dictionary)
            arrays = (starts[1:], ends, pair - code * own.num_rows, times, sizes)
            packed = b"".join(a.astype(np.uint32).tobytes() for a in arrays)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([int((sizes > 0).sum())]),
                    pa.array([int(sizes.sum())]),
                    pa.array([len(ends)], pa.int32()),
                    pa.array([len(pair)], pa.int32()),
                    pa.ListArray.from_arrays(pa.array([0, own.num_rows], pa.int32()), own.column("doc_id")),
                    pa.array([pack(words.tobytes())], pa.binary()),
                    pa.array([pack(packed)], pa.binary()),
                ],
                ["n_docs", "n_terms", "words", "postings", "ids", "dictionary", "index"],
            )


def _small_pieces(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    if batch.num_rows:
        _, offsets = tx.text_bytes(batch.column("text"))
        yield from tx.pieces(batch, np.diff(offsets) + PIECE_BYTES // PIECE_DOCS, PIECE_BYTES)


def indexed(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The index of a table: a row per piece, with its documents' ids, its dictionary and packed postings."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), tx.closed_text(F.col(text_col)).alias("text"))
    schema = "n_docs long, n_terms long, words int, postings int, ids array<long>, dictionary binary, index binary"
    return rows.mapInArrow(_index_rows, schema)


class _Piece:
    """A row of the index, unpacked."""

    def __init__(self, batch: pa.RecordBatch, row: int):
        unpack = zstandard.ZstdDecompressor().decompress
        words, postings = batch.column("words")[row].as_py(), batch.column("postings")[row].as_py()
        packed = np.frombuffer(unpack(batch.column("index")[row].as_py()), np.uint32).astype(np.int64)
        starts, self.ends, self.docs, self.times, self.sizes = np.split(
            packed, np.cumsum([words, words, postings, postings])
        )
        joined = np.frombuffer(unpack(batch.column("dictionary")[row].as_py()), np.uint8)
        self.terms = tx.blank_ended(joined, np.append(0, starts)).cast(pa.binary())
        self.begins = np.append(0, self.ends[:-1])

    def codes(self, wanted: pa.Array) -> np.ndarray:
        """Numbers of the wanted terms (blank-ended) in this piece; -1 for those it does not hold."""
        return pa.compute.index_in(wanted, self.terms).fill_null(-1).to_numpy(zero_copy_only=False)


def _pieces_with(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[tuple[pa.RecordBatch, int, _Piece, pa.Array]]:
    for batch in batches:
        for row in range(batch.num_rows):
            wanted = batch.column(column)[row].values
            yield batch, row, _Piece(batch, row), wanted


def _found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many documents of each piece hold each term of a block."""
    for batch, row, piece, wanted in _pieces_with(batches, "terms"):
        codes = piece.codes(wanted)
        held = np.flatnonzero(codes >= 0)
        n = piece.ends[codes[held]] - piece.begins[codes[held]]
        block = pa.array(np.full(len(held), batch.column("block")[row].as_py(), np.int64))
        yield pa.RecordBatch.from_arrays([block, wanted.take(pa.array(held)), pa.array(n)], ["block", "term", "n"])


def _groups(bits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct columns of a matrix of bits (terms by documents), and the number of each document's."""
    width = -(-len(bits) // 64) * 8
    masks = np.zeros((bits.shape[1], width), np.uint8)
    packed = np.packbits(bits, axis=0)
    masks[:, : len(packed)] = packed.T
    keys = masks.view(np.uint64 if width == 8 else np.dtype((np.void, width))).ravel()
    _, first, group = np.unique(keys, return_index=True, return_inverse=True)
    return bits[:, first], group


class _Best:
    """The best documents of one item so far, by descending score, then ascending id with null first."""

    def __init__(self, most: int):
        self.most = most
        self.score, self.known, self.doc_id = (np.empty(0, np.int64) for _ in range(3))

    def least(self) -> int:
        """A score that a further document has to reach."""
        return int(self.score[-1]) if len(self.score) >= self.most else 1

    def add(self, score: np.ndarray, known: np.ndarray, doc_id: np.ndarray) -> None:
        score, known, doc_id = (
            np.concatenate(x) for x in ((self.score, score), (self.known, known), (self.doc_id, doc_id))
        )
        by = np.lexsort((doc_id, known, -score))[: self.most]
        self.score, self.known, self.doc_id = score[by], known[by], doc_id[by]


def _rank(batches: Iterator[pa.RecordBatch], n_docs: int, n_terms: int, most: int) -> Iterator[pa.RecordBatch]:
    best: dict[tuple[int | None, int], _Best] = {}
    for batch, row, piece, wanted in _pieces_with(batches, "terms"):
        ids = batch.column("ids")[row].values
        known = ids.is_valid().to_numpy(zero_copy_only=False).astype(np.int64)
        doc_id = ids.fill_null(0).to_numpy(zero_copy_only=False)
        own = FLAT + (SLOPE * piece.sizes * n_docs) // max(n_terms, 1)
        codes = piece.codes(wanted)
        weight = batch.column("weights")[row].values.to_numpy(zero_copy_only=False)
        item = batch.column("items")[row].values
        keys = [item.field(name).to_pylist() for name in ("item_id", "copy")]
        ends = item.field("until").to_numpy(zero_copy_only=False)
        start = 0
        for *key, end in zip(*keys, ends.tolist(), strict=True):
            at = np.flatnonzero(codes[start:end] >= 0) + start
            start = end
            if not len(at):
                continue
            parts, bits, docs = [], np.zeros((len(at), len(doc_id)), bool), None
            for i, (code, w) in enumerate(zip(codes[at].tolist(), weight[at].tolist(), strict=True)):
                some = slice(piece.begins[code], piece.ends[code])
                docs, times = piece.docs[some], piece.times[some]
                bits[i, docs] = True
                parts.append((docs, w * ((SCALE * times) // (1000 * times + RISE * own[docs]))))
            any_term = np.flatnonzero(np.bitwise_or.reduce(bits, axis=0))
            masks, group = _groups(bits[:, any_term])
            highest = np.array([part.max() for _, part in parts]) @ masks
            found = best.setdefault(tuple(key), _Best(most))
            order = np.argsort(-highest, kind="stable")
            reached = np.cumsum(np.bincount(group, minlength=len(order))[order])
            # The groups of highest maximum that hold enough documents; then all that can reach the least score then known.
            first = int(np.searchsorted(reached, most)) + 1 if len(found.score) < most else 0
            done = np.zeros(len(order), bool)
            for stop in (first, len(order)):
                chosen = order[:stop]
                chosen = chosen[~done[chosen] & (highest[chosen] >= found.least())]
                if not len(chosen):
                    continue
                done[chosen] = True
                wants = np.zeros(len(order), bool)
                wants[chosen] = True
                wanted_docs = np.zeros(len(doc_id), bool)
                wanted_docs[any_term[wants[group]]] = True
                score = np.zeros(len(doc_id), np.int64)
                for docs, part in parts:
                    hit = wanted_docs[docs]
                    score[docs[hit]] += part[hit]
                some = np.flatnonzero(wanted_docs & (score >= found.least()))
                found.add(score[some], known[some], doc_id[some])
    for (item_id, copy), found in best.items():
        n = len(found.score)
        if n:
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([item_id] * n, pa.int64()),
                    pa.array([copy] * n, pa.int64()),
                    pa.array(found.doc_id, mask=found.known == 0),
                    pa.array(found.score),
                ],
                ["item_id", "copy", "doc_id", "score"],
            )


def search(
    docs: DataFrame,
    items: DataFrame,
    *,
    most: int = MOST,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
) -> DataFrame:
    """`item_id`, `copy` (hash of the item's text), `rank` (from 1), `doc_id` and `score` of each item's best documents.

    A null or empty text holds no term: it is found by nothing, and as an item finds nothing. Documents with equal scores rank by
    id, null first; rows with one id are ranked side by side. Items with one id and different texts are ranked apart; items
    that repeat in whole are one. Terms that no document holds add nothing. Empty tables give an empty result. Columns besides
    ids and texts are not looked at.
    """
    index, _ = stored(indexed(docs, id_col=id_col, text_col=text_col), "index")
    sums = index.agg(F.sum("n_docs"), F.sum("n_terms")).first()
    n_docs, n_terms = (int(x or 0) for x in sums)
    text = F.col(item_text_col).cast("string")
    asked = items.select(
        F.col(item_col).cast("long").alias("item_id"), F.xxhash64(text).alias("copy"), text.alias("text")
    ).distinct()
    size = asked.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    block = F.pmod(F.xxhash64("item_id", "copy"), F.lit(1 + size // BLOCK_BYTES))
    terms = asked.select(block.alias("block"), "item_id", "copy", F.explode(terms_of(F.col("text"))).alias("term"))
    terms = terms.groupBy("block", "item_id", "copy", "term").agg(F.count("*").alias("times"))
    # Each term ends in a blank, as in the index.
    terms, _ = stored(terms.withColumn("term", F.concat("term", F.lit(" ")).cast("binary")), "terms")
    listed = terms.groupBy("block").agg(F.collect_set("term").alias("terms"))
    counts = index.crossJoin(listed).select("words", "postings", "ids", "dictionary", "index", "block", "terms")
    counts = counts.mapInArrow(_found, "block long, term binary, n long").groupBy("block", "term").agg(F.sum("n").alias("df"))
    weight = F.floor(1000 * F.log((2 * F.lit(n_docs) + 2) / (2 * F.col("df") + 1))).cast("long")
    weighed = terms.join(counts, ["block", "term"]).withColumn("weight", F.col("times") * weight)
    per_item = weighed.groupBy("block", "item_id", "copy").agg(
        F.sort_array(F.collect_list(F.struct("term", "weight"))).alias("of")
    )
    blocks = per_item.groupBy("block").agg(F.collect_list(F.struct("item_id", "copy", "of")).alias("all"))
    until = F.expr("transform(all, (x, i) -> aggregate(slice(all, 1, i + 1), 0, (n, y) -> n + size(y.of)))")
    flat = F.flatten(F.transform("all", lambda x: x["of"]))
    blocks = blocks.withColumn("until", until).select(
        F.transform(
            F.arrays_zip("all", "until"),
            lambda x: F.struct(
                x["all"]["item_id"].alias("item_id"), x["all"]["copy"].alias("copy"), x["until"].alias("until")
            ),
        ).alias("items"),
        F.transform(flat, lambda x: x["term"]).alias("terms"),
        F.transform(flat, lambda x: x["weight"]).alias("weights"),
    )
    blocks, _ = stored(blocks, "blocks")
    met = index.crossJoin(blocks).select(
        "words", "postings", "ids", "dictionary", "index", "items", "terms", "weights"
    )
    best = met.mapInArrow(
        lambda batches: _rank(batches, n_docs, n_terms, most), "item_id long, copy long, doc_id long, score long"
    )
    order = [F.desc("score"), "doc_id"]
    part = Window.partitionBy("item_id", "copy", F.pmod(F.xxhash64("doc_id"), F.lit(PARTS))).orderBy(*order)
    best = best.withColumn("rank", F.row_number().over(part)).where(F.col("rank") <= most)
    whole = Window.partitionBy("item_id", "copy").orderBy(*order)
    best = best.withColumn("rank", F.row_number().over(whole)).where(F.col("rank") <= most)
    return best.select("item_id", "copy", "rank", "doc_id", "score")


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best documents of every benchmark item among all documents."""
    docs, items = (spark.read.parquet(f"{sf_dir}/{name}.parquet") for name in ("documents", "benchmark"))
    return search(docs, items).select("item_id", "rank", "doc_id", "score")


_SQL_TERMS = (
    "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
    rf"'{TERM}')"
)

OP12_SQL = rf"""
WITH docs AS (
  SELECT row_number() OVER () AS d, doc_id, {_SQL_TERMS} AS terms FROM documents
), facts AS (
  SELECT CAST(count(*) FILTER (WHERE len(terms) > 0) AS BIGINT) AS n, CAST(sum(len(terms)) AS BIGINT) AS l FROM docs
), postings AS (
  SELECT d, doc_id, len(terms) AS size, term, count(*) AS tf
  FROM (SELECT d, doc_id, terms, unnest(terms) AS term FROM docs) GROUP BY d, doc_id, size, term
), weights AS (
  SELECT term, CAST(floor(1000 * ln((2 * n + 2) / (2 * df + 1))) AS BIGINT) AS w
  FROM (SELECT term, count(*) AS df FROM postings GROUP BY term) CROSS JOIN facts
), asked AS (
  SELECT item_id, unnest({_SQL_TERMS}) AS term FROM benchmark
), scores AS (
  SELECT item_id, d, doc_id,
    CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 12 * (100 - 25 + (25 * size * n) // l)))) AS BIGINT) AS score
  FROM asked JOIN postings USING (term) JOIN weights USING (term) CROSS JOIN facts GROUP BY item_id, d, doc_id
), ranked AS (
  SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS FIRST) AS INTEGER) AS rank,
    doc_id, score FROM scores WHERE score > 0
)
SELECT * FROM ranked WHERE rank <= 20
"""

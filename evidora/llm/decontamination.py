"""Benchmark decontamination by spaced seeds.

Texts are compared as lower-case words without punctuation; in scripts written without blanks each character is a word. A test
item overlaps a document where WINDOW words in a row of
the one (the whole item, if it is shorter) stand aligned with those of the other and at most a fifth of them differ. Items under
EXACT_BELOW words have to stand in the document word for word. Fixed
masks hash some positions of a stretch of words and ignore the others; the three masks are chosen such that every way in which
2 of 13 words can differ leaves at least one mask untouched somewhere in the window, so a seed never misses an overlap.
Hashes of the test items and of the documents are joined on equality; around each hit the aligned words are compared.

Test items are a query set: they go to the tasks in blocks of bounded size, and documents are looked at once for each block,
where they lie. Documents are not shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evidora.llm import text as tx

WINDOW = 13
#: One in so many words may differ.
DIFFERS = 5
#: Whole items of fewer words allow no difference.
EXACT_BELOW = 8
#: `clean` drops a document for items of at least so many words: shorter ones stand in texts that never saw the test.
CLEAN_WORDS = 5
MASKS = ((0, 1, 2, 4, 9, 10, 11), (0, 1, 2, 3, 4, 6, 7), (0, 1, 4, 5, 6, 7, 8))
#: For items under WINDOW words: three words in a row, which a fifth of differing words always leaves, or all that there are.
SHORT_MASKS = ((0, 1, 2), (0, 1), (0,))
#: Characters of scripts without blanks: Thai, Lao, Burmese, Khmer, kana and Han.
UNSPACED = r"[\x{E00}-\x{EFF}\x{1000}-\x{109F}\x{1780}-\x{17FF}\x{3040}-\x{30FF}\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}]"
#: Words of test items that tasks hold at once, about 100 bytes each.
BLOCK_WORDS = 200_000
#: Hits, and aligned words, that a task works on at once.
CELLS = 500_000
FILTER_BITS = 22
_SHIFT = np.uint64(64 - FILTER_BITS)

_HIT = T.StructType()
for _name in ("item", "doc_start", "doc_end", "item_start", "n_equal"):
    _HIT = _HIT.add(_name, T.LongType())
_HITS = T.ArrayType(_HIT)


@dataclass
class Block:
    """Hashed words of some test items, and their seeds by mask: hashes in order, and the word where each begins."""

    item: np.ndarray  # of each word, counted from the first of the table
    words: np.ndarray
    first: np.ndarray  # of each item's words; by `item - item[0]`
    seeds: list[tuple[tuple[int, ...], np.ndarray, np.ndarray, np.ndarray]]


def _hashed(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    words = tx.words_of(array, plain=True)
    codes, vocabulary = words.codes()
    return (tx.value_hashes(vocabulary)[codes] if len(codes) else np.zeros(0, np.uint64)), words.first


def _masked(hashes: np.ndarray, mask: tuple[int, ...]) -> np.ndarray:
    n = max(len(hashes) - mask[-1], 0)
    total = np.zeros(n, np.uint64)
    for k in mask:
        total = total * np.uint64(0x9E3779B97F4A7C15) + hashes[k : k + n]
    return tx.mixed(total)


def plain_text(text: Column) -> Column:
    """Lower case, with blanks around each character of a script without them."""
    return tx.closed_text(F.regexp_replace(F.lower(text.cast("string")), f"({UNSPACED})", " $1 "))


def _block(texts: list[str], number: int, least: int) -> Block:
    words, first = _hashed(pa.array(texts, pa.large_string()))
    count = np.diff(first)
    item = np.repeat(np.arange(len(count)), count)
    seeds = []
    for mask in (*MASKS, *SHORT_MASKS):
        if mask in MASKS:
            sought = count >= max(WINDOW, least)
        else:
            sought = (count < WINDOW) & (count >= least) & (np.minimum(count, len(SHORT_MASKS[0])) == len(mask))
        hashes = _masked(words, mask)
        at = np.arange(len(hashes))
        at = at[sought[item[at]] & (item[at] == item[at + mask[-1]])]
        by = at[np.argsort(hashes[at], kind="stable")]
        if len(by):
            held = np.zeros(1 << FILTER_BITS, bool)
            held[hashes[by] >> _SHIFT] = True
            seeds.append((mask, hashes[by], by, held))
    return Block(item + number, words, first, seeds)


def blocks(items: DataFrame, text_col: str, least: int = 1) -> Iterator[tuple[list, Block]]:
    """Ids and blocks of test items, read in the order of their ids; the driver holds one block's texts at a time."""
    held: list[tuple] = []
    size = number = 0
    for row in items.toLocalIterator():
        n = len((row[text_col] or "").split()) + 1
        if held and size + n > BLOCK_WORDS:
            yield [h[0] for h in held], _block([h[1] for h in held], number, least)
            number += len(held)
            held, size = [], 0
        held.append((row["item_id"], row[text_col] or ""))
        size += n
    if held:
        yield [h[0] for h in held], _block([h[1] for h in held], number, least)


def _spans(sizes: np.ndarray) -> Iterator[slice]:
    """Neighbours whose sizes add up to about CELLS; a larger one goes alone."""
    ends = np.cumsum(sizes)
    start = 0
    while start < len(sizes):
        base = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, base + CELLS, side="right")))
        yield slice(start, stop)
        start = stop


def _places(words: np.ndarray, doc: np.ndarray, block: Block) -> np.ndarray:
    """Where items could stand by one seed or more: the word where the item would begin, the item, the document."""
    found = [np.zeros((0, 3), np.int64)]
    for mask, seeds, where, held in block.seeds:
        hashes = _masked(words, mask)
        at = np.flatnonzero(held[hashes >> _SHIFT])
        at = at[doc[at] == doc[at + mask[-1]]]
        lo, hi = np.searchsorted(seeds, hashes[at], "left"), np.searchsorted(seeds, hashes[at], "right")
        at, lo, hi = at[hi > lo], lo[hi > lo], hi[hi > lo]
        # A word that is repeated in both meets itself everywhere, mostly at a place that is known already.
        for some in _spans(hi - lo):
            times = hi[some] - lo[some]
            begin, word = np.repeat(at[some], times), where[tx.ranges(lo[some], times)]
            item = block.item[word] - block.item[0]
            found.append(np.unique(np.column_stack([begin - word + block.first[item], item, doc[begin]]), axis=0))
    return np.unique(np.concatenate(found), axis=0)


def _aligned(words: np.ndarray, first: np.ndarray, places: np.ndarray, block: Block) -> np.ndarray:
    """Overlaps at some places: document, item, its first word in the document and past its last, in the item, equal words."""
    origin, item, owner = places.T
    size = np.diff(block.first)[item]
    # All aligned words of these places, one place after the other.
    step = tx.ranges(np.zeros(len(size), np.int64), size)
    place = np.repeat(np.arange(len(size)), size)
    there = origin[place] + step
    inside = (there >= first[owner[place]]) & (there < first[owner[place] + 1])
    equal = np.zeros(len(step), np.int64)
    equal[inside] = words[there[inside]] == block.words[block.first[item[place[inside]]] + step[inside]]
    window = np.minimum(size, WINDOW)
    total = np.concatenate([[0], np.cumsum(equal)])
    start = np.flatnonzero(step + window[place] <= size[place])
    width = window[place[start]]
    # A window lies inside the document as a whole.
    some = np.concatenate([[0], np.cumsum(inside)])
    least = np.where(width < EXACT_BELOW, width, width - width // DIFFERS)
    good = (total[start + width] - total[start] >= least) & (some[start + width] - some[start] == width)
    start, width = start[good], width[good]
    mine = place[start]
    a, b = tx.runs(np.diff(mine, prepend=-1) != 0)
    if not len(start):
        return np.zeros((0, 6), np.int64)
    mine, lo, hi = mine[a], start[a], start[b - 1] + width[b - 1]
    begin = there[lo] - first[owner[mine]]
    return np.column_stack([owner[mine], item[mine], begin, begin + hi - lo, step[lo], total[hi] - total[lo]])


def _overlaps(array: pa.Array, block: Block) -> pa.Array:
    words, first = _hashed(array)
    doc = np.repeat(np.arange(len(array)), np.diff(first))
    places = _places(words, doc, block)
    sizes = np.diff(block.first)[places[:, 1]]
    rows = np.concatenate(
        [np.zeros((0, 6), np.int64), *(_aligned(words, first, places[some], block) for some in _spans(sizes))]
    )
    owner, item, begin, end, step, equal = rows[np.lexsort((rows[:, 4], rows[:, 1], rows[:, 0]))].T
    columns = [item + block.item[0], begin, end, step, equal] if len(rows) else [item, begin, end, step, equal]
    hits = pa.StructArray.from_arrays([pa.array(c) for c in columns], [f.name for f in _HIT])
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(owner, np.arange(len(array) + 1)), pa.int32()), hits)


_ARROW = pa.struct([(f.name, pa.int64()) for f in _HIT])


def _seen(block, text: Column) -> Column:
    @F.arrow_udf(_HITS)
    def hits(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            sizes = np.diff(tx.text_bytes(batch)[1])
            parts = [_overlaps(part, block.value) for part in tx.pieces(batch, sizes)] if len(batch) else []
            del batch
            yield pa.concat_arrays(parts) if parts else pa.array([], pa.list_(_ARROW))

    return hits(plain_text(text))


def hits(
    spark: SparkSession, text: Column, items: DataFrame, *, id_col: str, text_col: str, least: int = 1
) -> tuple[Column, list]:
    """A column of all overlaps of a text with items of at least so many words, and the items' ids by the number they give."""
    lowered = items.select(F.col(id_col).alias("item_id"), plain_text(F.col(text_col)).alias("t"))
    ids, columns = [], []
    for some, block in blocks(lowered.orderBy("item_id", "t"), "t", least):
        ids += some
        if block.seeds:
            columns.append(_seen(spark.sparkContext.broadcast(block), text))
    none = F.array().cast(_HITS)
    return (reduce(lambda a, b: F.concat(a, b), columns) if columns else none), ids


def overlaps(
    docs: DataFrame,
    items: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_id_col: str = "item_id",
    item_text_col: str = "text",
) -> DataFrame:
    """One row per overlap: `doc_id`, `item_id`, `doc_start`, `doc_end` (words of the document, end exclusive), `item_start`,
    `n_equal`.

    Null and empty texts overlap nothing. Null ids and repeated
    rows of either table give rows of their own. An empty table gives an empty result. Other columns are not looked at.
    """
    spark = docs.sparkSession
    column, ids = hits(spark, F.col(text_col), items, id_col=item_id_col, text_col=item_text_col)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.explode(column).alias("hit")).select("doc_id", "hit.*")
    kind = items.schema[item_id_col].dataType
    names = spark.createDataFrame(
        list(enumerate(ids)), T.StructType().add("item", T.LongType()).add("item_id", kind)
    )
    return rows.join(names, "item").select("doc_id", "item_id", "doc_start", "doc_end", "item_start", "n_equal")


def clean(docs: DataFrame, items: DataFrame, *, text_col: str = "text", item_text_col: str = "text") -> DataFrame:
    """The rows of `docs` without any overlap with items of CLEAN_WORDS or more words; those with a null text stay."""
    items = items.select(F.monotonically_increasing_id().alias("item"), F.col(item_text_col).alias("text"))
    column, _ = hits(docs.sparkSession, F.col(text_col), items, id_col="item", text_col="text", least=CLEAN_WORDS)
    return docs.where(F.size(column) == 0)


def op3_benchmark_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlaps of all documents with all test items."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return overlaps(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


_TOKEN = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F\x{AB}\x{BB}\x{2000}-\x{206F}]+"
OP3_SQL = rf"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(regexp_replace(lower(coalesce(text, '')), '({UNSPACED})', ' \1 ', 'g'), '{_TOKEN}') AS w
  FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(regexp_replace(lower(coalesce(text, '')), '({UNSPACED})', ' \1 ', 'g'), '{_TOKEN}') AS w
  FROM benchmark
), dw AS (
  SELECT doc_id, unnest(w) AS word, unnest(range(len(w))) AS i FROM d
), bw AS (
  SELECT item_id, len(w) AS n, unnest(w) AS word, unnest(range(len(w))) AS i FROM b
), dg AS (
  SELECT doc_id, i, 3 AS k, word || ' ' || lead(word) OVER s || ' ' || lead(word, 2) OVER s AS g FROM dw
  WINDOW s AS (PARTITION BY doc_id ORDER BY i)
  UNION ALL SELECT doc_id, i, 2, word || ' ' || lead(word) OVER s FROM dw WINDOW s AS (PARTITION BY doc_id ORDER BY i)
  UNION ALL SELECT doc_id, i, 1, word FROM dw
), bg AS (
  SELECT item_id, n, i, least(n, 3) AS k, CASE n WHEN 1 THEN word WHEN 2 THEN word || ' ' || lead(word) OVER s
    ELSE word || ' ' || lead(word) OVER s || ' ' || lead(word, 2) OVER s END AS g FROM bw
  WINDOW s AS (PARTITION BY item_id ORDER BY i)
), places AS (
  SELECT DISTINCT doc_id, item_id, n, dg.i - bg.i AS origin FROM dg JOIN bg USING (g, k)
), aligned AS (
  SELECT p.*, bw.i, dw.word IS NOT NULL AS inside, CAST(coalesce(dw.word = bw.word, false) AS BIGINT) AS equal
  FROM places p JOIN bw USING (item_id) LEFT JOIN dw ON dw.doc_id = p.doc_id AND dw.i = p.origin + bw.i
), summed AS (
  SELECT *, sum(equal) OVER s AS before, sum(CAST(inside AS BIGINT)) OVER s AS present, least(n, {WINDOW}) AS width
  FROM aligned WINDOW s AS (PARTITION BY doc_id, item_id, origin ORDER BY i)
), windows AS (
  SELECT s.doc_id, s.item_id, s.origin, s.i, s.width FROM summed s JOIN summed e
    ON e.doc_id = s.doc_id AND e.item_id = s.item_id AND e.origin = s.origin AND e.i = s.i + s.width - 1
  WHERE e.present - s.present + CAST(s.inside AS BIGINT) = s.width
    AND e.before - s.before + s.equal >= s.width - CASE WHEN s.width < {EXACT_BELOW} THEN 0 ELSE s.width // {DIFFERS} END
), spans AS (
  SELECT doc_id, item_id, origin, min(i) AS lo, max(i + width) AS hi FROM windows GROUP BY ALL
)
SELECT doc_id, item_id, CAST(origin + lo AS BIGINT) AS doc_start, CAST(origin + hi AS BIGINT) AS doc_end,
  CAST(lo AS BIGINT) AS item_start, CAST(sum(equal) AS BIGINT) AS n_equal
FROM spans JOIN aligned USING (doc_id, item_id, origin) WHERE i >= lo AND i < hi
GROUP BY doc_id, item_id, origin, lo, hi
"""

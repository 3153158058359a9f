"""Language identification of words in code-switched text by a linear-chain conditional random field.

A word's emission is the sum of hashed feature weights: its lower-case form (lexicon), its runs of two to four bytes, and
those that touch its borders (affixes). Transitions between the languages of neighbouring words are learned with the
weights. Forward-backward over the whole text gives each word's posterior; a document's language has the largest sum.

Learning looks at a bounded sample of labelled documents on the driver. Its sequences are spliced from passages of
different languages, as labels are known for documents only. Scoring runs in Arrow tasks over all texts: a text is cut into
blocks of words, each block's transfer matrix is worked out for all blocks at once, the blocks of a text are chained, and
forward and backward passes run inside all blocks at once, which equals one pass over the whole text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evidora.llm import text as tx

UNDETERMINED = "und"
#: Bound of the labelled sample: documents for each language, and characters taken from each.
SAMPLE_DOCS, SAMPLE_CHARS = 300, 3000
#: Passages, evenly spread, that the characters of a longer text come from.
SAMPLE_PASSAGES = 6
#: Languages of the labels; a set of labels with more is refused.
MOST_LANGUAGES = 500
FEATURE_BITS = 18
BLOCK = 128
#: Distinct words of the sample whose features are made at a time.
PIECE_WORDS = 4096
#: Words of a passage in the spliced sequences, their mean.
PASSAGE = 12
EPOCHS, STEP, DECAY, SEED = 3, 0.3, 1e-6, 11

_MASK = np.uint64((1 << FEATURE_BITS) - 1)
_ORDERS = (2, 3, 4)


@dataclass
class Field:
    languages: list[str]
    weights: np.ndarray  # features by languages
    transitions: np.ndarray  # factors, from by to
    start: np.ndarray


def _features(vocabulary: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Feature numbers, and the word that has each, for words with one blank behind them."""
    raw, offsets = tx.text_bytes(vocabulary)
    n = len(vocabulary)
    joined = np.concatenate([[0x20], raw]).astype(np.uint64)
    word = np.concatenate([[-1], np.repeat(np.arange(n), np.diff(offsets))])
    features, owners = [tx.value_hashes(vocabulary) & _MASK], [np.arange(n)]
    for order in _ORDERS:
        if len(joined) < order:
            break
        gram = np.zeros(len(joined) - order + 1, np.uint64)
        for k in range(order):
            gram = gram * np.uint64(257) + joined[k : len(joined) - order + 1 + k] + np.uint64(1)
        owner = word[1 : len(joined) - order + 2]
        inside = owner == word[order - 1 :]
        features.append(tx.mixed(gram[inside] + np.uint64(order << 60)) & _MASK)
        owners.append(owner[inside])
    return np.concatenate(features).astype(np.int64), np.concatenate(owners)


def _features_by_word(vocabulary: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Feature numbers, word after word, and how many each word has; made in pieces, so that only the numbers are held whole."""
    features, counts = [np.empty(0, np.int32)], [np.empty(0, np.int64)]
    for at in range(0, len(vocabulary), PIECE_WORDS):
        piece = vocabulary.slice(at, PIECE_WORDS)
        feature, owner = _features(piece)
        features.append(feature[np.argsort(owner, kind="stable")].astype(np.int32))
        counts.append(np.bincount(owner, minlength=len(piece)))
    return np.concatenate(features), np.concatenate(counts)


def _emissions(vocabulary: pa.Array, weights: np.ndarray) -> np.ndarray:
    """Scores of each word for each language, over the root of its number of features."""
    feature, owner = _features(vocabulary)
    n = len(vocabulary)
    count = np.sqrt(np.maximum(np.bincount(owner, minlength=n), 1))
    sums = [np.bincount(owner, weights[feature, y], n) for y in range(weights.shape[1])]
    return np.stack(sums, axis=1) / count[:, None] if n else np.zeros((0, weights.shape[1]))


def _lettered(vocabulary: pa.Array) -> np.ndarray:
    """Words with an ASCII letter or anything beyond ASCII."""
    raw, offsets = tx.text_bytes(vocabulary)
    letter = (raw >= 128) | ((raw | 32) >= 97) & ((raw | 32) <= 122)
    total = np.concatenate([[0], np.cumsum(letter)])
    return total[offsets[1:]] > total[offsets[:-1]]


def _sequences(first: np.ndarray, labels: np.ndarray, rng: np.random.Generator, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Word numbers and labels of sequences spliced from passages of documents, all of one length.

    `first` has each document's words; they stay in their array, as numbers, so that the driver makes no object for each."""
    starts, sizes, tags = [], [], []
    for begin, end, label in zip(first[:-1].tolist(), first[1:].tolist(), labels.tolist(), strict=True):
        while begin < end:
            n = min(int(rng.geometric(1 / PASSAGE)), end - begin)
            starts.append(begin)
            sizes.append(n)
            tags.append(label)
            begin += n
    order = rng.permutation(len(starts))
    size = np.array(sizes, np.int64)[order]
    words = tx.ranges(np.array(starts, np.int64)[order], size)
    whole = len(words) // length * length
    return words[:whole], np.repeat(np.array(tags, np.int64)[order], size)[:whole].reshape(-1, length)


def fit(texts: list[str], labels: list[str]) -> Field:
    """Weights and transitions from documents with a language each, by stochastic gradients of the likelihood."""
    languages = sorted(set(labels))
    y = len(languages)
    if not y:
        return Field([], np.zeros((1 << FEATURE_BITS, 0)), np.zeros((0, 0)), np.zeros(0))
    rng = np.random.default_rng(SEED)
    number = {name: i for i, name in enumerate(languages)}
    words = tx.words_of(pa.array([t.lower() + " " for t in texts], pa.large_string()))
    length, batch = 32, 64
    sequence, tags = _sequences(words.first, np.array([number[x] for x in labels]), rng, length)
    weights = np.zeros((1 << FEATURE_BITS, y))
    squares = np.full(weights.shape, 1e-8)
    trans, trans_squares = np.zeros((y, y)), np.full((y, y), 1e-8)
    if not len(tags):
        return Field(languages, weights.astype(np.float32), np.full((y, y), 1 / y), np.full(y, 1 / y))
    coded = words.array().take(pa.array(sequence)).dictionary_encode()
    codes = coded.indices.to_numpy().astype(np.int64).reshape(-1, length)
    feature, count = _features_by_word(coded.dictionary)
    first = np.concatenate([[0], np.cumsum(count)[:-1]])
    scale = 1 / np.sqrt(count)
    for _ in range(EPOCHS):
        for rows in np.array_split(rng.permutation(len(codes)), max(1, len(codes) // batch)):
            used, inverse = np.unique(codes[rows], return_inverse=True)
            inverse = inverse.reshape(len(rows), length)
            at = tx.ranges(first[used], count[used])
            own = np.repeat(np.arange(len(used)), count[used])
            sums = np.stack([np.bincount(own, weights[feature[at], k], len(used)) for k in range(y)], axis=1)
            scores = (sums * scale[used, None])[inverse]
            factor = np.exp(scores - scores.max(axis=2, keepdims=True))
            move = np.exp(trans)
            ahead, behind = np.empty_like(factor), np.ones_like(factor)
            state = factor[:, 0] / factor[:, 0].sum(axis=1, keepdims=True)
            ahead[:, 0] = state
            for t in range(1, length):
                state = (state @ move) * factor[:, t]
                state /= state.sum(axis=1, keepdims=True)
                ahead[:, t] = state
            expected = np.zeros((y, y))
            for t in range(length - 2, -1, -1):
                next_ = factor[:, t + 1] * behind[:, t + 1]
                pair = ahead[:, t, :, None] * move * next_[:, None, :]
                expected += (pair / pair.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
                state = next_ @ move.T
                behind[:, t] = state / state.sum(axis=1, keepdims=True)
            post = ahead * behind
            post /= post.sum(axis=2, keepdims=True)
            truth = tags[rows]
            slope = -post
            np.put_along_axis(slope, truth[:, :, None], np.take_along_axis(slope, truth[:, :, None], 2) + 1, 2)
            by_word = np.zeros((len(used), y))
            np.add.at(by_word, inverse.ravel(), slope.reshape(-1, y))
            change = np.zeros((len(at), y))
            change[:] = (by_word * scale[used, None])[own]
            touched, where = np.unique(feature[at], return_inverse=True)
            grad = np.stack([np.bincount(where, change[:, k], len(touched)) for k in range(y)], axis=1)
            grad -= DECAY * weights[touched]
            squares[touched] += grad**2
            weights[touched] += STEP * grad / np.sqrt(squares[touched])
            seen = np.zeros((y, y))
            np.add.at(seen, (truth[:, :-1].ravel(), truth[:, 1:].ravel()), 1)
            grad = seen - expected
            trans_squares += grad**2
            trans += STEP * grad / np.sqrt(trans_squares)
    share = np.bincount(tags.ravel(), minlength=y) + 1.0
    return Field(languages, weights.astype(np.float32), np.exp(trans), share / share.sum())


def _spread(text: Column) -> Column:
    """The text, or passages spread over it of SAMPLE_CHARS characters together, less the words cut at their ends."""
    size = SAMPLE_CHARS // SAMPLE_PASSAGES
    room, parts = F.char_length(text) - size, []
    for k in range(SAMPLE_PASSAGES):
        start = F.floor(room * k / (SAMPLE_PASSAGES - 1)).cast("int")
        part = F.substring(text, start + 1, F.lit(size))
        part = F.regexp_replace(part, r"^\S{1,40}\s", "") if k else part
        parts.append(F.regexp_replace(part, r"\s\S{1,40}$", "") if k < SAMPLE_PASSAGES - 1 else part)
    return F.when(F.char_length(text) <= SAMPLE_CHARS, text).otherwise(F.concat_ws(" ", *parts))


def sample(docs: DataFrame, text_col: str, lang_col: str, key: str) -> list[tuple[str, str]]:
    """Passages of at most SAMPLE_DOCS documents of each language, the first by a hash of `key` and text (text, language).

    Rows of one language with the same key and text are one document. The smallest hashes are picked by a rank whose limit
    holds in each task already, and texts are cut before they leave their tasks: the driver gets the sample, nothing more."""
    text = F.col(text_col).cast("string")
    rows = docs.select(
        text.alias("text"),
        F.col(lang_col).cast("string").alias("lang"),
        F.xxhash64(F.col(key).cast("string"), text).alias("order"),
    ).where("lang is not null and text is not null")
    languages = rows.select("lang").distinct().limit(MOST_LANGUAGES + 1).count()
    if languages > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("order"))
    first = rows.select("lang", "order").distinct().withColumn("rank", rank).where(F.col("rank") <= SAMPLE_DOCS)
    picked = rows.join(F.broadcast(first.select("lang", "order")), ["lang", "order"])
    texts = picked.select("lang", "order", _spread(F.col("text")).alias("text")).groupBy("lang", "order")
    found = sorted((r.lang, r.order, r.text) for r in texts.agg(F.min("text").alias("text")).collect())
    return [(text, lang) for lang, _, text in found]


def word_posteriors(codes: np.ndarray, first: np.ndarray, emission: np.ndarray, field: Field) -> np.ndarray:
    """Posterior of each language for each word; `codes` number the emissions, `first` the words of each text."""
    y = len(field.languages)
    factor = np.exp(emission - emission.max(axis=1, keepdims=True)) + 1e-12
    move = field.transitions / field.transitions.max()
    counts = np.diff(first)
    blocks = -(-counts // BLOCK)
    lead = np.concatenate([[0], np.cumsum(blocks)])
    total = int(lead[-1])
    if not total:
        return np.zeros((0, y))
    doc = np.repeat(np.arange(len(counts)), blocks)
    begin = first[doc] + (np.arange(total) - lead[doc]) * BLOCK
    size = np.minimum(first[doc + 1] - begin, BLOCK)
    step = np.arange(BLOCK)
    real = step[None, :] < size[:, None]
    at = np.where(real, begin[:, None] + step, begin[:, None])
    own = factor[codes[at]]  # block, step, language
    del at

    def normal(x: np.ndarray) -> np.ndarray:
        return x / x.sum(axis=tuple(range(1, x.ndim)), keepdims=True)

    transfer = np.broadcast_to(np.eye(y), (total, y, y)).copy()
    for t in range(BLOCK):
        new = (transfer.reshape(-1, y) @ move).reshape(total, y, y) * own[:, t, None, :]
        transfer = normal(np.where(real[:, t, None, None], new, transfer))
    # The state that enters the first block is made such that one step gives the start distribution.
    entry = np.linalg.lstsq(move.T, field.start, rcond=None)[0].clip(1e-9)
    into, back = np.empty((total, y)), np.ones((total, y))
    docs = np.flatnonzero(blocks)
    into[lead[docs]] = entry
    for k in range(1, int(blocks.max())):
        here = lead[docs[blocks[docs] > k]] + k
        into[here] = normal(np.einsum("by,byz->bz", into[here - 1], transfer[here - 1]))
    for k in range(int(blocks.max()) - 1, 0, -1):
        here = lead[docs[blocks[docs] > k]] + k
        back[here - 1] = normal(np.einsum("byz,bz->by", transfer[here], back[here]))
    ahead = np.empty_like(own)
    state = normal(into)
    for t in range(BLOCK):
        state = np.where(real[:, t, None], normal((state @ move) * own[:, t]), state)
        ahead[:, t] = state
    state = back
    for t in range(BLOCK - 1, -1, -1):
        ahead[:, t] *= state
        state = np.where(real[:, t, None], normal((state * own[:, t]) @ move.T), state)
    post = ahead[real]
    return post / post.sum(axis=1, keepdims=True)


def _predict(array: pa.Array, field: Field, spans: bool = True) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    words = tx.words_of(array)
    n, y = len(array), len(field.languages)
    codes, vocabulary = words.codes()
    none = pa.nulls(n, pa.list_(_SPAN_ARROW))
    if not len(codes):
        return np.zeros(n, np.int64), np.zeros(n), none
    post = word_posteriors(codes, words.first, _emissions(vocabulary, field.weights), field)
    doc = np.repeat(np.arange(n), np.diff(words.first))
    counted = _lettered(vocabulary)[codes].astype(float)
    sums = np.stack([np.bincount(doc, post[:, k] * counted, n) for k in range(y)], axis=1)
    best = sums.argmax(axis=1)
    score = sums[np.arange(n), best] / np.maximum(sums.sum(axis=1), 1e-9)
    return best, score.clip(0, 1), _spans(words, post.argmax(axis=1), field.languages) if spans else none


def _spans(words: tx.Words, label: np.ndarray, languages: list[str]) -> pa.Array:
    """Runs of words with one language in each text: first word, past-last word, language."""
    doc = np.repeat(np.arange(len(words.first) - 1), np.diff(words.first))
    edge = np.ones(len(label), bool)
    edge[1:] = (label[1:] != label[:-1]) | (doc[1:] != doc[:-1])
    a, b = tx.runs(edge)
    base = words.first[doc[a]]
    lists = np.searchsorted(doc[a], np.arange(len(words.first)))
    spans = pa.StructArray.from_arrays(
        [pa.array(a - base), pa.array(b - base), pa.array(languages, pa.string()).take(pa.array(label[a]))],
        ["start", "end", "lang"],
    )
    return pa.ListArray.from_arrays(pa.array(lists, pa.int32()), spans)


_SPAN_ARROW = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("lang", pa.string())])
_SPAN = T.StructType().add("start", T.LongType()).add("end", T.LongType()).add("lang", T.StringType())
_RESULT = T.StructType().add("lang", T.StringType()).add("score", T.DoubleType()).add("spans", T.ArrayType(_SPAN))


def labelled(
    docs: DataFrame,
    field: Field,
    *,
    text_col: str = "text",
    into: str = "language",
    spans: bool = True,
    piece_bytes: int = tx.CHUNK_BYTES // 2,
) -> DataFrame:
    """The same rows with a struct column `into`: `lang`, `score` and, if asked for, `spans` (word ranges by language).

    Null, empty and letterless texts are `und` with score 0; so is everything if the field knows no language. Rows are
    judged alone, so repeated rows agree.
    """
    known = docs.sparkSession.sparkContext.broadcast(field) if field.languages else None
    text = F.col(text_col).cast("string")
    none = F.struct(
        F.lit(UNDETERMINED).alias("lang"), F.lit(0.0).alias("score"), F.array().cast(T.ArrayType(_SPAN)).alias("spans")
    )
    if known is None:
        return docs.withColumn(into, none)

    @F.arrow_udf(_RESULT)
    def judged(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = known.value
        names = pa.array(own.languages, pa.string())
        for batch in batches:
            parts = []
            sizes = np.diff(tx.text_bytes(batch)[1])
            for part in tx.pieces(batch, sizes, piece_bytes) if len(batch) else ():
                best, score, found = _predict(part, own, spans)
                parts.append(
                    pa.StructArray.from_arrays([names.take(pa.array(best)), pa.array(score), found], ["lang", "score", "spans"])
                )
                del part
            del batch
            yield pa.concat_arrays(parts)

    has_letter = F.coalesce(text.rlike(r"\p{L}"), F.lit(False))
    seen = docs.withColumn(into, judged(tx.closed_text(F.lower(text))))
    return seen.withColumn(into, F.when(has_letter, F.col(into)).otherwise(none))


def trained(docs: DataFrame, *, text_col: str = "text", lang_col: str = "lang", key: str = "doc_id") -> Field:
    rows = sample(docs, text_col, lang_col, key)
    return fit([t for t, _ in rows], [lang for _, lang in rows])


def remainder(column: str, of: int) -> Column:
    """crc32 of the id as text, modulo `of`; null ids count as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % of


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of all documents, learned from those of three of four folds."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    held_out = remainder("doc_id", 4) == 2
    field = trained(docs.where(~held_out))
    return labelled(docs.select("doc_id", "text"), field, spans=False).select(
        "doc_id", held_out.alias("held_out"), F.col("language.lang").alias("lang_pred"), F.col("language.score").alias("score")
    )

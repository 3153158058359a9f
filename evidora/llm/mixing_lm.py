"""Language-model scores by logistic mixing of hashed-context bit predictors.

A text is a sequence of words and one end. A word is spelled byte by byte, each byte as a path in one binary code tree, with a
blank as its last byte. For every bit several predictors look up how often it was 0 and 1 after a hashed context: the last one
to five bytes, and the whole beginning of the word, each together with the tree's node. Their log odds are
refined by what came true at such counts, and combined by weights of a gate (how well known the contexts are). The frequency
of the whole word joins in by a share. All three are learned from all training words: the refinement from the bit counts
themselves, the weights by Newton's method, each step of which sums up slopes and curvatures over all words by their counts, and the
share from a histogram of all words. Inside a document a cache of its earlier words shares in
the probability, more so the longer the document. The sum of all bits is the score.

Counts cover all training texts. Each piece of the corpus becomes one packed row of its distinct words and word numbers.
Distinct words go to buckets by hash as packed strings; a bucket adds up each word's count, so every distinct word is counted
once and spelled once, not once per occurrence. Counts and spelling scores go back to the pieces as packed arrays. Only the
bit tables (fixed size), the weights and a few sums pass through the driver.
"""

from __future__ import annotations

import heapq
import itertools
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evidora.llm import text as tx
from evidora.llm.components import stored
from evidora.llm.langid import remainder

PIECE_BYTES = 6 << 20
#: Buckets of words for each shuffle partition.
BUCKETS = 2
#: Table size of each predictor as a power of two: contexts of 1 to 5 bytes, and the word so far.
TABLE_BITS = (16, 20, 21, 21, 21, 21)
#: Words that a first guess of the weights is made from, on the driver: the draws made from them, and their number in one step.
SAMPLE_WORDS, DRAWS, BATCH, STEP, SEED = 32_768, 300_000, 128, 0.1, 13
#: Weights are fitted until a step gains less than so much for each bit, in so many passes at most. Pull towards the plain weights,
#: once and for each bit.
GAIN, PASSES, PULL, BIT_PULL = 1e-5, 6, 1.0, 1e-3
#: Bins of the histogram of spelling against frequency, for each power of ten.
RATIO_SCALE = 100
#: Counts travel and are kept as steps on a scale of powers of two: so many for each power, enough for any 64-bit count.
COUNT_SCALE, COUNT_CODES = 8, 512
#: Words spelled at once.
SPELL_WORDS = 4_000
#: Gate: how often the word so far (by powers of two, the last for all above) and the last five bytes (never, seldom, often) were seen.
WORD_GATES, BYTE_GATES, OFTEN = 14, 3, 16
#: Refinement: counts of 0 and of 1 by powers of two, and the weight of no change.
COUNT_STEPS, NO_CHANGE = 16, 4.0
#: Most that the cache shares in a probability, and the number of words at which it has half of that.
CACHE, CACHE_HALF = 0.2, 50.0

_CONTEXTS = len(TABLE_BITS)
_COUNT_OF = np.round(2 ** (np.arange(COUNT_CODES) / COUNT_SCALE) - 1).astype(np.float32)  # small counts come back exactly
_OFFSETS = np.concatenate([[0], np.cumsum([1 << b for b in TABLE_BITS])])
# By step of a count, and again for the count less one.
_LEFT = np.concatenate([_COUNT_OF, np.maximum(_COUNT_OF - 1, 0)])
_LOG = np.log(_LEFT + 0.4)
_STEP = np.ceil(np.log2(_LEFT + 1)).astype(np.int64).clip(0, COUNT_STEPS - 1)


@dataclass
class Tree:
    """A binary code of bytes: nodes and bits on the path of each, one after the other."""

    first: np.ndarray
    node: np.ndarray
    bit: np.ndarray


def code_tree(counts: np.ndarray) -> Tree:
    """Shortest code for the byte counts (each counted once more, so that every byte has a path)."""
    order = itertools.count()
    heap = [(int(n) + 1, next(order), b) for b, n in enumerate(counts)]
    heapq.heapify(heap)
    kids: dict[int, tuple[int, int]] = {}
    name = 256
    while len(heap) > 1:
        a, b = heapq.heappop(heap), heapq.heappop(heap)
        kids[name] = (a[2], b[2])
        heapq.heappush(heap, (a[0] + b[0], next(order), name))
        name += 1
    paths: list[list[tuple[int, int]]] = [[] for _ in range(256)]
    stack: list[tuple[int, list[tuple[int, int]]]] = [(name - 1, [])]
    while stack:
        at, path = stack.pop()
        if at < 256:
            paths[at] = path
        else:
            stack += [(kid, [*path, (at - 256, bit)]) for bit, kid in enumerate(kids[at])]
    flat = [x for path in paths for x in path]
    return Tree(
        np.concatenate([[0], np.cumsum([len(p) for p in paths])]),
        np.array([x[0] for x in flat]),
        np.array([x[1] for x in flat]),
    )


@dataclass
class Bits:
    """Bits that spell some words: the word of each, table slots by predictor, and the byte before."""

    word: np.ndarray
    slots: np.ndarray
    bit: np.ndarray
    before: np.ndarray


def spelled(raw: np.ndarray, starts: np.ndarray, tree: Tree) -> Bits:
    """Bits of words that stand one after the other, each with one blank behind it."""
    word = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
    into = np.arange(len(raw)) - starts[word]
    wide = raw.astype(np.uint64) + np.uint64(1)
    contexts, ahead = [], np.zeros(len(raw), np.uint64)
    for k in range(1, _CONTEXTS):
        moved = np.zeros(len(raw), np.uint64)
        moved[k:] = wide[:-k]
        ahead = ahead * np.uint64(263) + np.where(into >= k, moved, np.uint64(0x20 if k else 0))
        contexts.append(tx.mixed(ahead + np.uint64(k << 56)))
    at = np.arange(len(raw))
    contexts.append(tx.range_hashes(wide, starts[word], at))
    before = np.full(len(raw), 0x20)
    before[into > 0] = raw[:-1][into[1:] > 0] if len(raw) else 0
    length = np.diff(tree.first)[raw]
    step = tx.ranges(tree.first[raw], length)
    byte = np.repeat(at, length)
    node = tree.node[step].astype(np.uint64)
    slots = np.empty((_CONTEXTS, len(step)), np.int32)
    for k, bits in enumerate(TABLE_BITS):
        hashed = (contexts[k][byte] ^ (node * np.uint64(0x9E3779B97F4A7C15))) * np.uint64(0xD6E8FEB86659FD93)
        slots[k] = (hashed >> np.uint64(64 - bits)).astype(np.int64) + _OFFSETS[k]
    return Bits(word[byte], slots, tree.bit[step].astype(np.int8), before[byte])


@dataclass
class Model:
    tree: Tree
    zeros: np.ndarray  # counts by slot, as steps
    ones: np.ndarray
    weights: np.ndarray  # gate by predictor, the last a bias
    refined: np.ndarray  # by predictor and counts: added to the log odds
    share: float = 1.0  # of the spelling in a word's chance; the word's frequency has the rest

    def odds(self, bits: Bits, less: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Inputs (predictor by bit), their places in the refinement, and gates; with `less` each bit itself is left uncounted."""
        n0, n1 = self.zeros[bits.slots].astype(np.int32), self.ones[bits.slots].astype(np.int32)
        if less:
            n0 += COUNT_CODES * (bits.bit == 0)
            n1 += COUNT_CODES * (bits.bit == 1)
        place = (np.arange(_CONTEXTS)[:, None] * COUNT_STEPS + _STEP[n0]) * COUNT_STEPS + _STEP[n1]
        inputs = _LOG[n1] - _LOG[n0] + self.refined.ravel()[place]
        five = _LEFT[n0[-2]] + _LEFT[n1[-2]]
        gate = _steps(_LEFT[n0[-1]] + _LEFT[n1[-1]]).clip(0, WORD_GATES - 1) * BYTE_GATES + (five > 0) + (five > OFTEN)
        return inputs, place, gate

    def chances(self, bits: Bits, less: int = 0) -> np.ndarray:
        """Chance of a 1 for each bit."""
        inputs, _, gate = self.odds(bits, less)
        return _logistic(self.mixed(inputs, gate))

    def mixed(self, inputs: np.ndarray, gate: np.ndarray) -> np.ndarray:
        return (np.einsum("ij,ji->i", self.weights[gate, :-1], inputs) + self.weights[gate, -1]).clip(-12, 12)

    def word_scores(self, raw: np.ndarray, starts: np.ndarray, less: int = 0) -> np.ndarray:
        """log10 of the chance of each word's spelling."""
        out = np.empty(len(starts) - 1)
        for lo in range(0, len(out), SPELL_WORDS):
            hi = min(lo + SPELL_WORDS, len(out))
            bits = spelled(raw[starts[lo] : starts[hi]], starts[lo : hi + 1] - starts[lo], self.tree)
            p = self.chances(bits, less)
            p = np.where(bits.bit == 1, p, 1 - p).clip(1e-6, 1)
            out[lo:hi] = np.bincount(bits.word, np.log10(p), hi - lo)
        return out


def _logistic(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


def _steps(counts: np.ndarray) -> np.ndarray:
    return np.ceil(np.log2(counts + 1)).astype(np.int64).clip(0, COUNT_STEPS - 1)


def plain_weights() -> np.ndarray:
    start = np.zeros((WORD_GATES * BYTE_GATES, _CONTEXTS + 1))
    start[:, -2] = np.repeat(np.linspace(0, 0.9, WORD_GATES), BYTE_GATES)
    start[:, -3] = 0.7 - 0.6 * start[:, -2]
    start[:, -4] = 0.3 - 0.3 * start[:, -2]
    return start


def learn(
    tree: Tree, zeros: np.ndarray, ones: np.ndarray, words: list[bytes], counts: np.ndarray, tokens: int
) -> Model:
    """Refinement, weights and share from draws of words by their counts; each draw is left out of its own counts.

    Where all words are at hand in the tasks, `fitted` goes on from the weights; nothing else is kept."""
    start = plain_weights()
    shape = (_CONTEXTS, COUNT_STEPS, COUNT_STEPS)
    model = Model(tree, zeros, ones, start, np.zeros(shape))
    if not words:
        return model
    rng = np.random.default_rng(SEED)
    drawn = rng.choice(len(words), DRAWS, p=counts / counts.sum())
    squares = np.full(start.shape, 1e-2)
    said, came, seen = (np.zeros(model.refined.size) for _ in range(3))
    for lo in range(0, DRAWS, BATCH):
        some = [words[i] for i in drawn[lo : lo + BATCH]]
        starts = np.concatenate([[0], np.cumsum([len(w) for w in some])])
        bits = spelled(np.frombuffer(b"".join(some), np.uint8), starts, tree)
        inputs, place, gate = model.odds(bits, 1)
        plain = _logistic(inputs - model.refined.ravel()[place])
        said += np.bincount(place.ravel(), plain.ravel(), len(said))
        came += np.bincount(place.ravel(), np.tile(bits.bit, _CONTEXTS), len(said))
        seen += np.bincount(place.ravel(), minlength=len(said))
        said_rate, came_rate = ((x + NO_CHANGE / 2) / (seen + NO_CHANGE) for x in (said, came))
        model.refined = (_logit(came_rate) - _logit(said_rate)).reshape(shape)
        error = bits.bit - _logistic(model.mixed(inputs, gate))
        slope = np.stack([np.bincount(gate, error * x, len(start)) for x in (*inputs, np.ones_like(error))], axis=1)
        squares += slope**2
        model.weights = model.weights + STEP * slope / np.sqrt(squares)
    starts = np.concatenate([[0], np.cumsum([len(w) for w in words])])
    spelling = 10.0 ** model.word_scores(np.frombuffer(b"".join(words), np.uint8), starts, 1)
    whole = (counts - 1) / tokens
    for _ in range(50):
        spelled_part = model.share * 0.999 * spelling
        model.share = float(np.average(spelled_part / (spelled_part + (1 - model.share * 0.999) * whole), weights=counts))
    return model


def _training(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Bytes, starts and counts of the training words, some at a time."""
    for batch in batches:
        for words, counts in zip(batch.column("words").to_pylist(), batch.column("counts").to_pylist(), strict=True):
            raw, counts = _unpack(words, np.uint8), _unpack(counts, np.int64)
            starts = _starts(raw)
            for lo in range(0, len(counts), SPELL_WORDS):
                some = lo + np.flatnonzero(counts[lo : lo + SPELL_WORDS])
                size = starts[some + 1] - starts[some]
                if len(some):
                    yield raw[tx.ranges(starts[some], size)], np.concatenate([[0], np.cumsum(size)]), counts[some]


def _slopes(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    """Of each gate over a task's training words by their counts: loss, bits, slope and curvature of the weights."""
    wide = _CONTEXTS + 1
    sums = np.zeros((WORD_GATES * BYTE_GATES, 2 + wide + wide * wide))
    for raw, starts, counts in _training(batches):
        bits = spelled(raw, starts, model.tree)
        inputs, _, gate = model.odds(bits, 1)
        p = _logistic(model.mixed(inputs, gate))
        n = counts[bits.word].astype(float)
        by = np.argsort(gate.astype(np.uint8), kind="stable")
        x = np.concatenate([inputs, np.ones((1, len(p)))])[:, by]
        error, bend, loss = (n * (bits.bit - p))[by], (n * p * (1 - p))[by], (-n * np.log(np.where(bits.bit, p, 1 - p)))[by]
        n, gate = n[by], gate[by]
        for lo, hi in zip(*tx.runs(np.diff(gate, prepend=-1) != 0), strict=True):
            part, own = x[:, lo:hi], sums[gate[lo]]
            own[0] += loss[lo:hi].sum()
            own[1] += n[lo:hi].sum()
            own[2 : 2 + wide] += part @ error[lo:hi]
            own[2 + wide :] += ((part * bend[lo:hi]) @ part.T).ravel()
    some = np.flatnonzero(sums[:, 1])
    yield pa.RecordBatch.from_arrays(
        [pa.array(some.astype(np.int32)), pa.array([sums[g].tobytes() for g in some], pa.binary())], ["gate", "sums"]
    )


def _gate_sums(table: pa.Table) -> pa.Table:
    total = sum(np.frombuffer(x, np.float64) for x in table.column("sums").to_pylist())
    return pa.table({"gate": table.column("gate")[:1], "sums": pa.array([total.tobytes()], pa.binary())})


def _ratios(batches: Iterator[pa.RecordBatch], model: Model, tokens: int) -> Iterator[pa.RecordBatch]:
    """Histogram of a task's training words, by occurrence: logarithm of spelling against frequency, null where that is zero."""
    n, most = Counter(), 40 * RATIO_SCALE
    logs = Counter()
    for raw, starts, counts in _training(batches):
        spelling = model.word_scores(raw, starts, 1)
        ratio = spelling - np.log10(np.maximum(counts - 1, 0.5) / tokens)
        bins = np.where(counts > 1, np.floor(ratio * RATIO_SCALE).clip(-10 * most, most), most + 1).astype(np.int64)
        value, index = np.unique(bins, return_inverse=True)
        for v, a, b in zip(value.tolist(), np.bincount(index, counts), np.bincount(index, counts * ratio), strict=True):
            n[v] += a
            logs[v] += b
    bins = sorted(n)
    yield pa.RecordBatch.from_arrays(
        [
            pa.array([None if b == most + 1 else b for b in bins], pa.int64()),
            pa.array([n[b] for b in bins], pa.float64()),
            pa.array([logs[b] for b in bins], pa.float64()),
        ],
        ["bin", "n", "logs"],
    )


def fitted(words: DataFrame, model: Model, tokens: int) -> Model:
    """The model with weights and share fitted to all training words; `words` has packed `words` and `counts`."""
    spark = words.sparkSession
    shared = spark.sparkContext.broadcast((model.tree, model.zeros, model.ones, model.refined))

    def of(weights: np.ndarray) -> Model:
        tree, zeros, ones, refined = shared.value
        return Model(tree, zeros, ones, weights, refined)

    plain, wide = plain_weights(), _CONTEXTS + 1
    # Gates are fitted side by side, each by itself.
    at, base, step = model.weights, model.weights, np.zeros_like(plain)
    least, gain = np.full(len(plain), np.inf), np.zeros(len(plain))
    for _ in range(PASSES):
        made = words.mapInArrow(lambda batches, at=at: _slopes(batches, of(at)), "gate int, sums binary")
        sums = np.zeros((len(plain), 2 + wide + wide * wide))
        for row in made.groupBy("gate").applyInArrow(_gate_sums, "gate int, sums binary").collect():
            sums[row.gate] = np.frombuffer(bytes(row.sums), np.float64)
        pull = PULL + BIT_PULL * sums[:, 1]
        loss = sums[:, 0] + pull / 2 * ((at - plain) ** 2).sum(axis=1)
        slope = sums[:, 2 : 2 + wide] - pull[:, None] * (at - plain)
        curve = sums[:, 2 + wide :].reshape(-1, wide, wide) + pull[:, None, None] * np.eye(wide)
        full = np.linalg.solve(curve, slope[:, :, None])[:, :, 0]
        better = loss <= least
        step = np.where(better[:, None], full, step / 2)
        gain = np.where(better, (slope * full).sum(axis=1) / 2, gain)
        base = np.where(better[:, None], at, base)
        least = np.where(better, loss, least)
        at = base + step
        if gain.sum() <= GAIN * sums[:, 1].sum():
            break
    else:
        at = base
    at = np.round(at, 6)  # sums of tasks come in any order
    ratios = words.mapInArrow(lambda batches: _ratios(batches, of(at), tokens), "bin long, n double, logs double")
    rows = ratios.groupBy("bin").agg(F.sum("n").alias("n"), F.sum("logs").alias("logs")).orderBy("bin").collect()
    n = np.array([r.n for r in rows])
    ratio = np.array([np.inf if r.bin is None else 10.0 ** (r.logs / r.n) for r in rows])
    share = 1.0
    for _ in range(200):
        part = share * 0.999
        share = float(np.average(1 / (1 + (1 - part) / (part * ratio)), weights=n))
    return Model(model.tree, model.zeros, model.ones, at, model.refined, round(share, 6))


def _logit(p: np.ndarray) -> np.ndarray:
    return np.log(p / (1 - p))


def _pack(array: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=3).compress(np.ascontiguousarray(array).tobytes())


def _unpack(data: bytes, kind) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(data), kind)


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per piece: ids, training flags and numbers of words of its texts, distinct words, word numbers."""
    for batch in tx.text_pieces(batches, "text", PIECE_BYTES):
        words = tx.words_of(batch.column("text"))
        codes, vocabulary = words.codes()
        ids = batch.column("doc_id")
        train = batch.column("train").to_numpy(zero_copy_only=False)
        about = np.stack(
            [
                ids.is_valid().to_numpy(zero_copy_only=False),
                ids.fill_null(0).to_numpy(zero_copy_only=False),
                train,
                np.diff(words.first),
            ],
            axis=1,
        ).astype(np.int64)
        trained = np.repeat(train, np.diff(words.first))
        counts = np.bincount(codes[trained], minlength=len(vocabulary))
        raw = tx.text_bytes(vocabulary)[0] if len(vocabulary) else np.zeros(0, np.uint8)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([_pack(about)], pa.binary()),
                pa.array([_pack(raw)], pa.binary()),
                pa.array([_pack(counts.astype(np.int64))], pa.binary()),
                pa.array([_pack(codes.astype(np.int32))], pa.binary()),
                pa.array([np.bincount(raw, minlength=256).tolist()], pa.list_(pa.int64())),
                pa.array([int(train.sum())]),
            ],
            ["about", "words", "counts", "codes", "bytes", "trained"],
        )


def _starts(raw: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.flatnonzero(raw == 0x20) + 1]).astype(np.int64)


def _deal(batches: Iterator[pa.RecordBatch], buckets: int) -> Iterator[pa.RecordBatch]:
    """The distinct words of each piece by bucket."""
    for batch in batches:
        for piece, words, counts in zip(*(batch.column(c).to_pylist() for c in ("piece", "words", "counts")), strict=True):
            raw = _unpack(words, np.uint8)
            array = tx.blank_ended(raw, _starts(raw))
            if not len(array):
                continue
            target = (tx.value_hashes(array) % np.uint64(buckets)).astype(np.int64)
            by = np.argsort(target, kind="stable")
            counts = _unpack(counts, np.int64)
            out = []
            for lo, hi in zip(*tx.runs(np.diff(target[by], prepend=-1) != 0), strict=True):
                some = by[lo:hi]
                part = tx.text_bytes(array.take(pa.array(some)))[0]
                out.append((int(target[some[0]]), piece, _pack(part), _pack(counts[some]), _pack(some.astype(np.int32))))
            columns = list(zip(*out, strict=True))
            kinds = (pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary())
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["bucket", "piece", "words", "counts", "place"]
            )


def _count(table: pa.Table) -> pa.Table:
    """One row per bucket: distinct words, their counts, and for each piece its words' numbers here and places there."""
    parts = table.select(["piece", "words", "counts", "place"]).to_pylist()
    raw = np.concatenate([_unpack(p["words"], np.uint8) for p in parts])
    coded = tx.blank_ended(raw, _starts(raw)).dictionary_encode()
    codes = coded.indices.to_numpy(zero_copy_only=False)
    counts = np.bincount(codes, np.concatenate([_unpack(p["counts"], np.int64) for p in parts]), len(coded.dictionary))
    places = [_unpack(p["place"], np.int32) for p in parts]
    ends = np.cumsum([len(p) for p in places])
    codes = np.split(codes.astype(np.int32), ends[:-1])
    back = [
        {"piece": p["piece"], "codes": _pack(c), "place": _pack(at)} for p, c, at in zip(parts, codes, places, strict=True)
    ]
    return pa.table(
        {
            "words": pa.array([_pack(tx.text_bytes(coded.dictionary)[0])], pa.binary()),
            "counts": pa.array([_pack(counts.astype(np.int64))], pa.binary()),
            "types": pa.array([int((counts > 0).sum())]),
            "tokens": pa.array([int(counts.sum())]),
            "back": pa.array([back], pa.list_(_BACK_ARROW)),
        }
    )


_BACK = "back array<struct<piece: bigint, codes: binary, place: binary>>"
_BACK_ARROW = pa.struct([("piece", pa.int64()), ("codes", pa.binary()), ("place", pa.binary())])


def _tables(batches: Iterator[pa.RecordBatch], tree: Tree) -> Iterator[pa.RecordBatch]:
    """Bit counts of a task's words, in blocks of 65,536 slots."""
    size = int(_OFFSETS[-1])
    totals = np.zeros((2, size), np.int64)
    for batch in batches:
        for words, counts in zip(batch.column("words").to_pylist(), batch.column("counts").to_pylist(), strict=True):
            raw, counts = _unpack(words, np.uint8), _unpack(counts, np.int64)
            starts = _starts(raw)
            for lo in range(0, len(counts), SPELL_WORDS):
                hi = min(lo + SPELL_WORDS, len(counts))
                bits = spelled(raw[starts[lo] : starts[hi]], starts[lo : hi + 1] - starts[lo], tree)
                weight = counts[lo:hi][bits.word]
                for bit in (0, 1):
                    some = np.flatnonzero(bits.bit == bit)
                    for slots in bits.slots:
                        np.add.at(totals[bit], slots[some], weight[some])
    for block, lo in enumerate(range(0, size, 1 << 16)):
        part = totals[:, lo : lo + (1 << 16)]
        if part.any():
            yield pa.RecordBatch.from_arrays(
                [pa.array([block], pa.int32()), pa.array([_pack(part)], pa.binary())], ["block", "counts"]
            )


def _add(table: pa.Table) -> pa.Table:
    total = sum(_unpack(x, np.int64) for x in table.column("counts").to_pylist()).reshape(2, -1)
    steps = np.round(np.log2(total + 1.0) * COUNT_SCALE).clip(0, COUNT_CODES - 1).astype(np.uint16)
    # What each counted bit would be told without itself, and what it is, by steps of the counts.
    told = np.zeros((3, COUNT_STEPS * COUNT_STEPS))
    for bit in (0, 1):
        n0, n1 = (steps[b].astype(np.int32) + COUNT_CODES * (bit == b) for b in (0, 1))
        place, n = _STEP[n0] * COUNT_STEPS + _STEP[n1], total[bit].astype(float)
        for k, weight in enumerate((n * _logistic(_LOG[n1] - _LOG[n0]), n * bit, n)):
            told[k] += np.bincount(place, weight, told.shape[1])
    return pa.table(
        {
            "block": table.column("block")[:1].cast(pa.int32()),
            "counts": pa.array([_pack(steps)], pa.binary()),
            "told": pa.array([_pack(told)], pa.binary()),
        }
    )


def _samples(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """The words of each bucket that are first by a hash, with their counts."""
    for batch in batches:
        for words, counts in zip(batch.column("words").to_pylist(), batch.column("counts").to_pylist(), strict=True):
            raw, counts = _unpack(words, np.uint8), _unpack(counts, np.int64)
            array = tx.blank_ended(raw, _starts(raw))
            known = np.flatnonzero(counts)
            some = known[np.argsort(tx.mixed(tx.value_hashes(array)[known] + np.uint64(1)), kind="stable")[:most]]
            if len(some):
                yield pa.RecordBatch.from_arrays(
                    [array.take(pa.array(some)).cast(pa.binary()), pa.array(counts[some])], ["word", "n"]
                )


def _give_back(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    """Counts and scores of each piece's words of a bucket."""
    for batch in batches:
        for words, counts, back in zip(*(batch.column(c).to_pylist() for c in ("words", "counts", "back")), strict=True):
            raw, counts = _unpack(words, np.uint8), _unpack(counts, np.int64)
            scores = model.word_scores(raw, _starts(raw)).astype(np.float32)
            for b in back:
                codes = _unpack(b["codes"], np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([b["piece"]]),
                        pa.array([b["place"]], pa.binary()),
                        pa.array([_pack(counts[codes])], pa.binary()),
                        pa.array([_pack(scores[codes])], pa.binary()),
                    ],
                    ["piece", "place", "counts", "scores"],
                )


def _scored(pieces: pa.Table, words: pa.Table, tokens: int, types: int, ends: int, spelt: float) -> pa.Table:
    """Scores of the texts of one piece."""
    row = pieces.slice(0, 1).to_pylist()[0]
    about = _unpack(row["about"], np.int64).reshape(-1, 4)
    codes = _unpack(row["codes"], np.int32)
    distinct = int((_unpack(row["words"], np.uint8) == 0x20).sum())
    count, score = np.zeros(distinct, np.int64), np.zeros(distinct, np.float32)
    for part in words.to_pylist():
        place = _unpack(part["place"], np.int32)
        count[place], score[place] = _unpack(part["counts"], np.int64), _unpack(part["scores"], np.float32)
    n = len(about)
    doc = np.repeat(np.arange(n), about[:, 3])
    share = tokens + 0.1 * (types + 1)
    base = np.bincount(doc, np.log10((count + 0.1) / share)[codes], n) + np.log10((ends + 0.1) / share)
    end = (ends + 0.5) / (tokens + 1)
    # Words of the same text before this one: all, and those equal to it.
    first = np.concatenate([[0], np.cumsum(about[:, 3])])[doc]
    earlier = np.arange(len(codes)) - first
    key = doc * np.int64(distinct + 1) + codes
    by = np.argsort(key, kind="stable")
    begin, stop = tx.runs(np.diff(key[by], prepend=-1) != 0)
    same = np.empty(len(codes), np.int64)
    same[by] = np.arange(len(codes)) - np.repeat(begin, stop - begin)
    part = CACHE * earlier / (earlier + CACHE_HALF)
    word = spelt * 10.0 ** score.astype(float) + (1 - spelt) * count / max(tokens - ends, 1)
    chance = (1 - part) * word[codes] + part * same / np.maximum(earlier, 1)
    own = np.bincount(doc, np.log10(chance * (1 - end)), n) + np.log10(end)
    return pa.table(
        {
            "doc_id": pa.array(about[:, 1], mask=about[:, 0] == 0),
            "held_out": pa.array(about[:, 2] == 0),
            "n_tokens": pa.array(about[:, 3] + 1),
            "n_known": pa.array((np.bincount(doc, (count > 0)[codes], n) + (ends > 0)).astype(np.int64)),
            "base_score": pa.array(base),
            "score": pa.array(own),
        }
    )


def scores(docs: DataFrame, train: Column, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Scores of all texts by a model of those where `train` holds.

    `doc_id` (long), `held_out`, `n_tokens` (words and the end), `n_known` (tokens seen in training), `train_tokens`,
    `base_score` (additive smoothing over single words) and `score` (both log10 of the text's chance), one row per input row.
    A-Z count in lower case. Null and empty texts are an end alone. A null `train` is false; null ids and repeated rows keep
    their own rows. Without training texts only the smoothing is left. An empty table gives an empty result. Columns besides
    id, text and those in `train` are not looked at.
    """
    spark = docs.sparkSession
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        tx.closed_text(tx.lower_ascii(F.col(text_col).cast("string"))).alias("text"),
        F.coalesce(train, F.lit(False)).alias("train"),
    )
    schema = "about binary, words binary, counts binary, codes binary, bytes array<long>, trained long"
    # Written once, so that a piece keeps its number and its texts whatever is worked out again.
    packed = rows.mapInArrow(_pieces, schema).withColumn("piece", F.monotonically_increasing_id())
    pieces, _ = stored(packed, "pieces")
    sums = pieces.select(F.sum("trained").alias("ends"), *(F.sum(F.col("bytes")[b]).alias(f"b{b}") for b in range(256)))
    sums = sums.first()
    ends, tree = sums.ends or 0, code_tree(np.array([sums[f"b{b}"] or 0 for b in range(256)]))
    buckets = BUCKETS * int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = pieces.select("piece", "words", "counts").mapInArrow(
        lambda batches: _deal(batches, buckets), "bucket int, piece long, words binary, counts binary, place binary"
    )
    counted = dealt.groupBy("bucket").applyInArrow(
        _count, f"words binary, counts binary, types long, tokens long, {_BACK}"
    )
    counted, _ = stored(counted, "counted")
    whole = counted.agg(F.sum("types").alias("types"), F.sum("tokens").alias("tokens")).first()
    tokens, types = (whole.tokens or 0) + ends, (whole.types or 0) + (ends > 0)
    narrow = counted.select("words", "counts")
    blocks = narrow.mapInArrow(lambda batches: _tables(batches, tree), "block int, counts binary")
    both = np.zeros((2, int(_OFFSETS[-1])), np.uint16)
    told = np.zeros((_CONTEXTS, 3, COUNT_STEPS * COUNT_STEPS))
    for row in sorted(blocks.groupBy("block").applyInArrow(_add, "block int, counts binary, told binary").toLocalIterator()):
        part = _unpack(bytes(row["counts"]), np.uint16).reshape(2, -1)
        both[:, row["block"] << 16 : (row["block"] << 16) + part.shape[1]] = part
        told[np.searchsorted(_OFFSETS, row["block"] << 16, side="right") - 1] += _unpack(bytes(row["told"]), float).reshape(3, -1)
    said_rate, came_rate = ((x + NO_CHANGE / 2) / (told[:, 2] + NO_CHANGE) for x in (told[:, 0], told[:, 1]))
    refined = (_logit(came_rate) - _logit(said_rate)).reshape(_CONTEXTS, COUNT_STEPS, COUNT_STEPS)
    each = max(1, SAMPLE_WORDS // buckets)
    sample = sorted((bytes(r.word), r.n) for r in narrow.mapInArrow(lambda b: _samples(b, each), "word binary, n long").collect())
    sample = sample[:: max(1, len(sample) // SAMPLE_WORDS)][:SAMPLE_WORDS]
    model = learn(tree, both[0], both[1], [w for w, _ in sample], np.array([n for _, n in sample], float), whole.tokens)
    model.refined = refined
    if whole.tokens:
        model = fitted(narrow, model, whole.tokens)
    shared, spelt = spark.sparkContext.broadcast(model), model.share
    back = counted.select("words", "counts", "back").mapInArrow(
        lambda batches: _give_back(batches, shared.value), "piece long, place binary, counts binary, scores binary"
    )
    result = (
        pieces.select("piece", "about", "words", "codes")
        .groupBy("piece")
        .cogroup(back.groupBy("piece"))
        .applyInArrow(
            lambda a, b: _scored(a, b, tokens, types, ends, spelt),
            "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double",
        )
    )
    return result.select(
        "doc_id", "held_out", "n_tokens", "n_known", F.lit(tokens).cast("long").alias("train_tokens"), "base_score", "score"
    )


def op7_mixing_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents by a model of nine of ten folds."""
    return scores(spark.read.parquet(f"{sf_dir}/documents.parquet"), remainder("doc_id", 10) != 0)

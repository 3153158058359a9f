"""Words of Arrow text columns as NumPy arrays; the helpers that several operators share."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: A word is a run of anything but the ASCII white space characters.
WORD = r"[^\x20\x09-\x0D]+"
CHUNK_BYTES = 2 << 20

_IS_WORD = np.ones(256, dtype=bool)
_IS_WORD[[0x20, *range(0x09, 0x0E)]] = False
_IS_PLAIN = np.ones(256, dtype=bool)
_IS_PLAIN[[*range(0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]] = False


def fresh(name: str, *taken: list[str]) -> str:
    """The name, with as many underscores behind it as it takes to be none of those taken (in any case)."""
    used = {c.lower() for columns in taken for c in columns}
    while name.lower() in used:
        name += "_"
    return name


def word_count(text: Column) -> Column:
    """Number of words of a text; 0 for null and empty texts."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def closed_text(text: Column) -> Column:
    """The text with one blank after it (null: the blank alone), as `words_of` needs it."""
    return F.concat(F.coalesce(text.cast("string"), F.lit("")), F.lit(" "))


def lower_ascii(text: Column) -> Column:
    """A-Z in lower case, everything else as it is."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def text_bytes(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string array without nulls, and the offsets of its values in them."""
    if isinstance(array, pa.ChunkedArray):
        array = array.combine_chunks()
    kind = np.int64 if pa.types.is_large_string(array.type) or pa.types.is_large_binary(array.type) else np.int32
    if not len(array):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = array.buffers()
    offsets = np.frombuffer(offsets, kind)[array.offset : array.offset + len(array) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def pieces(batch, sizes: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator:
    """Slices of a batch of about `limit` bytes by the sizes of its rows; a longer row makes a slice of its own."""
    ends = np.cumsum(sizes)
    start = 0
    while start < len(sizes):
        base = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, base + limit, side="right")))
        yield batch.slice(start, stop - start)
        start = stop


def text_pieces(batches: Iterator[pa.RecordBatch], column: str, limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            _, offsets = text_bytes(batch.column(batch.schema.names.index(column)))
            yield from pieces(batch, np.diff(offsets), limit)
            del offsets
        del batch  # before the next one comes in


@dataclass
class Words:
    """Words of several texts: each as its bytes and one blank, one after the other."""

    joined: np.ndarray
    starts: np.ndarray  # of the words in `joined`, and its length
    first: np.ndarray  # of each text's words, and the number of words

    def __len__(self) -> int:
        return len(self.starts) - 1

    def array(self) -> pa.Array:
        return blank_ended(self.joined, self.starts)

    def codes(self) -> tuple[np.ndarray, pa.Array]:
        """A number for each word, and the distinct words (with their blank) by number."""
        coded = self.array().dictionary_encode()
        return coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary


def blank_ended(joined: np.ndarray, starts: np.ndarray) -> pa.Array:
    buffers = [None, pa.py_buffer(np.ascontiguousarray(starts, np.int64)), pa.py_buffer(np.ascontiguousarray(joined))]
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts) - 1, buffers)


def words_of(array: pa.Array, plain: bool = False) -> Words:
    """Words of texts made by `closed_text`; if `plain`, runs of anything but ASCII signs and common punctuation."""
    raw, offsets = text_bytes(array)
    word = _IS_WORD[raw]
    if plain:
        word = _IS_PLAIN[raw]
        lead = np.flatnonzero((raw[:-1] == 0xC2) & ((raw[1:] == 0xAB) | (raw[1:] == 0xBB)))  # quotation marks
        word[lead] = word[lead + 1] = False
        # U+2000 to U+206F
        lead = np.flatnonzero((raw[:-2] == 0xE2) & ((raw[1:-1] == 0x80) | (raw[1:-1] == 0x81) & (raw[2:] < 0xB0)))
        word[lead] = word[lead + 1] = word[lead + 2] = False
    end = np.zeros(len(raw), dtype=bool)
    end[1:] = word[:-1] & ~word[1:]
    joined = raw[word | end]
    joined[(end & ~word)[word | end]] = 0x20
    starts = np.concatenate([[0], np.flatnonzero(joined == 0x20) + 1]).astype(np.int64)
    first = np.searchsorted(np.flatnonzero(end), offsets).astype(np.int64)
    return Words(joined, starts, first)


def mixed(values: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, element by element."""
    x = np.asarray(values).astype(np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Powers:
    """Powers of an odd number and of its inverse modulo 2^64, as many as asked for so far."""

    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, np.uint64)

    def to(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = 1 << (n - 1).bit_length()
            for name, base in (("up", self.base), ("down", self.inverse)):
                steps = np.full(size, base & ((1 << 64) - 1), np.uint64)
                steps[0] = 1
                setattr(self, name, np.multiply.accumulate(steps))
        return self.up[:n], self.down[:n]


_BYTES, _ROWS = Powers(0x9E3779B97F4A7C15), Powers(0xD6E8FEB86659FD93)


def range_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, powers: Powers = _ROWS) -> np.ndarray:
    """A hash of values[start:end] for each pair, by one running sum."""
    up, down = powers.to(len(values) + 1)
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values.astype(np.uint64) * up[:-1], out=total[1:])
    return mixed((total[ends] - total[starts]) * down[starts])


def value_hashes(array: pa.Array) -> np.ndarray:
    """A 64-bit hash of each binary value, the same in every task."""
    raw, offsets = text_bytes(array)
    return range_hashes(raw.astype(np.uint64) + np.uint64(1), offsets[:-1], offsets[1:], _BYTES)


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The numbers of all ranges one after the other."""
    total = int(lengths.sum())
    if not total:
        return np.empty(0, np.int64)
    shift = np.repeat(starts - np.concatenate([[0], np.cumsum(lengths)[:-1]]), lengths)
    return np.arange(total, dtype=np.int64) + shift


def runs(breaks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and past-last index of each run, given where a new run begins (the first always does)."""
    first = np.flatnonzero(breaks)
    return first, np.append(first[1:], len(breaks))

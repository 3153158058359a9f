"""Token counts by a compiled finite-state transducer of a piece vocabulary (pair merging by score, byte fallback).

A sequence of pieces is what merging gives for a text if and only if each two neighbours are what merging gives for their
two texts together. The last piece of a prefix therefore settles the whole of it, and the next last piece depends on the
last pieces at the places where a piece may still begin. That is the transducer's state: the beginnings of pieces that the
text ends with, each with the last piece before it and its count relative to the text's. A transition by a character leads
to the next state and carries the number of tokens that it adds (which is negative where a merge joins earlier tokens).
States and transitions are compiled when first met and kept for the life of the worker.

Pieces never reach over the end of a word, so the transducer is in its start state wherever a blank follows something else,
from whatever state it came. Texts are cut into chunks there; the state map of a chunk is then constant, maps compose by
adding up their counts, and the prefix scan over all chunks of a batch is a running sum.
"""

from __future__ import annotations

import functools
import os
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evidora.llm import text as tx

LIMIT = 4096
BLANK = "▁"
#: States kept; beyond, new ones are made for the one text and forgotten.
MOST_STATES = 120_000
PIECE_BYTES = 16 << 20

State = tuple[tuple[str, str, int], ...]  # (beginning of a piece, last piece before it, count before it less the count)


class Node:
    """A state and its compiled transitions: by character the next node and the tokens added."""

    __slots__ = ("moves", "state")

    def __init__(self, state: State):
        self.state = state
        self.moves: dict[str, tuple[Node, int]] = {}


class Transducer:
    def __init__(self, path: str):
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        special = [i for i in range(model.vocab_size()) if model.is_control(i) or model.is_unknown(i) or model.is_byte(i)]
        plain = sorted(set(range(model.vocab_size())) - set(special))
        self.score = {model.id_to_piece(i): model.get_score(i) for i in plain}
        self.inside = {c for piece in self.score for c in piece}
        #: Texts that a longer piece begins with.
        self.open = {sys.intern(piece[:k]) for piece in self.score for k in range(1, len(piece))}
        if any(BLANK in piece.lstrip(BLANK) for piece in self.score):
            raise ValueError("pieces of this vocabulary reach over words")
        self.start: State = (("", "", 0),)
        self.fits = functools.lru_cache(1 << 17)(self._fits)
        self.root = Node(self.start)
        self.shared: dict[tuple[str, str, int], tuple[str, str, int]] = {}
        self.nodes: dict[State, Node] = {self.start: self.root}

    def merged(self, text: str) -> list[str]:
        """Pieces of a short text by merging the pair of highest score, the leftmost of equal ones."""
        parts = list(text)
        while len(parts) > 1:
            best = max(
                ((self.score.get(a + b, -np.inf), -i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)))
            )
            if best[0] == -np.inf:
                break
            i = -best[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return parts

    def _fits(self, before: str, piece: str) -> bool:
        return self.merged(before + piece) == ([before, piece] if before else [piece])

    def _step(self, state: State, char: str) -> tuple[State, int]:
        if char not in self.inside:  # no piece holds it: its bytes are tokens, and nothing merges over it
            now = -max((offset for begin, _, offset in state if begin == ""), default=0) + len(char.encode())
            return self.start, now
        grown = [(begin + char, before, offset) for begin, before, offset in state]
        for text, before, offset in grown:
            if (text in self.score or len(text) == 1) and self.fits(before, text):
                added = offset + (1 if text in self.score else len(text.encode()))
                kept = [(sys.intern(t), p, o - added) for t, p, o in grown if t in self.open]
                return tuple(self.shared.setdefault(x, x) for x in (*kept, ("", sys.intern(text), 0))), added
        raise AssertionError("some piece always ends a text")

    def _compile(self, node: Node, char: str) -> tuple[Node, int]:
        state, added = self._step(node.state, char)
        after = self.nodes.get(state)
        if after is None:
            if len(self.nodes) >= MOST_STATES:
                return Node(state), added
            after = self.nodes[state] = Node(state)
        node.moves[char] = after, added
        return after, added

    def count(self, text: str) -> int:
        """Tokens of a chunk, from the start state."""
        node, total = self.root, 0
        for char in text:
            node, added = node.moves.get(char) or self._compile(node, char)
            total += added
        return total


@functools.cache
def transducer(path: str) -> Transducer:
    return Transducer(path)


def chunk_counts(array: pa.Array, machine: Transducer) -> np.ndarray:
    """Tokens of each text of an array without nulls; texts begin with a blank unless they are empty."""
    raw, offsets = tx.text_bytes(array)
    if not len(raw):
        return np.zeros(len(array), np.int64)
    begins = raw == 0x20
    begins[1:] &= raw[:-1] != 0x20
    begins[offsets[:-1][offsets[:-1] < offsets[1:]]] = True
    starts = np.append(np.flatnonzero(begins), len(raw))
    coded = tx.blank_ended(raw, starts).dictionary_encode()
    chunks = [machine.count(x.decode().replace(" ", BLANK)) for x in coded.dictionary.to_pylist()]
    counts = np.array(chunks, np.int64)[coded.indices.to_numpy(zero_copy_only=False)]
    scanned = np.concatenate([[0], np.cumsum(counts)])
    return np.diff(scanned[np.searchsorted(starts, offsets)])


def token_count(text: Column, path: str) -> Column:
    """Tokens of a text for the vocabulary file at `path`, which every executor has; 0 for null and empty texts."""

    @F.arrow_udf("long")
    def counted(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        machine = transducer(path)
        for batch in batches:
            sizes = np.diff(tx.text_bytes(batch)[1])
            parts = [chunk_counts(part, machine) for part in tx.pieces(batch, sizes, PIECE_BYTES)] if len(batch) else []
            del batch
            yield pa.array(np.concatenate([np.zeros(0, np.int64), *parts]))

    plain = F.translate(F.coalesce(text.cast("string"), F.lit("")), BLANK, " ")
    return counted(F.when(plain == "", plain).otherwise(F.concat(F.lit(" "), plain)))


def token_counts(
    docs: DataFrame, path: str, *, id_col: str = "doc_id", text_col: str = "text", limit: int = LIMIT
) -> DataFrame:
    """`doc_id`, `n_bytes` (of UTF-8), `n_tokens` and `over_limit`, one row per input row.

    Null texts count as empty, empty ones have no bytes and no tokens. Null ids and repeated rows keep their own rows. An
    empty table gives an empty result. Columns besides id and text are not looked at.
    """
    size = F.octet_length(F.coalesce(F.col(text_col).cast("string"), F.lit("")))
    rows = docs.select(
        F.col(id_col).alias("doc_id"), size.cast("long").alias("n_bytes"), token_count(F.col(text_col), path).alias("n_tokens")
    )
    return rows.withColumn("over_limit", F.col("n_tokens") > limit)


def vocabulary(name: str) -> str:
    import public_tokenizers

    return os.fspath(public_tokenizers.path(name))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of all documents for the 32k piece vocabulary."""
    return token_counts(spark.read.parquet(f"{sf_dir}/documents.parquet"), vocabulary("piece_bpe_32k.model"))

"""Secret scans: fixed patterns, and a battery of randomness tests for everything else.

Runs of key-like characters outside the patterns' matches are tested, what is left of a run beside a match too. No encoding holds
an equals sign but as padding, so runs are split there; the pieces of a run between slashes, hyphens and underscores are tested
beside the whole. The smallest usual encoding whose alphabet holds all
their characters is inferred. Under the hypothesis of random characters of that alphabet, a chi-squared test of uniformity,
a test of the number of runs of character classes and a test of the serial correlation of neighbours give p-values; a run
that random characters would hardly give is set aside. Under the hypothesis of words, the chi-squared statistic grows with
the length by the coincidence rate of letters, and digits begin or end seldom; how far a run stays below the one and above the
other gives one p-value, which a longer run can bring lower. The false-discovery rate of these is controlled over all runs
of the corpus (step-up procedure on exact counts by p-value, rounded up to a tenth of a decimal power).
"""

from __future__ import annotations

import math
import re
import string
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evidora.llm import text as tx
from evidora.llm.components import stored

ASSIGN = re.compile(
    r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
RUN = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
#: Candidates in a run: with padding at its end, and between the signs that paths, names and keys of some encodings are cut by.
WHOLE = re.compile(r"[^=]+(?:=+\Z)?")
CUTS = [re.compile(f"[^{cut}]+") for cut in ("=/", "=_-", "=/_-")]
ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
HEX = re.compile(r"[0-9a-f]{32,}")
KINDS = ("assign", "access", "hex", "random")
LEAST_VALUE = 8
#: Shorter runs are not tested.
LEAST_RUN = 20
#: False discoveries among what the tests add, and the p-value below which a run is no random one.
FDR, UNLIKELY = 0.001, 0.001
#: Hypothesis of words: chance that two letters are equal, and that digits begin or end from one character to the next.
COINCIDENCE, CHANGE = 0.065, 0.06

_LOWER, _UPPER, _DIGITS = string.ascii_lowercase, string.ascii_uppercase, string.digits
ENCODINGS = {
    "hex": _DIGITS + "abcdef",
    "HEX": _DIGITS + "ABCDEF",
    "base32": _UPPER + "234567",
    "lower36": _DIGITS + _LOWER,
    "upper36": _DIGITS + _UPPER,
    "alphanumeric": _DIGITS + _UPPER + _LOWER,
    "base64": _UPPER + _LOWER + _DIGITS + "+/",
    "base64url": _UPPER + _LOWER + _DIGITS + "-_",
}
_CODES = {name: {c: i for i, c in enumerate(chars)} for name, chars in ENCODINGS.items()}


def _class(char: str) -> int:
    return 0 if char.isdigit() else 1 if char.islower() else 2 if char.isupper() else 3


_CHANGES = {
    name: 1 - sum((n / len(chars)) ** 2 for n in Counter(map(_class, chars)).values()) for name, chars in ENCODINGS.items()
}


def _below(z: float) -> float:
    return 0.5 * math.erfc(-z / math.sqrt(2))


def _at_least(k: int, n: int, p: float) -> float:
    """Chance of k or more of n, each with chance p."""
    if n > 500:
        return _below((n * p - k + 0.5) / math.sqrt(n * p * (1 - p)))
    return min(1.0, sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k, n + 1)))


def encoding_of(run: str) -> str | None:
    return next((name for name, codes in _CODES.items() if all(c in codes for c in run)), None)


def word_p(run: str) -> float:
    """Chance that words give a run as even and as mixed as this one; 1 if random characters hardly would give it."""
    run = run.rstrip("=")
    name = encoding_of(run)
    if name is None or len(run) < LEAST_RUN or run.isdigit():
        return 1.0
    codes, n = _CODES[name], len(run)
    k = len(codes)
    df = k - 1
    chi = sum(c * c for c in Counter(run).values()) * k / n - n
    spread = 2 / (9 * df)
    p_even = _below(-((max(chi, 1e-9) / df) ** (1 / 3) - 1 + spread) / math.sqrt(spread))
    changes = sum(_class(a) != _class(b) for a, b in zip(run, run[1:], strict=False))
    rate = _CHANGES[name]
    p_runs = 2 * _below(-abs(changes - (n - 1) * rate) / math.sqrt((n - 1) * rate * (1 - rate)))
    values = np.array([codes[c] for c in run], float)
    values -= values.mean()
    total = float(values @ values)
    p_serial = 2 * _below(-abs(float(values[:-1] @ values[1:]) / total) * math.sqrt(n)) if total else 0.0
    if min(p_even, p_runs, p_serial) * 3 < UNLIKELY:
        return 1.0
    excess = n * max(k * COINCIDENCE - 1, 0.1)
    p_word_even = _below((chi - df - excess) / math.sqrt(2 * df + 4 * excess))
    mixed = sum(a.isdigit() != b.isdigit() for a, b in zip(run, run[1:], strict=False))  # words may change their case
    both = max(p_word_even * _at_least(mixed, n - 1, CHANGE), 1e-300)
    return min(1.0, both * (1 - math.log(both)))


def _beside(a: int, b: int, base: list[tuple[int, int]]) -> Iterator[tuple[int, int]]:
    """What is left of a run beside the spans of the patterns (in order of their start)."""
    for x, y in base:
        if x < b and a < y:
            if a < x:
                yield a, x
            a = max(a, y)
    if a < b:
        yield a, b


def _tested(text: str, a: int, b: int) -> list[tuple[int, int]]:
    """Candidates of a run, long enough to be tested: parts between equals signs, and the pieces of some encoding in them."""
    run = text[a:b]
    whole = {m.span() for m in WHOLE.finditer(run) if m.end() - m.start() >= LEAST_RUN}
    pieces = {m.span() for cut in CUTS for m in cut.finditer(run) if m.end() - m.start() >= LEAST_RUN and encoding_of(m[0])}
    inner = {(x, y) for x, y in pieces if not any(x == p and run[y:q].strip("=") == "" for p, q in whole)}
    return sorted((a + x, a + y) for x, y in whole | inner)


def spans_of(text: str) -> list[tuple[str, int, int, float | None]]:
    """All spans (kind, start, end, p) by start, then kind; p is null for those of the patterns."""
    out: list[tuple[str, int, int, float | None]] = []
    if ":" in text or "=" in text:
        out += [("assign", *m.span(), None) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST_VALUE]
    found = [m.span() for m in RUN.finditer(text)]
    for kind, pattern in (("access", ACCESS), ("hex", HEX)):
        out += [(kind, *m.span(), None) for a, b in found for m in pattern.finditer(text, a, b)]
    base = sorted((a, b) for _, a, b, _ in out)
    for a, b in found:
        for x, y in _beside(a, b, base):
            out += [("random", *span, word_p(text[slice(*span)])) for span in _tested(text, x, y)]
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0])))


_KEY = np.zeros(256, bool)
_KEY[[ord(c) for c in ENCODINGS["base64"] + "-_="]] = True
_SPANS = T.ArrayType(
    T.StructType().add("kind", T.StringType()).add("start", T.IntegerType()).add("end", T.IntegerType()).add("p", T.DoubleType())
)
_SPANS_ARROW = pa.list_(
    pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("p", pa.float64())])
)


def _worth_a_look(array: pa.Array) -> np.ndarray:
    """Texts with a colon, an equals sign or a run of key-like characters."""
    raw, offsets = tx.text_bytes(array)
    at = np.searchsorted(offsets, np.flatnonzero((raw == 58) | (raw == 61)), side="right") - 1
    key = np.concatenate([[False], _KEY[raw], [False]])
    edges = np.flatnonzero(key[1:] != key[:-1])
    first, last = edges[::2], edges[1::2]
    long = first[last - first >= 16]  # runs over a border only add texts to look at
    from_run = np.searchsorted(offsets, long, side="right") - 1
    to_run = np.searchsorted(offsets, last[last - first >= 16] - 1, side="right") - 1
    look = np.zeros(len(array) + 1, np.int64)
    np.add.at(look, from_run, 1)
    np.add.at(look, to_run + 1, -1)
    out = np.cumsum(look)[:-1] > 0
    out[at] = True
    return out


@F.arrow_udf(_SPANS)
def _scan(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for batch in batches:
        found: list = [[]] * len(batch)
        sizes, done = np.diff(tx.text_bytes(batch)[1]), 0
        for part in tx.pieces(batch, sizes) if len(batch) else ():
            for i in np.flatnonzero(_worth_a_look(part)):
                spans = spans_of(part[int(i)].as_py())
                found[done + i] = [dict(zip(("kind", "start", "end", "p"), s, strict=True)) for s in spans]
            done += len(part)
            del part
        del batch
        yield pa.array(found, _SPANS_ARROW)


def scanned(text: Column) -> Column:
    """Spans of a text with their p-values; none for null and empty texts."""
    return _scan(F.coalesce(text.cast("string"), F.lit("")))


def threshold(spans: DataFrame, column: str = "spans", rate: float = FDR) -> float:
    """The largest p-value that counts as a secret, over all tested runs of a table; 0 if none does."""
    tested = spans.select(F.explode(column).alias("s")).where("s.p is not null")
    step = F.floor(F.log10(F.col("s.p")) * 10 + 1).cast("int")  # upper edge of the tenth, at most 3,001 of them
    rows = tested.groupBy(F.least(step, F.lit(0)).alias("step")).agg(F.count("*").alias("n")).orderBy("step").collect()
    total, best, below = sum(r.n for r in rows), 0.0, 0
    for row in rows:
        below += row.n
        edge = 10 ** (row.step / 10)
        if edge * total <= rate * below:
            best = edge
    return best


def _counting(column: str, limit: float) -> Column:
    """Spans of the patterns, and tested ones that count as a secret and lie in no other one that does."""
    kept = F.filter(column, lambda s: s["p"].isNull() | (s["p"] <= limit))

    def inside(s: Column, t: Column) -> Column:
        return (
            t["p"].isNotNull()
            & (t["start"] <= s["start"])
            & (s["end"] <= t["end"])
            & (t["end"] - t["start"] > s["end"] - s["start"])
        )

    return F.filter(kept, lambda s: s["p"].isNull() | ~F.exists(kept, lambda t: inside(s, t)))


def secrets(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", rate: float = FDR) -> DataFrame:
    """`doc_id` and `spans` (kind, start, end in code points, p), one row per input row.

    Null and empty texts have no spans. Null ids and repeated rows keep their own rows (a repeated text counts as often as it
    stands there). An empty table gives an empty result. Columns besides id and text are not looked at. Texts are read
    once: their spans are written to the shared folder before the threshold is known.
    """
    rows, _ = stored(docs.select(F.col(id_col).alias("doc_id"), scanned(F.col(text_col)).alias("spans")), "spans")
    limit = threshold(rows, rate=rate)
    return rows.withColumn("spans", _counting("spans", limit))


def _blotted(text: Column, spans: Column) -> Column:
    """The text with each span, or group of spans that overlap or touch, replaced; spans are in order of their start."""
    start = F.struct(F.lit(0).alias("end"), F.lit("").alias("done"))

    def add(so_far: Column, s: Column) -> Column:
        apart = (s["start"] > so_far["end"]) | (so_far["done"] == "")
        before = F.substring(text, so_far["end"] + 1, s["start"] - so_far["end"])
        done = F.when(apart, F.concat(so_far["done"], before, F.lit("[REDACTED]"))).otherwise(so_far["done"])
        return F.struct(F.greatest(so_far["end"], s["end"]).alias("end"), done.alias("done"))

    whole = F.aggregate(spans, start, add)
    rest = F.substring(text, whole["end"] + 1, F.char_length(text))
    return F.when(F.size(spans) > 0, F.concat(whole["done"], rest)).otherwise(text)


def redacted(docs: DataFrame, *, text_col: str = "text", rate: float = FDR) -> DataFrame:
    """The same rows with each secret in the text replaced by `[REDACTED]`; null texts stay null."""
    text = F.col(text_col).cast("string")
    limit = threshold(docs.select(scanned(text).alias("spans")), rate=rate)
    name = tx.fresh("secret_spans", docs.columns)
    seen = docs.withColumn(name, scanned(text))
    seen = seen.withColumn(name, _counting(name, limit))
    return seen.withColumn(text_col, _blotted(text, F.col(name))).select(*docs.columns)


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digest of the spans in all documents."""
    rows = secrets(spark.read.parquet(f"{sf_dir}/documents.parquet"))

    def listed(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    def number(kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    base = F.filter("spans", lambda s: s["p"].isNull())
    return rows.select(
        "doc_id", *map(number, KINDS), F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans")
    )

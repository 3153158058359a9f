"""Text projections: folding, trimming, snippets, titles, short names, fallbacks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from evidora import constants as K

# Code points of white space and line ends that trimming removes.
_SPACE_POINTS = [
    0x09, 0x0A, 0x0B, 0x0C, 0x0D, 0x20, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000,
    0xFEFF,
]
_SPACE = "".join(map(chr, _SPACE_POINTS))


def fold(text: Column) -> Column:
    return F.lower(text)


def trim_all(text: Column) -> Column:
    """Trim every kind of Unicode space, line breaks and the byte-order mark."""
    return F.btrim(text, F.lit(_SPACE))


def has_text(text: Column) -> Column:
    return F.length(trim_all(text)) > 0


def contains_any(text: Column, needles: list[str]) -> Column:
    """True when any needle occurs; the text is expected to be folded already."""
    found = F.lit(False)
    for needle in needles:
        found = found | text.contains(needle)
    return found


def quote_snippet(text: Column, chars: int = K.QUOTE_CHARS) -> Column:
    """First characters with a trailing ellipsis, also when nothing was cut."""
    return F.concat(F.substring(text, 1, chars), F.lit("..."))


def short_title(text: Column, chars: int = K.TITLE_CHARS) -> Column:
    return F.when(F.length(text) > chars, F.concat(F.substring(text, 1, chars), F.lit("..."))).otherwise(text)


def falsy_or(value: Column, default: Column | int | float | str, *, empty: Column | int | str = 0) -> Column:
    """Fallback for null and for the empty value (0 or '') of the column; NaN falls through too.

    For display only: a measured 0 is replaced as well, so never use it inside an average.
    """
    fallback = default if isinstance(default, Column) else F.lit(default)
    blank = empty if isinstance(empty, Column) else F.lit(empty)
    kept = F.nullif(value, blank)
    if not isinstance(empty, str):
        kept = F.when(~F.isnan(kept.cast("double")), kept)
    return F.coalesce(kept, fallback)


def local_part(address: Column, *, delimiter: str = "@", default: str = K.DEFAULT_USER_LABEL) -> Column:
    return F.coalesce(F.nullif(F.substring_index(address, delimiter, 1), F.lit("")), F.lit(default))


def profile_name(full_name: Column, address: Column, *, delimiter: str = "@") -> Column:
    """Given name, else the part of the address before the delimiter."""
    return F.coalesce(full_name, F.split_part(address, F.lit(delimiter), F.lit(1)))


def model_short_name(model: Column) -> Column:
    return F.coalesce(F.nullif(F.split_part(model, F.lit("/"), F.lit(2)), F.lit("")), model)


def row_id(prefix: str, *keys: Column) -> Column:
    """Repeatable row id, so that a rerun of a lost task gives the same one."""
    return F.concat(F.lit(prefix), F.sha2(F.concat_ws("|", *[k.cast("string") for k in keys]), 256))


def evidence_block(index: Column, source: Column, section: Column, page: Column, content: Column) -> Column:
    """One numbered evidence block of the prompt context."""
    return F.concat(
        F.lit("[Evidence Document "), index.cast("string"), F.lit("]:\nSource: "), source,
        F.lit(" ("), section, F.lit(", "), page, F.lit(")\nContent: "), content, F.lit("\n"),
    )


def token_proxy(text: Column, chars_per_token: int = 4) -> Column:
    """Rough token count from the number of characters; a proxy, not a tokenizer."""
    return F.ceil(F.length(text) / F.lit(chars_per_token)).cast("bigint")

"""Structure of markdown-like text, worked out inside the row, so a corpus is never shuffled."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidora.functions.text import trim_all

HEADING = "^#{2,3} "


def once(value: Column, use) -> Column:
    """Evaluate a value once and use it many times, also inside lambdas."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _is_table(trimmed: Column) -> Column:
    return trimmed.startswith("|") & trimmed.endswith("|")


def line_kind(line: Column, trimmed: Column | None = None) -> Column:
    """Kind of a line; the first rule that holds decides."""
    t = trim_all(line) if trimmed is None else trimmed
    inner = F.substring(t, F.lit(3), F.greatest(F.length(t) - 4, F.lit(0)))
    return (
        F.when(t.isin("---", "***", "___"), "rule")
        .when(_is_table(t), "table")
        .when(line.rlike(HEADING), "heading")
        .when(t.startswith("**") & t.endswith("**") & ~inner.contains("**"), "bold_title")
        .when(t.startswith("- ") | t.startswith("• "), "bullet")
        .when(t.rlike(r"^[0-9]+\.\s"), "ordered")
        .when(t == "", "empty")
        .otherwise("paragraph")
    )


def marker_free(line: Column, trimmed: Column, kind: Column) -> Column:
    """Text of a heading, bold title or list line without its marker."""
    return (
        F.when(kind == "heading", F.regexp_replace(line, r"^#+\s*", ""))
        .when(kind == "bold_title", F.regexp_replace(trimmed, r"\*\*", ""))
        .when(kind == "bullet", F.regexp_replace(trimmed, r"^[-•]\s*", ""))
        .when(kind == "ordered", F.regexp_replace(trimmed, r"^[0-9]+\.\s*", ""))
        .otherwise(line)
    )


def lines_of(df: DataFrame, text: str, *keys: str) -> DataFrame:
    """One row per line: its 1-based number, kind, and text without markers."""
    split = df.select(*keys, F.posexplode(F.split(text, "\n")).alias("at", "line"))
    trimmed = split.withColumn("trimmed", trim_all(F.col("line")))
    kinds = trimmed.withColumn("kind", line_kind(F.col("line"), F.col("trimmed")))
    return kinds.select(
        *keys, (F.col("at") + 1).alias("line_no"), "line", "kind",
        marker_free(F.col("line"), F.col("trimmed"), F.col("kind")).alias("content"),
    )


def _cells(trimmed: Column) -> Column:
    return once(
        F.split(trimmed, "[|]"),
        lambda parts: F.transform(F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 2, F.lit(0))), trim_all),
    )


def _table(lines: Column, first: Column, last: Column) -> Column:
    def from_rows(rows: Column) -> Column:
        body = F.filter(
            F.slice(rows, F.lit(2), F.greatest(F.size(rows) - 1, F.lit(0))),
            lambda r: ~F.forall(r, lambda c: c.contains("---") | (c == "")),
        )
        return F.struct((first + 1).alias("first_line"), F.get(rows, F.lit(0)).alias("header"), body.alias("body"))

    return once(F.transform(F.slice(lines, first + 1, last - first + 1), _cells), from_rows)


def tables_of(text: Column) -> Column:
    """Array of tables (first_line, header, body) in a text.

    A table is a run of neighbouring table lines. Runs are found from their first and last lines,
    which pair up in order, so the work is linear in the number of lines.
    """

    def from_lines(lines: Column) -> Column:
        return once(F.transform(lines, _is_table), lambda flags: from_flags(lines, flags))

    def from_flags(lines: Column, flags: Column) -> Column:
        no = F.lit(False)
        positions = F.sequence(F.lit(0), F.size(flags) - 1)
        starts = F.filter(positions, lambda i: F.get(flags, i) & ~F.coalesce(F.get(flags, i - 1), no))
        ends = F.filter(positions, lambda i: F.get(flags, i) & ~F.coalesce(F.get(flags, i + 1), no))
        spans = F.zip_with(starts, ends, lambda s, e: F.struct(s.alias("s"), e.alias("e")))
        return F.transform(spans, lambda span: _table(lines, span["s"], span["e"]))

    return once(F.transform(F.split(text, "\n"), trim_all), from_lines)


def inline_spans(text: Column) -> Column:
    """Bold and code spans in order of appearance: array of (style, text)."""
    found = F.regexp_extract_all(text, F.lit(r"(\*\*.*?\*\*|`.*?`)"), F.lit(1))
    return F.transform(
        found,
        lambda s: F.when(
            s.startswith("**"),
            F.struct(F.lit("bold").alias("style"), F.substring(s, F.lit(3), F.length(s) - 4).alias("text")),
        ).otherwise(F.struct(F.lit("code").alias("style"), F.substring(s, F.lit(2), F.length(s) - 2).alias("text"))),
    )


def formatted_spans(df: DataFrame, text: str, *keys: str) -> DataFrame:
    """Bold and code spans of the lines that are formatted: all but headings, bold titles and rules."""
    lines = lines_of(df, text, *keys).filter(~F.col("kind").isin("heading", "bold_title", "rule"))
    return lines.select(*keys, "line_no", F.inline(inline_spans(F.col("content"))))


def headings_of(text: Column) -> Column:
    return F.transform(
        F.filter(F.split(text, "\n"), lambda line: line.rlike(HEADING)),
        lambda line: F.regexp_replace(line, r"^#+\s*", ""),
    )


def chunk_by_section(
    df: DataFrame, text: str, *keys: str, section_break: str = "#{2,3} ", chunk_chars: int = 1000
) -> DataFrame:
    """Chunks that never cross a section: a line matching ``section_break`` opens a new section,
    and whole lines are packed up to ``chunk_chars``. A longer line is a chunk of its own.
    """
    sections = F.split(text, rf"\n(?={section_break})")
    packed = rf"(?s).{{1,{chunk_chars}}}(?:\n|\z)|[^\n]+(?:\n|\z)"
    by_section = df.select(*keys, F.posexplode(sections).alias("section_at", "section_text"))
    chunks = by_section.select(
        *keys,
        (F.col("section_at") + 1).alias("section_no"),
        F.substring_index("section_text", "\n", 1).alias("section"),
        F.posexplode(F.regexp_extract_all("section_text", F.lit(packed), F.lit(0))).alias("at", "chunk"),
    )
    return chunks.select(
        *keys, "section_no", "section", (F.col("at") + 1).alias("ordinal"),
        F.regexp_replace("chunk", r"\n\z", "").alias("content"),
        # Names the chunk by its place, so a repeated run gives the same id; the title is the section without its marker.
        F.concat_ws(":", *[F.col(k).cast("string") for k in keys], "section_no", F.col("at") + 1).alias("chunk_id"),
        F.regexp_replace("section", r"^#+\s*", "").alias("title"),
    )

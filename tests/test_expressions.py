import pytest
from pyspark.sql import functions as F

from evidora import constants as K
from evidora.functions import language, payloads, scores, text, times


def value(spark, column, schema="a string", row=(None,)):
    return spark.createDataFrame([row], schema).select(column.alias("v")).first()["v"]


@pytest.mark.parametrize(
    "raw, trimmed",
    [
        ("  a b  ", "a b"),
        ("\n\t a \r\n", "a"),
        ("  　a﻿", "a"),
        ("\x85a\x85", "\x85a\x85"),
        ("\n", ""),
        ("", ""),
    ],
)
def test_trim_all(spark, raw, trimmed):
    assert value(spark, text.trim_all(F.col("a")), row=(raw,)) == trimmed


def test_has_text(spark):
    rows = spark.createDataFrame([(" \n ",), ("x",), ("",)], "a string")
    assert [r.a for r in rows.filter(text.has_text(F.col("a"))).collect()] == ["x"]


@pytest.mark.parametrize("length", [0, 5, 119, 120, 121, 300])
def test_quote_always_ends_with_dots(spark, length):
    raw = "x" * length
    assert value(spark, text.quote_snippet(F.col("a")), row=(raw,)) == raw[:120] + "..."


@pytest.mark.parametrize("length", [0, 37, 38, 39, 80])
def test_title_is_cut_only_when_longer(spark, length):
    raw = "y" * length
    assert value(spark, text.short_title(F.col("a")), row=(raw,)) == raw[:38] + ("..." if length > 38 else "")


def test_title_counts_code_points(spark):
    raw = "z" * 37 + "😀" + "tail"
    assert value(spark, text.short_title(F.col("a")), row=(raw,)) == "z" * 37 + "😀..."


@pytest.mark.parametrize("given, shown", [(0, 25), (None, 25), (7, 7), (-1, -1)])
def test_falsy_number(spark, given, shown):
    assert value(spark, text.falsy_or(F.col("a"), K.FALLBACK_RETRIEVAL_MS), "a int", (given,)) == shown


def test_falsy_nan_and_text(spark):
    assert value(spark, text.falsy_or(F.col("a"), 1.5), "a double", (float("nan"),)) == 1.5
    assert value(spark, text.falsy_or(F.col("a"), "Strong", empty=""), row=("",)) == "Strong"
    assert value(spark, text.falsy_or(F.col("a"), "Strong", empty=""), row=(None,)) == "Strong"
    assert value(spark, text.falsy_or(F.col("a"), "Strong", empty=""), row=("Weak",)) == "Weak"


@pytest.mark.parametrize("address, part", [("ann@x.org", "ann"), ("@x.org", "Dr. User"), ("plain", "plain")])
def test_local_part(spark, address, part):
    assert value(spark, text.local_part(F.col("a")), row=(address,)) == part


@pytest.mark.parametrize("model, short", [("a/b", "b"), ("a/b/c", "b"), ("a", "a"), ("a/", "a/")])
def test_model_short_name(spark, model, short):
    assert value(spark, text.model_short_name(F.col("a")), row=(model,)) == short


@pytest.mark.parametrize("x, rounded", [(1.005, 1.0), (0.125, 0.13), (0.945, 0.95), (-0.125, -0.12), (2.0, 2.0)])
def test_round_half_up(spark, x, rounded):
    assert value(spark, scores.round_half_up(F.col("a")), "a double", (x,)) == rounded


@pytest.mark.parametrize("x, band", [(0.85, "high"), (0.845, "high"), (0.844, "good"), (0.7, "good"), (0.5, "fair"), (0.49, "low")])
def test_band_uses_rounded_percentage(spark, x, band):
    assert value(spark, scores.score_band(F.col("a")), "a double", (x,)) == band


def test_mean_of_nothing_is_zero(spark):
    assert value(spark, scores.mean_in_order(F.col("a")), "a array<double>", ([],)) == 0.0
    assert value(spark, scores.mean_in_order(F.col("a")), "a array<double>", (None,)) == 0.0
    assert value(spark, scores.mean_in_order(F.col("a")), "a array<double>", ([0.94, 0.92, 0.96],)) == (0.94 + 0.92 + 0.96) / 3


@pytest.mark.parametrize("raw, lang", [("ما هي", "ar"), ("plain", "en"), ("mixed كلمة", "ar"), ("ﷺ", "ar"), ("é", "en"), ("", "en")])
def test_detected_language(spark, raw, lang):
    assert value(spark, language.detected_language(F.col("a")), row=(raw,)) == lang


@pytest.mark.parametrize(
    "raw, content, tokens",
    [
        ('{"choices":[{"message":{"content":"hi"}}],"usage":{"total_tokens":7}}', "hi", 7),
        ('{"choices":[],"usage":{"total_tokens":0}}', "", 350),
        ('{"usage":null}', "", 350),
        ("not json", "", 350),
        (None, "", 350),
    ],
)
def test_response_fields(spark, raw, content, tokens):
    assert value(spark, payloads.response_content(F.col("a")), row=(raw,)) == content
    assert value(spark, payloads.response_tokens(F.col("a")), row=(raw,)) == tokens


def test_translated_text_falls_back(spark):
    blank = '{"choices":[{"message":{"content":"  "}}]}'
    found = '{"choices":[{"message":{"content":" salut "}}]}'
    assert value(spark, payloads.translated_text(F.col("a"), F.lit("q")), row=(blank,)) == "q"
    assert value(spark, payloads.translated_text(F.col("a"), F.lit("q")), row=(found,)) == "salut"


def test_epoch_round_trip(spark):
    assert value(spark, times.to_epoch_ms(times.from_epoch_ms(F.col("a"))), "a bigint", (1704067200123,)) == 1704067200123
    assert value(spark, times.hour_minute(times.from_epoch_ms(F.col("a"))), "a bigint", (1704067200123,)) == "00:00"


def test_row_id_repeats(spark):
    row = spark.range(1).select(text.row_id("msg_", F.lit(1), F.lit("a")).alias("x"), text.row_id("msg_", F.lit(1), F.lit("a")).alias("y")).first()
    assert row.x == row.y and row.x.startswith("msg_")

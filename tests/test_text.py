"""Text functions on hand-written cases."""

from __future__ import annotations

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quire.functions import text as X
from quire.functions.geometry import is_figure, polygon_box, x_band
from quire.functions.units import drawing_points, points


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'double' if isinstance(v, float) else 'int' if isinstance(v, int) else 'string'}" for k, v in values.items()))
    return row.select(column.alias("r")).first()["r"]


def test_white_space_of_every_kind_is_one_space(spark):
    odd = "  a  b﻿\x0bc\t\n d\u0085 "
    assert one(spark, X.normalized(F.col("t")), t=odd) == "a b c d\u0085"  # a next-line character is no white space here


def test_comparable_joins_hyphens_and_drops_punctuation(spark):
    assert one(spark, X.comparable(F.col("t")), t="Hyphen-\n ated, (Words) [End].") == "hyphenated words end"
    assert one(spark, X.words(F.col("t")), t="Large words, large WORDS and more; words") == ["large", "words"]


@pytest.mark.parametrize(("text", "readable"), [("a", False), ("ab", True), ("--ab", True), ("-----ab", False), ("", False), ("\U0001f600a", False)])
def test_readable(spark, text, readable):
    assert one(spark, X.is_readable(F.col("t")), t=text) is readable


def test_noise(spark):
    urls = "http://a " * 4
    assert one(spark, X.is_noise(F.col("t")), t="x �") is True
    assert one(spark, X.is_noise(F.col("t")), t="in Microsoft  Himalaya") is True
    assert one(spark, X.is_noise(F.col("t")), t=urls) is False
    assert one(spark, X.is_noise(F.col("t")), t=urls + "w " * 600) is True


def test_line_classes(spark):
    assert one(spark, X.is_caption(F.col("t")), t=" Tabell 3 : Mått") is True
    assert one(spark, X.is_caption(F.col("t")), t="Tabellen 3:") is False
    assert one(spark, X.is_source_note(F.col("t")), t="KÄLLA : x") is True
    assert one(spark, X.is_footnote(F.col("t")), t="12 note") is True
    assert one(spark, X.is_table_cell(F.col("t")), t="x" * 36) is False


def test_coverage_of_nothing(spark):
    values = [one(spark, f(F.col("s"), F.col("t")), s="a b", t="whole text") for f in (X.coverage_canonical, X.coverage_words, X.coverage_text, X.page_score)]
    assert values == [0.0, 1.0, 1.0, 0.0]


def test_coverage_counts_words_or_distinct_words(spark):
    source, target = "house house tree stone", "a treehouse"
    assert one(spark, X.coverage_words(F.col("s"), F.col("t")), s=source, t=target) == 0.75
    assert one(spark, X.coverage_text(F.col("s"), F.col("t")), s=source, t=target) == 0.5


def test_landmark_drops_the_cut_word(spark):
    assert one(spark, X.landmark(F.col("t"), 9), t="alpha beta gamma") == "alpha"
    assert one(spark, X.landmark(F.col("t"), 80), t="single") == "single"


@pytest.mark.parametrize(("text", "value", "drawing"), [("2in", 144.0, 144.0), ("2.5pt", 2.5, 2.5), ("1cm", 1.0, 28.3464566929), ("7", 7.0, 7.0), ("x", None, None), ("", None, None), ("xin", None, None), ("-1.5in", -108.0, -108.0)])
def test_units(spark, text, value, drawing):
    assert one(spark, points(F.col("t")), t=text) == value
    assert one(spark, drawing_points(F.col("t")), t=text) == drawing


def test_polygon_leaves_out_negative_points(spark):
    box = one(spark, polygon_box(F.col("t")), t="drawPolygon (svg:x: 1in, svg:y: 2in) (svg:x: -3in, svg:y: 0in) (svg:x: 2in, svg:y: 5in)")
    assert tuple(box) == (72.0, 144.0, 72.0, 216.0)
    assert one(spark, polygon_box(F.col("t")), t="drawPolygon ()") is None


def test_bands_round_halves_up(spark):
    assert [one(spark, x_band(F.col("x")), x=v) for v in (-6.0, -6.1, 6.0, 5.9)] == [0, -1, 1, 0]


def test_figure(spark):
    def figure(x, y, w, h):
        return one(spark, is_figure(*(F.col(c) for c in ("x", "y", "w", "h", "pw", "ph"))), x=x, y=y, w=w, h=h, pw=600.0, ph=800.0)

    assert figure(0.0, 200.0, 400.0, 200.0) and not figure(0.0, 200.0, 400.0, 7.0) and not figure(0.0, 20.0, 200.0, 80.0) and not figure(0.0, 750.0, 400.0, 200.0)


def test_colour(spark):
    assert one(spark, X.color_hex(F.col("c")), c=255) == "#0000ff"
    assert one(spark, X.sanitized(F.col("t")), t="a\r\x00b") == "ab"


@settings(max_examples=12, deadline=None)
@given(st.text(alphabet=st.sampled_from("ab \t\n  é"), max_size=30))
def test_normalized_is_stable(spark, text):
    plain = one(spark, X.normalized(F.col("t")), t=text)
    assert one(spark, X.normalized(F.col("t")), t=plain) == plain
    assert plain == " ".join("".join(" " if c in "\t\n  " else c for c in text).split())

"""Operators on ordered rows, dictionaries."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.operators import dictionary as D
from quire.operators import sequences as S


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


def test_adjacent_runs_merge_also_on_nulls(spark):
    df = spark.createDataFrame([("d", 1, None, "a"), ("d", 2, None, "b"), ("d", 3, "x", "c"), ("d", 4, None, "d"), ("d", 5, None, "e")], "doc string, no int, style string, text string")
    assert rows(S.merge_adjacent(df, ["doc"], ["no"], ["style"], "text"), "run_no") == [("d", 1, None, "ab", 2), ("d", 2, "x", "c", 1), ("d", 3, None, "de", 2)]


def test_longest_run_breaks_at_empty_and_long(spark):
    lengths = [1] * 19 + [0] + [1] * 20 + [5]
    df = spark.createDataFrame([("d", k, n) for k, n in enumerate(lengths)], "doc string, no int, n int")
    assert rows(S.longest_runs(df, ["doc"], ["no"], F.col("n") == 1), "doc") == [("d", 39, 20, True)]
    assert rows(S.longest_runs(df.where("no < 19"), ["doc"], ["no"], F.col("n") == 1), "doc") == [("d", 19, 19, False)]


def test_carried_value_can_be_null(spark):
    df = spark.createDataFrame([(1, "set", "a"), (2, "x", None), (3, "set", None), (4, "x", None), (5, "set", "b"), (6, "x", None)], "no int, kind string, v string").withColumn("doc", F.lit("d"))
    out = S.carry_forward(df, ["doc"], ["no"], F.col("kind") == "set", F.col("v"), "now")
    assert [r["now"] for r in out.orderBy("no").collect()] == ["a", "a", None, None, "b", "b"]


def test_take_until(spark):
    df = spark.createDataFrame([(["a", "b", "!", "c"],), (["a"],), (["!"],), ([],)], "t array<string>")
    assert [r["r"] for r in df.select(S.take_until(F.col("t"), lambda x: x == "!").alias("r")).collect()] == [["a", "b"], ["a"], [], []]


def test_first_flags_and_offsets(spark):
    df = spark.createDataFrame([(1, "same text that is long enough, yes"), (2, "same text that is long enough, yes"), (3, "x"), (4, "x")], "no int, t string").withColumn("doc", F.lit("d"))
    out = S.first_flags(df, F.col("t"), "no", ["doc"], F.length("t") >= 32)
    assert [r["first"] for r in out.orderBy("no").collect()] == [True, False, True, True]
    assert [r["start"] for r in S.offsets(df, ["doc"], ["no"], F.length("t")).orderBy("no").collect()] == [0, 35, 70, 72]


def test_nested_ordinals(spark):
    df = spark.createDataFrame(list(enumerate("xpffpf")), "no int, k string").withColumn("doc", F.lit("d"))
    out = S.nested_ordinals(df, ["doc"], ["no"], F.col("k") == "p", F.col("k") == "f").orderBy("no").collect()
    assert [(r["outer_no"], r["inner_no"]) for r in out] == [(0, 0), (1, 0), (1, 1), (1, 2), (2, 0), (2, 1)]


def test_top_breaks_ties_by_item(spark):
    df = spark.createDataFrame([("d", 2, 5), ("d", 1, 5), ("d", 3, 4)], "doc string, item int, area int")
    assert rows(S.top(df, ["doc"], [F.desc("area"), "item"]), "item") == [("d", 1, 5)]


def test_dictionary_numbers_by_first_use_after_seeds(spark):
    df = spark.createDataFrame([("d", 1, None, None), ("d", 2, "b", None), ("d", 3, "a", None), ("d", 4, "b", None), ("d", 5, "left", None), ("d", 6, "b", "1")], "doc string, no int, align string, margin string")
    entries = D.dictionary(df, ["doc"], ["no"], ["align", "margin"], "para-", [("left", None), ("right", None)])
    assert {(r["align"], r["margin"]): r["id"] for r in entries.collect()} == {("left", None): "para-1", ("right", None): "para-2", ("b", None): "para-3", ("a", None): "para-4", ("b", "1"): "para-5"}
    named = D.with_ids(df, entries, ["doc"], ["align", "margin"], "style_id")
    assert [r["style_id"] for r in named.orderBy("no").collect()] == [None, "para-3", "para-4", "para-3", "para-1", "para-5"]


def test_fonts(spark):
    wanted = spark.createDataFrame([("k", ["X", "B", "A"]), ("n", ["X"])], "key string, candidates array<string>")
    installed = spark.createDataFrame([("A",), ("B",)], "name string")
    assert {r["key"]: r["font"] for r in D.resolve_fonts(wanted, installed).collect()} == {"k": "B", "n": None}

"""Operators on ordered rows: runs, carried values, nested ordinals, first places, offsets.

Each takes the columns that name a document (``by``) and its order (``order``, enough columns
to be total), and is one window over hashpartitioning of ``by``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import let

Names = Sequence[str]


def _so_far(by: Names, order: Names):
    return Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)


def _before(by: Names, order: Names):
    return Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)


def first_flags(rows: DataFrame, key: Column, order: str, by: Names = (), least: Column | None = None, copies: str | None = None) -> DataFrame:
    """rows with ``first``: whether no earlier row of ``by`` has the key, null as one key; true where ``least`` is false.

    copies: a column for how many rows have the key. A minimum by key, combined before the
    shuffle, and a join that Spark can split, so a text that a third of the rows repeat is no single task.
    """
    keys = {"_key": key, **{f"_by{k}": F.col(name) for k, name in enumerate(by)}}
    keyed = rows.withColumns(keys)
    first = keyed.groupBy(*keys).agg(F.min(order).alias("_first"), F.count("*").alias(copies or "_copies"))
    same = F.lit(True)
    for name in keys:
        first = first.withColumnRenamed(name, f"{name}2")
        same &= F.col(name).eqNullSafe(F.col(f"{name}2"))
    flag = F.col(order).eqNullSafe(F.col("_first"))
    if least is not None:
        flag |= ~F.coalesce(least, F.lit(True))
    return keyed.join(first, same, "left").withColumn("first", flag).drop("_first", "_copies", *keys, *(f"{name}2" for name in keys))


def numbered(rows: DataFrame, by: Names, stretch: str, order: Sequence, out: str) -> DataFrame:
    """rows with a running number from 1 in ``by``, in order of ``stretch`` (nulls first) and ``order``.

    Two steps: within a stretch, and from the numbers of rows in the stretches before, so that one task sorts
    no more than a stretch, and the counts of stretches.
    """
    before = Window.partitionBy(*by).orderBy(F.col(stretch).asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)
    sizes = rows.groupBy(*by, stretch).agg(F.count("*").alias("_n")).withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    sizes = sizes.select(*(F.col(c).alias(f"_{c}2") for c in [*by, stretch]), "_before")
    ranked = rows.withColumn("_rank", F.row_number().over(Window.partitionBy(*by, stretch).orderBy(*order)))
    same = F.lit(True)
    for c in [*by, stretch]:
        same &= F.col(c).eqNullSafe(F.col(f"_{c}2"))
    return ranked.join(sizes, same).withColumn(out, (F.col("_rank") + F.col("_before"))).drop("_rank", "_before", *(f"_{c}2" for c in [*by, stretch]))


def merge_adjacent(rows: DataFrame, by: Names, order: Names, same: Names, text: str) -> DataFrame:
    """Neighbouring rows that are equal, nulls included, on ``same`` become one run.

    Returns by, run_no (from 1), same, ``text`` (end to end) and n_rows.
    """
    window = Window.partitionBy(*by).orderBy(*order)
    change = F.row_number().over(window) == 1
    for name in same:
        change |= ~F.col(name).eqNullSafe(F.lag(name).over(window))
    numbered = rows.withColumn("_new", change.cast("int")).withColumn("run_no", F.sum("_new").over(_so_far(by, order))).withColumn("_at", F.row_number().over(window))
    parts = F.array_sort(F.collect_list(F.struct("_at", F.col(text).alias("t"))))
    return numbered.groupBy(*by, "run_no", *same).agg(F.array_join(F.transform(parts, lambda p: p["t"]), "").alias(text), F.count("*").alias("n_rows"))


def longest_runs(rows: DataFrame, by: Names, order: Names, inside: Column, least: int = 20) -> DataFrame:
    """Per document: rows inside, the longest run of them, and whether it reaches ``least``."""
    marked = rows.withColumn("_in", F.coalesce(inside, F.lit(False))).withColumn("_run", F.sum((~F.col("_in")).cast("int")).over(_so_far(by, order)))
    runs = marked.groupBy(*by, "_run").agg(F.count_if("_in").alias("_n"))
    return runs.groupBy(*by).agg(F.sum("_n").alias("single_count"), F.max("_n").alias("longest_run"), (F.max("_n") >= least).alias("detected"))


def carry_forward(rows: DataFrame, by: Names, order: Names, sets: Column, value: Column, out: str) -> DataFrame:
    """The value of the last row that sets one; a row may set null, which holds too."""
    wrapped = F.when(sets, F.struct(value.alias("v")))
    return rows.withColumn(out, F.last(wrapped, ignorenulls=True).over(_so_far(by, order))["v"])


def ordinals(rows: DataFrame, by: Names, order: Names, opens: dict[str, Column]) -> DataFrame:
    """A running number for each kind of opening, from 1; 0 before the first."""
    for name, opening in opens.items():
        rows = rows.withColumn(name, F.sum(opening.cast("int")).over(_so_far(by, order)))
    return rows


def nested_ordinals(rows: DataFrame, by: Names, order: Names, outer: Column, inner: Column) -> DataFrame:
    """outer_no, and inner_no, which begins anew inside each outer."""
    rows = ordinals(rows, by, order, {"outer_no": outer})
    return ordinals(rows, [*by, "outer_no"], order, {"inner_no": inner})


def running_max(rows: DataFrame, by: Names, order: Names, value: Column, out: str) -> DataFrame:
    """The largest value so far."""
    return rows.withColumn(out, F.max(value).over(_so_far(by, order)))


def take_until(lines: Column, stop) -> Column:
    """The elements of an array before the first that stops; all if none does."""

    def body(given: Column) -> Column:
        return F.when(given["at"] > 0, F.slice(given["lines"], F.lit(1), (given["at"] - 1).cast("int"))).otherwise(given["lines"])

    stops = F.transform(lines, lambda x: F.coalesce(stop(x), F.lit(False)))
    return let(F.struct(lines.alias("lines"), F.array_position(stops, F.lit(True)).alias("at")), body)


def first_places(rows: DataFrame, by: Names, place: str, anchors: dict[str, Column]) -> DataFrame:
    """Per document, the first place at which each predicate holds, or null."""
    return rows.groupBy(*by).agg(*(F.min(F.when(holds, F.col(place))).alias(name) for name, holds in anchors.items()))


def offsets(rows: DataFrame, by: Names, order: Names, length: Column, gap: int = 1, out: str = "start") -> DataFrame:
    """Where each row's text begins when rows follow each other with ``gap`` characters between."""
    return rows.withColumn(out, F.coalesce(F.sum(length + gap).over(_before(by, order)), F.lit(0)))


def thread(rows: DataFrame, by: Names, order: Names, key: str, out: str = "next") -> DataFrame:
    """The key of the next row."""
    return rows.withColumn(out, F.lead(key).over(Window.partitionBy(*by).orderBy(*order)))


def top(rows: DataFrame, by: Names, order: Sequence[Column | str], n: int = 1) -> DataFrame:
    """The first n rows of each document in the order given; Spark prunes groups before the shuffle (L2, L3)."""
    return rows.withColumn("_rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("_rank") <= n).drop("_rank")

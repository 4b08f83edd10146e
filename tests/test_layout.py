"""Geometry, against hand-worked cases and direct Python readings."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from quire.operators import layout as L


def boxes(spark, rows):
    return spark.createDataFrame(rows, "page int, item_no long, x double, y double, w double, h double")


def test_touching_boxes_do_not_overlap(spark):
    df = boxes(spark, [(1, 1, 0.0, 0.0, 10.0, 10.0), (1, 2, 10.0, 0.0, 5.0, 5.0), (1, 3, 9.0, 9.0, 5.0, 5.0), (2, 4, 0.0, 0.0, 99.0, 99.0)])
    assert [tuple(r) for r in L.overlapping(df, ["page"]).collect()] == [(1, 1, 3)]
    assert sorted(r["item_no"] for r in L.without_overlap(df, df.where("item_no = 3"), ["page"]).collect()) == [2, 4]


def test_rows_are_anchored(spark):
    df = spark.createDataFrame([(1, k, 0.0, float(y)) for k, y in enumerate([0, 3, 6, 9, 11])], "page int, item_no int, x double, y double")
    out = L.baseline_rows(df, ["page"]).orderBy("row_no").collect()
    assert [(r["anchor"], list(r["members"])) for r in out] == [(0.0, [0, 1]), (6.0, [2, 3]), (11.0, [4])]


def test_rows_match_a_loop(spark):
    rng = random.Random(1)
    lines = [(p, k, float(rng.randint(0, 9)), float(rng.randint(0, 60))) for p in range(20) for k in range(15)]
    out = {}
    for r in L.baseline_rows(spark.createDataFrame(lines, "page int, item_no int, x double, y double"), ["page"]).collect():
        out.setdefault(r["page"], []).append((r["anchor"], tuple(r["members"])))
    for page in range(20):
        rows = []
        for line in sorted((x for x in lines if x[0] == page), key=lambda x: (x[3], x[2], x[1])):
            old = next((r for r in rows if abs(r[0][3] - line[3]) <= 4), None)
            old.append(line) if old else rows.append([line])
        assert sorted(out[page]) == sorted((r[0][3], tuple(x[1] for x in sorted(r, key=lambda x: (x[2], x[3], x[1])))) for r in rows)


def gaps_by_loop(base, page_h, cuts):
    """The gaps of one column, read directly."""
    y, h = base
    found, cursor = [], y
    rows = sorted((max(y, top - 8), min(page_h - 76, top + height + 10)) for top, height in cuts)
    for top, bottom in sorted((c for c in rows if c[1] > c[0]), key=lambda c: c[0]):
        if top - cursor >= 42:
            found.append((cursor, top - cursor))
        cursor = max(cursor, bottom)
    end = min(y + h, page_h - 76)
    if end - cursor >= 42:
        found.append((cursor, end - cursor))
    return found or [(y, h)]


def test_gaps_match_a_loop(spark):
    rng = random.Random(2)
    bases, blocks, want = [], [], {}
    for page in range(60):
        base, cuts = (float(rng.randint(0, 100)), float(rng.randint(50, 500))), []
        for k in range(rng.randint(0, 6)):
            cuts.append((float(rng.randint(0, 600)), float(rng.randint(0, 120))))
            blocks.append((page, k, 0.0, cuts[-1][0], 50.0, cuts[-1][1]))
        bases.append((page, 1, 0.0, base[0], 50.0, base[1], 640.0))
        want[page] = gaps_by_loop(base, 640.0, cuts)
    out = {}
    got = L.interval_gaps(spark.createDataFrame(bases, "page int, base_no int, x double, y double, w double, h double, page_h double"), spark.createDataFrame(blocks, "page int, block_no int, x double, y double, w double, h double"), ["page"])
    for r in got.collect():
        out.setdefault(r["page"], []).append((r["y"], r["h"]))
    assert {k: sorted(v) for k, v in out.items()} == {k: sorted(v) for k, v in want.items()}


def test_columns_split_with_a_gutter(spark):
    df = spark.createDataFrame([(1, 10.0, 100.0, 2, None), (2, 10.0, 100.0, None, None), (3, 0.0, 100.0, 5, 20.0)], "page int, x double, w double, columns int, column_gap double")
    out = [(r["page"], r["column_no"], r["x"], r["w"]) for r in L.split_columns(df).orderBy("page", "column_no").collect()]
    assert out == [(1, 0, 10.0, 41.0), (1, 1, 69.0, 41.0), (2, 0, 10.0, 100.0), (3, 0, 0.0, 40.0), (3, 1, 60.0, 40.0)]


def assign_by_loop(scores, least=0.16):
    now, out = 0, []
    for row in scores:
        best, at = 0, now
        for page in range(now, len(row)):
            if row[page] > best:
                best, at = row[page], page
        if best >= least:
            now = max(now, at)
        out.append(now)
    return out


def test_assignment_matches_a_loop_and_never_goes_back(spark):
    rng = random.Random(3)
    rows, want = [], {}
    for doc in range(40):
        scores = [[rng.choice([0.0, 0.1, 0.15, 0.16, 0.5, 0.5, 0.9]) for _ in range(5)] for _ in range(8)]
        rows += [(doc, p, g, s) for p, row in enumerate(scores) for g, s in enumerate(row)]
        want[doc] = assign_by_loop(scores)
    out = {}
    for r in L.monotone(spark.createDataFrame(rows, "doc int, para_no int, page_no int, score double"), ["doc"]).orderBy("doc", "para_no").collect():
        out.setdefault(r["doc"], []).append(r["page_no"])
    assert out == want and all(x == sorted(x) for x in out.values())


def test_captions_and_their_lines(spark):
    captions = spark.createDataFrame([(1, 1, 10.0, 100, 100.0), (1, 2, 10.0, 200, 100.0), (1, 3, 10.0, 202, 100.0)], "page int, caption_no long, x double, y long, w double")
    below = L.next_below(captions, ["page"], "y")
    assert {r["caption_no"]: r["next_y"] for r in below.collect()} == {1: 200, 2: None, 3: None}  # two below by no more than 2 is no next one
    lines = spark.createDataFrame([(1, 1, 20.0, 150.0), (1, 2, 20.0, 140.0), (1, 3, 500.0, 120.0), (1, 4, 20.0, 250.0)], "page int, line_no long, x double, y double")
    first = L.first_in_band(below, lines, ["page"])
    assert {r["caption_no"]: r["line_no"] for r in first.collect()} == {1: 2, 2: 4, 3: 4}
    assert {r["line_no"]: r["caption_no"] for r in L.claimed_lines(first, ["page"]).collect()} == {2: 1, 4: 2}


def test_table_lines(spark):
    captions = spark.createDataFrame([(1, 1, 10.0, 100.0, 100.0, 10.0, 200.0)], "page int, caption_no int, x double, y double, w double, h double, source_y double")
    lines = spark.createDataFrame([(1, 1, 10.0, 117.0, 50.0, True), (1, 2, 10.0, 116.0, 50.0, True), (1, 3, 10.0, 196.0, 50.0, True), (1, 4, 10.0, 150.0, 50.0, False), (1, 5, 10.0, 150.0, 300.0, True)], "page int, line_no int, x double, y double, w double, cell boolean")
    assert [r["line_no"] for r in L.table_lines(captions, lines, ["page"]).collect()] == [1]


def test_page_analysis(spark):
    df = boxes(spark, [(1, 1, 0.0, 0.0, 10.0, 10.0), (1, 2, 100.0, 0.0, 10.0, 10.0), (1, 3, 101.0, 0.0, 10.0, 10.0)]).withColumn("n", F.when(F.col("item_no") == 2, 2))
    row = L.page_analysis(df, ["page"], F.col("n"), F.lit(True)).first()
    assert (row["frame_count"], row["column_count"], [tuple(b) for b in row["column_bands"]]) == (3, 2, [(100.0, 110.0)])
    assert tuple(L.union_bounds(df, ["page"]).first()) == (1, 0.0, 0.0, 111.0, 10.0)

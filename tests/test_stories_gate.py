"""Stories, rasters, the gate and jobs on small cases."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from quire.operators import gate as G
from quire.operators import jobs as J
from quire.operators import raster as R
from quire.operators import stories as S
from quire.streaming import jobs as SJ


def test_repeated_frames_become_stories(spark):
    df = spark.createDataFrame([("d", 1, "once"), ("d", 2, "same  text"), ("d", 3, "same text "), ("d", 4, " "), ("d", 5, " "), ("d", 6, "b"), ("d", 7, "b")], "doc string, item_no int, text string")
    stories = S.repeated_stories(df, ["doc"], "item_no", "text")
    assert [(r["story_id"], r["members"], r["text"]) for r in stories.orderBy("story_no").collect()] == [("story-1", 2, "same  text"), ("story-2", 2, "b")]
    out = S.with_stories(df, stories, ["doc"], "text").orderBy("item_no").collect()
    assert [(r["story_id"], r["text"]) for r in out] == [(None, "once"), ("story-1", None), ("story-1", None), (None, " "), (None, " "), ("story-2", None), ("story-2", None)]


def test_repair_takes_styles(spark):
    raw = spark.createDataFrame([("d", 1, "Exact TEXT", "s1", None, None), ("d", 2, "exact text", "s2", None, None), ("d", 3, "w " * 50, "body", "P", None), ("d", 4, "Head", "head", "Arial", "bold")], "doc string, para_no int, text string, style_id string, font string, weight string")
    canonical = spark.createDataFrame([("d", 1, "exact  text"), ("d", 2, "Looks like heading"), ("d", 3, "A sentence, with a comma.")], "doc string, para_no int, text string")
    assert [r["style_id"] for r in S.repaired(canonical, raw, ["doc"]).orderBy("para_no").collect()] == ["s1", "head", "body"]


def test_segments(spark):
    df = spark.createDataFrame([("d", k, t) for k, t in enumerate(["intro", "The Title", "sub", "abstract", "End"])], "doc string, para_no int, text string")
    out = S.segments(df, ["doc"], {"title": ("contains", "title"), "end": ("equals", "end"), "none": ("equals", "missing")}, {"title": ("title", 0, "title", 2), "body": ("title", 2, "end", 0), "rest": ("none", 0, None, 0), "open": ("end", 0, "none", 0)})
    got = {}
    for r in out.collect():
        got.setdefault(r["part"], []).append(r["para_no"])
    assert {k: sorted(v) for k, v in got.items()} == {"title": [1, 2], "body": [3], "open": [4]}


def test_running_coverage_is_cumulative(spark):
    df = spark.createDataFrame([("d", 1, "one two three four", "one two"), ("d", 2, "one two three four", ""), ("d", 3, "one two three four", "three two one four")], "doc string, story_no int, canonical string, text string")
    assert [r["canonical_coverage"] for r in S.running_coverage(df, ["doc"], "canonical", "text").orderBy("story_no").collect()] == [0.5, 0.5, 1.0]


def test_largest_empty_frame_is_chosen_before_its_size_is_tested(spark):
    pages = spark.createDataFrame([("d", p, 600.0, 800.0) for p in (1, 2)], "doc string, page_no int, page_w double, page_h double")
    stories = spark.createDataFrame([("d", "s")], "doc string, story_id string")
    placed = spark.createDataFrame([("d", 1, "s")], "doc string, page_no int, story_id string")
    narrow, wide = ("d", 2, 1, 0.0, 0.0, 200.0, 700.0), ("d", 2, 2, 0.0, 0.0, 400.0, 300.0)
    schema = "doc string, page_no int, item_no int, x double, y double, w double, h double"
    assert S.continuations(stories, pages, placed, spark.createDataFrame([narrow, wide], schema), ["doc"]).count() == 0
    assert [r["item_no"] for r in S.continuations(stories, pages, placed, spark.createDataFrame([wide], schema), ["doc"]).collect()] == [2]


def test_footers(spark):
    pages = spark.createDataFrame([("d", 1, 600.0, 800.0), ("d", 2, 600.0, 800.0)], "doc string, page_no int, page_w double, page_h double")
    empty = spark.createDataFrame([("d", 2, 1, 10.0, 750.0, 100.0, 60.0), ("d", 2, 2, 300.0, 750.0, 100.0, 20.0)], "doc string, page_no int, item_no int, x double, y double, w double, h double")
    assert [tuple(r)[2:] for r in S.footers(pages, empty, ["doc"]).orderBy("page_no").collect()] == [(440.0, 758.0, 135.0, 18.0), (300.0, 750.0, 100.0, 20.0)]


def test_blocks_and_anchored_stories(spark):
    block = spark.createDataFrame([("table", "a\nb", None, 10.0, 5.0)], "role string, text string, rows array<string>, w double, h double")
    row = S.block_frames(block).first()
    assert (row["frame_w"], row["frame_h"], [p["bold"] for p in row["paragraphs"]]) == (80.0, 34.0, [True, False])
    df = spark.createDataFrame([("d", 0, 2, "b"), ("d", 0, 1, "a"), ("d", 1, 3, "References")], "doc string, page_no int, para_no int, text string")
    out = S.anchored_stories(df, ["doc"], F.lower("text") == "references").orderBy("page_no").collect()
    assert [(r["text"], r["role"], r["font_size_pt"]) for r in out] == [("a\nb", "article", 8.9), ("References", "reference", 7.6)]


def pixels(spark, points):
    return spark.createDataFrame([(1, x, y) for x, y in points], "page int, x int, y int")


@pytest.mark.parametrize(("apart", "missing"), [(5, 0.0), (6, 1.0)])
def test_masks_within_the_radius(spark, apart, missing):
    out = R.tolerant_diff(pixels(spark, [(10, 10)]), pixels(spark, [(10 + apart, 10)]), ["page"], F.lit(40), F.lit(40)).first()
    assert (out["missing_ratio"], out["extra_ratio"], out["tolerant_passed"]) == (missing, missing, missing == 0.0)


def test_disc_and_clip(spark):
    assert R.dilated(pixels(spark, [(20, 20)]), ["page"], F.lit(40), F.lit(40)).count() == 81
    assert R.dilated(pixels(spark, [(0, 0)]), ["page"], F.lit(40), F.lit(40), 1).count() == 3


def test_pixel_difference(spark):
    schema = "page int, x int, y int, r int, g int, b int, a int"
    one = spark.createDataFrame([(1, 0, 0, 0, 0, 0, 255), (1, 1, 0, 250, 250, 250, 255)], schema)
    two = spark.createDataFrame([(1, 0, 0, 255, 255, 255, 255)], schema)
    row = R.pixel_diff(one, two, ["page"]).first()
    assert (row["differing_pixels"], row["total_pixels"]) == (1, 2)
    ink = one.select(R.is_ink(*(F.col(c) for c in "rgba")).alias("i")).collect()
    assert [r["i"] for r in ink] == [True, False]


def test_document_verdict_compares_common_pages(spark):
    pages = spark.createDataFrame([("d", 1, 0, 10, True), ("d", 2, 5, 10, False)], "doc string, page_no int, differing_pixels long, total_pixels long, page_passed boolean")
    counts = spark.createDataFrame([("d", 2, 1)], "doc string, reference_pages int, candidate_pages int")
    assert tuple(R.document_verdicts(pages, ["doc"], counts).first()) == ("d", False, False, False, 0.0)


@pytest.mark.parametrize(("length", "repeated"), [(31, False), (32, True)])
def test_repeated_page_text(spark, length, repeated):
    pages = spark.createDataFrame([("d", 1, "x" * length), ("d", 2, "x" * length)], "doc string, page_no int, text string")
    assert G.repeated_page_text(pages, ["doc"]).first()["repeated"] is repeated


def test_gate_reasons_and_defaults(spark):
    df = spark.createDataFrame([(1, True, None), (2, False, None)], "d int, a boolean, b boolean")
    out = G.gate(df, [G.Condition("c1", F.col("a"), False, "a fails"), G.Condition("c2", F.col("b"), True, "b fails")], {"both": ["c1", "c2"]}).orderBy("d").collect()
    assert [(r["approved"], r["both"], r["reasons"]) for r in out] == [(True, True, []), (False, False, ["a fails"])]


def test_columns_and_flow(spark):
    expected = spark.createDataFrame([("d", 1, 1), ("d", 2, 2)], "doc string, page_no int, columns int")
    short = spark.createDataFrame([("d", 1, 3)], "doc string, page_no int, columns int")
    assert G.columns_match(expected, expected, ["doc"]).first()["columns_match"] is True
    assert G.columns_match(expected, short, ["doc"]).first()["columns_match"] is False
    flow = spark.createDataFrame([("d", 1, 1), ("d", 2, 2), ("d", 18, 1)], "doc string, page_no int, columns int")
    assert G.main_flow_columns(flow, ["doc"]).first()["two_columns"] is True
    assert G.main_flow_columns(flow.where("page_no = 1"), ["doc"]).first()["two_columns"] is True


def test_landmarks_sections_footers(spark):
    lines = spark.createDataFrame([("d", 1, "Table 1: something"), ("d", 2, "Gone")], "doc string, page_no int, text string")
    pages = spark.createDataFrame([("d", 1, "x Table 1: something else Label 1 url")], "doc string, page_no int, text string")
    assert {r["page_no"]: r["landmarks_match"] for r in G.landmarks_match(lines, pages, ["doc"]).collect()} == {1: True, 2: False}
    assert tuple(G.footers_present(pages, ["doc"], "Label", "url").first()) == ("d", True, True)
    order = spark.createDataFrame([("d", 1, False, True), ("d", 2, True, False), ("e", 1, False, True)], "doc string, page_no int, h boolean, r boolean")
    assert {r["doc"]: r["sections_in_order"] for r in G.sections_in_order(order, ["doc"], F.col("h"), F.col("r")).collect()} == {"d": False, "e": True}


def test_audit_and_tables(spark):
    audit = spark.createDataFrame([(1, False, [], [], [], [], 3), (2, False, ["x"], [], [], [], 3), (3, None, None, None, None, None, 0)], "d int, overset_text boolean, missing_links array<string>, font_issues array<string>, full_page_pdf_placements array<string>, full_page_image_placements array<string>, total_text_frames int")
    assert [r["native_audit_passed"] for r in G.audit_passed(audit).orderBy("d").collect()] == [True, False, False]
    flags = spark.createDataFrame([(1, True, 0), (2, False, 0), (3, None, 0)], "d int, f boolean, n int")
    assert [r["p"] for r in flags.orderBy("d").select(G.tables_present(F.col("f"), F.col("n")).alias("p")).collect()] == [False, False, True]
    assert [r["p"] for r in flags.orderBy("d").select(G.tables_present(F.col("f"), F.col("n"), strict=False).alias("p")).collect()] == [True, False, True]


def test_jobs(spark):
    at = lambda h: dt.datetime(2024, 1, 1, h)
    events = spark.createDataFrame([("a", "uploaded", at(0)), ("a", "processing", at(1)), ("b", "uploaded", at(1)), ("b", "completed", at(2))], "job_id string, status string, ts timestamp")
    found = J.latest(events)
    assert {r["job_id"]: r["status"] for r in found.collect()} == {"a": "processing", "b": "completed"}
    assert [r["job_id"] for r in J.alive(found, F.lit(dt.datetime(2024, 1, 1, 1, 30))).collect()] == ["b"]  # also one that is still processing goes
    assert {r["job_id"]: (r["has_result"], r["progress"]) for r in J.shown(found).collect()} == {"a": (False, 55), "b": (True, 100)}


def test_job_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text('{"job_id":"a","status":"uploaded","ts":"2024-01-01T00:00:00Z"}\n{"job_id":"a","status":"completed","ts":"2024-01-01T00:10:00Z"}\n')
    query = SJ.latest_states(SJ.read_events(spark, str(tmp_path / "in"))).writeStream.outputMode("complete").format("memory").queryName("states").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination(60)
    assert [(r["job_id"], r["status"]) for r in spark.table("states").collect()] == [("a", "completed")]


def test_job_stream_expires_an_hour_after_upload(spark, tmp_path):
    (tmp_path / "in").mkdir()
    files = [
        [("a", "uploaded", "00:50"), ("b", "uploaded", "00:55")],
        [("a", "processing", "01:10"), ("b", "completed", "01:20")],
        [("c", "uploaded", "02:02")],  # the watermark passes a's hour, not b's
        [("d", "uploaded", "02:30")],
        [("d", "failed", "02:31")],
    ]
    for k, rows in enumerate(files):
        (tmp_path / "in" / f"{k}.json").write_text("".join(f'{{"job_id":"{j}","status":"{s}","ts":"2024-01-01T{t}:00Z"}}\n' for j, s, t in rows))
        query = SJ.expiring_states(SJ.read_events(spark, str(tmp_path / "in"))).writeStream.outputMode("update").foreachBatch(lambda df, n: df.write.mode("append").parquet(str(tmp_path / "out"))).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        query.awaitTermination(120)
    rows = [(r["job_id"], r["status"], r["expired"], str(r["created_at"])[11:16]) for r in spark.read.parquet(str(tmp_path / "out")).collect()]
    assert {r for r in rows if r[2]} == {("a", "processing", True, "00:50"), ("b", "completed", True, "00:55")}
    assert {("a", "uploaded", False, "00:50"), ("a", "processing", False, "00:50"), ("b", "completed", False, "00:55"), ("c", "uploaded", False, "02:02"), ("d", "failed", False, "02:30")} <= set(rows)


def test_cover_placeholders(spark):
    schema = "doc string, page_no int, item_no int, x double, y double, w double, h double"
    empty = spark.createDataFrame([("d", 1, 1, 50.0, 200.0, 400.0, 30.0), ("d", 1, 2, 50.0, 100.0, 400.0, 30.0), ("d", 1, 3, 50.0, 50.0, 100.0, 30.0), ("d", 1, 4, 50.0, 390.0, 400.0, 30.0)], schema)
    pages = spark.createDataFrame([("d", 1, 600.0, 800.0)], "doc string, page_no int, page_w double, page_h double")
    first = spark.createDataFrame([("d", 390.0)], "doc string, first_y double")
    out = S.cover_placeholders(empty, pages, first, ["doc"]).orderBy("y").collect()
    assert [(r["item_no"], r["role"], r["h"]) for r in out] == [(2, "cover-title", 30.0), (1, "cover-abstract", 70.0)]


def test_zone_frames(spark):
    pages = spark.createDataFrame([("d", 1, 600.0), ("d", 2, 600.0)], "doc string, page_no int, page_w double")
    empty = spark.createDataFrame([("d", 2, 1, 20.0, 300.0, 90.0, 20.0), ("d", 2, 2, 30.0, 100.0, 80.0, 25.0), ("d", 2, 3, 400.0, 50.0, 80.0, 25.0)], "doc string, page_no int, item_no int, x double, y double, w double, h double")
    zones = spark.createDataFrame([(1, "label", 1.0, 10.0, 1.0, 1.0), (2, "label", 1.0, 20.0, 1.0, 1.0), (3, "label", 1.0, 30.0, 1.0, 1.0), (1, "content", 5.0, 40.0, 5.0, 5.0)], "zone_no int, kind string, x double, y double, w double, h double")
    out = {(r["kind"], r["zone_no"]): (r["page_no"], r["x"], r["w"], r["h"], r["y"]) for r in S.zone_frames(pages, empty, zones, ["doc"]).collect()}
    assert out == {("label", 1): (2, 30.0, 80.0, 25.0, 10.0), ("label", 2): (2, 20.0, 90.0, 20.0, 20.0), ("label", 3): (2, 1.0, 1.0, 1.0, 30.0), ("content", 1): (2, 5.0, 5.0, 5.0, 40.0)}


def test_totals_and_counts(spark):
    stories = spark.createDataFrame([("d", True, 1), ("d", False, 2)], "doc string, overflows boolean, tables int")
    pages = spark.createDataFrame([("d", 3, 2), ("d", 4, 1)], "doc string, text_frame_count int, max_column_count int")
    assert tuple(G.audit_totals(stories, pages, ["doc"]).first()) == ("d", True, 3, 7, 2)
    items = spark.createDataFrame([("d", "shape", True, "bounding-box"), ("d", "shape", True, None), ("d", "textFrame", False, None)], "doc string, kind string, is_figure boolean, text_wrap string")
    assert tuple(G.item_counts(items, ["doc"]).first()) == ("d", 1, 2)
    assert tuple(G.wrap_counts(items, ["doc"]).first())[1:3] == (2, 1)
    entries = spark.createDataFrame([("d", "b/x"), ("d", "a"), ("d", "b/y")], "doc string, path string")
    assert tuple(G.entry_summary(entries, ["doc"]).first()) == ("d", ["a", "b/x", "b/y"], ["a", "b"], 3)


def test_anti_aliased_pixels_like_loops(spark):
    import random

    def loops(one, two, w, h, threshold):
        """Differing pixels that no image only softens an edge with."""

        def blend(c):
            return [255 + (v - 255) * c[3] / 255 for v in c[:3]]

        def light(img, x, y):
            return sum(v * k for v, k in zip(blend(img[x, y]), R.YIQ[0], strict=True))

        def around(x, y):
            return [(i, j) for i in range(max(x - 1, 0), min(x + 1, w - 1) + 1) for j in range(max(y - 1, 0), min(y + 1, h - 1) + 1) if (i, j) != (x, y)]

        def on_edge(x, y):
            return x in (0, w - 1) or y in (0, h - 1)

        def many(img, x, y):
            return on_edge(x, y) + sum(img[p] == img[x, y] for p in around(x, y)) > 2

        def soft(img, x, y):
            deltas = [(light(img, x, y) - light(img, *p), p) for p in around(x, y)]
            low, high = (min((d for d in deltas if d[0] < 0), key=lambda d: d[0], default=None), max((d for d in deltas if d[0] > 0), key=lambda d: d[0], default=None))
            if on_edge(x, y) + sum(d == 0 for d, _ in deltas) > 2 or not low or not high:
                return False
            return any(many(one, *p) and many(two, *p) for _, p in (low, high))

        count = 0
        for p in one:
            a, b = blend(one[p]), blend(two[p])
            far = sum(share * sum((u - v) * k for u, v, k in zip(a, b, weights, strict=True)) ** 2 for weights, share in zip(R.YIQ, R.YIQ_WEIGHTS, strict=True))
            count += far > R.YIQ_MOST * threshold**2 and not soft(one, *p) and not soft(two, *p)
        return count

    rng, pages, want, plain = random.Random(5), [], {}, 0
    for page in range(6):  # shapes of few colours, with softened pixels at their edges
        w, h = 12, 9
        one = {(x, y): (0, 0, 0, 255) if x + y * page % 5 < 6 else (255, 255, 255, 255) for x in range(w) for y in range(h)}
        two = dict(one)
        for img in (one, two):
            for p in rng.sample(sorted(img), 20):
                v = rng.choice([60, 128, 200])
                img[p] = (v, v, v, rng.choice([255, 255, 100]))
        pages += [(page, x, y, *one[x, y], *two[x, y]) for x, y in one]
        want[page] = loops(one, two, w, h, 0.1)
    table = spark.createDataFrame(pages, "page int, x int, y int, r int, g int, b int, a int, r2 int, g2 int, b2 int, a2 int")
    left, right = table.select("page", "x", "y", *"rgba"), table.select("page", "x", "y", *(F.col(f"{c}2").alias(c) for c in "rgba"))
    got = {r["page"]: r["differing_pixels"] for r in R.pixel_diff(left, right, ["page"], 0.1, count_anti_aliased=False).collect()}
    plain = {r["page"]: r["differing_pixels"] for r in R.pixel_diff(left, right, ["page"], 0.1).collect()}
    assert got == want and any(got[k] < plain[k] for k in got)

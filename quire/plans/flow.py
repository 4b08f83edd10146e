"""Queries of page flow, gates, sources and exports: customers stand for documents, their orders for pages, line items for frames."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions import text as X
from ..operators import dictionary, gate, jobs, layout, raster, sequences, stories
from ..sources import containers, drawings
from .registry import query, table

PAGE_W, PAGE_H = 500.0, 480.0
_ITEM_ORDER = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]

_FRAMES = f"""pg AS (SELECT o_custkey AS doc_id, o_orderkey, o_orderstatus AS status, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS page_no FROM orders),
fr AS (SELECT doc_id, page_no, row_number() OVER (PARTITION BY l_orderkey ORDER BY {", ".join(_ITEM_ORDER)}) AS item_no, l_quantity * 7 AS x, l_linenumber * 62.0::DOUBLE + l_suppkey % 9 AS y, (l_partkey % 390)::DOUBLE AS w, ((l_partkey * 7 + l_suppkey) % 260)::DOUBLE AS h, l_returnflag AS flag, l_linestatus AS status FROM lineitem JOIN pg ON o_orderkey = l_orderkey)"""
_FOOTER = f"(y > {PAGE_H} - 90 AND w >= 70 AND h <= 80)"


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    number = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")).cast("long")
    return table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("doc_id"), number.alias("page_no"), "o_orderkey", F.col("o_orderstatus").alias("page_status"), F.lit(PAGE_W).alias("page_w"), F.lit(PAGE_H).alias("page_h"))


def _frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    items = table(spark, sf_dir, "lineitem").withColumn("item_no", F.row_number().over(Window.partitionBy("l_orderkey").orderBy(*_ITEM_ORDER)).cast("long"))
    box = {"x": c("l_quantity") * 7, "y": c("l_linenumber") * 62.0 + c("l_suppkey") % 9, "w": (c("l_partkey") % 390).cast("double"), "h": ((c("l_partkey") * 7 + c("l_suppkey")) % 260).cast("double")}
    pages = _pages(spark, sf_dir).select("doc_id", "page_no", c("o_orderkey").alias("l_orderkey"))
    return items.join(pages, "l_orderkey").select("doc_id", "page_no", "item_no", *(v.alias(k) for k, v in box.items()), c("l_returnflag").alias("flag"), c("l_linestatus").alias("status"))


# ---- stories and frames ----


@query(
    f"""WITH {_FRAMES}, c AS (SELECT doc_id, item_no, h, row_number() OVER (PARTITION BY doc_id ORDER BY y, item_no) AS n FROM fr WHERE page_no = 1 AND flag = 'A' AND w > {PAGE_W} * 0.55 AND x < {PAGE_W} * 0.25 AND y < 200 + doc_id % 200 - 4 AND NOT {_FOOTER})
SELECT doc_id, item_no, CASE n WHEN 1 THEN 'cover-title' ELSE 'cover-abstract' END AS role, CASE n WHEN 2 THEN greatest(h, 70.0) ELSE h END::DOUBLE AS h FROM c WHERE n <= 2"""
)
def cover_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """the first page's places for title and abstract."""
    pages = _pages(spark, sf_dir)
    first_y = pages.select("doc_id").distinct().withColumn("first_y", 200.0 + F.col("doc_id") % 200)
    return stories.cover_placeholders(_frames(spark, sf_dir).where("flag = 'A'"), pages, first_y, ["doc_id"]).select("doc_id", "item_no", "role", "h")


@query(
    f"""WITH {_FRAMES}, s AS (SELECT DISTINCT doc_id, 's' || k AS story_id FROM pg, (VALUES (1), (2)) v(k)), last AS (SELECT doc_id, max(page_no) AS page_no FROM pg WHERE doc_id % 3 = 0 GROUP BY doc_id),
p AS (SELECT pg.doc_id, pg.page_no FROM pg LEFT JOIN last USING (doc_id, page_no) WHERE last.page_no IS NULL),
placed AS (SELECT DISTINCT doc_id, page_no, CASE WHEN page_no % 2 = 0 THEN 's1' ELSE 's2' END AS story_id FROM fr WHERE flag = 'R'),
e AS (SELECT * FROM (SELECT fr.*, row_number() OVER (PARTITION BY doc_id, page_no ORDER BY w * h DESC, item_no) AS n FROM fr WHERE flag = 'A' AND NOT {_FOOTER}) WHERE n = 1 AND w >= {PAGE_W} * 0.35 AND h >= {PAGE_H} * 0.3)
SELECT s.doc_id, s.story_id, p.page_no, e.item_no FROM s JOIN p USING (doc_id) JOIN e USING (doc_id, page_no) LEFT JOIN placed l ON l.doc_id = s.doc_id AND l.page_no = p.page_no AND l.story_id = s.story_id WHERE l.story_id IS NULL"""
)
def story_continuations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages without a story, and their largest empty frame."""
    pages, frames = _pages(spark, sf_dir), _frames(spark, sf_dir)
    of = pages.select("doc_id").distinct().select("doc_id", F.explode(F.array(F.lit("s1"), F.lit("s2"))).alias("story_id"))
    placed = frames.where("flag = 'R'").select("doc_id", "page_no", F.when(F.col("page_no") % 2 == 0, "s1").otherwise("s2").alias("story_id")).distinct()
    found = stories.continuations(of, pages, placed, frames.where("flag = 'A'"), ["doc_id"], pages.where("doc_id % 3 = 0"))
    return found.select("doc_id", "story_id", "page_no", "item_no")


@query(
    f"""WITH {_FRAMES}, r AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, page_no ORDER BY x DESC, item_no) AS n FROM fr WHERE flag = 'A' AND {_FOOTER}) WHERE n = 1)
SELECT pg.doc_id, pg.page_no, coalesce(x, {PAGE_W} - 160)::DOUBLE AS x, coalesce(y, {PAGE_H} - 42)::DOUBLE AS y, coalesce(w, 135)::DOUBLE AS w, least(coalesce(h, 18), 28)::DOUBLE AS h FROM pg LEFT JOIN r USING (doc_id, page_no)"""
)
def footer_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A footer's box for every page."""
    return stories.footers(_pages(spark, sf_dir), _frames(spark, sf_dir).where("flag = 'A'"), ["doc_id"])


@query(
    f"""WITH {_FRAMES}, last AS (SELECT doc_id, max(page_no) AS page_no FROM pg GROUP BY doc_id),
n AS (SELECT fr.doc_id, row_number() OVER (PARTITION BY fr.doc_id ORDER BY y, item_no) AS zone_no, x, w, h FROM fr JOIN last USING (doc_id, page_no) WHERE flag = 'A' AND x < {PAGE_W} * 0.3 AND w < {PAGE_W} * 0.35),
z AS (SELECT * FROM (VALUES (1, 'label', 10.0, 20.0, 30.0, 40.0), (2, 'content', 50.0, 20.0, 30.0, 40.0), (3, 'label', 10.0, 320.0, 30.0, 40.0)) v(zone_no, kind, x, y, w, h))
SELECT last.doc_id, last.page_no, z.zone_no, kind, CASE WHEN kind = 'label' THEN coalesce(n.x, z.x) ELSE z.x END::DOUBLE AS x, z.y::DOUBLE AS y, CASE WHEN kind = 'label' THEN coalesce(n.w, z.w) ELSE z.w END::DOUBLE AS w, CASE WHEN kind = 'label' THEN coalesce(n.h, z.h) ELSE z.h END::DOUBLE AS h
FROM last CROSS JOIN z LEFT JOIN n ON n.doc_id = last.doc_id AND n.zone_no = z.zone_no"""
)
def back_matter_zones(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Configured zones of the last page."""
    zones = spark.createDataFrame([(1, "label", 10.0, 20.0, 30.0, 40.0), (2, "content", 50.0, 20.0, 30.0, 40.0), (3, "label", 10.0, 320.0, 30.0, 40.0)], "zone_no int, kind string, x double, y double, w double, h double")
    return stories.zone_frames(_pages(spark, sf_dir), _frames(spark, sf_dir).where("flag = 'A'"), zones, ["doc_id"])


_ROLE = "CASE flag WHEN 'A' THEN 'table' WHEN 'N' THEN 'caption' ELSE CASE WHEN status = 'F' THEN 'footnote' ELSE 'figure' END END"


@query(
    f"""WITH {_FRAMES}, b AS (SELECT *, {_ROLE} AS role FROM fr)
SELECT doc_id, page_no, item_no, greatest(w + 6, CASE role WHEN 'table' THEN 80 ELSE w END)::DOUBLE AS frame_w, greatest(h + 4, CASE role WHEN 'table' THEN 2 * 12 + 10 ELSE 12 END)::DOUBLE AS frame_h, CASE role WHEN 'table' THEN 2 ELSE 1 END AS n_rows,
CASE WHEN role IN ('caption', 'table') THEN 1 ELSE 0 END AS n_bold, CASE role WHEN 'table' THEN 7.2 WHEN 'footnote' THEN 6.2 ELSE 8.0 END::DOUBLE AS size FROM b"""
)
def block_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """blocks as padded frames with a paragraph for each row."""
    role = F.when(F.col("flag") == "A", "table").when(F.col("flag") == "N", "caption").when(F.col("status") == "F", "footnote").otherwise("figure")
    blocks = _frames(spark, sf_dir).withColumn("role", role).withColumn("text", F.lit("one\ntwo")).withColumn("rows", F.lit(None).cast("array<string>"))
    found = stories.block_frames(blocks)
    return found.select("doc_id", "page_no", "item_no", "frame_w", "frame_h", F.size("paragraphs").alias("n_rows"), F.size(F.filter("paragraphs", lambda p: p["bold"])).alias("n_bold"), F.col("paragraphs")[0]["font_size_pt"].alias("size"))


_T1 = f"trim(regexp_replace(text, '[{X.SPACES}]+', ' ', 'g'))"


@query(
    f"""WITH t AS (SELECT conv_id, turn AS para_no, role, text, {_T1} AS p, lower({_T1}) AS k FROM conversations), raw AS (SELECT *, 'style-' || para_no AS style_id FROM t WHERE role = 'user'),
e AS (SELECT conv_id, k, arg_min(style_id, para_no) AS style_id FROM raw WHERE k <> '' GROUP BY ALL), b AS (SELECT conv_id, arg_min(style_id, para_no) FILTER (WHERE length(p) > 80) AS body, arg_min(style_id, para_no) FILTER (WHERE para_no % 4 = 0) AS head FROM raw GROUP BY conv_id),
h AS (SELECT DISTINCT conv_id, k FROM raw WHERE para_no % 2 = 0 AND length(p) BETWEEN 1 AND 120), l AS (SELECT DISTINCT lower({_T1}) AS k FROM benchmark)
SELECT t.conv_id, t.para_no, (h.k IS NOT NULL OR l.k IS NOT NULL OR (length(t.text) <= 95 AND NOT regexp_matches(t.text, '[.!?]$') AND regexp_matches(t.text, '[A-ZÅÄÖa-zåäö]') AND NOT contains(t.text, ','))) AS is_heading,
coalesce(e.style_id, CASE WHEN h.k IS NOT NULL OR l.k IS NOT NULL OR (length(t.text) <= 95 AND NOT regexp_matches(t.text, '[.!?]$') AND regexp_matches(t.text, '[A-ZÅÄÖa-zåäö]') AND NOT contains(t.text, ',')) THEN head ELSE body END) AS style_id
FROM t LEFT JOIN e ON e.conv_id = t.conv_id AND e.k = t.k LEFT JOIN h ON h.conv_id = t.conv_id AND h.k = t.k LEFT JOIN l ON l.k = t.k LEFT JOIN b ON b.conv_id = t.conv_id"""
)
def canonical_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Canonical paragraphs with the style of an equal raw one, or of a template."""
    turns = table(spark, sf_dir, "conversations").withColumnRenamed("turn", "para_no")
    raw = turns.where("role = 'user'").select("conv_id", "para_no", "text", F.concat(F.lit("style-"), "para_no").alias("style_id"), F.when(F.col("para_no") % 2 == 0, "Arial").alias("font"), F.when(F.col("para_no") % 4 == 0, "bold").alias("weight"))
    found = stories.repaired(turns.select("conv_id", "para_no", "text"), raw, ["conv_id"], table(spark, sf_dir, "benchmark"))
    return found.select("conv_id", "para_no", "is_heading", "style_id")


@query(
    f"""WITH l AS (SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS para_no, unnest(string_split(text, chr(10))) AS text FROM documents), k AS (SELECT doc_id, para_no, lower({_T1}) AS k FROM l),
a AS (SELECT doc_id, min(para_no) FILTER (WHERE contains(k, 'the ')) AS body, min(para_no) FILTER (WHERE contains(k, '@')) AS back FROM k GROUP BY doc_id)
SELECT doc_id, count(*) FILTER (WHERE para_no < body + 1) AS head, count(*) FILTER (WHERE para_no >= body + 1 AND (back IS NULL OR para_no < back)) AS article, count(*) FILTER (WHERE para_no >= back) AS back FROM k JOIN a USING (doc_id) GROUP BY doc_id HAVING count(*) FILTER (WHERE body IS NULL OR para_no < body + 1) + count(*) FILTER (WHERE para_no >= body + 1 AND (back IS NULL OR para_no < back)) + count(*) FILTER (WHERE para_no >= back) > 0""".replace("WHERE para_no < body + 1) AS head", "WHERE body IS NULL OR para_no < body + 1) AS head")
)
def text_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of a head, an article and back matter, by what they hold first."""
    lines = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("para_no", "text"))
    parts = {"head": (None, 0, "body", 1), "article": ("body", 1, "back", 0), "back": ("back", 0, None, 0)}
    found = stories.segments(lines, ["doc_id"], {"body": ("contains", "the "), "back": ("contains", "@")}, parts)
    return found.groupBy("doc_id").agg(*(F.count_if(F.col("part") == p).alias(p) for p in parts))


@query(
    f"""WITH p AS (SELECT conv_id, turn, text, first_value(text) OVER (PARTITION BY conv_id ORDER BY turn, role) AS c FROM conversations), w AS (SELECT conv_id, turn, list_filter(string_split(lower({_T1.replace('text', 'c')}), ' '), lambda x: length(x) >= 3) AS w, lower({_T1}) AS t FROM p),
s AS (SELECT conv_id, turn, CASE WHEN len(w) = 0 THEN 0 ELSE len(list_filter(w, lambda x: contains(t, x))) / len(w) END AS s FROM w) SELECT conv_id, turn AS story_no, round(max(s) OVER (PARTITION BY conv_id ORDER BY turn), 6)::DOUBLE AS canonical_coverage FROM s"""
)
def story_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best coverage of the first turn so far."""
    turns = table(spark, sf_dir, "conversations").withColumn("canonical", F.first("text").over(Window.partitionBy("conv_id").orderBy("turn", "role")))
    found = stories.running_coverage(turns.withColumnRenamed("turn", "story_no"), ["conv_id"], "canonical", "text")
    return found.select("conv_id", "story_no", F.round("canonical_coverage", 6).alias("canonical_coverage"))


@query(
    f"""WITH d AS (SELECT doc_id, source, sha1({_T1}) AS f, {_T1} AS t FROM documents), g AS (SELECT source, f, min(doc_id) AS first, row_number() OVER (PARTITION BY source ORDER BY min(doc_id)) AS n FROM d WHERE t <> '' GROUP BY source, f HAVING count(*) > 1)
SELECT doc_id, 'story-' || n AS story_id FROM d LEFT JOIN g ON g.source = d.source AND g.f = d.f"""
)
def story_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The story of each text that repeats within its source; others keep their own text."""
    docs = table(spark, sf_dir, "documents").select("source", "doc_id", "text")
    found = stories.with_stories(docs, stories.repeated_stories(docs, ["source"], "doc_id", "text"), ["source"], "text")
    return found.select("doc_id", "story_id")


@query(
    f"""WITH {_FRAMES}, st AS (SELECT doc_id, page_no, count(*) AS n, bool_or(flag = 'R') AS ref FROM fr WHERE status = 'F' GROUP BY ALL)
SELECT doc_id, page_no, 'page-story-' || page_no AS story_id, n AS paragraphs, CASE WHEN ref THEN 'reference' ELSE 'article' END AS role, CASE WHEN ref THEN 7.6 ELSE 8.9 END::DOUBLE AS font_size_pt FROM st"""
)
def page_stories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """a story for each page with text."""
    assigned = _frames(spark, sf_dir).where("status = 'F'").select("doc_id", "page_no", F.col("item_no").alias("para_no"), F.col("flag").alias("text"))
    return stories.anchored_stories(assigned, ["doc_id"], F.col("text") == "R").select("doc_id", "page_no", "story_id", "paragraphs", "role", "font_size_pt")


_GAPS = f"""base AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, page_no ORDER BY w * h DESC, item_no) AS n FROM fr WHERE flag = 'N') WHERE n = 1),
st AS (SELECT doc_id, page_no, bool_or(flag = 'R') AS ref FROM fr WHERE status = 'F' GROUP BY ALL),
b0 AS (SELECT st.doc_id, st.page_no, coalesce(b.x, 72.0) AS x, coalesce(b.y, CASE WHEN page_no = 1 THEN 390 ELSE 120 END)::DOUBLE AS y, coalesce(b.w, {PAGE_W} - 144) AS w, coalesce(b.h, {PAGE_H} - CASE WHEN page_no = 1 THEN 470 ELSE 210 END)::DOUBLE AS h, CASE WHEN b.x IS NULL THEN 2 ELSE 1 END AS k FROM st LEFT JOIN base b USING (doc_id, page_no)),
b1 AS (SELECT doc_id, page_no, c AS base_no, x + c * ((w - 18) / 2 + 18) AS x, y, CASE WHEN k = 2 THEN (w - 18) / 2 ELSE w END AS w, h FROM b0, (VALUES (0), (1)) v(c) WHERE c < k),
blocks AS (SELECT * FROM fr WHERE flag = 'A'),
cuts AS (SELECT b.doc_id, b.page_no, b.base_no, b.x, b.w, b.y, b.h, greatest(b.y, k.y - 8) AS top, least({PAGE_H} - 76, k.y + k.h + 10) AS bottom, k.item_no, 0 AS last FROM b1 b JOIN blocks k ON k.doc_id = b.doc_id AND k.page_no = b.page_no AND k.status <> 'F' AND b.x < k.x + k.w AND k.x < b.x + b.w),
r AS (SELECT * FROM cuts WHERE bottom > top UNION ALL SELECT doc_id, page_no, base_no, x, w, y, h, least(y + h, {PAGE_H} - 76), least(y + h, {PAGE_H} - 76), NULL, 1 FROM b1),
g AS (SELECT *, greatest(y, coalesce(max(bottom) OVER (PARTITION BY doc_id, page_no, base_no ORDER BY last, top, item_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), y)) AS f FROM r),
o AS (SELECT doc_id, page_no, base_no, x, w, f AS y, top - f AS h FROM g WHERE top - f >= 42),
fl AS (SELECT * FROM o UNION ALL SELECT doc_id, page_no, base_no, x, w, y, h FROM b1 WHERE (doc_id, page_no, base_no) NOT IN (SELECT (doc_id, page_no, base_no) FROM o))"""


@query(
    f"""WITH {_FRAMES}, {_GAPS} SELECT doc_id, page_no, CASE WHEN ref THEN 'reference' ELSE 'article' END AS role, 'page-story-' || page_no AS story_id, (row_number() OVER (PARTITION BY doc_id, page_no ORDER BY y, x, base_no))::INT AS frame_no, round(x, 6) AS x, round(y, 6) AS y, round(w, 6) AS w, round(h, 6) AS h FROM fl JOIN st USING (doc_id, page_no)
UNION ALL SELECT doc_id, page_no, CASE WHEN status = 'F' THEN 'footnote' ELSE 'table' END, NULL, item_no::INT, x, y, w, h FROM blocks UNION ALL SELECT doc_id, page_no, 'footer', NULL, item_no::INT, x, y, w, h FROM fr WHERE flag = 'R'"""
)
def anchored_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages laid out anew around the blocks of their reference."""
    every = _frames(spark, sf_dir)
    frames = every.where("flag <> 'A'").withColumns({"role": F.when(F.col("flag") == "N", "article").otherwise("footer"), "columns": F.lit(1), "column_gap": F.lit(None).cast("double")})
    blocks = every.where("flag = 'A'").select("doc_id", "page_no", F.col("item_no").cast("long").alias("block_no"), F.when(F.col("status") == "F", "footnote").otherwise("table").alias("role"), "x", "y", "w", "h")
    assigned = every.where("status = 'F'").select("doc_id", "page_no", F.col("item_no").alias("para_no"), F.col("flag").alias("text"))
    found = stories.anchored_frames(frames, blocks, _pages(spark, sf_dir), assigned, ["doc_id"], F.col("text") == "R")
    return found.select("doc_id", "page_no", "role", "story_id", "frame_no", *(F.round(c, 6).alias(c) for c in "xywh"))


# ---- geometry and reference blocks ----


@query(
    f"""WITH {_FRAMES} SELECT doc_id, page_no, item_no, (w * h >= {PAGE_W} * {PAGE_H} * 0.08 AND h >= 8 AND NOT (y < 80 AND w < {PAGE_W} * 0.45 AND h < 90) AND NOT y > {PAGE_H} - 90) AS figure, {_FOOTER} AS footer,
(abs(x - 7) <= 2 AND abs(y - 62) <= 2 AND abs(w - {PAGE_W} + 200) <= 2 AND abs(h - {PAGE_H} + 300) <= 2) AS full_page, (x < 200 AND 100 < x + w) AS overlaps_x FROM fr"""
)
def box_predicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Figures, footers, full-page placements and horizontal overlap."""
    x, y, w, h = (F.col(c) for c in "xywh")
    band = G.overlap_x(G.Box(), G.Box("x2", "y", "w2", "h"))
    flags = {"figure": G.is_figure(x, y, w, h, F.lit(PAGE_W), F.lit(PAGE_H)), "footer": G.is_footer(y, w, h, F.lit(PAGE_H)), "full_page": G.is_full_page(x - 7, y - 62, w, h, F.lit(PAGE_W - 200), F.lit(PAGE_H - 300)), "overlaps_x": band}
    return _frames(spark, sf_dir).withColumns({"x2": F.lit(100.0), "w2": F.lit(100.0)}).withColumns(flags).select("doc_id", "page_no", "item_no", *flags)


@query(
    f"""WITH {_FRAMES}, c AS (SELECT doc_id, page_no, item_no AS caption_no, x, y, w, h, min(y) OVER (PARTITION BY doc_id, page_no ORDER BY y RANGE BETWEEN 3 FOLLOWING AND UNBOUNDED FOLLOWING) AS next_y, CASE WHEN status = 'F' THEN y + 150 END AS source_y FROM fr WHERE flag = 'R')
SELECT c.doc_id, c.page_no, c.caption_no, l.item_no AS line_no FROM c JOIN fr l ON l.doc_id = c.doc_id AND l.page_no = c.page_no AND l.flag = 'A' AND l.y > c.y + c.h + 6 AND l.y < coalesce(source_y, least(next_y, c.y + 220)) - 4 AND l.x >= c.x - 12 AND l.x + l.w <= c.x + greatest(c.w, 180) + 24"""
)
def caption_table_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells between a caption and its source note, or where that is missing."""
    frames = _frames(spark, sf_dir)
    captions = frames.where("flag = 'R'").withColumn("y", F.col("y").cast("long")).withColumnRenamed("item_no", "caption_no").withColumn("source_y", F.when(F.col("status") == "F", F.col("y") + 150))
    lines = frames.where("flag <> 'R'").withColumnRenamed("item_no", "line_no").withColumn("cell", F.col("flag") == "A")
    return layout.table_lines(layout.next_below(captions, ["doc_id", "page_no"], "y"), lines, ["doc_id", "page_no"])


@query(f"WITH {_FRAMES} SELECT doc_id, page_no, item_no FROM fr a WHERE flag <> 'R' AND NOT EXISTS (SELECT 1 FROM fr b WHERE b.doc_id = a.doc_id AND b.page_no = a.page_no AND b.flag = 'R' AND a.x < b.x + b.w AND b.x < a.x + a.w AND a.y < b.y + b.h AND b.y < a.y + a.h)")
def free_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames that overlap no block."""
    frames = _frames(spark, sf_dir)
    return layout.without_overlap(frames.where("flag <> 'R'"), frames.where("flag = 'R'"), ["doc_id", "page_no"]).select("doc_id", "page_no", "item_no")


_LINES = f"""ln AS (SELECT doc_id, page_no, x, y, w, 10.0::DOUBLE AS h, CASE flag WHEN 'R' THEN CASE WHEN status = 'F' THEN 'Tabell ' ELSE 'Figur ' END || item_no || ': x' WHEN 'A' THEN CASE WHEN status = 'F' THEN 'Källa: ' || item_no ELSE item_no || ' note' END ELSE 'cell ' || item_no END AS text, item_no FROM fr),
pl AS (SELECT *, row_number() OVER (PARTITION BY doc_id, page_no ORDER BY y, x, text, w, h) AS line_no, regexp_matches(text, '^(Figur|Tabell)') AS caption, starts_with(text, 'Källa') AS note FROM ln),
ca AS (SELECT *, row_number() OVER (PARTITION BY doc_id, page_no ORDER BY line_no) AS caption_no FROM pl WHERE caption),
cn AS (SELECT c.*, (SELECT min(d.y) FROM ca d WHERE d.doc_id = c.doc_id AND d.page_no = c.page_no AND d.y > c.y + 2) AS next_y FROM ca c),
so AS (SELECT c.doc_id, c.page_no, c.caption_no, arg_min(struct_pack(n := l.line_no, x := l.x, y := l.y, w := l.w), l.line_no) AS s FROM cn c JOIN pl l ON l.doc_id = c.doc_id AND l.page_no = c.page_no AND l.note AND l.y > c.y AND (c.next_y IS NULL OR l.y < c.next_y) AND abs(l.x - c.x) <= greatest(80, c.w * 0.55) GROUP BY ALL),
ta AS (SELECT c.doc_id, c.page_no, c.caption_no, min(l.x) AS x, min(l.y) AS y, max(l.x + l.w) - min(l.x) AS w, max(l.y + l.h) - min(l.y) AS h, count(*) AS n FROM cn c LEFT JOIN so USING (doc_id, page_no, caption_no) JOIN pl l ON l.doc_id = c.doc_id AND l.page_no = c.page_no AND NOT l.caption AND NOT l.note AND l.y > c.y + c.h + 6
 AND l.y < coalesce(s.y, least(c.next_y, c.y + 220)) - 4 AND l.x >= c.x - 12 AND l.x + l.w <= c.x + greatest(c.w, 180) + 24 WHERE starts_with(c.text, 'Tabell') GROUP BY ALL),
no AS (SELECT doc_id, page_no, line_no, min(caption_no) AS caption_no FROM (SELECT s.doc_id, s.page_no, s.caption_no, l.line_no FROM so s JOIN cn c USING (doc_id, page_no, caption_no) JOIN pl l ON l.doc_id = s.doc_id AND l.page_no = s.page_no AND l.line_no >= s.s.n AND l.y < least(coalesce(c.next_y, 'inf'::DOUBLE), s.s.y + 80) AND l.x >= s.s.x - 8 AND l.x <= s.s.x + greatest(s.s.w, 180) + 12) GROUP BY ALL),
nb AS (SELECT n.doc_id, n.page_no, n.caption_no, min(l.x) AS x, min(l.y) AS y, max(l.x + l.w) - min(l.x) AS w, max(l.y + l.h) - min(l.y) AS h, string_agg(l.text, ' ' ORDER BY n.line_no) AS text FROM no n JOIN pl l USING (doc_id, page_no, line_no) GROUP BY ALL),
fo AS (SELECT *, row_number() OVER (PARTITION BY doc_id, page_no ORDER BY line_no) AS k FROM pl WHERE y > {PAGE_H} - 135 AND regexp_matches(text, '^\\d+\\s+\\S')),
sh AS (SELECT *, row_number() OVER (PARTITION BY doc_id, page_no ORDER BY item_no) AS k FROM fr WHERE flag = 'N'),
al AS (SELECT doc_id, page_no, 0 AS part, caption_no AS no, 0 AS rank, 'caption' AS role, text, x, y, w, h FROM ca UNION ALL SELECT doc_id, page_no, 0, caption_no, 1, 'table', NULL, x, y, w, h FROM ta UNION ALL SELECT doc_id, page_no, 0, caption_no, 2, 'source-note', text, x, y, w, h FROM nb
 UNION ALL SELECT doc_id, page_no, 1, k, 2, 'footnote', text, x, y, w, h FROM fo UNION ALL SELECT doc_id, page_no, 2, k, 2, 'figure', '', x, y, w, h FROM sh WHERE w * h >= {PAGE_W} * {PAGE_H} * 0.08 AND h >= 8 AND NOT (y < 80 AND w < {PAGE_W} * 0.45 AND h < 90) AND NOT y > {PAGE_H} - 90)"""


def _reference_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = (
        F.when(F.col("flag") == "R", F.concat(F.when(F.col("status") == "F", "Tabell ").otherwise("Figur "), "item_no", F.lit(": x")))
        .when(F.col("flag") == "A", F.when(F.col("status") == "F", F.concat(F.lit("Källa:  "), "item_no")).otherwise(F.concat("item_no", F.lit(" note"))))
        .otherwise(F.concat(F.lit(" cell "), "item_no"))
    )
    return _frames(spark, sf_dir).select("doc_id", "page_no", "x", "y", "w", F.lit(10.0).alias("h"), text.alias("text"))


@query(f"WITH {_FRAMES}, {_LINES} SELECT doc_id, page_no, row_number() OVER (PARTITION BY doc_id, page_no ORDER BY part, no, rank)::INT AS block_no, role, no::INT AS of_no, CASE role WHEN 'table' THEN NULL ELSE text END AS text, round(x, 6) AS x, round(y, 6) AS y, round(w, 6) AS w, round(h, 6) AS h FROM al")
def reference_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Captions, tables, source notes, footnotes and figures of each page."""
    shapes = _frames(spark, sf_dir).where("flag = 'N'")
    pages = _pages(spark, sf_dir).select("doc_id", "page_no", "page_w", "page_h")
    found = layout.reference_blocks(_reference_lines(spark, sf_dir), shapes, pages, ["doc_id", "page_no"])
    text = F.when(F.col("role") != "table", F.col("text"))
    return found.select("doc_id", "page_no", "block_no", "role", "of_no", text.alias("text"), *(F.round(c, 6).alias(c) for c in "xywh"))


@query(f"WITH {_FRAMES} SELECT doc_id, page_no, sha1({_T1.replace('text', 't')}) AS page_fingerprint FROM (SELECT doc_id, page_no, string_agg(flag || item_no % 2, chr(10) ORDER BY item_no) AS t FROM fr GROUP BY ALL)")
def page_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A1: a fingerprint of each page's texts."""
    return layout.page_fingerprints(_frames(spark, sf_dir).withColumn("t", F.concat("flag", F.col("item_no") % 2)), ["doc_id", "page_no"], "item_no", "t")


# ---- gates ----


@query(
    f"""WITH {_FRAMES}, n AS (SELECT doc_id, page_no, count(*) AS c FROM fr GROUP BY ALL), e AS (SELECT doc_id, page_no, c % 3 AS c FROM n WHERE doc_id % 7 > 0 OR page_no > 1), b AS (SELECT coalesce(e.doc_id, n.doc_id) AS doc_id, coalesce(e.page_no, n.page_no) AS page_no, e.c AS e, n.c AS a FROM e FULL JOIN n ON n.doc_id = e.doc_id AND n.page_no = e.page_no)
SELECT doc_id, bool_and(e IS NOT NULL AND a IS NOT NULL AND (coalesce(e <= 1, false) OR coalesce(a = e, false))) AS columns_match, coalesce(bool_and(a >= 2) FILTER (WHERE page_no BETWEEN 2 AND 17), true) AS two_columns FROM b GROUP BY doc_id"""
)
def column_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expected and actual columns by page, and the main pages' columns."""
    actual = _frames(spark, sf_dir).groupBy("doc_id", "page_no").agg(F.count("*").alias("columns"))
    expected = actual.where("doc_id % 7 > 0 OR page_no > 1").withColumn("columns", F.col("columns") % 3)
    return gate.columns_match(expected, actual, ["doc_id"]).join(gate.main_flow_columns(actual, ["doc_id"]), "doc_id")


@query(
    f"""WITH {_FRAMES} SELECT doc_id, count(*) FILTER (WHERE flag = 'A') AS textFrame, count(*) FILTER (WHERE flag <> 'A') AS shape, count(*) FILTER (WHERE status = 'F') AS figures, count(*) FILTER (WHERE status = 'F' AND flag = 'R') AS wrapped, coalesce(bool_and(status <> 'F' OR flag = 'R'), true) AS wrap_passed FROM fr GROUP BY doc_id"""
)
def item_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items by kind, and figures that wrap text."""
    items = _frames(spark, sf_dir).withColumns({"kind": F.when(F.col("flag") == "A", "textFrame").otherwise("shape"), "is_figure": F.col("status") == "F", "text_wrap": F.when(F.col("flag") == "R", "bounding-box")})
    return gate.item_counts(items, ["doc_id"]).join(gate.wrap_counts(items, ["doc_id"]), "doc_id")


@query(f"WITH t AS (SELECT conv_id, {_T1} AS t FROM conversations), r AS (SELECT DISTINCT conv_id FROM t WHERE length(t) >= 32 GROUP BY conv_id, t HAVING count(*) > 1) SELECT DISTINCT c.conv_id, r.conv_id IS NOT NULL AS repeated FROM conversations c LEFT JOIN r USING (conv_id)")
def repeated_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a long enough text occurs twice."""
    return gate.repeated_page_text(table(spark, sf_dir, "conversations"), ["conv_id"])


@query(
    f"""WITH t AS (SELECT conv_id, turn, role, text, {_T1} AS p, lower({_T1}) AS k FROM conversations), l AS (SELECT u.conv_id, u.turn AS page_no, u.text, a.text AS page, u.p, a.p AS q, list_distinct(list_filter(string_split(trim(regexp_replace(regexp_replace(replace(u.k, '- ', ''), '[.,;:()\\[\\]{{}}]', ' ', 'g'), ' +', ' ', 'g')), ' '), lambda w: length(w) >= 5)) AS w,
 trim(regexp_replace(regexp_replace(replace(a.k, '- ', ''), '[.,;:()\\[\\]{{}}]', ' ', 'g'), ' +', ' ', 'g')) AS c FROM t u LEFT JOIN t a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 AND a.role <> 'user' WHERE u.role = 'user')
SELECT conv_id, page_no, bool_and(page IS NOT NULL AND coalesce(contains(q, regexp_replace(substr(p, 1, 80), '[{X.SPACES}]+[^{X.SPACES}]*$', '')) OR CASE WHEN len(w) = 0 THEN 1 ELSE len(list_filter(w, lambda x: contains(c, x))) / len(w) END >= 0.72, false)) AS landmarks_match FROM l GROUP BY ALL"""
)
def page_landmarks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the answer holds the question's landmark or words."""
    turns = table(spark, sf_dir, "conversations")
    lines = turns.where("role = 'user'").select("conv_id", F.col("turn").alias("page_no"), "text")
    pages = turns.where("role <> 'user'").select("conv_id", (F.col("turn") - 1).alias("page_no"), "text")
    return gate.landmarks_match(lines, pages, ["conv_id"])


@query(
    """WITH t AS (SELECT conv_id, turn + 1 AS n, role, text FROM conversations), f AS (SELECT conv_id, min(n) FILTER (WHERE contains(lower(text), 'ing')) AS h, min(n) FILTER (WHERE role = 'assistant') AS r FROM t GROUP BY conv_id),
b AS (SELECT conv_id, bool_and(contains(text, 'e')) AS footer_present, bool_and(contains(text, 'e ' || n) AND contains(text, 'http')) AS footer_numbered FROM t GROUP BY conv_id)
SELECT conv_id, coalesce(r >= h, true) AS sections_in_order, footer_present, footer_numbered FROM f JOIN b USING (conv_id)"""
)
def section_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sections in order, and footers on every page."""
    pages = table(spark, sf_dir, "conversations").withColumn("page_no", F.col("turn") + 1)
    order = gate.sections_in_order(pages, ["conv_id"], F.contains(F.lower("text"), F.lit("ing")), F.col("role") == "assistant")
    return order.join(gate.footers_present(pages, ["conv_id"], "e", "http"), "conv_id")


@query(
    f"""WITH {_FRAMES}, f AS (SELECT *, CASE WHEN flag = 'A' AND item_no = 1 THEN 'cover-title' WHEN flag = 'A' THEN 'cover-abstract' WHEN flag = 'N' THEN 'article' ELSE 'footer' END AS role, CASE WHEN status = 'F' THEN 'Some  Words' ELSE ' ' END AS text FROM fr),
l AS (SELECT doc_id, max(page_no) AS page_no FROM fr GROUP BY doc_id)
SELECT f.doc_id, coalesce(bool_or(role = 'cover-title' AND status = 'F'), false) AS cover_title_present, coalesce(bool_or(role = 'cover-abstract' AND status = 'F'), false) AS cover_abstract_present,
coalesce(arg_min(y, (f.page_no, item_no)) FILTER (WHERE role = 'article') >= arg_min(y + h, (f.page_no, item_no)) FILTER (WHERE role = 'cover-abstract') - 8, true) AS article_after_cover, coalesce(bool_or(status = 'F'), false) AS leaked, bool_or(f.page_no = l.page_no AND flag = 'R' AND y >= 300) AS zone_passed FROM f JOIN l USING (doc_id) GROUP BY f.doc_id"""
)
def cover_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cover, leak and zone flags."""
    role = F.when((F.col("flag") == "A") & (F.col("item_no") == 1), "cover-title").when(F.col("flag") == "A", "cover-abstract").when(F.col("flag") == "N", "article").otherwise("footer")
    frames = _frames(spark, sf_dir).withColumns({"role": role, "text": F.when(F.col("status") == "F", "Some  Words").otherwise(" "), "item_id": F.col("flag")})
    by = ["doc_id"]
    return gate.cover_flags(frames, by, "some words").join(gate.leaks(frames, by, {"leaked": ["no such", "words"]}), by).join(gate.zone_passed(frames, by, "R", 300.0), by)


@query(
    f"""WITH {_FRAMES} SELECT doc_id, coalesce(bool_and(status = 'F') FILTER (WHERE flag = 'R'), true) AS reference_aligned FROM fr GROUP BY doc_id"""
)
def reference_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether paragraphs of reference frames have the left style."""
    paragraphs = _frames(spark, sf_dir).withColumns({"role": F.when(F.col("flag") == "R", "reference").otherwise("article"), "style_id": F.when(F.col("status") == "F", "left")})
    return gate.reference_aligned(paragraphs, ["doc_id"], "left")


@query(
    f"""WITH {_FRAMES}, x AS (SELECT doc_id, CASE flag WHEN 'A' THEN 'caption' WHEN 'N' THEN 'table' ELSE 'source-note' END AS role, CASE WHEN status = 'F' THEN 'known words here' ELSE 'unheard sentences elsewhere' END AS text FROM fr),
e AS (SELECT doc_id, coalesce(bool_and(text = 'known words here') FILTER (WHERE role = 'caption'), true) AS captions_present, coalesce(bool_and(text = 'known words here') FILTER (WHERE role = 'table'), true) AS table_texts_present, coalesce(bool_and(text = 'known words here') FILTER (WHERE role = 'source-note'), true) AS source_notes_present, count(*) FILTER (WHERE role = 'table') AS detected_tables, count(*) FILTER (WHERE role = 'caption') AS detected_captions FROM x GROUP BY doc_id),
p AS (SELECT doc_id, count(*) AS tables FROM pg GROUP BY doc_id)
SELECT doc_id, coalesce(captions_present, true) AS captions_present, coalesce(table_texts_present, true) AS table_texts_present, coalesce(source_notes_present, true) AS source_notes_present, coalesce(detected_tables, 0) AS detected_tables, coalesce(detected_captions, 0) AS detected_captions, tables, tables >= coalesce(detected_tables, 0) AS tables_present, tables >= coalesce(detected_tables, 0) AND coalesce(table_texts_present, true) AS table_blocks_match FROM p LEFT JOIN e USING (doc_id)"""
)
def block_presence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether captions, tables and source notes are in the document."""
    role = F.when(F.col("flag") == "A", "caption").when(F.col("flag") == "N", "table").otherwise("source-note")
    expected = _frames(spark, sf_dir).select("doc_id", role.alias("role"), F.when(F.col("status") == "F", "known words here").otherwise("unheard sentences elsewhere").alias("text"))
    pages = _pages(spark, sf_dir)
    rendered = pages.groupBy("doc_id").agg(F.count("*").alias("tables"))
    return gate.blocks_present(expected, pages.withColumn("text", F.lit("Many Known, words here.")), rendered, ["doc_id"])


_FLOW_FLAGS = ("footer_present", "cover_title_present", "cover_abstract_present", "footer_numbered")


@query(
    f"""WITH {_FRAMES}, d AS (SELECT doc_id, count(*) AS n, bool_and(status <> 'F' OR flag <> 'N' OR item_no > 1) AS table_blocks_match, CASE WHEN doc_id % 5 > 0 THEN doc_id % 3 > 0 END AS columns_match FROM fr GROUP BY doc_id), f AS (SELECT doc_id, table_blocks_match, coalesce(columns_match, false) AS columns_match, (0.9 + (doc_id % 11) / 100.0 >= 0.98 AND coalesce(table_blocks_match, true) AND doc_id % 2 = 0) AS text_flow FROM d)
SELECT doc_id, text_flow, coalesce(table_blocks_match, true) AS visual, columns_match AND text_flow AS structural, text_flow AND columns_match AND coalesce(table_blocks_match, true) AS release FROM f"""
)
def release_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shipped conditions with their defaults, and the gates that they make."""
    rows = _frames(spark, sf_dir).groupBy("doc_id").agg(F.bool_and((F.col("status") != "F") | (F.col("flag") != "N") | (F.col("item_no") > 1)).alias("table_blocks_match"))
    doc, given = F.col("doc_id"), {name: F.lit(True) for name in (*_FLOW_FLAGS, "visual_compared", "no_repeated_pages", "no_image_pages", "page_counts_match", "audit_passed")}
    coverage = F.lit(0.9) + (doc % 11) / F.lit(100.0)
    rows = rows.withColumns(given | {"canonical_coverage": F.round(coverage, 6), "exported_coverage": F.lit(1.0), "columns_match": F.when(doc % 5 > 0, doc % 3 > 0), "text_wrap": doc % 2 == 0})
    return gate.release_gates(rows).select("doc_id", "text_flow", "visual", "structural", "release")


@query(
    f"""WITH {_FRAMES}, s AS (SELECT doc_id, bool_or(flag = 'R' AND item_no > 5) AS overset_text, count(*) FILTER (WHERE flag = 'A') AS total_tables FROM fr GROUP BY doc_id), p AS (SELECT doc_id, count(*) AS total_text_frames, max(page_no) AS max_columns FROM pg GROUP BY doc_id)
SELECT p.doc_id, overset_text, total_tables::BIGINT AS total_tables, total_text_frames, max_columns, NOT coalesce(overset_text, false) AND p.doc_id % 4 > 0 AND coalesce(total_text_frames, 0) > 0 AS native_audit_passed, CASE WHEN total_tables > 2 THEN total_tables > 0 ELSE coalesce(total_tables > 2, true) END AS tables_present FROM p LEFT JOIN s USING (doc_id)"""
)
def export_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals of an export, and its verdict."""
    frames, pages = _frames(spark, sf_dir), _pages(spark, sf_dir)
    of = frames.select("doc_id", ((F.col("flag") == "R") & (F.col("item_no") > 5)).alias("overflows"), (F.col("flag") == "A").cast("int").alias("tables"))
    totals = gate.audit_totals(of, pages.select("doc_id", F.lit(1).alias("text_frame_count"), F.col("page_no").alias("max_column_count")), ["doc_id"])
    none = F.lit(None).cast("array<string>")
    audit = totals.withColumns({"missing_links": F.when(F.col("doc_id") % 4 == 0, F.array(F.lit("a.png"))), "font_issues": none, "full_page_pdf_placements": F.array().cast("array<string>"), "full_page_image_placements": none})
    return gate.audit_passed(audit).withColumn("tables_present", gate.tables_present(F.col("total_tables") > 2, F.col("total_tables"))).select("doc_id", "overset_text", "total_tables", "total_text_frames", "max_columns", "native_audit_passed", "tables_present")


# ---- rasters ----

_PIXELS = """px AS (SELECT l_orderkey AS page, l_linenumber AS x, (l_suppkey % 5)::INT AS y, max((l_partkey * 13 % 256)::INT) AS r, max((l_partkey * 7 % 256)::INT) AS g, max((l_suppkey * 31 % 256)::INT) AS b, max((l_partkey % 300)::INT) AS a0 FROM lineitem GROUP BY ALL), pa AS (SELECT page, x, y, r, g, b, least(a0, 255) AS a FROM px),
qa AS (SELECT page, x, y, r, 255 - g AS g, b, a FROM pa WHERE (x + y) % 4 > 0)"""


def _pixels(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    c = F.col
    grouped = table(spark, sf_dir, "lineitem").groupBy(c("l_orderkey").alias("page"), c("l_linenumber").alias("x"), (c("l_suppkey") % 5).cast("int").alias("y"))
    one = grouped.agg(F.max((c("l_partkey") * 13 % 256).cast("int")).alias("r"), F.max((c("l_partkey") * 7 % 256).cast("int")).alias("g"), F.max((c("l_suppkey") * 31 % 256).cast("int")).alias("b"), F.least(F.max((c("l_partkey") % 300).cast("int")), F.lit(255)).alias("a"))
    return one, one.where((c("x") + c("y")) % 4 > 0).withColumn("g", 255 - c("g"))


@query(f"WITH {_PIXELS} SELECT page, count(*) FILTER (WHERE a > 10 AND (r < 246 OR g < 246 OR b < 246)) AS ink FROM pa GROUP BY page")
def page_ink(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Visible pixels that are not white."""
    one, _ = _pixels(spark, sf_dir)
    return one.groupBy("page").agg(F.count_if(raster.is_ink(*(F.col(c) for c in "rgba"))).alias("ink"))


_BLEND = ", ".join(f"255 + ({p}.{c} - 255) * {p}.a / 255.0::DOUBLE AS {c}{k}" for k, p in ((1, "m"), (2, "n")) for c in "rgb")
_DELTA = " + ".join(f"{share} * pow({' + '.join(f'({c}1 - {c}2) * {v}' for c, v in zip('rgb', weights, strict=True))}, 2)" for weights, share in zip(raster.YIQ, raster.YIQ_WEIGHTS, strict=True))


@query(
    f"""WITH {_PIXELS}, k AS (SELECT page, x, y FROM pa UNION SELECT page, x, y FROM qa), w AS (SELECT k.*, coalesce(p.r, 255) AS r, coalesce(p.g, 255) AS g, coalesce(p.b, 255) AS b, coalesce(p.a, 255) AS a FROM k LEFT JOIN pa p USING (page, x, y)),
z AS (SELECT k.*, coalesce(p.r, 255) AS r, coalesce(p.g, 255) AS g, coalesce(p.b, 255) AS b, coalesce(p.a, 255) AS a FROM k LEFT JOIN qa p USING (page, x, y)), e AS (SELECT m.page, {_BLEND} FROM w m JOIN z n USING (page, x, y)),
d AS (SELECT page, count(*) FILTER (WHERE {_DELTA} > {raster.YIQ_MOST} * 0.3 * 0.3) AS differing_pixels, count(*) AS total_pixels FROM e GROUP BY page)
SELECT page, differing_pixels, total_pixels, round(differing_pixels / total_pixels, 6) AS mismatch_ratio, page % 3 = 0 OR differing_pixels / total_pixels <= 0.09 AS passed FROM d"""
)
def pixel_mismatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Perceptual differences of two images of a page, and the page's verdict."""
    found = raster.pixel_diff(*_pixels(spark, sf_dir), ["page"])
    return found.select("page", "differing_pixels", "total_pixels", F.round("mismatch_ratio", 6).alias("mismatch_ratio"), raster.page_verdict(F.col("page") % 3 == 0, F.col("mismatch_ratio")).alias("passed"))


@query(
    f"""WITH {_FRAMES}, p AS (SELECT doc_id, page_no, count(*) FILTER (WHERE flag = 'A') AS d, count(*) AS t FROM fr GROUP BY ALL), c AS (SELECT doc_id, max(page_no) AS n, CASE WHEN doc_id % 4 = 0 THEN max(page_no) - 1 ELSE max(page_no) END AS m FROM pg GROUP BY doc_id),
e AS (SELECT p.doc_id, bool_and(d = 0) AS x, bool_and(d < 4) AS o, sum(d) AS d, sum(t) AS t FROM p JOIN c USING (doc_id) WHERE page_no <= least(n, m) GROUP BY p.doc_id)
SELECT doc_id, n = m AS page_count_matches, n = m AND coalesce(x, true) AS exact_passed, n = m AND coalesce(o, true) AS tolerant_passed, round(CASE WHEN coalesce(t, 0) > 0 THEN d / t ELSE 0 END, 6)::DOUBLE AS raw_mismatch_ratio FROM c LEFT JOIN e USING (doc_id)"""
)
def document_mismatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document's verdict from its pages'."""
    pages = _frames(spark, sf_dir).groupBy("doc_id", "page_no").agg(F.count_if(F.col("flag") == "A").alias("differing_pixels"), F.count("*").alias("total_pixels")).withColumn("page_passed", F.col("differing_pixels") < 4)
    most = F.max("page_no")
    counts = _pages(spark, sf_dir).groupBy("doc_id").agg(most.alias("reference_pages"), F.when(F.col("doc_id") % 4 == 0, most - 1).otherwise(most).alias("candidate_pages"))
    found = raster.document_verdicts(pages, ["doc_id"], counts)
    return found.withColumn("raw_mismatch_ratio", F.round("raw_mismatch_ratio", 6))


# ---- text, exports, sources ----


@query("SELECT p_partkey, regexp_replace(p_name || chr(p_size::INT) || 'x', '[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F]', '', 'g') AS plain, replace(p_name || chr(p_size::INT), chr(13), '') AS sanitized, printf('#%06x', (p_partkey * 7919) & 16777215) AS color FROM part")
def clean_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts without control characters, and colours in hex."""
    marked = F.concat("p_name", F.chr("p_size"))
    return table(spark, sf_dir, "part").select("p_partkey", X.without_controls(F.concat(marked, F.lit("x"))).alias("plain"), X.sanitized(marked).alias("sanitized"), X.color_hex(F.col("p_partkey") * 7919).alias("color"))


@query("SELECT p_partkey, '\"' || p_name || ' \\u00e5\\\"\\n\"' AS literal, [p_brand] AS brands, CASE WHEN p_size % 2 = 0 THEN '#' || p_size END AS color FROM part".replace("[p_brand] AS brands", "p_brand AS brands"))
def text_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quoted literals, single values as arrays, colours."""
    color = X.parsed_color(F.when(F.col("p_size") % 2 == 0, F.concat(F.lit("#"), "p_size")).otherwise(""))
    return table(spark, sf_dir, "part").select("p_partkey", X.literal(F.concat("p_name", F.lit(' å"\n'))).alias("literal"), F.array_join(X.as_array(F.col("p_brand")), ",").alias("brands"), color["hex"].alias("color"))


@query("SELECT conv_id, sha1(string_agg(text, chr(10) ORDER BY turn, role)) AS text_sha1, count(*) AS n_texts FROM conversations GROUP BY conv_id")
def document_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document's texts end to end."""
    found = stories.document_text(table(spark, sf_dir, "conversations"), ["conv_id"], ["turn", "role"], "text")
    return found.select("conv_id", F.sha1(F.encode("text", "UTF-8")).alias("text_sha1"), "n_texts")


@query(
    f"""WITH {_FRAMES} SELECT doc_id, page_no, item_no, CASE flag WHEN 'A' THEN 'LEFT_JUSTIFIED' WHEN 'N' THEN 'CENTER_ALIGN' ELSE 'LEFT_ALIGN' END AS alignment, [y, x, y + h, x + w]::VARCHAR AS bounds, flag || chr(13) || status AS story, 2 AS n_rows, 1 AS n_cells FROM fr""".replace("[y, x, y + h, x + w]::VARCHAR", "round(y + x + (y + h) * 2 + (x + w) * 3, 6)")
)
def export_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alignments, story texts, table cells and bounds."""
    align = F.when(F.col("flag") == "A", "justify").when(F.col("flag") == "N", "center")
    b, story = drawings.bounds(*(F.col(c) for c in "xywh")), drawings.story_text(F.array("flag", "status"))
    cells = drawings.table_cells(story)
    return _frames(spark, sf_dir).select("doc_id", "page_no", "item_no", drawings.alignment(align).alias("alignment"), F.round(b[0] + b[1] + b[2] * 2 + b[3] * 3, 6).alias("bounds"), story.alias("story"), F.size(cells).alias("n_rows"), F.size(cells[0]).alias("n_cells"))


@query("WITH j AS (SELECT user_id, arg_max(CASE event_type WHEN 'purchase' THEN 'completed' WHEN 'error' THEN 'failed' WHEN 'view' THEN 'processing' ELSE event_type END, (ts, event_id)) AS status FROM events GROUP BY user_id) SELECT user_id, status, status = 'completed' AS has_result, status IN ('completed', 'failed') AS has_report, CASE status WHEN 'uploaded' THEN 10 WHEN 'processing' THEN 55 WHEN 'completed' THEN 100 WHEN 'failed' THEN 100 ELSE 0 END AS progress FROM j")
def shown_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K1, K3, K4: what others see of a job."""
    kind = F.col("event_type")
    status = F.when(kind == "purchase", "completed").when(kind == "error", "failed").when(kind == "view", "processing").otherwise(kind)
    found = jobs.latest(table(spark, sf_dir, "events").withColumn("status", status), "user_id", "status", "ts", "event_id")
    return jobs.shown(found).select("user_id", "status", "has_result", "has_report", "progress")


@query(
    f"""WITH {_FRAMES}, l AS (SELECT *, 4 + item_no * 2.5::DOUBLE AS s FROM fr), u AS (SELECT doc_id, flag, s, min((page_no, item_no)) AS f FROM l GROUP BY ALL), n AS (SELECT doc_id, flag, s, 'char-' || row_number() OVER (PARTITION BY doc_id ORDER BY f) AS style FROM u)
SELECT l.doc_id, page_no, item_no, style, round(x - greatest(2, s * 0.2), 6) AS x_pt, round(y - greatest(2, s * 0.3), 6) AS y_pt, round(w + 2 * greatest(2, s * 0.2), 6) AS width_pt, round(h + 2 * greatest(2, s * 0.3), 6) AS height_pt FROM l JOIN n USING (doc_id, flag, s)"""
)
def extracted_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Padded line boxes, and their character styles."""
    names = dict(zip("xywh", ("x_pt", "y_pt", "width_pt", "height_pt"), strict=True))
    lines = _frames(spark, sf_dir).withColumnsRenamed(names | {"item_no": "line_no", "flag": "font"}).withColumns({"font_size_pt": 4 + F.col("line_no") * 2.5, "color": F.lit(0), "flags": F.lit(None).cast("int")})
    keys = ["font", "font_size_pt", "color", "flags"]
    found = dictionary.with_ids(lines, drawings.line_styles(lines), ["doc_id"], keys, "style")
    return drawings.padded(found).select("doc_id", "page_no", F.col("line_no").alias("item_no"), "style", *(F.round(c, 6).alias(c) for c in names.values()))


@query("WITH c AS (SELECT p_partkey, unnest(['Brand#' || p_partkey % 9, p_brand, 'Brand#1']) AS name, unnest([0, 1, 2]) AS n FROM part), i AS (SELECT DISTINCT p_brand AS name FROM part WHERE p_size % 2 = 0 AND p_brand <> 'Brand#3') SELECT p.p_partkey AS key, f.font FROM part p LEFT JOIN (SELECT p_partkey, arg_min(name, n) AS font FROM c JOIN i USING (name) GROUP BY p_partkey) f USING (p_partkey)")
def font_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first candidate that is installed."""
    parts = table(spark, sf_dir, "part")
    wanted = parts.select(F.col("p_partkey").alias("key"), F.array(F.concat(F.lit("Brand#"), F.col("p_partkey") % 9), "p_brand", F.lit("Brand#1")).alias("candidates"))
    installed = parts.where("p_size % 2 = 0 AND p_brand <> 'Brand#3'").select(F.col("p_brand").alias("name"))
    return dictionary.resolve_fonts(wanted, installed).select("key", "font")


@query("WITH e AS (SELECT split_part(url, '/', 3) AS host, split_part(split_part(url, '?', 1), '/', 4) || '/' || split_part(split_part(url, '?', 1), '/', 5) AS path FROM pages) SELECT host, sha1(array_to_string(list_sort(list(path)), ',')) AS entries_sha1, len(list_distinct(list(split_part(path, '/', 1))))::INT AS n_folders, count(*) AS entry_count FROM e GROUP BY host")
def archive_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries and top folders of an archive, here of a host."""
    path = F.split_part("url", F.lit("?"), F.lit(1))
    entries = table(spark, sf_dir, "pages").select(F.split_part("url", F.lit("/"), F.lit(3)).alias("host"), F.concat(F.split_part(path, F.lit("/"), F.lit(4)), F.lit("/"), F.split_part(path, F.lit("/"), F.lit(5))).alias("path"))
    found = gate.entry_summary(entries, ["host"])
    return found.select("host", F.sha1(F.encode(F.array_join("entries", ","), "UTF-8")).alias("entries_sha1"), F.size("top_folders").alias("n_folders"), "entry_count")


@query("SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'f' || o_orderkey WHEN o_custkey % 2 = 0 THEN 'c' || o_custkey WHEN o_custkey % 3 = 0 THEN 'p' WHEN o_custkey % 5 = 0 THEN 'r' END AS path, CASE WHEN o_orderstatus = 'F' THEN 'explicit' WHEN o_custkey % 2 = 0 THEN 'adjacent' WHEN o_custkey % 3 = 0 THEN 'project-root' WHEN o_custkey % 5 = 0 THEN 'rendered' ELSE 'unknown' END AS origin FROM orders")
def reference_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first reference that is there, and where it came from."""
    cust = F.col("o_custkey")
    given = (F.when(F.col("o_orderstatus") == "F", F.concat(F.lit("f"), "o_orderkey")), F.when(cust % 2 == 0, F.concat(F.lit("c"), cust)), F.when(cust % 3 == 0, F.lit("p")), F.when(cust % 5 == 0, F.lit("r")))
    path, origin = drawings.reference_source(*given)
    return table(spark, sf_dir, "orders").select("o_orderkey", path.alias("path"), origin.alias("origin"))


def _drawing_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A zipped drawing for each customer: a page for each order, an element for each line item."""
    items = _frames(spark, sf_dir).withColumn("at", F.struct("page_no", "item_no", "x", "y", "flag", "status"))
    rows = _pages(spark, sf_dir).groupBy("doc_id").agg(F.max("page_no").alias("n")).join(items.groupBy("doc_id").agg(F.array_sort(F.collect_list("at")).alias("items")), "doc_id", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = {"A": "frame", "N": "rect", "R": "line"}
        # A few customers at once: their items are many times larger as objects.
        for batch in (b.slice(k, 100) for b in batches for k in range(0, b.num_rows, 100)):
            files = []
            for r in batch.to_pylist():
                pages = []
                for n in range(1, r["n"] + 1):
                    own = "".join(f'<d:{names[i["flag"]]} d:style-name="gr{i["status"]}" s:x="{i["x"]:.1f}cm" s:y="{i["y"]:.1f}pt" s:width="1in">{"<t:p>head<t:span t:style-name=" + chr(34) + "s" + chr(34) + ">tail</t:span><t:line-break/></t:p>" if i["flag"] == "A" else ""}</d:{names[i["flag"]]}>' for i in r["items"] or [] if i["page_no"] == n)
                    pages.append(f'<d:page d:name="{"p%d" % n if n % 2 else ""}">{own}</d:page>')
                space = 'xmlns:d="urn:d" xmlns:s="urn:s" xmlns:t="urn:t" xmlns:o="urn:o" xmlns:f="urn:f"'
                auto = '<o:automatic-styles><s:style s:name="grF" s:family="graphic"><s:graphic-properties d:fill-image-name="img"/></s:style><s:style s:name="grO" s:family="graphic"/></o:automatic-styles>'
                content = f"<o:doc {space}>{auto}{''.join(pages)}</o:doc>"
                styles = f'<o:doc {space}><s:page-layout-properties f:page-width="21cm" f:page-height="29cm"/><d:fill-image d:name="img" x:href="Pictures/a.png" xmlns:x="urn:x"/></o:doc>'
                out = io.BytesIO()
                with zipfile.ZipFile(out, "w") as z:
                    for name, data in (("content.xml", content), ("styles.xml", styles), ("Pictures/", ""), ("Pictures/a.png", "PNG")):
                        z.writestr(name, data)
                files.append((str(r["doc_id"]), out.getvalue()))
            yield pa.RecordBatch.from_arrays([pa.array([f for f, _ in files], pa.string()), pa.array([d for _, d in files], pa.binary())], ["path", "content"])

    return rows.select("doc_id", "n", "items").mapInArrow(run, "path string, content binary")


@query(
    f"""WITH {_FRAMES}, k AS (SELECT *, CASE flag WHEN 'A' THEN 0 WHEN 'N' THEN 2 ELSE 3 END AS rank FROM fr), n AS (SELECT *, row_number() OVER (PARTITION BY doc_id, page_no ORDER BY rank, item_no) - 1 AS n FROM k)
SELECT doc_id::VARCHAR AS doc_id, page_no::INT AS page_no, CASE WHEN page_no % 2 = 1 THEN 'p' ELSE 'page' END || page_no AS page_name, n::INT AS item_no, CASE WHEN flag = 'A' THEN 'textFrame' ELSE 'shape' END AS kind, 'item-' || page_no || '-' || n AS item_id, CASE WHEN status = 'F' THEN 'Pictures/a.png' END AS image_path, CASE WHEN flag = 'A' THEN 'headtail' || chr(10) ELSE '' END AS text,
round(round(x, 1) * 28.3464566929::DOUBLE, 4) AS x_pt, round(y, 1) AS y_pt, 72.0::DOUBLE AS width_pt, round(21 * 28.3464566929::DOUBLE, 4) AS page_width_pt FROM n"""
)
def drawing_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page items of zipped drawings, with the image of their style."""
    found = drawings.page_items(drawings.filled_items(_drawing_files(spark, sf_dir)))
    return found.select("doc_id", "page_no", "page_name", "item_no", "kind", "item_id", "image_path", "text", F.round("x_pt", 4).alias("x_pt"), F.round("y_pt", 4).alias("y_pt"), "width_pt", F.round("page_width_pt", 4).alias("page_width_pt"))


@query("WITH d AS (SELECT DISTINCT o_custkey::VARCHAR AS doc_id FROM orders), e AS (SELECT * FROM (VALUES (0, 'content.xml', 'content.xml', 'stream'), (1, 'styles.xml', 'styles.xml', 'stream'), (2, 'Pictures', 'Pictures', 'storage'), (3, 'Pictures/a.png', 'a.png', 'stream')) v(entry_no, path, name, type)) SELECT doc_id, entry_no, path, name, type FROM d, e")
def container_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries of each container."""
    return containers.entries(_drawing_files(spark, sf_dir)).select("doc_id", "entry_no", "path", "name", "type")


@query("WITH d AS (SELECT DISTINCT o_custkey::VARCHAR AS doc_id FROM orders) SELECT doc_id, 'img' AS name, 'Pictures/a.png' AS path, 'PNG' AS content FROM d")
def drawing_fills(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Image fills and the bytes they name."""
    return drawings.fills(_drawing_files(spark, sf_dir)).withColumn("content", F.decode("content", "UTF-8"))


_QUILL = f"""WITH l AS (SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) AS n, trim(regexp_replace(unnest(string_split(text, chr(10))), '[{X.SPACES}]+', ' ', 'g')) AS t FROM documents),
s AS (SELECT doc_id, min(n) FILTER (WHERE contains(t, 'Raavi') OR contains(t, '@')) AS stop FROM l GROUP BY doc_id),
k AS (SELECT l.doc_id, t, length(t) AS len, len(regexp_extract_all(t, '[A-Za-zÅÄÖåäö0-9]')) AS solid, n FROM l JOIN s USING (doc_id) WHERE stop IS NULL OR n < stop)"""


@query(
    f"""{_QUILL} SELECT doc_id::VARCHAR AS doc_id, count(*) AS n_paragraphs, sum(len)::BIGINT AS chars FROM k WHERE len >= 2 AND solid >= 2 AND solid / greatest(len, 1) >= 0.35 GROUP BY doc_id"""
)
def canonical_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Readable paragraphs of UTF-16 streams before the first that is noise."""
    streams = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("doc_id"), F.encode("text", "UTF-16LE").alias("content"))
    found = containers.canonical_paragraphs(streams, fonts=("Raavi", "@"))
    return found.groupBy("doc_id").agg(F.count("*").alias("n_paragraphs"), F.sum(F.length("text")).alias("chars"))


@query(f"WITH {_FRAMES} SELECT doc_id, page_no, string_agg(item_no::VARCHAR, ',' ORDER BY y, x, item_no) AS items, min(y) AS first_y FROM fr GROUP BY ALL")
def reading_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """L1: a page's items from top to bottom and left to right."""
    ranked = sequences.top(_frames(spark, sf_dir), ["doc_id", "page_no"], ["y", "x", "item_no"], 2**30)
    return ranked.groupBy("doc_id", "page_no").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("y", "x", "item_no"))), lambda i: i["item_no"].cast("string")), ",").alias("items"), F.min("y").alias("first_y"))

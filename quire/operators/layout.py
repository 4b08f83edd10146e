"""Geometry over pages: bounds, baselines, bands, gaps, nearest lines, assignment.

Every join has the page as an equality, so it is a hash or sort-merge join with a residual
condition and never all pairs of a table.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import Box, is_figure, overlap, x_band
from ..functions.text import comparable, fingerprint, is_caption, is_footnote, is_source_note, is_table_cell, normalized

Names = Sequence[str]


def union_bounds(boxes: DataFrame, by: Names) -> DataFrame:
    """The box around all boxes of a group; groups without boxes have no row."""
    return boxes.groupBy(*by).agg(F.min("x").alias("x"), F.min("y").alias("y"), (F.max(F.col("x") + F.col("w")) - F.min("x")).alias("w"), (F.max(F.col("y") + F.col("h")) - F.min("y")).alias("h"))


def baseline_rows(lines: DataFrame, by: Names, within: float = 4.0) -> DataFrame:
    """Rows of text lines: by, row_no, anchor (the first line's y) and members.

    Lines go by (y, x); one within ``within`` of a row's anchor joins that row, else begins one.
    As lines come in order of y, only the last row can take one. A page's lines fold in one array.
    """
    line = F.struct(F.col("y").cast("double").alias("y"), F.col("x").cast("double").alias("x"), F.col("item_no").cast("long").alias("item_no"))
    start = F.array().cast("array<struct<anchor:double,members:array<struct<x:double,y:double,item_no:bigint>>>>")

    def member(v: Column) -> Column:
        return F.struct(v["x"].alias("x"), v["y"].alias("y"), v["item_no"].alias("item_no"))

    def step(rows: Column, v: Column) -> Column:
        last = F.try_element_at(rows, F.lit(-1))
        grown = F.struct(last["anchor"].alias("anchor"), F.concat(last["members"], F.array(member(v))).alias("members"))
        begun = F.struct(v["y"].alias("anchor"), F.array(member(v)).alias("members"))
        near = F.coalesce(F.abs(last["anchor"] - v["y"]) <= within, F.lit(False))
        return F.when(near, F.concat(F.slice(rows, F.lit(1), F.size(rows) - 1), F.array(grown))).otherwise(F.concat(rows, F.array(begun)))

    folded = lines.groupBy(*by).agg(F.array_sort(F.collect_list(line)).alias("_lines")).withColumn("_rows", F.aggregate("_lines", start, step))
    out = folded.select(*by, F.posexplode("_rows").alias("row_no", "_row"))
    return out.select(*by, (F.col("row_no") + 1).alias("row_no"), F.col("_row.anchor").alias("anchor"), F.transform(F.array_sort("_row.members"), lambda m: m["item_no"]).alias("members"))


def overlapping(boxes: DataFrame, by: Names) -> DataFrame:
    """Pairs of overlapping boxes of a page: by, item_no, item_no_b."""
    right = boxes.select(*by, *(F.col(c).alias(f"{c}_b") for c in ("item_no", "x", "y", "w", "h")))
    return boxes.join(right, list(by)).where((F.col("item_no") < F.col("item_no_b")) & overlap(Box(), Box.suffixed("_b"))).select(*by, "item_no", "item_no_b")


def without_overlap(frames: DataFrame, blocks: DataFrame, by: Names) -> DataFrame:
    """Frames that overlap no block of their page."""
    right = blocks.select(*(F.col(c).alias(f"_{c}") for c in by), *(F.col(c).alias(f"{c}_b") for c in "xywh"))
    same = F.lit(True)
    for c in by:
        same &= F.col(c) == F.col(f"_{c}")
    return frames.join(right, same & overlap(Box(), Box.suffixed("_b")), "left_anti")


def page_analysis(frames: DataFrame, by: Names, columns: Column | None = None, flow: Column | None = None) -> DataFrame:
    """Per page: frames, columns (the declared most, or distinct bands of flow frames), and bands (A1, A5)."""
    declared = F.coalesce(F.max(columns), F.lit(0)) if columns is not None else F.lit(0)
    inside = F.lit(True) if flow is None else flow
    bands = F.count_distinct(F.when(inside, x_band(F.col("x"))))
    wide = (columns > 1) if columns is not None else F.lit(False)
    edges = F.array_sort(F.collect_list(F.when(wide, F.struct(F.col("x").alias("left"), (F.col("x") + F.col("w")).alias("right")))))
    return frames.groupBy(*by).agg(F.count("*").alias("frame_count"), F.greatest(declared, bands).cast("long").alias("column_count"), edges.alias("column_bands"))


def page_fingerprints(frames: DataFrame, by: Names, order: str, text: str) -> DataFrame:
    """Per page, the fingerprint of its frames' texts joined by line feeds (A1)."""
    texts = F.transform(F.array_sort(F.collect_list(F.struct(order, F.coalesce(F.col(text), F.lit("")).alias("t")))), lambda f: f["t"])
    return frames.groupBy(*by).agg(F.array_join(texts, "\n").alias("_t")).select(*by, fingerprint(F.col("_t")).alias("page_fingerprint"))


def interval_gaps(bases: DataFrame, blocks: DataFrame, by: Names, *, margin: float = 76, above: float = 8, below: float = 10, least: float = 42) -> DataFrame:
    """What is left of a base frame's height between the blocks that cross it: by, y, h.

    bases: by, base_no, x, y, w, h, page_h; blocks: by, block_no, x, y, w, h. A cut reaches from a
    little above its block to a little below. Gaps under ``least`` go; the last is clipped to the
    base. A gap before a cut that lies below the base is not. A base with no gap stays whole.
    """
    right = blocks.select(*(F.col(c).alias(f"_{c}") for c in by), "block_no", *(F.col(c).alias(f"{c}_b") for c in "xywh"))
    same = F.col("x") < F.col("x_b") + F.col("w_b")
    same &= F.col("x_b") < F.col("x") + F.col("w")
    for c in by:
        same &= F.col(c) == F.col(f"_{c}")
    limit = F.col("page_h") - margin
    cuts = bases.join(right, same).withColumn("_top", F.greatest("y", F.col("y_b") - above)).withColumn("_bottom", F.least(limit, F.col("y_b") + F.col("h_b") + below)).where("_bottom > _top")
    end = F.least(F.col("y") + F.col("h"), limit)
    columns = [*by, "base_no", "x", "y", "w", "h", "page_h"]
    # The base's end is a last row of its own.
    rows = cuts.select(*columns, "_top", "_bottom", "block_no", F.lit(0).alias("_last")).unionByName(bases.select(*columns, end.alias("_top"), end.alias("_bottom"), F.lit(None).cast("long").alias("block_no"), F.lit(1).alias("_last")))
    before = Window.partitionBy(*by, "base_no").orderBy("_last", "_top", "block_no").rowsBetween(Window.unboundedPreceding, -1)
    found = rows.withColumn("_from", F.greatest("y", F.coalesce(F.max("_bottom").over(before), F.col("y"))))
    gaps = found.where(F.col("_top") - F.col("_from") >= least).select(*by, "base_no", "x", "w", F.col("_from").alias("y"), (F.col("_top") - F.col("_from")).alias("h"))
    whole = bases.join(gaps.select(*by, "base_no").distinct(), [*by, "base_no"], "left_anti").select(*by, "base_no", "x", "w", "y", "h")
    return gaps.unionByName(whole)


def split_columns(bases: DataFrame, gutter: float = 18.0) -> DataFrame:
    """Bases of two columns as one row for each column (the first step of splitting a frame)."""
    number = F.greatest(F.lit(1), F.least(F.coalesce("columns", F.lit(1)), F.lit(2)))
    gap = F.coalesce("column_gap", F.lit(gutter))
    width = F.when(number == 1, F.col("w")).otherwise((F.col("w") - gap) / 2)
    return bases.withColumn("_w", width).withColumn("_gap", gap).withColumn("column_no", F.explode(F.sequence(F.lit(0), number - 1))).withColumn("x", F.col("x") + F.col("column_no") * (F.col("_w") + F.col("_gap"))).withColumn("w", F.col("_w")).drop("_w", "_gap")


def next_below(lines: DataFrame, by: Names, y: str, beyond: int = 2, out: str = "next_y") -> DataFrame:
    """The smallest y of the group that is more than ``beyond`` below, or null (J6). y is whole.

    One sorted window with a range frame, where a join would compare all lines of a page.
    """
    window = Window.partitionBy(*by).orderBy(y).rangeBetween(beyond + 1, Window.unboundedFollowing)
    return lines.withColumn(out, F.min(y).over(window))


def first_in_band(captions: DataFrame, lines: DataFrame, by: Names) -> DataFrame:
    """For each caption the first line below it, before the next caption, and near in x.

    captions: by, caption_no, x, y, w, next_y; lines: by, line_no, x, y. Returns by, caption_no, line_no.
    """
    right = lines.select(*by, F.col("line_no"), F.col("x").alias("_x"), F.col("y").alias("_y"))
    near = (F.col("_y") > F.col("y")) & (F.col("next_y").isNull() | (F.col("_y") < F.col("next_y"))) & (F.abs(F.col("_x") - F.col("x")) <= F.greatest(F.lit(80.0), F.col("w") * 0.55))
    return captions.join(right, list(by)).where(near).groupBy(*by, "caption_no").agg(F.min(F.struct("_y", "_x", "line_no")).alias("_first")).select(*by, "caption_no", F.col("_first.line_no").alias("line_no"))


def table_lines(captions: DataFrame, lines: DataFrame, by: Names) -> DataFrame:
    """Cell-like lines between a caption and its source note.

    captions: by, caption_no, x, y, w, h, source_y and perhaps next_y; lines: by, line_no, x, y, w and ``cell``. Without a
    source note the table ends at the next caption, or 220 below its own.
    """
    following = F.col("next_y") if "next_y" in captions.columns else F.lit(None).cast("double")
    captions = captions.withColumn("source_y", F.coalesce("source_y", F.least(following, F.col("y") + 220)))
    right = lines.select(*by, "line_no", "cell", *(F.col(c).alias(f"_{c}") for c in "xyw"))
    inside = (F.col("_y") > F.col("y") + F.col("h") + 6) & (F.col("_y") < F.col("source_y") - 4) & (F.col("_x") >= F.col("x") - 12) & (F.col("_x") + F.col("_w") <= F.col("x") + F.greatest(F.col("w"), F.lit(180.0)) + 24)
    return captions.join(right, list(by)).where(inside & F.col("cell")).select(*by, "caption_no", "line_no")


def note_lines(notes: DataFrame, lines: DataFrame, by: Names) -> DataFrame:
    """A source note's lines: those from its first on, near in x, above the next caption and within 80.

    notes: by, caption_no, next_y, line_no, x, y, w of the first line; lines: by, line_no, x, y. A line that several notes
    could take goes to the earliest caption. line_no must follow (y, x).
    """
    right = lines.select(*by, F.col("line_no").alias("_no"), F.col("x").alias("_x"), F.col("y").alias("_y"))
    below = (F.col("_no") >= F.col("line_no")) & (F.col("_y") < F.least(F.coalesce("next_y", F.lit(float("inf"))), F.col("y") + 80))
    near = (F.col("_x") >= F.col("x") - 8) & (F.col("_x") <= F.col("x") + F.greatest(F.col("w"), F.lit(180.0)) + 12)
    return claimed_lines(notes.join(right, list(by)).where(below & near).select(*by, "caption_no", F.col("_no").alias("line_no")), by)


def claimed_lines(candidates: DataFrame, by: Names) -> DataFrame:
    """Each line goes to the earliest caption that could take it (J9). candidates: by, caption_no, line_no."""
    return candidates.groupBy(*by, "line_no").agg(F.min("caption_no").alias("caption_no"))


def reference_blocks(lines: DataFrame, shapes: DataFrame, pages: DataFrame, by: Names) -> DataFrame:
    """Captions, tables, source notes, footnotes and figures of reference pages, as numbered blocks.

    lines: by, x, y, w, h, text; shapes: by, item_no, x, y, w, h; pages: by, page_w, page_h; ``by`` ends with the page.
    Returns by, block_no, role, of_no (the caption's, footnote's or shape's number), text and the box. A caption's
    table and source note follow it; footnotes and figures come after all captions.
    """
    text = F.col("text")
    plain = lines.withColumn("text", normalized(text)).where("text <> ''")
    in_order = Window.partitionBy(*by).orderBy("y", "x", "text", "w", "h")
    plain = plain.withColumn("line_no", F.row_number().over(in_order)).withColumns({"caption": is_caption(text, plain=True), "note": is_source_note(text, plain=True)})
    captions = plain.where("caption").withColumn("caption_no", F.row_number().over(Window.partitionBy(*by).orderBy("line_no")))
    # The first caption more than 2 below, also of fractions: from the next larger y on.
    later = captions.select(*by, F.col("y").alias("_y"))
    below = captions.select(*by, "caption_no", "y").join(later, list(by)).where(F.col("_y") > F.col("y") + 2).groupBy(*by, "caption_no").agg(F.min("_y").alias("next_y"))
    captions = captions.select(*by, "caption_no", "text", *"xywh").join(below, [*by, "caption_no"], "left")
    first = first_in_band(captions, plain.where("note").select(*by, "line_no", "x", "y"), by)
    note = first.join(plain.select(*by, "line_no", F.col("x").alias("source_x"), F.col("y").alias("source_y"), F.col("w").alias("source_w")), [*by, "line_no"])
    known = captions.join(note.select(*by, "caption_no", "line_no", "source_x", "source_y", "source_w"), [*by, "caption_no"], "left")

    cells = plain.where("NOT caption AND NOT note").withColumn("cell", is_table_cell(text, plain=True))
    is_table = F.startswith(comparable(text), F.lit("tabell"))
    inside = table_lines(known.where(is_table).drop("line_no"), cells.select(*by, "line_no", "cell", "x", "y", "w"), by).join(cells.select(*by, "line_no", "text", *"xywh"), [*by, "line_no"])
    tables = _of_lines(inside, by)
    rows = baseline_rows(inside.select(*by, "caption_no", "x", "y", F.col("line_no").alias("item_no")), [*by, "caption_no"]).select(*by, "caption_no", "row_no", F.posexplode("members").alias("_at", "line_no"))
    row_text = rows.join(inside.select(*by, "caption_no", "line_no", "text"), [*by, "caption_no", "line_no"]).groupBy(*by, "caption_no", "row_no").agg(_joined("_at", "\t").alias("_row"))
    tables = tables.join(row_text.groupBy(*by, "caption_no").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("row_no", "_row"))), lambda r: r["_row"]), "\n").alias("text")), [*by, "caption_no"])
    taken = note_lines(known.where("line_no IS NOT NULL").select(*by, "caption_no", "next_y", "line_no", F.col("source_x").alias("x"), F.col("source_y").alias("y"), F.col("source_w").alias("w")), plain.select(*by, "line_no", "x", "y"), by)
    of_notes = taken.join(plain.select(*by, "line_no", "text", *"xywh"), [*by, "line_no"])
    notes = _of_lines(of_notes, by).join(of_notes.groupBy(*by, "caption_no").agg(_joined("line_no", " ").alias("text")), [*by, "caption_no"])

    sized = plain.join(pages, list(by))
    footnotes = sized.where((F.col("y") > F.col("page_h") - 135) & is_footnote(text, plain=True)).withColumn("caption_no", F.row_number().over(Window.partitionBy(*by).orderBy("line_no")))
    numbered = shapes.withColumn("caption_no", F.row_number().over(Window.partitionBy(*by).orderBy("item_no"))).join(pages, list(by))
    figures = numbered.where(is_figure(*(F.col(c) for c in ("x", "y", "w", "h", "page_w", "page_h")))).withColumn("text", F.lit(""))
    out = None
    for rank, (role, found) in enumerate((("caption", captions), ("table", tables), ("source-note", notes), ("footnote", footnotes), ("figure", figures))):
        place = F.struct(F.lit(max(rank - 2, 0)).alias("part"), F.col("caption_no").alias("no"), F.lit(min(rank, 2)).alias("rank"))
        part = found.select(*by, place.alias("_place"), F.lit(role).alias("role"), F.col("caption_no").alias("of_no"), "text", *(F.col(c).cast("double").alias(c) for c in "xywh"))
        out = part if out is None else out.unionByName(part)
    return out.withColumn("block_no", F.row_number().over(Window.partitionBy(*by).orderBy("_place"))).drop("_place")


def _of_lines(found: DataFrame, by: Names) -> DataFrame:
    return union_bounds(found, [*by, "caption_no"])


def _joined(order: str, between: str) -> Column:
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, "text"))), lambda r: r["text"]), between)


def monotone(scores: DataFrame, by: Names, least: float = 0.16) -> DataFrame:
    """Paragraphs to pages, never backwards: by, para_no, page_no.

    scores: by, para_no, page_no (from 0) and score, for every paragraph and page of a document.
    From the current page on, the best page by score, the earliest among equals, is taken if it
    reaches ``least``; the fold over a document's paragraphs carries the current page.
    """
    pages = F.transform(F.array_sort(F.collect_list(F.struct("page_no", "score"))), lambda s: s["score"].cast("double"))
    rows = scores.groupBy(*by, "para_no").agg(pages.alias("s"))
    lists = rows.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("para_no", "s"))).alias("_paras"))

    def step(done: Column, para: Column) -> Column:
        now = F.coalesce(F.try_element_at(done, F.lit(-1))["page_no"], F.lit(0))
        ahead = F.slice(para["s"], now + 1, F.greatest(F.size(para["s"]) - now, F.lit(0)))
        best = F.array_max(ahead)
        # no page ahead scores above 0: the current one stays
        to = F.when((best > 0) & (best >= least), now + F.array_position(ahead, best).cast("int") - 1).otherwise(now)
        return F.concat(done, F.array(F.struct(para["para_no"].cast("long").alias("para_no"), to.cast("int").alias("page_no"))))

    start = F.array().cast("array<struct<para_no:bigint,page_no:int>>")
    return lists.select(*by, F.inline(F.aggregate("_paras", start, step)))

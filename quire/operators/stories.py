"""Stories and text flow: repeated frames, repair, segments, covers, footers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.geometry import is_footer
from ..functions.text import coverage_canonical, fingerprint, looks_like_heading, matchable, normalized
from .dictionary import STRETCH
from .layout import interval_gaps, split_columns
from .sequences import longest_runs, numbered, running_max, top

Names = Sequence[str]
#: Zones of a page that can be configured.
MOST_ZONES = 1000


def fingerprint_groups(frames: DataFrame, by: Names, order: str, text: str) -> DataFrame:
    """Texts that two or more frames share: by, fingerprint, members and the first frame's order (F1)."""
    plain = frames.select(*by, order, normalized(F.col(text)).alias("_t"))
    seen = plain.groupBy(*by, F.sha1(F.encode("_t", "UTF-8")).alias("fingerprint")).agg(F.count("*").alias("members"), F.min(order).alias("first"), F.max(F.length("_t")).alias("_n"))
    return seen.where("members > 1 AND _n > 0").drop("_n")


def repeated_stories(frames: DataFrame, by: Names, order: str, text: str) -> DataFrame:
    """Those groups as stories, numbered in each document by first appearance, with the first frame's text (F1)."""
    groups = fingerprint_groups(frames, by, order, text)
    whole = isinstance(groups.schema["first"].dataType, T.IntegralType)
    stretched = groups.withColumn("_stretch", F.floor(F.col("first") / STRETCH) if whole else F.lit(0).cast("long"))
    numbered_ = numbered(stretched, by, "_stretch", ["first"], "story_no").drop("_stretch")
    first = frames.select(*by, F.col(order).alias("first"), text)
    return numbered_.join(first, [*by, "first"]).withColumn("story_id", F.concat(F.lit("story-"), F.col("story_no")))


def with_stories(frames: DataFrame, stories: DataFrame, by: Names, text: str) -> DataFrame:
    """Frames with story_id; members of a story lose their own text (F1)."""
    keyed = frames.withColumn("fingerprint", fingerprint(F.col(text)))
    out = keyed.join(stories.select(*by, "fingerprint", "story_id"), [*by, "fingerprint"], "left")
    return out.withColumn(text, F.when(F.col("story_id").isNull(), F.col(text))).drop("fingerprint")


def malformed_paragraphs(paragraphs: DataFrame, by: Names, order: Names, text: str, least: int = 20) -> DataFrame:
    """Documents whose paragraphs of one character run on for ``least`` or more (F2)."""
    return longest_runs(paragraphs, by, order, F.length(normalized(F.col(text))) == 1, least)


def repaired(canonical: DataFrame, raw: DataFrame, by: Names, headings: DataFrame | None = None) -> DataFrame:
    """Canonical paragraphs with a style: of the first raw paragraph of equal text, else a template's.

    canonical: by, para_no, text; raw: by, para_no, text, style_id, font, weight. The templates are
    the first long paragraph, and the first bold one in a heading font.
    """
    keyed = raw.withColumn("_key", matchable(F.col("text")))
    exact = keyed.where(F.col("_key") != "").groupBy(*by, "_key").agg(F.min_by("style_id", "para_no").alias("_exact"))
    heading = F.lower(F.coalesce("font", F.lit(""))).contains("arial")
    templates = raw.groupBy(*by).agg(
        F.min_by("style_id", F.when(F.length(normalized(F.col("text"))) > 80, F.col("para_no"))).alias("_body"),
        F.min_by("style_id", F.when(heading & (F.col("weight") == "bold"), F.col("para_no"))).alias("_heading"),
    )
    known = keyed.where(heading & (F.length(normalized(F.col("text"))).between(1, 120))).select(*by, "_key")
    known = known.distinct().withColumn("_known", F.lit(True))
    out = canonical.withColumn("_key", matchable(F.col("text"))).join(exact, [*by, "_key"], "left").join(known, [*by, "_key"], "left").join(templates, list(by), "left")
    listed = F.lit(None).cast("boolean")
    if headings is not None:
        out = out.join(headings.select(matchable(F.col("text")).alias("_key")).distinct().withColumn("_listed", F.lit(True)), "_key", "left")
        listed = F.col("_listed")
    is_heading = looks_like_heading(F.col("text"), F.coalesce("_known", listed, F.lit(False)))
    style = F.coalesce("_exact", F.when(is_heading, F.col("_heading")).otherwise(F.col("_body")))
    return out.select(*canonical.columns, is_heading.alias("is_heading"), style.alias("style_id"))


def segments(paragraphs: DataFrame, by: Names, anchors: dict[str, tuple[str, str]], parts: dict[str, tuple[str | None, int, str | None, int]]) -> DataFrame:
    """Paragraphs of each named part: from an anchor plus an offset to before another plus an offset.

    anchors: name to ("contains" or "equals", text). parts: name to (from, offset, to, offset). A part
    whose first anchor is missing is empty; a missing last anchor is the document's end.
    """
    key = matchable(F.col("text"))
    found = paragraphs.groupBy(*by).agg(*(F.min(F.when(F.contains(key, F.lit(v.lower())) if how == "contains" else key == v.lower(), F.col("para_no"))).alias(f"_{name}") for name, (how, v) in anchors.items()))
    rows, out = paragraphs.join(found, list(by)), None
    for name, (start, plus, end, beyond) in parts.items():
        inside = F.lit(True)
        if start:
            inside &= F.col("para_no") >= F.col(f"_{start}") + plus
        if end:
            inside &= F.col(f"_{end}").isNull() | (F.col("para_no") < F.col(f"_{end}") + beyond)
        part = rows.where(inside).select(*paragraphs.columns, F.lit(name).alias("part"))
        out = part if out is None else out.unionByName(part)
    return out


def running_coverage(stories: DataFrame, by: Names, canonical: str, text: str) -> DataFrame:
    """Each story with the best canonical coverage so far; without canonical text it is 1."""
    share = F.when(F.coalesce(F.length(F.col(canonical)), F.lit(0)) == 0, F.lit(1.0)).otherwise(coverage_canonical(F.col(canonical), F.col(text)))
    return running_max(stories, by, ["story_no"], share, "canonical_coverage")


def cover_placeholders(empty: DataFrame, pages: DataFrame, first_y: DataFrame, by: Names) -> DataFrame:
    """Empty frames of the first page above the story, by y: the title's and the abstract's."""
    rows = empty.where("page_no = 1").join(pages.where("page_no = 1").select(*by, "page_w", "page_h"), list(by)).join(first_y, list(by))
    good = rows.where((F.col("w") > F.col("page_w") * 0.55) & (F.col("x") < F.col("page_w") * 0.25) & (F.col("y") < F.col("first_y") - 4) & ~is_footer(F.col("y"), F.col("w"), F.col("h"), F.col("page_h")))
    ranked = good.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy("y", "item_no"))).where("_n <= 2")
    return ranked.withColumn("role", F.when(F.col("_n") == 1, "cover-title").otherwise("cover-abstract")).withColumn("h", F.when(F.col("_n") == 2, F.greatest("h", F.lit(70.0))).otherwise(F.col("h"))).drop("_n")


def continuations(stories: DataFrame, pages: DataFrame, placed: DataFrame, empty: DataFrame, by: Names, back_matter: DataFrame | None = None) -> DataFrame:
    """For each story and page without it, the page's largest empty frame, if it is large enough.

    The largest is chosen before its size is tested, so a wide second never takes its place. One
    frame may serve several stories. All joins have the document as an equality. back_matter: documents (by) whose last page
    is left out.
    """
    if back_matter is not None:
        last = pages.groupBy(*by).agg(F.max("page_no").alias("page_no")).join(back_matter.select(*by).distinct(), list(by), "left_semi")
        pages = pages.join(last, [*by, "page_no"], "left_anti")
    open_ = stories.select(*by, "story_id").join(pages, list(by)).join(placed.select(*by, "page_no", "story_id"), [*by, "page_no", "story_id"], "left_anti")
    sized = empty.join(pages.select(*by, "page_no", "page_w", "page_h"), [*by, "page_no"])
    largest = top(sized.where(~is_footer(F.col("y"), F.col("w"), F.col("h"), F.col("page_h"))), [*by, "page_no"], [(F.col("w") * F.col("h")).desc(), F.col("item_no")])
    fits = largest.where((F.col("w") >= F.col("page_w") * 0.35) & (F.col("h") >= F.col("page_h") * 0.3)).select(*by, "page_no", "item_no", "x", "y", "w", "h")
    return open_.join(fits, [*by, "page_no"])


def footers(pages: DataFrame, empty: DataFrame, by: Names) -> DataFrame:
    """A footer box for every page: of its right-most footer-like empty frame, or the default."""
    sized = empty.join(pages.select(*by, "page_no", "page_h"), [*by, "page_no"]).where(is_footer(F.col("y"), F.col("w"), F.col("h"), F.col("page_h")))
    right = top(sized, [*by, "page_no"], [F.col("x").desc(), F.col("item_no")]).select(*by, "page_no", *(F.col(c).alias(f"_{c}") for c in "xywh"))
    out = pages.join(right, [*by, "page_no"], "left")
    return out.select(*by, "page_no", F.coalesce("_x", F.col("page_w") - 160).alias("x"), F.coalesce("_y", F.col("page_h") - 42).alias("y"), F.coalesce("_w", F.lit(135.0)).alias("w"), F.least(F.coalesce("_h", F.lit(18.0)), F.lit(28.0)).alias("h"))


def zone_frames(pages: DataFrame, empty: DataFrame, zones: DataFrame, by: Names) -> DataFrame:
    """Frames at configured zones of the last page; a label takes x, w and h of the n-th left empty frame."""
    last = top(pages, by, [F.col("page_no").desc()])
    left = empty.join(last.select(*by, "page_no", "page_w"), [*by, "page_no"]).where((F.col("x") < F.col("page_w") * 0.3) & (F.col("w") < F.col("page_w") * 0.35))
    nth = left.withColumn("zone_no", F.row_number().over(Window.partitionBy(*by).orderBy("y", "item_no"))).select(*by, "zone_no", *(F.col(c).alias(f"_{c}") for c in "xwh"))
    listed = zones.limit(MOST_ZONES + 1).collect()
    if len(listed) > MOST_ZONES:
        raise ValueError(f"more than {MOST_ZONES} zones")
    every = last.select(*by, "page_no", F.inline(F.array(*(F.struct(*(F.lit(z[c]).cast(kind).alias(c) for c, kind in zones.dtypes)) for z in listed))))
    out = every.join(nth, [*by, "zone_no"], "left")
    label = F.col("kind") == "label"
    return out.select(*by, "page_no", "zone_no", "kind", *(F.when(label, F.coalesce(f"_{c}", c)).otherwise(F.col(c)).alias(c) for c in "xwh"), "y")


def block_frames(blocks: DataFrame) -> DataFrame:
    """Blocks with padding by role and a paragraph for each row, the first row of a table bold."""
    table, rows = F.col("role") == "table", F.when(F.col("role") == "table", F.coalesce("rows", F.split("text", "\n"))).otherwise(F.array("text"))
    size = F.when(F.col("role").isin("source-note", "footnote"), 6.2).when(table, 7.2).otherwise(8.0)
    bold = F.col("role") == "caption"
    paragraphs = F.transform(rows, lambda r, i: F.struct(r.alias("text"), size.alias("font_size_pt"), (bold | (table & (i == 0))).alias("bold")))
    return blocks.select(
        "*",
        F.greatest(F.col("w") + 6, F.when(table, F.lit(80.0)).otherwise(F.col("w"))).alias("frame_w"),
        F.greatest(F.col("h") + 4, F.when(table, F.size(rows) * 12 + 10).otherwise(F.lit(12)).cast("double")).alias("frame_h"),
        paragraphs.alias("paragraphs"),
    )


def anchored_stories(assigned: DataFrame, by: Names, reference: Column) -> DataFrame:
    """A story for each page that has paragraphs, with its role and font size.

    assigned: by, page_no, para_no, text; reference says whether a paragraph marks a reference page.
    """
    lines = F.array_sort(F.collect_list(F.struct("para_no", "text")))
    pages = assigned.groupBy(*by, "page_no").agg(F.array_join(F.transform(lines, lambda p: p["text"]), "\n").alias("text"), F.bool_or(reference).alias("_ref"), F.count("*").alias("paragraphs"))
    return pages.select(*by, "page_no", F.concat(F.lit("page-story-"), F.col("page_no")).alias("story_id"), "text", fingerprint(F.col("text")).alias("fingerprint"), "paragraphs", F.when(F.col("_ref"), "reference").otherwise("article").alias("role"), F.when(F.col("_ref"), 7.6).otherwise(8.9).alias("font_size_pt"))


def anchored_frames(frames: DataFrame, blocks: DataFrame, pages: DataFrame, assigned: DataFrame, by: Names, reference: Column) -> DataFrame:
    """Pages laid out anew around the blocks of their reference.

    frames: by, page_no, item_no, role, x, y, w, h, columns, column_gap; blocks: by, page_no, block_no, role, x, y, w, h; pages: by,
    page_no, page_w, page_h; assigned: as for :func:`anchored_stories`. On every page the frames that flow go, and frames of
    captions, tables, notes and footnotes; those of the blocks come instead. Where text is assigned, the largest flow frame, or a default
    one, is split around the blocks and takes the page's story. Returns by, page_no, role, story_id, frame_no and the box.
    """
    flowing = F.col("role").isin("story", "article", "reference")
    base = top(frames.where(flowing), [*by, "page_no"], [(F.col("w") * F.col("h")).desc(), F.col("item_no")]).select(*by, "page_no", *(F.col(c).alias(f"_{c}") for c in ("x", "y", "w", "h", "columns", "column_gap")))
    is_first = F.col("page_no") == 1
    default = {"x": F.lit(72.0), "y": F.when(is_first, 390.0).otherwise(120.0), "w": F.col("page_w") - 144, "h": F.col("page_h") - F.when(is_first, 470).otherwise(210), "columns": F.lit(2), "column_gap": F.lit(18.0)}
    missing = F.col("_x").isNull()
    sized = pages.join(base, [*by, "page_no"], "left").select(*by, "page_no", "page_h", *(F.when(missing, v).otherwise(F.col(f"_{c}")).alias(c) for c, v in default.items()))
    stories = anchored_stories(assigned, by, reference)
    columns = split_columns(sized.join(stories.select(*by, "page_no"), [*by, "page_no"], "left_semi")).withColumnRenamed("column_no", "base_no")
    split = interval_gaps(columns, blocks.where("role <> 'footnote'"), [*by, "page_no"]).join(stories.select(*by, "page_no", "story_id", "role"), [*by, "page_no"])
    flow = split.withColumn("frame_no", F.row_number().over(Window.partitionBy(*by, "page_no").orderBy("y", "x", "base_no")))
    framed = blocks.where(F.col("role").isin("caption", "table", "source-note", "footnote")).select(*by, "page_no", "role", F.lit(None).cast("string").alias("story_id"), F.col("block_no").cast("int").alias("frame_no"), "x", "y", "w", "h")
    kept = frames.where(~flowing & ~F.col("role").isin("caption", "table", "source-note", "footnote") | F.col("role").isNull()).select(*by, "page_no", "role", F.lit(None).cast("string").alias("story_id"), F.col("item_no").cast("int").alias("frame_no"), "x", "y", "w", "h")
    return flow.select(*by, "page_no", "role", "story_id", "frame_no", "x", "y", "w", "h").unionByName(framed).unionByName(kept)


def document_text(rows: DataFrame, by: Names, order: Names, text: str, between: str = "\n", out: str = "text") -> DataFrame:
    """Per document, its texts in order, end to end (A10, T5), and how many there are."""
    parts = F.array_sort(F.collect_list(F.struct(*order, F.col(text).alias("_t"))))
    return rows.groupBy(*by).agg(F.array_join(F.transform(parts, lambda r: r["_t"]), between).alias(out), F.count("*").alias("n_texts"))


def styled(style: Column, font: Column, size: Column, default_font: str, default_size: float = 10.0) -> Column:
    """A run's style with a template's defaults."""
    return F.struct(style.alias("style_id"), F.coalesce(font, F.lit(default_font)).alias("font"), F.coalesce(size, F.lit(default_size)).alias("size"))

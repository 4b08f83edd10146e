"""The acceptance gate: named conditions, their conjunctions, and reasons of failure."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import LEAST_PAGE_TEXT, comparable, coverage_text, expected_text_present, landmark, matchable, normalized, units

LEAST_COVERAGE = 0.98


@dataclass(frozen=True)
class Condition:
    """A named condition, its value where the input is null, and what to say where it fails."""

    name: str
    holds: Column
    default: bool
    message: str


def gate(rows: DataFrame, conditions: Sequence[Condition], groups: Mapping[str, Sequence[str]] | None = None, verdict: str = "approved") -> DataFrame:
    """rows with a flag per condition, one per group (its conjunction), the verdict and ``reasons``."""
    rows = rows.withColumns({c.name: F.coalesce(c.holds, F.lit(c.default)) for c in conditions})
    for name, members in (groups or {}).items():
        rows = rows.withColumn(name, _every(F.col(m) for m in members))
    reasons = F.filter(F.array(*(F.when(~F.col(c.name), F.lit(c.message)) for c in conditions)), lambda x: x.isNotNull())
    return rows.withColumn(verdict, _every(F.col(c.name) for c in conditions)).withColumn("reasons", reasons)


def _every(columns) -> Column:
    out = F.lit(True)
    for c in columns:
        out &= c
    return out


def repeated_page_text(pages: DataFrame, by: Sequence[str], text: str = "text") -> DataFrame:
    """Per document, whether a page text of some length occurs twice."""
    plain = pages.select(*by, normalized(F.col(text)).alias("_t"))
    counts = plain.where(units(F.col("_t")) >= LEAST_PAGE_TEXT).groupBy(*by, "_t").count()
    found = counts.groupBy(*by).agg(F.max(F.col("count") > 1).alias("_any"))
    return pages.select(*by).distinct().join(found, list(by), "left").select(*by, F.coalesce("_any", F.lit(False)).alias("repeated"))


def item_counts(items: DataFrame, by: Sequence[str], kind: str = "kind", kinds: Sequence[str] = ("textFrame", "shape")) -> DataFrame:
    """Items of each kind (A3, A4)."""
    return items.groupBy(*by).agg(*(F.count_if(F.col(kind) == k).alias(k) for k in kinds))


def wrap_counts(shapes: DataFrame, by: Sequence[str]) -> DataFrame:
    """Shapes that are figures, those that wrap text, and whether all do."""
    wraps = F.col("text_wrap").eqNullSafe(F.lit("bounding-box"))
    return shapes.groupBy(*by).agg(F.count_if("is_figure").alias("figures"), F.count_if(F.col("is_figure") & wraps).alias("wrapped"), F.coalesce(F.bool_and(~F.col("is_figure") | wraps), F.lit(True)).alias("wrap_passed"))


def columns_match(expected: DataFrame, actual: DataFrame, by: Sequence[str], profile_used: bool = False) -> DataFrame:
    """Per document: equal page counts, and each expected column count above 1 is met."""
    both = expected.withColumnRenamed("columns", "_e").join(actual.withColumnRenamed("columns", "_a"), [*by, "page_no"], "full_outer")
    ok = F.col("_e").isNotNull() & F.col("_a").isNotNull() & ((F.col("_e") <= 1) | (F.col("_a") == F.col("_e")) | (F.lit(profile_used) & (F.col("_a") >= 1)))
    return both.groupBy(*by).agg(F.bool_and(ok).alias("columns_match"))


def main_flow_columns(pages: DataFrame, by: Sequence[str], first: int = 2, last: int = 17) -> DataFrame:
    """Pages first to last have two columns or more; none: true."""
    inside = F.col("page_no").between(first, last)
    return pages.groupBy(*by).agg(F.coalesce(F.bool_and(F.when(inside, F.col("columns") >= 2)), F.lit(True)).alias("two_columns"))


def landmarks_match(lines: DataFrame, pages: DataFrame, by: Sequence[str], least: float = 0.72) -> DataFrame:
    """Per page, whether each caption and source line is there by its landmark or enough words.

    A page that only the reference has fails; pages without such lines pass.
    """
    seen = lines.join(pages.select(*by, "page_no", F.col("text").alias("_page")), [*by, "page_no"], "left")
    found = F.contains(normalized(F.col("_page")), landmark(normalized(F.col("text")))) | (coverage_text(F.col("text"), F.col("_page")) >= least)
    return seen.groupBy(*by, "page_no").agg(F.bool_and(F.col("_page").isNotNull() & F.coalesce(found, F.lit(False))).alias("landmarks_match"))


def sections_in_order(pages: DataFrame, by: Sequence[str], heading: Column, is_reference: Column) -> DataFrame:
    """No page of the reference part comes before the first page with its heading; no heading: true."""
    first = pages.groupBy(*by).agg(F.min(F.when(heading, F.col("page_no"))).alias("_h"), F.min(F.when(is_reference, F.col("page_no"))).alias("_r"))
    return first.select(*by, F.coalesce(F.col("_r") >= F.col("_h"), F.lit(True)).alias("sections_in_order"))


def footers_present(pages: DataFrame, by: Sequence[str], label: str, url: str) -> DataFrame:
    """Every page holds the label, and the label with its number and the address."""
    text = F.col("text")
    return pages.groupBy(*by).agg(
        F.coalesce(F.bool_and(F.contains(text, F.lit(label))), F.lit(True)).alias("footer_present"),
        F.coalesce(F.bool_and(F.contains(text, F.concat(F.lit(f"{label} "), F.col("page_no").cast("string"))) & F.contains(text, F.lit(url))), F.lit(True)).alias("footer_numbered"),
    )


def blocks_present(expected: DataFrame, pages: DataFrame, rendered: DataFrame, by: Sequence[str]) -> DataFrame:
    """Per document, whether captions, tables and source notes are there.

    expected: by, role, text of reference blocks; pages: by, page_no, text; rendered: by, tables (table frames that were made).
    A text is there by its landmark or enough of its words (R8); nothing expected passes.
    """
    lines = F.array_sort(F.collect_list(F.struct("page_no", "text")))
    whole = pages.groupBy(*by).agg(F.array_join(F.transform(lines, lambda p: p["text"]), "\n").alias("_whole"))
    role, found = F.col("role"), F.coalesce(expected_text_present(F.col("text"), F.coalesce("_whole", F.lit(""))), F.lit(False))
    seen = expected.where(role.isin("caption", "table", "source-note", "footnote")).join(whole, list(by), "left")

    def every(*roles: str) -> Column:
        return F.coalesce(F.bool_and(F.when(role.isin(*roles), found | (comparable(F.col("text")) == ""))), F.lit(True))

    flags = seen.groupBy(*by).agg(every("caption").alias("captions_present"), every("table").alias("table_texts_present"), every("source-note", "footnote").alias("source_notes_present"), F.count_if(role == "table").alias("detected_tables"), F.count_if(role == "caption").alias("detected_captions"))
    out = whole.select(*by).join(flags, list(by), "left").join(rendered, list(by), "left")
    out = out.fillna(True, ["captions_present", "table_texts_present", "source_notes_present"]).fillna(0, ["detected_tables", "detected_captions", "tables"])
    return out.withColumn("tables_present", F.col("tables") >= F.col("detected_tables")).withColumn("table_blocks_match", F.col("tables_present") & F.col("table_texts_present"))


def reference_aligned(paragraphs: DataFrame, by: Sequence[str], left_style: str) -> DataFrame:
    """Per document, whether all paragraphs of frames with the reference role have the left style; none: true."""
    inside = F.when(F.col("role") == "reference", F.col("style_id").eqNullSafe(F.lit(left_style)))
    return paragraphs.groupBy(*by).agg(F.coalesce(F.bool_and(inside), F.lit(True)).alias("reference_aligned"))


def cover_flags(frames: DataFrame, by: Sequence[str], abstract_text: str) -> DataFrame:
    """Per document: a title, an abstract that holds a text, and a first story that starts below the abstract.

    frames: by, page_no, item_no, role, text, y, h; texts are compared as :func:`matchable`.
    """
    role, order = F.col("role"), F.struct("page_no", "item_no")
    first = frames.groupBy(*by).agg(
        F.coalesce(F.bool_or((role == "cover-title") & (normalized(F.col("text")) != "")), F.lit(False)).alias("cover_title_present"),
        F.coalesce(F.bool_or((role == "cover-abstract") & F.contains(matchable(F.col("text")), F.lit(abstract_text))), F.lit(False)).alias("cover_abstract_present"),
        F.min(F.when(role.isin("story", "article"), F.struct(order.alias("o"), F.col("y").alias("y")))).alias("_story"),
        F.min(F.when(role == "cover-abstract", F.struct(order.alias("o"), (F.col("y") + F.col("h")).alias("end")))).alias("_abstract"),
    )
    return first.withColumn("article_after_cover", F.coalesce(F.col("_story.y") >= F.col("_abstract.end") - 8, F.lit(True))).drop("_story", "_abstract")


def leaks(stories: DataFrame, by: Sequence[str], phrases: Mapping[str, Sequence[str]]) -> DataFrame:
    """Per document and flag, whether any of the flag's phrases is in a story's text."""
    text = matchable(F.col("text"))
    hits = {}
    for name, words in phrases.items():
        hit = F.lit(False)
        for w in words:
            hit |= F.contains(text, F.lit(w))
        hits[name] = F.coalesce(F.bool_or(hit), F.lit(False)).alias(name)
    return stories.groupBy(*by).agg(*hits.values())


def zone_passed(frames: DataFrame, by: Sequence[str], item: str, least_y: float = 520.0) -> DataFrame:
    """Per document, whether the last page holds the named frame, low enough."""
    last = frames.groupBy(*by).agg(F.max("page_no").alias("_last"))
    here = (F.col("page_no") == F.col("_last")) & (F.col("item_id") == item) & (F.col("y") >= least_y)
    return frames.join(last, list(by)).groupBy(*by).agg(F.bool_or(here).alias("zone_passed"))


# The conditions of the text-flow gate, each with its value where the document has none, and what is said of a failure.
TEXT_FLOW = (
    ("well_formed", True, "paragraphs of single characters"),
    ("canonical_coverage_passed", False, "canonical text is missing"),
    ("exported_coverage_passed", False, "exported text is missing"),
    ("first_page_columns", True, "the first page has other columns"),
    ("main_flow_columns", True, "main pages have one column"),
    ("footer_present", False, "a footer is missing"),
    ("cover_title_present", False, "the cover has no title"),
    ("cover_abstract_present", False, "the cover has no abstract"),
    ("article_after_cover", True, "the article begins above the abstract"),
    ("footer_numbered", False, "a footer has no number or address"),
    ("no_footer_in_story", True, "a footer's text is in a story"),
    ("back_matter_in_place", True, "back matter is in a story"),
    ("text_wrap", True, "a figure does not wrap text"),
    ("landmarks_match", True, "a page lacks its landmarks"),
    ("sections_in_order", True, "references come before their heading"),
    ("captions_present", True, "a caption is missing"),
    ("tables_present", True, "a table is missing"),
    ("table_blocks_match", True, "tables differ"),
    ("caption_blocks_match", True, "captions differ"),
    ("source_notes_present", True, "a source note is missing"),
    ("table_texts_present", True, "a table's text is missing"),
    ("no_overlap", True, "text overlaps an object"),
    ("reference_aligned", True, "references are not aligned"),
    ("zones_passed", True, "back matter is out of its zone"),
)
#: Conditions of the other gates, by what they ask of a document besides the text flow.
VISUAL = ("visual_compared", "table_blocks_match", "caption_blocks_match", "source_notes_present", "no_overlap")
STRUCTURAL = ("columns_match", "no_repeated_pages", "no_image_pages")


def release_gates(rows: DataFrame, canonical: str = "canonical_coverage", exported: str = "exported_coverage", least: float = LEAST_COVERAGE) -> DataFrame:
    """rows with the gates text_flow, visual, structural and release, and the reasons of failures.

    A condition that rows has no column for, or null in it, counts as its default; the two coverages are compared with ``least``.
    """
    known = set(rows.columns)
    holds = {"canonical_coverage_passed": F.col(canonical) >= least if canonical in known else F.lit(None), "exported_coverage_passed": F.col(exported) >= least if exported in known else F.lit(None)}
    extra = [(name, False, f"{name.replace('_', ' ')}: not passed") for name in ("visual_compared", *STRUCTURAL, "page_counts_match", "audit_passed")]
    conditions = [Condition(name, holds.get(name, F.col(name) if name in known else F.lit(None).cast("boolean")), default, message) for name, default, message in (*TEXT_FLOW, *extra)]
    flow = [name for name, *_ in TEXT_FLOW]
    groups = {"text_flow": flow, "visual": VISUAL, "structural": [*STRUCTURAL, *flow]}
    return gate(rows, conditions, groups, "release")


def audit_passed(audit: DataFrame) -> DataFrame:
    """No overset text, missing link, font issue or full-page placement, and some text frame."""
    none = F.lit(True)
    for name in ("missing_links", "font_issues", "full_page_pdf_placements", "full_page_image_placements"):
        none &= F.size(F.coalesce(name, F.array().cast("array<string>"))) == 0
    return audit.withColumn("native_audit_passed", ~F.coalesce("overset_text", F.lit(False)) & none & (F.coalesce("total_text_frames", F.lit(0)) > 0))


def tables_present(flag: Column, total: Column, strict: bool = True) -> Column:
    """Detected tables need exported ones; strict also fails a document without any."""
    return F.when(flag & F.lit(strict), total > 0).otherwise(F.coalesce(flag, F.lit(True)))


def audit_totals(stories: DataFrame, pages: DataFrame, by: Sequence[str]) -> DataFrame:
    """Overflow of any story, tables, and columns at most, per document."""
    left = stories.groupBy(*by).agg(F.coalesce(F.bool_or("overflows"), F.lit(False)).alias("overset_text"), F.sum("tables").alias("total_tables"))
    right = pages.groupBy(*by).agg(F.sum("text_frame_count").alias("total_text_frames"), F.max("max_column_count").alias("max_columns"))
    return left.join(right, list(by), "full_outer")


def entry_summary(entries: DataFrame, by: Sequence[str]) -> DataFrame:
    """Sorted names, distinct top folders and their number, of each archive."""
    return entries.groupBy(*by).agg(F.sort_array(F.collect_list("path")).alias("entries"), F.sort_array(F.collect_set(F.split_part("path", F.lit("/"), F.lit(1)))).alias("top_folders"), F.count("*").alias("entry_count"))

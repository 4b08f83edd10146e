"""Zipped XML drawings, extracted page lines, manifests and sinks."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.units import drawing_points
from ..operators.dictionary import dictionary
from .containers import _mapped

# Kinds of page items in the order in which a page lists them, and the default page, A4.
KINDS = ("frame", "polygon", "rect", "line")
A4 = (595.28, 841.89)

ITEM_SCHEMA = "doc_id string, page_no int, page_name string, item_no int, kind_rank int, kind string, style_id string, x string, y string, width string, height string, points string, runs array<struct<text:string,style_id:string>>, width_page string, height_page string"
ITEM_FIELDS = [c.split()[0] for c in ITEM_SCHEMA.split(", ")]
STYLE_SCHEMA = "doc_id string, family string, style_no int, style_id string, fill_image string, font string, size string, weight string, style string, color string, align string, margin_top string, margin_bottom string"
FILL_SCHEMA = "doc_id string, name string, path string, content binary"


def _local(name: str) -> str:
    return name.rsplit("}", 1)[-1]


def _get(node: ElementTree.Element, name: str) -> str | None:
    return next((v for k, v in node.attrib.items() if _local(k) == name), None)


def _all(node: ElementTree.Element, name: str) -> list[ElementTree.Element]:
    return [x for x in node.iter() if _local(x.tag) == name]


def _xml(raw: bytes, name: str) -> ElementTree.Element:
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        return ElementTree.fromstring(z.read(name))


def _runs(paragraph: ElementTree.Element) -> list[dict]:
    """Direct text, then spans, then line breaks: how they interleave is not kept."""
    out = [{"text": paragraph.text, "style_id": None}] if paragraph.text else []
    out += [{"text": "".join(s.itertext()), "style_id": _get(s, "style-name")} for s in paragraph if _local(s.tag) == "span" and "".join(s.itertext())]
    return out + [{"text": "\n", "style_id": None} for s in paragraph if _local(s.tag) == "line-break"]


def _items(content: ElementTree.Element, styles: ElementTree.Element) -> Iterator[tuple]:
    layout = next(iter(_all(styles, "page-layout-properties")), None)
    size = (_get(layout, "page-width"), _get(layout, "page-height")) if layout is not None else (None, None)
    for page_no, page in enumerate(_all(content, "page"), 1):
        number = 0
        for rank, kind in enumerate(KINDS):
            for node in [x for x in page if _local(x.tag) == kind]:
                runs = [r for p in _all(node, "p") for r in _runs(p)]
                yield page_no, _get(page, "name") or f"page{page_no}", number, rank, kind, _get(node, "style-name"), _get(node, "x"), _get(node, "y"), _get(node, "width"), _get(node, "height"), _get(node, "points"), runs, *size
                number += 1


def items(files: DataFrame) -> DataFrame:
    """Page items of drawings, by kind and then as they come; lengths as text."""
    return _mapped(files, ITEM_SCHEMA, lambda raw: _items(_xml(raw, "content.xml"), _xml(raw, "styles.xml")))


def filled_items(files: DataFrame) -> DataFrame:
    """:func:`items` with image_path, as :func:`with_fills` finds it, looked up as each file is read."""

    def rows_of(raw: bytes) -> Iterator[tuple]:
        content, styles_ = _xml(raw, "content.xml"), _xml(raw, "styles.xml")
        paths: dict[str | None, list[str]] = {}
        for name, path in _fills(styles_):
            paths.setdefault(name, []).append(path)
        images: dict[str | None, list[str | None]] = {}
        for family, _, name, image, *_ in _styles(content):
            if family == "graphic":
                images.setdefault(name, []).extend(paths.get(image, [None]) if image is not None else [None])
        at = ITEM_FIELDS.index("style_id") - 1
        for item in _items(content, styles_):
            for path in images.get(item[at], [None]) if item[at] is not None else [None]:
                yield *item, path

    return _mapped(files, f"{ITEM_SCHEMA}, image_path string", rows_of)


def page_items(found: DataFrame) -> DataFrame:
    """Items with boxes in points, frames with text as text frames and others as shapes."""
    filled = F.exists("runs", lambda r: r["text"] != "")
    kind = F.when((F.col("kind") == "frame") & filled, "textFrame").otherwise("shape")
    return found.select(
        "doc_id",
        "page_no",
        "page_name",
        "item_no",
        kind.alias("kind"),
        F.col("kind").alias("shape_type"),
        F.concat_ws("-", F.lit("item"), "page_no", "item_no").alias("item_id"),
        "style_id",
        *(F.coalesce(drawing_points(F.col(c)), F.lit(0.0)).alias(f"{c}_pt") for c in ("x", "y", "width", "height")),
        "points",
        F.array_join(F.transform("runs", lambda r: r["text"]), "").alias("text"),
        "runs",
        F.coalesce(drawing_points(F.col("width_page")), F.lit(A4[0])).alias("page_width_pt"),
        F.coalesce(drawing_points(F.col("height_page")), F.lit(A4[1])).alias("page_height_pt"),
        *(c for c in found.columns if c == "image_path"),
    )


def _styles(content: ElementTree.Element) -> Iterator[tuple]:
    number = 0
    for auto in _all(content, "automatic-styles"):
        for s in [x for x in auto if _local(x.tag) == "style"]:
            found: dict[str, str] = {}
            for p in s:
                found |= {_local(k): v for k, v in p.attrib.items()}
            yield _get(s, "family"), number, _get(s, "name"), found.get("fill-image-name"), found.get("font-name") or found.get("font-family"), found.get("font-size"), found.get("font-weight"), found.get("font-style"), found.get("color"), found.get("text-align"), found.get("margin-top"), found.get("margin-bottom")
            number += 1


def styles(files: DataFrame) -> DataFrame:
    """Automatic styles of every family, in their order."""
    return _mapped(files, STYLE_SCHEMA, lambda raw: _styles(_xml(raw, "content.xml")))


def _fills(styles_: ElementTree.Element) -> Iterator[tuple[str | None, str]]:
    for node in _all(styles_, "fill-image"):
        yield _get(node, "name"), _get(node, "href") or ""


def fills(files: DataFrame) -> DataFrame:
    """Image fills with the bytes they name; a missing entry has none."""

    def rows_of(raw: bytes) -> Iterator[tuple]:
        with zipfile.ZipFile(io.BytesIO(raw)) as z:
            names = set(z.namelist())
            for name, path in _fills(ElementTree.fromstring(z.read("styles.xml"))):
                yield name, path, z.read(path) if path in names else None

    return _mapped(files, FILL_SCHEMA, rows_of)


def with_fills(found: DataFrame, of: DataFrame, images: DataFrame) -> DataFrame:
    """Items with the image of their graphic style: two lookups, nothing where either is missing."""
    graphic = of.where("family = 'graphic'").select("doc_id", "style_id", "fill_image")
    named = images.select("doc_id", F.col("name").alias("fill_image"), F.col("path").alias("image_path"))
    return found.join(graphic, ["doc_id", "style_id"], "left").join(named, ["doc_id", "fill_image"], "left")


LINE_SCHEMA = "doc_id STRING, page_no INT, line_no INT, text STRING, x_pt DOUBLE, y_pt DOUBLE, width_pt DOUBLE, height_pt DOUBLE, font_size_pt DOUBLE, font STRING, color INT, flags INT"


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines that an extractor wrote as JSON, with a fixed schema."""
    return spark.read.schema(LINE_SCHEMA).option("mode", "FAILFAST").json(path)


def padded(lines: DataFrame) -> DataFrame:
    """Line boxes with room around them that grows with the font."""
    across, down = F.greatest(F.lit(2.0), F.col("font_size_pt") * 0.2), F.greatest(F.lit(2.0), F.col("font_size_pt") * 0.3)
    return lines.withColumns({"x_pt": F.col("x_pt") - across, "y_pt": F.col("y_pt") - down, "width_pt": F.col("width_pt") + 2 * across, "height_pt": F.col("height_pt") + 2 * down})


def line_styles(lines: DataFrame) -> DataFrame:
    """Character styles of extracted lines: font, size to three places, colour and flags."""
    rounded = lines.withColumn("font_size_pt", F.bround("font_size_pt", 3))
    return dictionary(rounded, ["doc_id"], ["page_no", "line_no"], ["font", "font_size_pt", "color", "flags"], "char-")


def reference_source(explicit: Column, adjacent: Column, project: Column, rendered: Column) -> tuple[Column, Column]:
    """The first reference that is there, and where it came from."""
    given = {"explicit": explicit, "adjacent": adjacent, "project-root": project, "rendered": rendered}
    label = F.lit("unknown")
    for name, path in reversed(given.items()):
        label = F.when(path.isNotNull(), F.lit(name)).otherwise(label)
    return F.coalesce(*given.values()), label


def read_manifests(spark: SparkSession, path: str) -> DataFrame:
    """All manifest.json files below a folder, ordered by their path."""
    schema = "id STRING, sourcePub STRING, referencePdf STRING"
    found = spark.read.schema(schema).option("multiLine", "true").option("recursiveFileLookup", "true").option("pathGlobFilter", "manifest.json").json(path)
    return found.withColumn("path", F.input_file_name()).orderBy("path")


def write_model(rows: DataFrame, path: str) -> None:
    """Model or report rows as JSON, replacing an earlier run's."""
    rows.write.mode("overwrite").json(path)


def write_images(images: DataFrame, path: str) -> None:
    """image_name and image as a table; names hold the shape's number and a digest."""
    images.select("doc_id", "image_name", "image").write.mode("overwrite").parquet(path)


# ---- what an exporter makes of text (E1-E4, E6) ----

# An exporter's names of alignments.
ALIGNMENTS = {"left": "LEFT_ALIGN", "center": "CENTER_ALIGN", "right": "RIGHT_ALIGN", "justify": "LEFT_JUSTIFIED"}


def alignment(align: Column) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for p in ALIGNMENTS.items() for x in p)), align), F.lit("LEFT_ALIGN"))


def story_text(paragraphs: Column) -> Column:
    """Paragraphs joined by carriage returns."""
    return F.array_join(paragraphs, "\r")


def table_cells(text: Column) -> Column:
    """Rows by carriage return, cells by tab."""
    return F.transform(F.split(text, "\r"), lambda row: F.split(row, "\t"))


def bounds(x: Column, y: Column, w: Column, h: Column) -> Column:
    """Top, left, bottom, right."""
    return F.array(y, x, y + h, x + w)

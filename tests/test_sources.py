"""Command logs, containers, drawings, lines and manifests on small files made here."""

from __future__ import annotations

import io
import json
import struct
import zipfile

from pyspark.sql import functions as F

from quire.sources import commandlog as C
from quire.sources import containers as K
from quire.sources import drawings as D

LOG = """startDocument ()
startPage(svg:height: 11in, svg:width: 8.5in)
setStyle(draw:fill-image: aGVsbG8=, librevenge:mime-type: image/jpeg, draw:fill: bitmap)
drawPolygon (svg:x: 1in, svg:y: 2in, svg:x: 6in, svg:y: 2in) (svg:x: 6in, svg:y: 6in)
setStyle(draw:fill: none)
drawPolygon (svg:x: 1in, svg:y: 2in)
startTextObject (svg:x: 1in, svg:y: 1in, svg:width: 2in, svg:height: 3in, fo:column-count: 2, fo:column-gap: 0.25in)
openParagraph (fo:text-align: left, fo:margin-top: 0.1in)
openSpan (style:font-name: Arial, fo:font-size: 10pt, fo:color: #ff0000)
insertText (Hello, a: b)
insertSpace
closeSpan
openSpan (style:font-name: Arial, fo:font-size: 10pt, fo:color: #ff0000)
insertText (world)
closeSpan
openSpan (style:font-name: Arial, fo:font-size: 12pt)
insertText (!)
closeSpan
insertText (lost)
closeParagraph
openParagraph ()
openSpan ()
insertSpace
closeSpan
closeParagraph
endTextObject
startTextObject (svg:x: 5in, svg:y: 1in)
endTextObject
endPage
unknownCommand (x)
startPage(svg:height: 11in)
startTextObject (svg:x: 1in)
openParagraph ()
openSpan ()
insertText (never ends)
""".replace("\n", "\r\n")


def log(spark):
    return C.lines(spark.createDataFrame([("a", LOG)], "doc_id string, t string"), "doc_id", "t")


def test_pages_that_end(spark):
    assert [tuple(r) for r in C.pages(log(spark)).collect()] == [("a", 1, "page-1", 612.0, 792.0)]


def test_frames_with_and_without_text(spark):
    filled, empty = C.split_frames(log(spark))
    row = filled.collect()
    assert [(r["item_id"], r["x_pt"], r["width_pt"], r["height_pt"], r["column_count"], r["column_gap_pt"]) for r in row] == [("text-frame-1", 72.0, 144.0, 216.0, 2, 18.0)]
    assert [r["item_id"] for r in empty.collect()] == ["text-frame-2"]  # the third is on a page that never ends


def test_runs_merge_and_keep_their_order(spark):
    rows = C.runs(log(spark)).where("frame_no = 1").orderBy("para_no", "run_no").collect()
    assert [(r["text"], r["font_size_pt"], r["color_hex"]) for r in rows] == [("Hello, a: b world", 10.0, "#ff0000"), ("!", 12.0, None), (" ", None, None)]


def test_paragraphs_need_visible_text(spark):
    rows = C.paragraphs(log(spark)).where("frame_no = 1").collect()
    assert [(r["text"], r["align"], round(r["margin_top_pt"], 6)) for r in rows] == [("Hello, a: b world!", "left", 7.2)]


def test_shapes_take_the_style_that_holds(spark):
    rows = C.shapes(log(spark)).collect()
    assert len(rows) == 1
    assert rows[0]["image_name"].startswith("shape-1-") and rows[0]["image_name"].endswith(".jpg") and bytes(rows[0]["image"]) == b"hello"
    assert (rows[0]["x_pt"], rows[0]["y_pt"], rows[0]["width_pt"], rows[0]["height_pt"]) == (72.0, 144.0, 360.0, 288.0) and rows[0]["text_wrap"] == "bounding-box"


def test_attributes_last_key_wins(spark):
    got = spark.sql("SELECT 'a: 1, b: x, y, a: 2, nothing' AS t").select(C.attributes(F.col("t")).alias("m")).first()["m"]
    assert got == {"a": "2, nothing", "b": "x, y"}


def test_ill_nested(spark):
    assert [r["reason"] for r in C.ill_nested(log(spark)).collect()] == ["text outside a span"]


def test_read_logs(spark, tmp_path):
    (tmp_path / "x.log").write_text("a\r\n\n b \n")
    assert [(r["line_no"], r["line"]) for r in C.read_logs(spark, str(tmp_path)).orderBy("line_no").collect()] == [(0, "a"), (2, "b")]


def compound(streams: dict[str, bytes]) -> bytes:
    """A compound file with streams below the root, of 4096 bytes or more each, so none is in the small-sector part."""
    sectors: list[bytes] = []
    fat: list[int] = []

    def put(data: bytes) -> int:
        first = len(sectors)
        for lo in range(0, len(data), 512):
            sectors.append(data[lo : lo + 512].ljust(512, b"\0"))
            fat.append(len(sectors))
        fat[-1] = K.END
        return first

    starts = {name: put(data) for name, data in streams.items()}
    names = list(streams)

    def entry(name: str, kind: int, right: int, child: int, start: int, size: int) -> bytes:
        raw = (name + "\0").encode("utf-16-le")
        return raw.ljust(64, b"\0") + struct.pack("<HBBIII", len(raw), kind, 1, K.FREE, right, child) + b"\0" * 36 + struct.pack("<IQ", start, size)

    directory = entry("Root Entry", 5, K.FREE, 1, K.END, 0)
    for k, name in enumerate(names):
        directory += entry(name, 2, k + 2 if k + 1 < len(names) else K.FREE, K.FREE, starts[name], len(streams[name]))
    at = put(directory)
    where = len(sectors)
    fat.append(0xFFFFFFFD)
    table = struct.pack(f"<{len(fat)}I", *fat).ljust(512, b"\xff")
    sectors.append(table)
    head = K.SIGNATURE + b"\0" * 16 + struct.pack("<HHHHH", 62, 3, 0xFFFE, 9, 6) + b"\0" * 6 + struct.pack("<IIIIIIIIII", 0, 1, at, 0, 4096, K.END, 0, K.END, 0, where)
    return head.ljust(512, b"\xff") + b"".join(sectors)


def test_containers(spark, tmp_path):
    text = "xx START First readable paragraph\rSecond one\n\nthird � noise\rfourth".encode("utf-16-le")
    (tmp_path / "a.pub").write_bytes(compound({"CONTENTS": text.ljust(5000, b"\0"), "Other": b"y" * 4500}))
    with zipfile.ZipFile(tmp_path / "b.zip", "w") as z:
        z.writestr("dir/", b"")
        z.writestr("dir/one.txt", b"abc")
    (tmp_path / "c.txt").write_text("neither")
    files = K.read_files(spark, str(tmp_path))
    rows = [(r["doc_id"].rsplit("/", 1)[1], r["entry_no"], r["path"], r["name"], r["type"], r["size"]) for r in K.entries(files).orderBy("doc_id", "entry_no").collect()]
    assert rows == [("a.pub", 0, "Root Entry", "Root Entry", "root", 0), ("a.pub", 1, "Root Entry/CONTENTS", "CONTENTS", "stream", 5000), ("a.pub", 2, "Root Entry/Other", "Other", "stream", 4500), ("b.zip", 0, "dir", "dir", "storage", 0), ("b.zip", 1, "dir/one.txt", "one.txt", "stream", 3)]
    found = K.canonical_paragraphs(K.canonical_streams(files), marker="START")
    assert [(r["para_no"], r["text"]) for r in found.orderBy("para_no").collect()] == [(0, "START First readable paragraph"), (1, "Second one")]


CONTENT = """<?xml version="1.0"?><o:document-content xmlns:o="urn:o" xmlns:s="urn:s" xmlns:d="urn:d" xmlns:t="urn:t" xmlns:v="urn:v" xmlns:f="urn:f">
<o:automatic-styles><s:style s:name="gr1" s:family="graphic"><s:graphic-properties d:fill-image-name="img1"/></s:style>
<s:style s:name="T1" s:family="text"><s:text-properties f:font-size="10pt" f:color="#ff0000"/></s:style></o:automatic-styles>
<o:body><d:page d:name="Cover"><d:rect d:style-name="gr1" v:x="1cm" v:y="2in" v:width="3pt"/><d:frame v:x="1in" v:y="1in" v:width="2in" v:height="1in"><d:text-box><t:p>Direct <t:span t:style-name="T1">span</t:span><t:line-break/></t:p></d:text-box></d:frame>
<d:frame v:x="0in"/></d:page><d:page/></o:body></o:document-content>"""
STYLES = """<?xml version="1.0"?><o:styles xmlns:o="urn:o" xmlns:s="urn:s" xmlns:f="urn:f" xmlns:d="urn:d" xmlns:x="urn:x">
<s:page-layout-properties f:page-width="21cm" f:page-height="29.7cm"/><d:fill-image d:name="img1" x:href="Pictures/1.png"/><d:fill-image d:name="img2" x:href="gone.png"/></o:styles>"""


def test_drawings(spark, tmp_path):
    raw = io.BytesIO()
    with zipfile.ZipFile(raw, "w") as z:
        z.writestr("content.xml", CONTENT)
        z.writestr("styles.xml", STYLES)
        z.writestr("Pictures/1.png", b"png")
    (tmp_path / "a.odg").write_bytes(raw.getvalue())
    files = K.read_files(spark, str(tmp_path))
    items = D.page_items(D.items(files)).orderBy("page_no", "item_no").collect()
    assert [(r["page_name"], r["kind"], r["shape_type"], r["text"]) for r in items] == [("Cover", "textFrame", "frame", "Direct span\n"), ("Cover", "shape", "frame", ""), ("Cover", "shape", "rect", "")]
    assert round(items[2]["x_pt"], 3) == 28.346 and items[2]["y_pt"] == 144.0 and items[2]["height_pt"] == 0.0 and round(items[0]["page_width_pt"]) == 595
    styles, fills = D.styles(files), D.fills(files)
    assert [(r["style_id"], r["family"], r["fill_image"], r["size"]) for r in styles.orderBy("style_no").collect()] == [("gr1", "graphic", "img1", None), ("T1", "text", None, "10pt")]
    assert {r["name"]: r["content"] and bytes(r["content"]) for r in fills.collect()} == {"img1": b"png", "img2": None}
    named = D.with_fills(D.page_items(D.items(files)), styles, fills).where("shape_type = 'rect'").first()
    assert named["image_path"] == "Pictures/1.png"


def test_lines_and_styles(spark, tmp_path):
    rows = [{"doc_id": "a", "page_no": 1, "line_no": k, "text": "x", "x_pt": 10.0, "y_pt": 10.0, "width_pt": 5.0, "height_pt": 5.0, "font_size_pt": s, "font": "F", "color": 0, "flags": 0} for k, s in enumerate((20.00001, 5.0, 20.0))]
    (tmp_path / "l.json").write_text("\n".join(map(json.dumps, rows)))
    lines = D.read_lines(spark, str(tmp_path))
    assert [(round(r["x_pt"], 2), round(r["height_pt"], 2)) for r in D.padded(lines).orderBy("line_no").collect()] == [(6.0, 17.0), (8.0, 9.0), (6.0, 17.0)]
    assert {r["font_size_pt"]: r["id"] for r in D.line_styles(lines).collect()} == {20.0: "char-1", 5.0: "char-2"}


def test_manifests_and_references(spark, tmp_path):
    for name in ("b", "a"):
        (tmp_path / name).mkdir()
        (tmp_path / name / "manifest.json").write_text(json.dumps({"id": name, "sourcePub": "x.pub"}, indent=1))
    assert [r["id"] for r in D.read_manifests(spark, str(tmp_path)).collect()] == ["a", "b"]
    row = spark.sql("SELECT CAST(NULL AS STRING) e, CAST(NULL AS STRING) a, 'p' p, 'r' r")
    path, label = D.reference_source(*(F.col(c) for c in "eapr"))
    assert tuple(row.select(path, label).first()) == ("p", "project-root")


def test_export_rules(spark):
    row = spark.sql("SELECT 'justify' a, array('x', 'y') p, 'a\\tb\\rc' t")
    got = row.select(D.alignment(F.col("a")), D.story_text(F.col("p")), D.table_cells(F.col("t")), D.bounds(F.lit(1), F.lit(2), F.lit(3), F.lit(4))).first()
    assert tuple(got) == ("LEFT_JUSTIFIED", "x\ry", [["a", "b"], ["c"]], [2, 1, 6, 4])

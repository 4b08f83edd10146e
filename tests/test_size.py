"""What keeps large tables within time and memory."""

from __future__ import annotations

import io
import zipfile

import pyarrow as pa

from quire.plans import catalogue
from quire.sources import commandlog as C
from quire.sources import containers as K
from quire.sources import drawings as D


def test_filled_frames_make_the_log_once(spark, sf_dir):
    plan = catalogue.QUERIES["log_filled_frames"](spark, sf_dir)._jdf.queryExecution().sparkPlan().toString()
    assert plan.count("lineitem.parquet") == 1


def test_filled_frames_agree_with_paragraphs(spark):
    pages = ["startPage(", "startTextObject (x)", "openParagraph ()", "openSpan ()", "insertText (a)", "closeSpan", "endTextObject", "startTextObject ()", "openParagraph ()", "openSpan ()", "insertText ( )", "insertSpace", "closeSpan", "insertText (lost)", "endPage"]
    over = ["insertText (no)", "startTextObject ()", "startPage(", "startTextObject ()", "startPage(", "openParagraph ()", "openSpan ()", "insertText (late)", "endPage", "openSpan ()", "insertText (out)"]
    rows = [("a", k, x) for k, x in enumerate([*pages, *over, *pages, "startPage(", *pages[1:7]])] + [("b", k, x) for k, x in enumerate(over)]
    log = spark.createDataFrame(rows, C.LOG_SCHEMA)
    filled = {(r["doc_id"], r["frame_no"]) for r in C.paragraphs(log).collect()}
    want = sorted((r["doc_id"], r["page_no"], r["frame_no"], (r["doc_id"], r["frame_no"]) in filled) for r in C.frames(log).collect())
    assert sorted(map(tuple, C.filled_frames(log).collect())) == want
    assert {x[3] for x in want} == {True, False}


def test_rows_of_files_are_given_on_by_the_thousand():
    made = []

    def rows():
        for k in range(2 * K.ROWS + 500):
            made.append(k)
            yield "a", k

    kinds = pa.schema([("doc_id", pa.string()), ("n", pa.int32())])
    sizes, ahead = [], 0
    for batch in K.batches_of(rows(), kinds):
        sizes.append(batch.num_rows)
        ahead = max(ahead, len(made) - sum(sizes))
    assert sizes == [K.ROWS, K.ROWS, 500] and ahead == 0
    assert [b.num_rows for b in K.batches_of(iter(()), kinds)] == [0]


def test_drawing_items_read_each_file_once(spark, sf_dir):
    plan = catalogue.QUERIES["drawing_items"](spark, sf_dir)._jdf.queryExecution().sparkPlan().toString()
    assert plan.count("lineitem.parquet") == 1


def test_filled_items_are_items_with_fills(spark):
    auto = "".join(f'<style name="{n}" family="{f}"><p fill-image-name="{i}"/></style>' if i else f'<style name="{n}" family="{f}"/>' for n, f, i in (("a", "graphic", "one"), ("a", "graphic", "two"), ("b", "graphic", "gone"), ("c", "text", "one"), ("d", "graphic", None)))
    page = "".join(f'<rect style-name="{n}" x="1in"/>' for n in "abcde") + '<rect x="2in"/><frame style-name="a"><p>t</p></frame>'
    raw = io.BytesIO()
    with zipfile.ZipFile(raw, "w") as z:
        z.writestr("content.xml", f"<doc><automatic-styles>{auto}</automatic-styles><page>{page}</page></doc>")
        z.writestr("styles.xml", '<doc><fill-image name="one" href="1.png"/><fill-image name="two" href="2.png"/><fill-image name="two" href="3.png"/><fill-image/></doc>')
    files = spark.createDataFrame([("f", raw.getvalue())], "path string, content binary")
    columns = ["doc_id", "page_no", "item_no", "kind", "style_id", "x_pt", "image_path"]
    got = D.page_items(D.filled_items(files)).select(columns).collect()
    want = D.with_fills(D.page_items(D.items(files)), D.styles(files), D.fills(files)).select(columns).collect()
    assert sorted(map(str, got)) == sorted(map(str, want)) and len(got) == 11

"""The operators on the driver's tables: registered queries, each with SQL where SQL can say it.

The tables are no layouts, so they stand in: lines of a text are paragraphs, line items are boxes
on the page of their order, a user's events are a command log. Every query reads whole tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.geometry import x_band
from ..functions.units import drawing_points, points
from ..operators import dictionary, gate, jobs, layout, raster, sequences, stories
from .registry import QUERIES, SQL  # noqa: F401
from .registry import query as _query
from .registry import table as _table

# ---- SQL of the scalar functions ----


def _t1(e: str) -> str:
    return f"trim(regexp_replace({e}, '[{X.SPACES}]+', ' ', 'g'))"


def _t2(e: str) -> str:
    return f"lower({_t1(e)})"


def _t3(e: str) -> str:
    joined = f"regexp_replace({_t2(e)}, '-[{X.SPACES}]+', '', 'g')"
    return _t1(f"regexp_replace({joined}, '[.,;:()\\[\\]{{}}]', ' ', 'g')")


def _units(e: str) -> str:
    return f"(length({e}) + len(regexp_extract_all({e}, '[\\x{{10000}}-\\x{{10FFFF}}]')))"


def _readable(e: str) -> str:
    solid = f"len(regexp_extract_all({e}, '[A-Za-zÅÄÖåäö0-9]'))"
    return f"({_units(e)} >= 2 AND {solid} >= 2 AND {solid} / greatest({_units(e)}, 1) >= 0.35)"


def _noise(e: str) -> str:
    fonts = " OR ".join(f"contains({e}, '{f}')" for f in X.METADATA_FONTS)
    return f"(regexp_matches({e}, '[\ufffd\uffff]') OR ({_units(e)} > 1000 AND len(regexp_extract_all({e}, 'https?://')) > 3) OR {fonts})"


def _words(e: str, least: int = 5) -> str:
    return f"list_distinct(list_filter(string_split({_t3(e)}, ' '), lambda w: length(w) >= {least}))"


def _share(sought: str, text: str, empty: str) -> str:
    return f"CASE WHEN len({sought}) = 0 THEN {empty} ELSE len(list_filter({sought}, lambda w: contains({text}, w))) / len({sought}) END"


# ---- text ----


@_query(f"SELECT doc_id, sha1({_t1('text')}) AS normalized_sha1, length({_t2('text')})::INT AS matchable_length, sha1({_t3('text')}) AS comparable_sha1 FROM documents")
def normalize_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T1, T2, T3."""
    text = F.col("text")
    return _table(spark, sf_dir, "documents").select("doc_id", X.fingerprint(text).alias("normalized_sha1"), F.length(X.matchable(text)).alias("matchable_length"), F.sha1(F.encode(X.comparable(text), "UTF-8")).alias("comparable_sha1"))


@_query(f"SELECT sha1({_t1('text')}) AS fingerprint, count(*) AS members, min(doc_id) AS first_doc_id FROM documents WHERE {_t1('text')} <> '' GROUP BY 1 HAVING count(*) > 1")
def fingerprint_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T4, F1: texts that several documents share."""
    return stories.fingerprint_groups(_table(spark, sf_dir, "documents"), [], "doc_id", "text").withColumnRenamed("first", "first_doc_id")


@_query(
    f"""WITH d AS (SELECT doc_id, source, text, {_t1('text')} AS t FROM documents)
SELECT doc_id, (doc_id = min(doc_id) OVER (PARTITION BY t) OR {_units('t')} < 32) AS first, (count(*) OVER (PARTITION BY t) > 1 AND {_units('t')} >= 32) AS repeated FROM d"""
)
def duplicate_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a text is its first occurrence, and whether a long enough one occurs again."""
    plain = _table(spark, sf_dir, "documents").select("doc_id", X.normalized(F.col("text")).alias("text"))
    docs = plain.select("doc_id", F.sha1(F.encode("text", "UTF-8")).alias("key"), (X.units(F.col("text")) >= X.LEAST_PAGE_TEXT).alias("long"))
    flagged = sequences.first_flags(docs, F.col("key"), "doc_id", least=F.col("long"), copies="copies")
    return flagged.select("doc_id", "first", (F.col("long") & (F.col("copies") > 1)).alias("repeated"))


_LINES = f"""l AS (SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS para_no, unnest(string_split(text, chr(10))) AS raw FROM documents),
p AS (SELECT doc_id, para_no, {_t1('raw')} AS t FROM l)"""


def _paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "documents").select("doc_id", F.posexplode_outer(F.split("text", "\n")).alias("para_no", "text"))


@_query(f"WITH {_LINES} SELECT doc_id, para_no::INT AS para_no, {_readable('t')} AS readable, {_noise('t')} AS noise, sha1(t) AS text_sha1 FROM p")
def readable_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T5, T8, T9 on the lines of each text."""
    plain = F.col("plain")
    lines = _paragraphs(spark, sf_dir).select("doc_id", "para_no", X.normalized(F.col("text")).alias("plain"))
    return lines.select("doc_id", "para_no", X.readable(plain).alias("readable"), X.noisy(plain).alias("noise"), F.sha1(F.encode(plain, "UTF-8")).alias("text_sha1"))


@_query(
    f"""WITH {_LINES}, n AS (SELECT *, ({_noise('t')} OR regexp_matches(t, '[#$%&*]{{3}}')) AS noise FROM p),
f AS (SELECT doc_id, min(para_no) FILTER (WHERE noise) AS stop FROM n GROUP BY doc_id)
SELECT n.doc_id, (count(*) FILTER (WHERE (stop IS NULL OR para_no < stop) AND {_readable('t')}))::INT AS kept, coalesce(sum(length(t)) FILTER (WHERE (stop IS NULL OR para_no < stop) AND {_readable('t')}), 0)::BIGINT AS kept_chars FROM n JOIN f USING (doc_id) GROUP BY n.doc_id"""
)
def take_until_noise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Readable lines before the first that is noise, in one pass without a shuffle."""
    lines = F.transform(F.split("text", "\n"), X.normalized)
    kept = F.filter(sequences.take_until(F.col("lines"), lambda t: X.noisy(t) | t.rlike("[#$%&*]{3}")), X.readable)
    docs = _table(spark, sf_dir, "documents").select("doc_id", lines.alias("lines")).select("doc_id", kept.alias("kept"))
    return docs.select("doc_id", F.size("kept").alias("kept"), F.aggregate("kept", F.lit(0).cast("long"), lambda n, t: n + F.length(t)).alias("kept_chars"))


@_query(
    f"""WITH {_LINES} SELECT doc_id, count(*) FILTER (WHERE regexp_matches(t, '(?i){X.CAPTION}')) AS captions, count(*) FILTER (WHERE regexp_matches(t, '(?i){X.SOURCE_NOTE}')) AS source_notes,
count(*) FILTER (WHERE regexp_matches(t, '{X.FOOTNOTE}')) AS footnotes, count(*) FILTER (WHERE regexp_matches(t, '\\d') OR {_units('t')} <= {X.CELL_LENGTH}) AS cells FROM p GROUP BY doc_id"""
)
def classify_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of each class."""
    plain = F.col("plain")
    kinds = {"captions": X.is_caption(plain, plain=True), "source_notes": X.is_source_note(plain, plain=True), "footnotes": X.is_footnote(plain, plain=True), "cells": X.is_table_cell(plain, plain=True)}
    lines = _paragraphs(spark, sf_dir).select("doc_id", X.normalized(F.col("text")).alias("plain"))
    return lines.groupBy("doc_id").agg(*(F.count_if(c).alias(name) for name, c in kinds.items()))


@_query(f"SELECT doc_id, len({_words('text')})::INT AS n_words, sha1(array_to_string(list_sort({_words('text')}), ' ')) AS words_sha1 FROM documents")
def distinct_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T6."""
    found = _table(spark, sf_dir, "documents").select("doc_id", X.words(F.col("text")).alias("w"))
    return found.select("doc_id", F.size("w").alias("n_words"), F.sha1(F.encode(F.array_join(F.array_sort("w"), " "), "UTF-8")).alias("words_sha1"))


_PAIRED = "pairs AS (SELECT d.doc_id, d.text, b.item_id, b.text AS item FROM documents d LEFT JOIN benchmark b ON b.item_id = d.doc_id % (SELECT max(item_id) + 1 FROM benchmark))"


def _paired(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with one benchmark item, by the remainder of its id: linear, where all pairs would not be. Where item_ids have gaps, it has none."""
    items = _table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("item"))
    most = items.agg((F.max("item_id") + 1).alias("n")).first()["n"] or 1
    return _table(spark, sf_dir, "documents").withColumn("item_no", F.pmod("doc_id", F.lit(most))).join(items, F.col("item_no") == F.col("item_id"), "left")


def _coverage_query(name: str, version: int, f, sql: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _paired(spark, sf_dir).select("doc_id", "item_id", F.round(f(F.col("item"), F.col("text")), 6).alias("coverage"))

    run.__name__, run.__doc__ = name, f"V{version}: how much of an item's words a document contains."
    _query(f"WITH {_PAIRED} SELECT doc_id, item_id, round({sql}, 6)::DOUBLE AS coverage FROM pairs")(run)


_coverage_query("coverage_v1", 1, X.coverage_canonical, _share(f"list_filter(string_split({_t2('item')}, ' '), lambda w: length(w) >= 3)", _t2("text"), "0"))
_coverage_query("coverage_v2", 2, X.coverage_words, _share(f"list_filter(string_split({_t2('item')}, ' '), lambda w: length(w) >= 4)", _t2("text"), "1"))
_coverage_query("coverage_v3", 3, X.coverage_text, _share(_words("item"), _t3("text"), "1"))
_coverage_query("coverage_v4", 4, lambda item, text: X.page_score(item, X.comparable(text)), _share(_words("item"), _t3("text"), "0"))


def _landmark_sql(e: str, n: int) -> str:
    return f"regexp_replace(substr({e}, 1, {n}), '[{X.SPACES}]+[^{X.SPACES}]*$', '')"


@_query(
    f"""WITH {_PAIRED} SELECT doc_id, item_id, sha1({_landmark_sql(_t1('text'), 80)}) AS landmark_sha1,
(contains({_t3('text')}, {_landmark_sql(_t3('item'), 120)}) OR {_share(_words('item'), _t3('text'), '1')} >= 0.72) AS present FROM pairs"""
)
def landmark_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A text's landmark, and whether an expected text is in it."""
    return _paired(spark, sf_dir).select("doc_id", "item_id", F.sha1(F.encode(X.landmark(X.normalized(F.col("text"))), "UTF-8")).alias("landmark_sha1"), X.expected_text_present(F.col("item"), F.col("text")).alias("present"))


_LENGTH = "p_size::VARCHAR || CASE p_partkey % 5 WHEN 0 THEN 'in' WHEN 1 THEN 'pt' WHEN 2 THEN 'cm' WHEN 3 THEN '' ELSE ' x' END"


@_query(
    f"""WITH p AS (SELECT p_partkey, {_LENGTH} AS v FROM part), n AS (SELECT *, try_cast(regexp_extract(v, '^\\s*([-+]?([0-9]+\\.?[0-9]*|\\.[0-9]+))', 1) AS DOUBLE) AS n FROM p)
SELECT p_partkey, round(CASE WHEN suffix(v, 'in') THEN n * 72 ELSE n END, 6) AS points, round(CASE WHEN suffix(v, 'cm') THEN n * 28.3464566929::DOUBLE WHEN suffix(v, 'in') THEN n * 72 ELSE n END, 6) AS drawing_points FROM n"""
)
def unit_conversion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lengths with several units, and none."""
    unit = F.element_at(F.array(*(F.lit(u) for u in ("in", "pt", "cm", "", " x"))), (F.col("p_partkey") % 5 + 1).cast("int"))
    length = F.concat(F.col("p_size").cast("string"), unit)
    return _table(spark, sf_dir, "part").select("p_partkey", F.round(points(length), 6).alias("points"), F.round(drawing_points(length), 6).alias("drawing_points"))


# ---- ordered rows ----


@_query(
    """WITH o AS (SELECT *, row_number() OVER w AS i, CASE WHEN row_number() OVER w = 1 OR event_type IS DISTINCT FROM lag(event_type) OVER w THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
r AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY i) AS run_no FROM o)
SELECT user_id, run_no::BIGINT AS run_no, event_type, sha1(string_agg(event_id::VARCHAR, '' ORDER BY i)) AS ids_sha1, count(*) AS n_rows FROM r GROUP BY user_id, run_no, event_type"""
)
def merge_adjacent_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Neighbouring events of one kind become one run."""
    events = _table(spark, sf_dir, "events").withColumn("t", F.col("event_id").cast("string"))
    runs = sequences.merge_adjacent(events, ["user_id"], ["ts", "event_id"], ["event_type"], "t")
    return runs.select("user_id", "run_no", "event_type", F.sha1(F.encode("t", "UTF-8")).alias("ids_sha1"), "n_rows")


@_query(
    """WITH o AS (SELECT *, coalesce(event_type = 'click', false) AS c FROM events), r AS (SELECT *, sum(CASE WHEN c THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS run FROM o),
n AS (SELECT user_id, run, count(*) FILTER (WHERE c) AS n FROM r GROUP BY user_id, run)
SELECT user_id, sum(n)::BIGINT AS single_count, max(n) AS longest_run, max(n) >= 4 AS detected FROM n GROUP BY user_id"""
)
def longest_short_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clicks in a row stand for paragraphs of one character."""
    return sequences.longest_runs(_table(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], F.col("event_type") == "click", 4)


@_query(
    """WITH o AS (SELECT *, max(CASE WHEN event_type IN ('signup', 'error') THEN struct_pack(ts := ts, id := event_id) END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS at FROM events)
SELECT o.event_id, CASE WHEN s.event_type = 'signup' THEN s.value END AS style FROM o LEFT JOIN events s ON s.event_id = o.at.id"""
)
def carry_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A signup sets a style, an error clears it, and both hold until the next."""
    kind = F.col("event_type")
    found = sequences.carry_forward(_table(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], kind.isin("signup", "error"), F.when(kind == "signup", F.col("value")), "style")
    return found.select("event_id", "style")


@_query(
    """WITH o AS (SELECT *, sum((event_type = 'signup')::INT) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS outer_no FROM events)
SELECT event_id, outer_no::BIGINT AS page_no, (sum((event_type = 'view')::INT) OVER (PARTITION BY user_id, outer_no ORDER BY ts, event_id))::BIGINT AS frame_no FROM o"""
)
def nested_ordinals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A signup opens a page, a view a frame in it."""
    found = sequences.nested_ordinals(_table(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], F.col("event_type") == "signup", F.col("event_type") == "view")
    return found.select("event_id", F.col("outer_no").alias("page_no"), F.col("inner_no").alias("frame_no"))


@_query("SELECT event_id, max(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS best FROM events")
def running_max_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F6, W3."""
    return sequences.running_max(_table(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], F.col("value"), "best").select("event_id", "best")


@_query(
    f"""SELECT conv_id, min(turn) FILTER (WHERE contains({_t2('text')}, 'the')) AS contains_the, min(turn) FILTER (WHERE length({_t1('text')}) > 200) AS long_turn, min(turn) FILTER (WHERE role = 'assistant') AS answer FROM conversations GROUP BY conv_id"""
)
def first_anchor_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first turn of each kind."""
    text = F.col("text")
    anchors = {"contains_the": F.contains(X.matchable(text), F.lit("the")), "long_turn": F.length(X.normalized(text)) > 200, "answer": F.col("role") == "assistant"}
    return sequences.first_places(_table(spark, sf_dir, "conversations"), ["conv_id"], "turn", anchors)


@_query(
    f"""WITH d AS (SELECT doc_id, {_t2("split_part(text, chr(10), 1)")} AS k FROM documents), f AS (SELECT k, min(doc_id) AS first_doc_id FROM d WHERE k <> '' GROUP BY k)
SELECT doc_id, first_doc_id FROM d LEFT JOIN f USING (k)"""
)
def exact_match_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first document whose first line is the same text."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", X.matchable(F.split_part("text", F.lit("\n"), F.lit(1))).alias("k"))
    first = docs.where("k <> ''").groupBy("k").agg(F.min("doc_id").alias("first_doc_id"))
    return docs.join(first, "k", "left").select("doc_id", "first_doc_id")


@_query("SELECT o_orderkey, o_custkey, lead(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS next_orderkey FROM orders")
def thread_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order and the customer's next."""
    return sequences.thread(_table(spark, sf_dir, "orders"), ["o_custkey"], ["o_orderdate", "o_orderkey"], "o_orderkey", "next_orderkey").select("o_orderkey", "o_custkey", "next_orderkey")


@_query(
    """WITH n AS (SELECT conv_id, turn, role, length(text) AS n FROM conversations)
SELECT conv_id, turn, coalesce(sum(n + 1) OVER (PARTITION BY conv_id ORDER BY turn, role, n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start, n::INT AS length FROM n"""
)
def char_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each turn begins in the conversation's joined text."""
    turns = _table(spark, sf_dir, "conversations").withColumn("length", F.length("text"))
    return sequences.offsets(turns, ["conv_id"], ["turn", "role", "length"], F.col("length")).select("conv_id", "turn", "start", "length")


# ---- dictionaries ----


@_query(
    """WITH u AS (SELECT l_returnflag, l_linestatus, min(struct_pack(a := l_orderkey, b := l_linenumber, c := l_partkey, d := l_suppkey)) AS f FROM lineitem GROUP BY ALL)
SELECT l_returnflag, l_linestatus, 'para-' || row_number() OVER (ORDER BY CASE WHEN l_returnflag = 'N' AND l_linestatus = 'O' THEN 0 ELSE 1 END, f) AS id FROM u"""
)
def style_dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attribute sets numbered by first use, after one that is registered before."""
    return dictionary.dictionary(_table(spark, sf_dir, "lineitem"), [], ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"], ["l_returnflag", "l_linestatus"], "para-", [("N", "O")])


# ---- geometry: line items as boxes ----

_BOXES = """boxes AS (SELECT l_orderkey AS page, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) AS item_no,
 l_quantity * 10 AS x, l_linenumber * 40.0::DOUBLE AS y, round(l_discount * 1000) AS w, round(l_tax * 1000) AS h, l_returnflag AS flag, (l_partkey % 60)::DOUBLE AS baseline FROM lineitem)"""


def _boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    order = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]
    return _table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("page"),
        F.row_number().over(Window.partitionBy("l_orderkey").orderBy(*order)).cast("long").alias("item_no"),
        (F.col("l_quantity") * 10).alias("x"),
        (F.col("l_linenumber") * 40).cast("double").alias("y"),
        F.round(F.col("l_discount") * 1000).alias("w"),
        F.round(F.col("l_tax") * 1000).alias("h"),
        F.col("l_returnflag").alias("flag"),
        F.pmod("l_partkey", F.lit(60)).cast("double").alias("baseline"),
    )


@_query(f"WITH {_BOXES} SELECT a.page, a.item_no, b.item_no AS item_no_b FROM boxes a JOIN boxes b ON a.page = b.page AND a.item_no < b.item_no AND a.x < b.x + b.w AND b.x < a.x + a.w AND a.y < b.y + b.h AND b.y < a.y + a.h")
def box_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G5, J10."""
    return layout.overlapping(_boxes(spark, sf_dir), ["page"])


@_query(f"WITH {_BOXES} SELECT page, min(x) AS x, min(y) AS y, max(x + w) - min(x) AS w, max(y + h) - min(y) AS h FROM boxes GROUP BY page")
def union_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G2."""
    return layout.union_bounds(_boxes(spark, sf_dir), ["page"])


@_query(f"WITH {_BOXES} SELECT page, count(*) AS frame_count, greatest(max(CASE WHEN flag = 'R' THEN 2 ELSE 1 END), count(DISTINCT floor(x / 12 + 0.5)))::BIGINT AS column_count, count(*) FILTER (WHERE flag = 'R')::INT AS bands, min(floor((x - 300) / 12 + 0.5))::BIGINT AS least_band FROM boxes GROUP BY page")
def x_band_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns as bands of x."""
    boxes = _boxes(spark, sf_dir)
    pages = layout.page_analysis(boxes, ["page"], F.when(F.col("flag") == "R", 2).otherwise(1))
    least = boxes.groupBy("page").agg(F.min(x_band(F.col("x") - 300)).alias("least_band"))
    return pages.join(least, "page").select("page", "frame_count", "column_count", F.size("column_bands").alias("bands"), "least_band")


@_query(
    f"""WITH {_BOXES}, bases AS (SELECT DISTINCT page, 100.0 AS x, 20.0 AS y, 300.0 AS w, 420.0 AS h, 476.0 AS page_h FROM boxes),
cuts AS (SELECT b.page, b.y, b.h, b.page_h, greatest(b.y, k.y - 8) AS top, least(b.page_h - 76, k.y + k.h + 10) AS bottom, k.item_no, 0 AS last FROM bases b JOIN boxes k ON k.page = b.page AND b.x < k.x + k.w AND k.x < b.x + b.w),
r AS (SELECT * FROM cuts WHERE bottom > top UNION ALL SELECT page, y, h, page_h, least(y + h, page_h - 76), least(y + h, page_h - 76), NULL, 1 FROM bases),
g AS (SELECT page, greatest(y, coalesce(max(bottom) OVER (PARTITION BY page ORDER BY last, top, item_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), y)) AS f, top FROM r),
o AS (SELECT page, f AS y, top - f AS h FROM g WHERE top - f >= 42)
SELECT page, y::DOUBLE AS y, h::DOUBLE AS h FROM o UNION ALL SELECT page, y, h FROM bases WHERE page NOT IN (SELECT page FROM o)"""
)
def interval_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of a page's frame between its boxes."""
    boxes = _boxes(spark, sf_dir)
    base = {"x": 100.0, "y": 20.0, "w": 300.0, "h": 420.0, "page_h": 476.0}
    bases = boxes.select("page").distinct().select("page", F.lit(1).alias("base_no"), *(F.lit(v).alias(c) for c, v in base.items()))
    return layout.interval_gaps(bases, boxes.withColumnRenamed("item_no", "block_no"), ["page"]).select("page", "y", "h")


@_query(
    f"""WITH RECURSIVE {_BOXES}, a AS (SELECT page, 1 AS row_no, min(baseline) AS y FROM boxes GROUP BY page UNION ALL
SELECT page, row_no, y FROM (SELECT a.page, a.row_no + 1 AS row_no, min(b.baseline) AS y FROM a JOIN boxes b ON b.page = a.page AND b.baseline > a.y + 4 GROUP BY a.page, a.row_no))
SELECT a.page, a.row_no::INT AS row_no, a.y AS anchor, count(*) AS members, min(b.item_no) AS least_item FROM a JOIN boxes b ON b.page = a.page AND b.baseline BETWEEN a.y AND a.y + 4 GROUP BY ALL"""
)
def baseline_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines in rows around anchors."""
    rows = layout.baseline_rows(_boxes(spark, sf_dir).withColumn("y", F.col("baseline")), ["page"])
    return rows.select("page", "row_no", "anchor", F.size("members").cast("long").alias("members"), F.array_min("members").alias("least_item"))


@_query(f"WITH {_BOXES} SELECT page, item_no, w * h AS area FROM (SELECT *, row_number() OVER (PARTITION BY page ORDER BY w * h DESC, item_no) AS n FROM boxes) WHERE n = 1")
def largest_per_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """L2, F13's base."""
    return sequences.top(_boxes(spark, sf_dir), ["page"], [(F.col("w") * F.col("h")).desc(), F.col("item_no")]).select("page", "item_no", (F.col("w") * F.col("h")).alias("area"))


@_query("WITH v AS (SELECT event_id, user_id, round(value * 100)::BIGINT AS y FROM events) SELECT event_id, y, min(y) OVER (PARTITION BY user_id ORDER BY y RANGE BETWEEN 201 FOLLOWING AND UNBOUNDED FOLLOWING) AS next_y FROM v")
def next_below(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The next value that is more than 2 larger, in hundredths."""
    rows = _table(spark, sf_dir, "events").select("event_id", "user_id", F.round(F.col("value") * 100).cast("long").alias("y"))
    return layout.next_below(rows, ["user_id"], "y", 200).select("event_id", "y", "next_y")


@_query(
    f"""WITH {_BOXES}, c AS (SELECT page, item_no AS caption_no, x, y, w, min(y::BIGINT) OVER (PARTITION BY page ORDER BY y::BIGINT RANGE BETWEEN 3 FOLLOWING AND UNBOUNDED FOLLOWING) AS next_y FROM boxes WHERE flag = 'R'),
m AS (SELECT c.page, c.caption_no, l.item_no AS line_no, l.x, l.y FROM c JOIN boxes l ON l.page = c.page AND l.flag <> 'R' AND l.y > c.y AND (c.next_y IS NULL OR l.y < c.next_y) AND abs(l.x - c.x) <= greatest(80, c.w * 0.55)),
f AS (SELECT page, caption_no, arg_min(line_no, struct_pack(y := y, x := x, n := line_no)) AS line_no FROM m GROUP BY page, caption_no)
SELECT page, line_no, min(caption_no) AS caption_no FROM f GROUP BY page, line_no"""
)
def band_join_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each caption the first line below and near it; a line goes to its earliest caption."""
    boxes = _boxes(spark, sf_dir)
    captions = boxes.where("flag = 'R'").withColumn("y", F.col("y").cast("long")).withColumnRenamed("item_no", "caption_no")
    lines = boxes.where("flag <> 'R'").withColumnRenamed("item_no", "line_no")
    found = layout.first_in_band(layout.next_below(captions, ["page"], "y"), lines, ["page"])
    return layout.claimed_lines(found, ["page"]).select("page", "line_no", "caption_no")


@_query(
    """SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F')"""
)
def page_without_story(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers without a finished order."""
    done = _table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey"))
    return _table(spark, sf_dir, "customer").join(done, "c_custkey", "left_anti").select("c_custkey")


@_query(
    f"""WITH RECURSIVE p AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role) AS n, turn, {_words('text')} AS w FROM conversations WHERE role <> 'user'),
g AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role) - 1 AS page_no, {_t3('text')} AS t FROM conversations WHERE role = 'user'),
s AS (SELECT p.conv_id, p.n, p.turn, g.page_no, {_share('p.w', 'g.t', '0')} AS score FROM p JOIN g USING (conv_id)),
f AS (SELECT conv_id, 0::BIGINT AS n, 0::BIGINT AS page_no FROM (SELECT DISTINCT conv_id FROM s) UNION ALL
 SELECT conv_id, n, page_no FROM (SELECT f.conv_id, f.n + 1 AS n, coalesce(arg_min(s.page_no, struct_pack(a := -s.score, b := s.page_no)) FILTER (WHERE s.page_no >= f.page_no AND s.score >= 0.16 AND s.score > 0), f.page_no) AS page_no
 FROM f JOIN s ON s.conv_id = f.conv_id AND s.n = f.n + 1 GROUP BY f.conv_id, f.n, f.page_no))
SELECT f.conv_id, p.turn AS para_no, f.page_no::INT AS page_no FROM f JOIN p ON p.conv_id = f.conv_id AND p.n = f.n"""
)
def monotone_assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers of a conversation stand for paragraphs, its questions for pages."""
    from pyspark.sql import Window

    turns = _table(spark, sf_dir, "conversations")
    number = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "role"))
    pages = turns.where("role = 'user'").select("conv_id", (number - 1).alias("page_no"), X.comparable(F.col("text")).alias("page"))
    paras = turns.where("role <> 'user'").select("conv_id", F.col("turn").alias("para_no"), "text")
    scores = paras.join(pages, "conv_id").select("conv_id", "para_no", "page_no", X.page_score(F.col("text"), F.col("page")).alias("score"))
    return layout.monotone(scores, ["conv_id"])


# ---- rasters, gate, jobs ----


@_query(
    """WITH c AS (SELECT vec_id, generate_subscripts(embedding, 1) - 1 AS i, unnest(embedding) AS v FROM embeddings), ref AS (SELECT vec_id, i % 8 AS x, i // 8 AS y FROM c WHERE v > 0.05), cand AS (SELECT vec_id, i // 8 AS x, i % 8 AS y FROM c WHERE v > 0.05),
o AS (SELECT a.x AS dx, b.x AS dy FROM (VALUES (-1), (0), (1)) a(x), (VALUES (-1), (0), (1)) b(x) WHERE a.x * a.x + b.x * b.x <= 1),
dr AS (SELECT DISTINCT vec_id, x + dx AS x, y + dy AS y FROM ref, o), dc AS (SELECT DISTINCT vec_id, x + dx AS x, y + dy AS y FROM cand, o),
m AS (SELECT r.vec_id, count(*) FILTER (WHERE d.x IS NULL) / count(*) AS q FROM ref r LEFT JOIN dc d ON d.vec_id = r.vec_id AND d.x = r.x AND d.y = r.y GROUP BY r.vec_id),
e AS (SELECT r.vec_id, count(*) FILTER (WHERE d.x IS NULL) / count(*) AS q FROM cand r LEFT JOIN dr d ON d.vec_id = r.vec_id AND d.x = r.x AND d.y = r.y GROUP BY r.vec_id)
SELECT v.vec_id, round(coalesce(m.q, 0), 6) AS missing_ratio, round(coalesce(e.q, 0), 6) AS extra_ratio, greatest(coalesce(m.q, 0), coalesce(e.q, 0)) <= 0.3 AS tolerant_passed FROM (SELECT DISTINCT vec_id FROM ref) v LEFT JOIN m USING (vec_id) LEFT JOIN e USING (vec_id)"""
)
def mask_dilate_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A vector's large components as an 8 x 8 page, against the page turned over."""
    cells = _table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode("embedding").alias("i", "v")).where("v > CAST(0.05 AS DOUBLE)")
    a, b = F.pmod("i", F.lit(8)), F.floor(F.col("i") / 8).cast("int")
    ref, cand = (cells.select("vec_id", x.alias("x"), y.alias("y")) for x, y in ((a, b), (b, a)))
    found = raster.tolerant_diff(ref, cand, ["vec_id"], F.lit(8), F.lit(8), radius=1, most=0.3)
    return found.select("vec_id", F.round("missing_ratio", 6).alias("missing_ratio"), F.round("extra_ratio", 6).alias("extra_ratio"), "tolerant_passed")


@_query(
    f"""WITH r AS (SELECT doc_id, coalesce(quality = 1, false) AS quality_passed, coalesce(toxic = 0, true) AS clean, coalesce(length({_t1('text')}) >= 32, false) AS long_enough, coalesce(lang IS NOT NULL, false) AS has_language FROM documents LEFT JOIN labels USING (doc_id))
SELECT doc_id, quality_passed, clean, long_enough, has_language, (long_enough AND has_language) AS structural, (quality_passed AND clean AND long_enough AND has_language) AS approved,
array_to_string(list_filter([CASE WHEN NOT quality_passed THEN 'low quality' END, CASE WHEN NOT clean THEN 'toxic' END, CASE WHEN NOT long_enough THEN 'short text' END, CASE WHEN NOT has_language THEN 'no language' END], lambda x: x IS NOT NULL), '; ') AS reasons FROM r"""
)
def gate_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conditions with defaults, conjunctions and reasons."""
    rows = _table(spark, sf_dir, "documents").join(_table(spark, sf_dir, "labels"), "doc_id", "left")
    conditions = [
        gate.Condition("quality_passed", F.col("quality") == 1, False, "low quality"),
        gate.Condition("clean", F.col("toxic") == 0, True, "toxic"),
        gate.Condition("long_enough", F.length(X.normalized(F.col("text"))) >= X.LEAST_PAGE_TEXT, False, "short text"),
        gate.Condition("has_language", F.col("lang").isNotNull(), False, "no language"),
    ]
    found = gate.gate(rows, conditions, {"structural": ["long_enough", "has_language"]})
    return found.select("doc_id", *(c.name for c in conditions), "structural", "approved", F.array_join("reasons", "; ").alias("reasons"))


_TAGS = ("p", "div", "a", "img", "table", "h1", "h2", "li", "span")


@_query("SELECT page_id, " + ", ".join(f"len(regexp_extract_all(html, '(?i)<{t}[ />]'))::INT AS n_{t}" for t in _TAGS) + ", split_part(url, '/', 3) AS host FROM pages")
def page_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Elements of each kind in a page."""
    return _table(spark, sf_dir, "pages").select("page_id", *(F.regexp_count("html", F.lit(f"(?i)<{t}[ />]")).alias(f"n_{t}") for t in _TAGS), F.split_part("url", F.lit("/"), F.lit(3)).alias("host"))


@_query(
    """WITH j AS (SELECT user_id, arg_max(event_type, struct_pack(ts := ts, id := event_id)) AS status, min(ts) AS created_at, max(ts) AS updated_at FROM events GROUP BY user_id)
SELECT user_id, status, created_at, updated_at, created_at + INTERVAL 720 HOUR <= (SELECT max(ts) FROM events) AS expired FROM j"""
)
def job_latest_ttl(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K1, K2: the last state of each user's events, and whether its time to live is over."""
    events = _table(spark, sf_dir, "events")
    now = events.agg(F.max("ts").alias("now")).first()["now"]
    found = jobs.latest(events, "user_id", "event_type", "ts", "event_id")
    return found.withColumn("expired", jobs.expired(F.col("created_at"), F.lit(now), "INTERVAL 720 HOUR"))


@_query("SELECT doc_id, n_chars, source FROM documents ORDER BY n_chars DESC, doc_id LIMIT 25")
def top_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The longest texts."""
    return _table(spark, sf_dir, "documents").orderBy(F.desc("n_chars"), "doc_id").limit(25).select("doc_id", "n_chars", "source")


@_query(
    f"""WITH d AS (SELECT doc_id, source, text FROM documents), g AS (SELECT source, sha1({_t1('text')}) AS f, min(doc_id) AS first, count(*) AS n FROM d WHERE {_t1('text')} <> '' GROUP BY ALL HAVING count(*) > 1)
SELECT source, 'story-' || row_number() OVER (PARTITION BY source ORDER BY first) AS story_id, f AS fingerprint, n AS members, first AS first_doc_id FROM g"""
)
def repeated_stories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F1 with numbering: texts that repeat within a source, by first appearance."""
    found = stories.repeated_stories(_table(spark, sf_dir, "documents").select("source", "doc_id", "text"), ["source"], "doc_id", "text")
    return found.select("source", "story_id", "fingerprint", "members", F.col("first").alias("first_doc_id"))


@_query(f"WITH {_LINES}, l2 AS (SELECT *, {_units('t')} <= 95 AND NOT regexp_matches(t, '[.!?]$') AND regexp_matches(t, '[A-ZÅÄÖa-zåäö]') AND NOT contains(t, ',') AS heading FROM p) SELECT doc_id, count(*) FILTER (WHERE heading) AS headings FROM l2 GROUP BY doc_id")
def heading_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lines that look like headings."""
    return _paragraphs(spark, sf_dir).groupBy("doc_id").agg(F.count_if(X.looks_like_heading(X.normalized(F.col("text")))).alias("headings"))

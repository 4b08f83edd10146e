"""The registered queries of the training-data operators, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import language_id, lm_scores, mixing, ngram_jaccard, packing, passages, quality_rules, quality_votes, tiff, token_ids

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def _query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@_query
def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    return quality_rules.rejected(docs, labels).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rule")


def _tokenizer(name: str) -> str:
    """Where the public vocabulary file lies; on a cluster, the same path on every machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


@_query
def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = packing.packed(_table(spark, sf_dir, "documents"), _tokenizer("byte_bpe_50k.json"))
    return found.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


@_query
def op9_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = token_ids.encoded(_table(spark, sf_dir, "documents"), _tokenizer("word_bpe_49k.json"))
    return found.select("doc_id", "start", "n_tokens", "ids_crc32")


@_query
def op4_tiff_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tiff.digests(tiff.texts_as_tiff(_table(spark, sf_dir, "documents")))


@_query
def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    found = language_id.predict(docs, language_id.fit(docs))
    return found.select("doc_id", language_id.held_out().alias("held_out"), "lang_pred", "score")


@_query
def op6_quality_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    found = quality_votes.score(docs, quality_votes.fit(docs, labels))
    return found.select("doc_id", language_id.held_out(5, 0).alias("held_out"), "score", "predicted")


@_query
def op5_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lm_scores.scores(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", F.round("score", 6).alias("score"))


SQL["op5_lm_scores"] = f"""
WITH t AS (SELECT doc_id, row_number() OVER () AS r, unnest(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')) AS z, generate_subscripts(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+'), 1) AS i FROM documents),
u AS (SELECT *, lag(z) OVER w AS y, lag(z, 2) OVER w AS x FROM t WINDOW w AS (PARTITION BY r ORDER BY i)),
c1 AS (SELECT z, count(*) AS n FROM u GROUP BY z),
c2 AS (SELECT y, z, count(*) AS n FROM u WHERE y IS NOT NULL GROUP BY y, z),
c3 AS (SELECT x, y, z, count(*) AS n FROM u WHERE x IS NOT NULL GROUP BY x, y, z),
s AS (SELECT u.doc_id, u.r, CASE WHEN c3.n >= {lm_scores.LEAST} THEN ln(c3.n / xy.n) WHEN c2.n >= {lm_scores.LEAST} THEN ln(c2.n / oy.n) + ln({lm_scores.BACKOFF})
  ELSE ln(c1.n / (SELECT count(*) FROM u)) + 2 * ln({lm_scores.BACKOFF}) END AS s
  FROM u JOIN c1 USING (z) LEFT JOIN c2 ON c2.y = u.y AND c2.z = u.z LEFT JOIN c3 ON c3.x = u.x AND c3.y = u.y AND c3.z = u.z
  LEFT JOIN c2 AS xy ON xy.y = u.x AND xy.z = u.y LEFT JOIN c1 AS oy ON oy.z = u.y),
d AS (SELECT doc_id, r, count(*) AS n, avg(s) AS s FROM s GROUP BY doc_id, r)
SELECT a.doc_id, coalesce(d.n, 0)::BIGINT AS n_words, round(d.s, 6) AS score FROM (SELECT doc_id, row_number() OVER () AS r FROM documents) AS a LEFT JOIN d USING (r)
"""


@_query
def op8_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = mixing.mixed(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "source", "lang", "topic", "n_tokens", F.round("probability", 6).alias("probability"), "kept")


SQL["op8_source_mixing"] = f"WITH {mixing.mixing_sql()}\nSELECT doc_id, source, lang, topic, n_tokens, round(probability, 6) AS probability, kept FROM mixed"


@_query
def op10_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_jaccard.joined(_table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


SQL["op10_ngram_jaccard"] = """
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, list_distinct(CASE WHEN coalesce(len(w), 0) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')] ELSE list_transform(generate_series(1, len(w) - 3), lambda i: array_to_string(w[i:i+3], ' ')) END) AS s FROM w),
e AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM s),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, a.n AS na, b.n AS nb, count(*) AS c FROM e a JOIN e b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM shared WHERE 100 * c >= 85 * (na + nb - c)),
ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT reach.a, ways.b FROM reach JOIN ways ON ways.a = reach.b)
SELECT s.doc_id, len(s.s)::BIGINT AS n_shingles, r.c AS component_id FROM s JOIN (SELECT a, min(b) AS c FROM reach GROUP BY a) AS r ON r.a = s.doc_id
"""


@_query
def op1_passage_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.passages(_table(spark, sf_dir, "documents"))

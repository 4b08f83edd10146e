"""Registered queries against their SQL, and the pipeline against its stages by hand."""

from __future__ import annotations

import pytest

from quire.llm import queries
from tests.test_queries import compare


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_sql(spark, sf_dir, name):
    compare(spark, sf_dir, name, queries.QUERIES[name], queries.SQL[name])


def test_one_query_for_each_operator():
    assert sorted(int(name[2:].split("_")[0]) for name in queries.QUERIES) == list(range(1, 11))


def test_pipeline(spark, sf_dir):
    import corpus_pipeline as P
    from tests.llm.test_operators import components_by_hand, sets_by_hand

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, seen = docs.columns, []
    for name, stage in P.STAGES:
        before = {r["doc_id"]: r["text"] for r in docs.collect()}
        docs = stage(spark, docs, sf_dir)
        after = docs.cache()
        if name == "best_fit_packing":
            assert {r["doc_id"] for r in after.collect()} == set(before)
            break
        assert after.columns == columns
        texts = {r["doc_id"]: r["text"] for r in after.collect()}
        assert set(texts) <= set(before) and len(texts) == after.count()
        if name == "ngram_jaccard":
            sets = sets_by_hand(before, P.SHINGLE)
            want = components_by_hand(sets, *P.RATIO)
            assert set(texts) == {k for k in before if not sets[k] or want[k] == k}
        if name == "substring_dedup":
            assert all(len(t) <= len(before[k]) for k, t in texts.items())
        else:
            assert all(before[k] == t for k, t in texts.items())
        seen.append(len(texts))
        docs = after
    assert seen[0] < 200 and seen[1] < seen[0] and seen[3] < seen[2]

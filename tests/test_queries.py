"""Every registered query against its SQL, on the smallest tables; those without SQL just run."""

from __future__ import annotations

import os

import pandas as pd
import pytest

import __spark_entry__ as entry
from quire.plans import catalogue

duckdb = pytest.importorskip("duckdb")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def compare(spark, sf_dir, name, query, sql):
    got = query(spark, sf_dir).toPandas()
    with duckdb.connect() as con:
        for t in TABLES:
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
        want = con.execute(sql).df()
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    got, want = (x[columns].sort_values(columns, ignore_index=True) for x in (got, want))
    pd.testing.assert_frame_equal(got, want, check_dtype=False, check_exact=False, rtol=1e-9)


@pytest.mark.parametrize("name", sorted(catalogue.SQL))
def test_catalogue(spark, sf_dir, name):
    if not os.path.isdir(sf_dir):
        pytest.skip("no test tables")
    compare(spark, sf_dir, name, catalogue.QUERIES[name], catalogue.SQL[name])


def test_entry(spark):
    assert entry.entry(spark).columns == ["fingerprint", "members", "first_doc_id"]
    assert set(entry.oracle_sql()) <= set(entry.queries())

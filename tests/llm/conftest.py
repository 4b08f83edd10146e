"""Small document tables with the cases that every operator must stand."""

from __future__ import annotations

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n long, score double"


def rows():
    """Nulls, empty and long texts, ties, repeated rows, and columns that clash with the operators' own."""
    base = "alpha beta gamma delta epsilon zeta eta theta iota kappa lamda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega " * 3
    passage = " ".join(f"w{k}" for k in range(60))
    texts = [None, "", " \n ", "one", "one two three", base, base, base + "end", passage, "before it " + passage + " and after", "x " * 9000, "é ü ß 語 😀 ok", "12 34 !!"]
    out = [(k, t, "en" if k % 2 else None, "s" if k % 3 else None, len(t or ""), k, 0.5) for k, t in enumerate(texts)]
    return [*out, out[5], (None, base, None, None, None, None, None)]


@pytest.fixture(scope="session")
def odd_docs(spark):
    return spark.createDataFrame(rows(), SCHEMA)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@pytest.fixture(scope="session")
def labels(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


@pytest.fixture(scope="session")
def texts(documents):
    return {r["doc_id"]: r["text"] for r in documents.select("doc_id", "text").collect()}

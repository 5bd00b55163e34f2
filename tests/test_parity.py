"""Every query with SQL gives what DuckDB gives on the smallest tables."""

from __future__ import annotations

import pytest

import __spark_entry__ as spark_entry
import parity
from quillspark.plans import catalog


@pytest.fixture(scope="module")
def con(tiny):
    return parity.connect(tiny)


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_query_equals_sql(spark, tiny, con, name):
    ok, said = parity.compare(spark, con, tiny, name)
    assert ok, said


def test_harness_sees_a_wrong_query(spark, tiny, con, monkeypatch):
    monkeypatch.setattr(spark_entry, "queries", lambda: {"doc_length": lambda s, d: catalog.doc_length(s, d).selectExpr("doc_id", "doc_len + 1 as doc_len")})
    assert not parity.compare(spark, con, tiny, "doc_length")[0]


def test_entry_has_rows_and_a_stable_schema(spark):
    df = spark_entry.entry(spark)
    assert df.count() > 0
    assert set(df.columns) == {"doc_id", "query_id", "score", "rank", "n_chars"}

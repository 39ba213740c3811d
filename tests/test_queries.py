"""Registered queries against their SQL on the smallest tables."""

from __future__ import annotations

import os

import duckdb
import pytest

from twinsift.plans import registry

SF = "/root/testdata/sf0.001"
SLOW = {"masked_evaluation", "jsonl_stoplist"}  # made of others that are tested


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.sql(f"create view {f.removesuffix('.parquet')} as select * from '{SF}/{f}'")
    return con


def rows(columns, values):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(str([round(r[i], 6) if isinstance(r[i], float) else r[i] for i in order]) for r in values)


@pytest.mark.parametrize("name", [n for n in registry.oracle_sql() if n not in SLOW])
def test_query_equals_sql(spark, duck, name):
    got = registry.queries()[name](spark, SF)
    want = duck.sql(registry.oracle_sql()[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got.columns, got.collect()) == rows(want.columns, want.fetchall())


@pytest.mark.parametrize("name", [n for n in registry.queries() if n not in registry.oracle_sql() and n not in ("ann_benchmark", "top_k_benchmark")])
def test_query_runs(spark, name):
    assert registry.queries()[name](spark, SF).count() > 0


def test_entry():
    import __spark_entry__

    assert set(registry.queries()) <= set(__spark_entry__.queries())
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())

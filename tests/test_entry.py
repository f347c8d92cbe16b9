"""Driver contract: entry() and every registered query run on sf0.001 with
a stable schema; every oracle key is also a query key."""

import pytest

import __spark_entry__ as E

from .conftest import SF_SMALL

KEYS = sorted(E.queries())


def test_entry(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert df.columns == ["paper_id", "rank"]
    assert len(rows) >= 0


def test_oracle_keys_subset():
    assert set(E.oracle_sql()) <= set(E.queries())
    assert len(KEYS) >= 90


@pytest.mark.parametrize("key", KEYS)
def test_query_runs(spark, key):
    df = E.queries()[key](spark, SF_SMALL)
    schema1 = df.schema
    df.count()
    assert schema1 == df.schema

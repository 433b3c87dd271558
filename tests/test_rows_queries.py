"""Queries without oracle SQL run on the small tables and keep a stable schema."""

import pytest

import __spark_entry__ as E
from tests.conftest import SF_SMALL

ROWS_ONLY = sorted(set(E.queries()) - set(E.oracle_sql()))


@pytest.mark.parametrize("key", ROWS_ONLY)
def test_runs(spark, key):
    df = E.queries()[key](spark, SF_SMALL)
    rows = df.collect()
    assert len(df.columns) == len(set(c.lower() for c in df.columns))
    assert rows is not None


def test_entry(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert {"outcome", "feat", "r", "p", "p_adj"} <= set(df.columns)

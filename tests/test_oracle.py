"""Every query with oracle SQL matches DuckDB at sf0.01 (names, types, rows, values)."""

import pytest

import __spark_entry__ as E
from tests.conftest import SF_ORACLE
from tools.oracle_check import compare, types_msg

ORACLE = E.oracle_sql()


@pytest.mark.parametrize("key", sorted(ORACLE))
def test_matches_oracle(spark, duck, key):
    sdf = E.queries()[key](spark, SF_ORACLE)
    got = sdf.toPandas()
    want = duck.sql(ORACLE[key]).df()
    msg = compare(sdf, got, want)
    assert msg.startswith("ok"), msg
    assert types_msg(sdf, duck, ORACLE[key]) == ""


def test_every_oracle_key_is_a_query():
    assert set(ORACLE) <= set(E.queries())

"""The queries of this subpackage over the smallest tables; those with SQL give the same rows in both engines."""

import pytest

from conftest import SF, rows
from quirewell.llm.queries import ORACLE, QUERIES


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    got = [tuple(r) for r in df.collect()]
    assert len(df.columns) == len(set(df.columns))
    if name in ORACLE:
        want = duck.sql(ORACLE[name])
        assert rows(got, df.columns) == rows(want.fetchall(), want.columns)

"""Every query with an oracle matches DuckDB on the small driver tables."""

import pytest

from conftest import SF_SMALL


@pytest.fixture(scope="module")
def duck():
    from tools.check_oracle import duck as mk
    return mk(SF_SMALL)


def _keys():
    from __spark_entry__ import oracle_sql
    return sorted(oracle_sql())


@pytest.mark.parametrize("key", _keys())
def test_query_matches_oracle(spark, duck, key):
    from __spark_entry__ import oracle_sql, queries
    from tools.check_oracle import rows_of
    df = queries()[key](spark, SF_SMALL)
    s_rows, s_cols = rows_of(df.columns, [tuple(r) for r in df.collect()])
    cur = duck.execute(oracle_sql()[key])
    d_rows, d_cols = rows_of([d[0] for d in cur.description], cur.fetchall())
    assert s_cols == d_cols
    assert s_rows == d_rows


def test_entry_smoke(spark):
    from __spark_entry__ import entry
    df = entry(spark)
    assert df.columns == ["city", "median_salary", "n"]
    assert df.count() >= 0

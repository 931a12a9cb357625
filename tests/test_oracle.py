"""Every registered query with an oracle: Spark result == DuckDB result (sf0.001)."""

import pytest

import __spark_entry__ as E
from scripts.check_oracle import canon, close

from conftest import SF_SMALL

ORACLES = E.oracle_sql()


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_oracle(spark, duck, name):
    df = E.queries()[name](spark, SF_SMALL)
    cols = df.columns
    rows = [tuple(r) for r in df.collect()]
    cur = duck.execute(ORACLES[name])
    ocols = [d[0] for d in cur.description]
    orows = cur.fetchall()
    assert sorted(cols) == sorted(ocols)
    assert len(rows) == len(orows)
    order = sorted(cols)
    a = sorted(tuple(canon(r[cols.index(c)]) for c in order) for r in rows)
    b = sorted(tuple(canon(r[ocols.index(c)]) for c in order) for r in orows)
    assert all(close(x, y) for x, y in zip(a, b)), name


def test_every_query_runs_at_small_scale(spark):
    for name, fn in E.queries().items():
        if name in ORACLES:
            continue
        df = fn(spark, SF_SMALL)
        assert df.count() >= 0, name


def test_entry(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert "total_payments" in df.columns

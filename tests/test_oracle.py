"""Every registered query with an oracle, Spark against DuckDB, at sf0.001."""
import pytest

from tests.conftest import SF_SMALL
from tools.compare import canon, duck

import __spark_entry__ as E

ORACLES = E.oracle_sql()
QUERIES = E.queries()


@pytest.fixture(scope="module")
def con():
    return duck(SF_SMALL)


def test_every_query_registered_has_entry():
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_oracle(spark, con, name):
    sdf = QUERIES[name](spark, SF_SMALL)
    s_cols, s_rows = canon(sdf.columns, [tuple(r) for r in sdf.collect()])
    res = con.execute(ORACLES[name])
    d_cols, d_rows = canon([d[0] for d in res.description], res.fetchall())
    assert s_cols == d_cols
    assert s_rows == d_rows


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert df.columns == ["doc_id", "rank", "term", "weight"]

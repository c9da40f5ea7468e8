import importlib
import pkgutil

import pytest

import spanforge.plans
from tests.oracle import connect, rows_of

MODULES = [importlib.import_module(f"spanforge.plans.{m.name}") for m in pkgutil.iter_modules(spanforge.plans.__path__) if m.name.endswith("_queries")]
QUERIES = {n: q for m in MODULES for n, q in m.QUERIES.items()}
SQL = {n: s for m in MODULES for n, s in m.SQL.items()}


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_agrees_with_sql(spark, sf, con, name):
    got = rows_of(QUERIES[name](spark, sf).toPandas())
    if name in SQL:
        assert got == rows_of(con.sql(SQL[name]).df())
    else:
        assert got[1]


def test_every_sql_belongs_to_a_query():
    assert set(SQL) <= set(QUERIES)

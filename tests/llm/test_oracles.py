"""Every query of these operators that has SQL gives the same rows in DuckDB; the others come out."""

import pytest

from codelattice.llm import queries

from ..helpers import canon, duck

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return duck(DATA)


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_same_as_sql(spark, con, name):
    assert canon(queries.queries()[name](spark, DATA).toPandas()) == canon(con.execute(queries.SQL[name]).df())


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.SQL)))
def test_rows_come_out(spark, name):
    assert queries.queries()[name](spark, DATA).count() > 0

"""Every query of the engine that has SQL gives the same rows in DuckDB."""

import pytest

from codelattice import catalogue

from .helpers import canon, duck

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return duck(DATA)


@pytest.mark.parametrize("name", sorted(catalogue.SQL))
def test_same_as_sql(spark, con, name):
    got = canon(catalogue.queries()[name](spark, DATA).toPandas())
    want = canon(con.execute(catalogue.SQL[name]).df())
    assert got == want


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_training_gives_the_centroids_asked_for(spark):
    got = catalogue.queries()["train_codebook"](spark, DATA).collect()
    assert [r.cid for r in got] == list(range(32)) and all(len(r.v) == 64 for r in got)

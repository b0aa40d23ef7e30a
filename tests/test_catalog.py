"""Each query of the catalog against its SQL twin, or at least run."""

import pytest
from compare import DATA, duck, same

from pulsegrid.plans import catalog

FOLDER = f"{DATA}/sf0.001"


@pytest.fixture(scope="module")
def con():
    return duck(FOLDER)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, con, name):
    got = catalog.QUERIES[name](spark, FOLDER).toPandas()
    if name in catalog.ORACLES:
        same(got, con.execute(catalog.ORACLES[name]).df())
    else:
        assert len(got)


def test_oracles_have_queries():
    assert set(catalog.ORACLES) <= set(catalog.QUERIES)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())

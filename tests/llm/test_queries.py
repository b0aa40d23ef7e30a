"""The queries with SQL twins, over the test tables."""

import pytest
from compare import DATA, duck, same

from pulsegrid.llm import queries


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
@pytest.mark.parametrize("folder", ["sf0.001", "sf0.01"])
def test_oracle(spark, name, folder):
    got = queries.QUERIES[name](spark, f"{DATA}/{folder}").toPandas()
    same(got, duck(f"{DATA}/{folder}").execute(queries.ORACLES[name]).df())


def test_all_are_registered():
    assert sorted(int(k[2:].split("_")[0]) for k in queries.QUERIES) == list(range(1, 14))

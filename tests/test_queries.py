"""Every registered query against its reference SQL on the smallest tables."""

import pytest
from compare import connect, difference
from conftest import SMALL

from vigilog.plans.oracles import ORACLES
from vigilog.plans.queries import QUERIES


@pytest.fixture(scope="module")
def database():
    return connect(SMALL)


def test_every_query_has_its_sql():
    assert set(QUERIES) == set(ORACLES)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, database, name):
    problem, rows = difference(spark, database, QUERIES[name], ORACLES.get(name), SMALL)
    assert not problem
    assert rows > 0

import pytest

from skein.oracles import ORACLES
from skein.queries import QUERIES
from tests.oracle import same


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, sf, name):
    ok, message = same(QUERIES[name](spark, sf), sf, ORACLES[name])
    assert ok, message

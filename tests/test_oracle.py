import pytest

from tests.helpers import duck, same
from tidemark.plans.oracle import ORACLE_SQL
from tidemark.plans.queries import QUERIES


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE_SQL)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(name, spark, sf_dir):
    same(QUERIES[name](spark, sf_dir), duck(sf_dir), ORACLE_SQL[name])

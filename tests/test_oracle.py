import pytest

import __spark_entry__ as contract
import check
from workload.oracle import ORACLE
from workload.queries import QUERIES
from tests.conftest import SMALL


@pytest.fixture(scope="module")
def duck():
    return check.duck(SMALL)


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE)
    assert set(QUERIES) <= set(contract.queries()) and set(ORACLE) <= set(contract.oracle_sql())


def test_entry(spark):
    df = contract.entry(spark)
    assert df.columns == ["patid", "part", "code", "age"] and df.count() > 0


@pytest.mark.parametrize("name", QUERIES)
def test_query_equals_sql(spark, duck, name):
    problem, _, n = check.compare(spark, duck, SMALL, name)
    assert problem is None and n > 0

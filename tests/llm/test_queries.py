import pytest

import __spark_entry__ as contract
import check
from tests.conftest import SMALL
from visitseq.llm.oracle import ORACLE
from visitseq.llm.queries import QUERIES


def test_all_are_registered():
    assert set(QUERIES) <= set(contract.queries()) and set(ORACLE) <= set(QUERIES)
    assert sorted(int(q[2:].split("_")[0]) for q in QUERIES if q != "pipeline") == list(range(1, 11))


@pytest.mark.parametrize("name", ORACLE)
def test_query_equals_sql(spark, name):
    problem, _, n = check.compare(spark, check.duck(SMALL), SMALL, name)
    assert problem is None and n > 0


@pytest.mark.parametrize("name", [q for q in QUERIES if q not in ORACLE])
def test_query_runs(spark, name):
    assert contract.queries()[name](spark, SMALL).count() > 0

import pytest

from stratawell.plans.catalogue import ORACLE, QUERIES
from tests.compare import assert_equal

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_equals_sql(spark, name):
    assert_equal(spark, QUERIES[name], ORACLE[name], SF)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_runs_and_repeats(spark, name):
    a, b = (sorted(map(str, QUERIES[name](spark, SF).collect())) for _ in range(2))
    assert a == b


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 2
    assert set(e.oracle_sql()) <= set(e.queries())

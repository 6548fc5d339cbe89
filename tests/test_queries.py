"""Every query of the core against its SQL on the smallest tables."""

import pytest

from lexiloom.plans.oracle import ORACLE
from lexiloom.plans.queries import QUERIES
from tests.compare import DATA, same_rows, views

pytestmark = pytest.mark.skipif(not DATA.exists(), reason="no tables here")


@pytest.fixture(scope="module")
def con():
    return views()


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query(spark, con, name):
    same_rows(spark, con, QUERIES[name], ORACLE[name])


def test_entry(spark):
    import __spark_entry__

    assert {*QUERIES} <= {*__spark_entry__.queries()} and {*ORACLE} <= {*__spark_entry__.oracle_sql()}
    assert __spark_entry__.entry(spark).count() > 0

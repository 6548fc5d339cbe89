"""The queries of these operators against their SQL on the smallest tables, and that all of them run."""

import pytest

from lexiloom.llm.oracle import ORACLE
from lexiloom.llm.queries import queries
from tests.compare import DATA, same_rows, views

pytestmark = pytest.mark.skipif(not DATA.exists(), reason="no tables here")


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query(spark, name):
    same_rows(spark, views(), queries()[name], ORACLE[name])


@pytest.mark.parametrize("name", sorted({*queries()} - {*ORACLE}))
def test_runs(spark, name):
    assert queries()[name](spark, str(DATA)).count() > 0

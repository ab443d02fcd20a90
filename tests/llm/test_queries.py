import pytest

from quern.llm.catalogue import ORACLES, QUERIES
from tests.oracle import FOLDER, same


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equals_sql(spark, name):
    same(spark, QUERIES[name], ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_gives_rows(spark, name):
    assert QUERIES[name](spark, FOLDER).limit(1).count() == 1

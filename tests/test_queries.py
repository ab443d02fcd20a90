import pytest

from quern.plans import catalogue
from tests.oracle import FOLDER, same

QUERIES, SQL = catalogue.queries(), catalogue.oracles()


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(spark, name):
    same(spark, QUERIES[name], SQL[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_gives_rows(spark, name):
    assert QUERIES[name](spark, FOLDER).limit(1).count() == 1


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).columns == ["puuid", "session_start_ms", "session_end_ms", "games"]
    assert set(e.oracle_sql()) <= set(e.queries())


def test_nothing_else_imports_llm():
    import pathlib
    import re

    root = pathlib.Path(__file__).parent.parent / "quern"
    for p in root.rglob("*.py"):
        if "llm" not in p.relative_to(root).parts:
            assert not re.search(r"^\s*(from|import)\s+quern\.llm", p.read_text(), re.M), p

import pytest

from lakeweave.llm import registry
from tests import oracle

QUERIES, SQL = registry.queries(), registry.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, name):
    oracle.check(QUERIES[name](spark, oracle.DATA), SQL[name], oracle.connect())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_query_without_sql_runs(spark, name):
    assert QUERIES[name](spark, oracle.DATA).count() >= 0


def test_only_the_entry_knows_this_part():
    import pathlib
    import re

    root = pathlib.Path(__file__).parents[2]
    for p in (root / "lakeweave").rglob("*.py"):
        if "llm" not in p.parts:
            assert not re.search(r"lakeweave\.llm|from \.+llm", p.read_text()), p

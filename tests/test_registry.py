import pytest

from lakeweave.plans import registry
from tests import oracle

QUERIES, SQL = registry.queries(), registry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return oracle.connect()


def test_every_sql_has_a_query():
    assert set(SQL) <= set(QUERIES)
    assert registry.FLAGSHIP in QUERIES


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, con, name):
    oracle.check(QUERIES[name](spark, oracle.DATA), SQL[name], con)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_query_without_sql_runs(spark, name):
    df = QUERIES[name](spark, oracle.DATA)
    assert df.columns
    df.write.format("noop").mode("overwrite").save()


def test_entry_works_without_llm(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(registry.queries()) <= set(entry.queries())


def test_entry_is_read_without_a_session():
    import pathlib
    import subprocess
    import sys

    code = "import __spark_entry__ as e; assert len(e.queries()) >= len(e.oracle_sql()) > 0"
    subprocess.run([sys.executable, "-c", code], cwd=pathlib.Path(__file__).parents[1], check=True)

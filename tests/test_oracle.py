"""Every query that has SQL gives the rows of that SQL on DuckDB."""

import oracle
import pytest

import __spark_entry__ as contract


@pytest.fixture(scope="module")
def con(folder):
    return oracle.connect(folder)


@pytest.mark.parametrize("name", sorted(contract.oracle_sql()))
def test_equals_sql(spark, con, folder, name):
    result, _ = oracle.compare(spark, con, contract.queries()[name], contract.oracle_sql()[name], folder)
    assert result == "ok"


def test_flagship_runs(spark):
    df = contract.entry(spark)
    assert df.columns == ["brand", "negative", "neutral", "positive"]
    assert df.count() > 0


def test_sql_keys_are_queries():
    assert set(contract.oracle_sql()) <= set(contract.queries())

import pytest

pytest.importorskip("scarpline.llm.queries")

from scarpline.llm.queries import QUERIES, SQL  # noqa: E402
from tests.sqlcheck import connect, same  # noqa: E402


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(spark, data, name):
    same(spark, connect(data), QUERIES[name], SQL[name], data)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, data, name):
    assert QUERIES[name](spark, data).count() >= (0 if name.startswith("p8") else 1)  # the smallest table has hardly a damaged text

"""The registered queries against their SQL, and the guard around this subpackage."""

import pytest

from oracle import same
from tidemark.llm import queries


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_gives_what_its_sql_gives(spark, sf_dir, name):
    assert same(spark, sf_dir, queries.QUERIES[name], queries.SQL[name])


def test_all_are_registered():
    import __spark_entry__

    names = set(__spark_entry__.queries())
    assert {n.split("_")[0] for n in queries.QUERIES} == {f"op{i}" for i in range(1, 14)} and set(queries.QUERIES) | {"pipeline"} <= names

"""Every query of the library against its SQL."""

import pytest

import __spark_entry__
from oracle import same
from tidemark.plans import library

MAY_BE_EMPTY = {"no_look_ahead_check"}


@pytest.mark.parametrize("name", sorted(library.SQL))
def test_query_gives_what_its_sql_gives(spark, sf_dir, name):
    assert same(spark, sf_dir, library.QUERIES[name], library.SQL[name]) or name in MAY_BE_EMPTY


@pytest.mark.parametrize("name", sorted(set(library.QUERIES) - set(library.SQL)))
def test_query_without_sql_has_rows(spark, sf_dir, name):
    assert library.QUERIES[name](spark, sf_dir).count() > 0


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())

"""Every query against its SQL on the smallest test tables."""

from __future__ import annotations

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from check_oracle import compare

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_same_as_sql(spark, name):
    assert compare(spark, name, SF) is None


def test_entry_and_names(spark):
    assert entry(spark).count() == 200
    assert set(oracle_sql()) <= set(queries())


@pytest.mark.parametrize("name", sorted(set(queries()) - set(oracle_sql())))
def test_queries_without_sql_run(spark, name):
    assert queries()[name](spark, SF).count() > 0

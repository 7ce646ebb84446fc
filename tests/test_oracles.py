"""Every query with SQL gives the same rows on both engines."""

from __future__ import annotations

import pytest

from meshspark.catalog import ORACLE_SQL, QUERIES

from .compare import connect, differences

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", list(ORACLE_SQL))
def test_same_rows(spark, con, name):
    assert differences(QUERIES[name](spark, SF), con, ORACLE_SQL[name]) == ""

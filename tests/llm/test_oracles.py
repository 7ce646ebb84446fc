"""Every query of the subpackage with SQL gives the same rows on both engines."""

from __future__ import annotations

import pytest

from meshspark.llm.queries import ORACLE_SQL, QUERIES
from tests.compare import connect, differences

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", list(ORACLE_SQL))
def test_same_rows(spark, name):
    assert differences(QUERIES[name](spark, SF), connect(SF), ORACLE_SQL[name]) == ""

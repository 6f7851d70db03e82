"""Training-data queries with a SQL text give the same rows in DuckDB."""

import pytest

from compare import connect, differences
from loadsig.llm.oracle import ORACLE
from loadsig.llm.queries import QUERIES


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_matches_sql(spark, sf_dir, name):
    assert differences(QUERIES[name](spark, sf_dir), connect(sf_dir), ORACLE[name]) is None

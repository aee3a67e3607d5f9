"""The registered queries of the operators against DuckDB, where SQL can express them."""

import pytest
from compare import connect, differences
from conftest_paths import SF_DIR
from tidewharf.llm.queries import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query(spark, name):
    assert differences(connect(SF_DIR), QUERIES[name](spark, SF_DIR), ORACLES[name]) == []

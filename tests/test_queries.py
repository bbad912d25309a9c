from __future__ import annotations

import pytest

from repolens.queries import oracle_sql, queries
from tests.oracle import available, same


@pytest.mark.skipif(not available(), reason="the standard tables are not here")
@pytest.mark.parametrize("name", sorted(queries()))
def test_query_against_sql(spark, name):
    same(spark, queries()[name], oracle_sql()[name])


@pytest.mark.skipif(not available(), reason="the standard tables are not here")
def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 10
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())

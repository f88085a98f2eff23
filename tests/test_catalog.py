"""Every registered query with SQL, against that SQL."""

import pytest
from compare import connect, same

from tidemark import catalog



@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_query_equals_sql(spark, sf, name):
    n = same(catalog.QUERIES[name](spark, sf), connect(sf), catalog.ORACLE_SQL[name])
    assert n > 0


def test_entry(spark, sf):
    import __spark_entry__ as e

    assert e.entry(spark).columns == ["doc_id", "rank", "topic_id", "dist"]
    assert set(e.oracle_sql()) <= set(e.queries())

import pytest

from siltworks import queries
from tests import oracle


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_same_as_sql(spark, name):
    oracle.same(queries.QUERIES[name](spark, oracle.SMALL), queries.ORACLE[name])


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.ORACLE)))
def test_rows(spark, name):
    assert queries.QUERIES[name](spark, oracle.SMALL).count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 1
    assert set(queries.QUERIES) <= set(__spark_entry__.queries())

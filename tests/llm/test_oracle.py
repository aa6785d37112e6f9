import pytest

from lumenry.llm import plans
from tests.oracle import DATA, differences


@pytest.mark.skipif(not DATA.exists(), reason="no test data")
@pytest.mark.parametrize("name", sorted(plans.QUERIES))
def test_query(spark, name):
    query, sql = plans.QUERIES[name], plans.SQL.get(name)
    if sql is None:
        query(spark, str(DATA)).write.format("noop").mode("overwrite").save()
    else:
        assert differences(spark, query, sql) == []

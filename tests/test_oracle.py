import pytest

from lumenry.plans import analysis, general, lists, services
from tests.oracle import DATA, differences

QUERIES = {n: (f, m.SQL.get(n)) for m in (general, lists, analysis, services) for n, f in m.QUERIES.items()}


@pytest.mark.skipif(not DATA.exists(), reason="no test data")
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    query, sql = QUERIES[name]
    if sql is None:
        query(spark, str(DATA)).write.format("noop").mode("overwrite").save()
    else:
        assert differences(spark, query, sql) == []

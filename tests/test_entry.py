import importlib.util

import __spark_entry__ as entry


def test_names_and_sql():
    queries, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(queries) and {"p2_found", "p3_found", "p6_found"} <= set(queries)
    if importlib.util.find_spec("lumenry.llm") is None:
        assert not any(n.startswith(("p1_", "p4_", "p5_", "p7_", "p8_", "p9_")) for n in queries)


def test_flagship(spark):
    assert entry.entry(spark).count() > 0

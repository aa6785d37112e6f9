import datetime as dt

from lumenry.streaming.usage import run_daily_usage


def test_daily_usage_counts_each_event_once_and_resumes(spark, tmp_path):
    source, target, check = (str(tmp_path / x) for x in ("in", "out", "check"))
    schema = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"

    def put(rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)

    day = lambda n: dt.datetime(2024, 1, n, 12)
    put([(1, day(1), 7, "a", 2.0, None), (1, day(1), 7, "a", 2.0, None), (2, day(1), 7, "a", 3.0, None)])
    put([(3, day(9), 8, "a", 1.0, None)])
    run_daily_usage(spark, source, target, check)
    put([(4, day(20), 8, "a", 1.0, None)])
    run_daily_usage(spark, source, target, check)
    got = {(r.user_id, str(r.day)): (r.requests, r.total) for r in spark.read.parquet(target).collect()}
    assert got[7, "2024-01-01"] == (2, 5.0) and (8, "2024-01-20") not in got

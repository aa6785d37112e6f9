import datetime as dt
import random

import pytest

from lumenry.operators.rolling import rolling_usage

SCHEMA = "user string, d date, version timestamp_ntz, tokens int, requests int, entity string, day string"
START = dt.date(2024, 1, 1)


def run(spark, rows, periods=(7, 30)):
    return rolling_usage(spark.createDataFrame(rows, SCHEMA), "user", "d", "version", ("tokens", "requests"), periods)


def brute(rows, periods):
    best = {}
    for user, d, version, tokens, requests, *_ in rows:
        if user is not None and d is not None:
            key = (version or dt.datetime.min, -1 if tokens is None else tokens, -1 if requests is None else requests)
            if (user, d) not in best or key > best[user, d][0]:
                best[user, d] = (key, tokens or 0, requests or 0)
    out = {}
    for user in {u for u, _ in best}:
        days = [d for u, d in best if u == user]
        for n in range((max(days) - min(days)).days + 1):
            day = min(days) + dt.timedelta(n)
            sums = [sum(best.get((user, day - dt.timedelta(i)), (0, 0, 0))[c] for i in range(p)) for c in (1, 2) for p in periods]
            out[user, day] = tuple(sums)
    return out


@pytest.mark.parametrize("periods", [(7, 30), (1, 2), (13, 31)])
def test_against_brute_force(spark, periods):
    rng = random.Random(3)
    rows = []
    for user in ("a", "b", "c"):
        for _ in range(60):
            d = START + dt.timedelta(rng.randrange(90))
            rows.append((user, d, dt.datetime(2024, 5, 1, rng.randrange(24)), rng.choice([None, 0, 5, 2_000_000_000]), rng.choice([None, 0, 3]), "x", "y"))
    rows += rows[:20] + [(None, START, None, 1, 1, "x", "y"), ("a", None, None, 1, 1, "x", "y"), ("b", START, None, 9, 9, "x", "y")]
    got = {(r.entity, r.day): tuple(r[f"{c}_{p}d"] for c in ("tokens", "requests") for p in periods) for r in run(spark, rows, periods).collect()}
    assert got == brute(rows, periods)


def test_empty_and_bad_periods(spark):
    assert run(spark, []).count() == 0
    with pytest.raises(ValueError):
        run(spark, [], (0, 7))


def test_averages_divide_by_the_period(spark):
    r = run(spark, [("a", START, None, 70, None, "", "")]).first()
    assert (r.tokens_7d_avg, r.requests_30d_avg, r.had_row) == (10.0, 0.0, True)

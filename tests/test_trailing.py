import datetime as dt
import random

from pyspark.sql import functions as F

from quern.operators import trailing

SCHEMA = "who long, at timestamp_ntz, amount int, total string, entity string, day string"


def brute(rows, periods):
    daily = {}
    for who, at, amount in rows:
        if at is not None and amount is not None:
            daily.setdefault(who, {}).setdefault(at.date(), []).append(amount)
    out = {}
    for who, days in daily.items():
        day = min(days)
        while day <= max(days):
            for p in periods:
                inside = [x for d, xs in days.items() if day - dt.timedelta(p - 1) <= d <= day for x in xs]
                out[who, p, day] = (sum(inside), len(inside))
            day += dt.timedelta(1)
    return out


def frame(spark, rows):
    # further columns with the names of the result's columns must not matter
    return spark.createDataFrame([(w, a, x, "x", "y", "z") for w, a, x in rows], SCHEMA)


def test_totals_equal_brute_force(spark):
    r = random.Random(1)
    start = dt.datetime(2024, 1, 30)
    rows = [(r.choice([1, 2, 3, None]), start + dt.timedelta(hours=r.randint(0, 1500)) if r.random() > 0.05 else None, r.choice([None, *range(-3, 9)])) for _ in range(300)]
    rows += rows[:20]
    got = trailing.trailing_totals(frame(spark, rows), F.col("who"), F.col("at"), F.col("amount"), (1, 7, 30)).collect()
    assert {(x.entity, x.period_days, x.day): (x.total, x.n) for x in got} == brute(rows, (1, 7, 30))
    assert len(got) == len({(x.entity, x.period_days, x.day) for x in got})
    assert all((x["mean"] is None) == (x.n == 0) for x in got)


def test_peak_days_keep_ties(spark):
    rows = [(1, dt.datetime(2024, 1, 1), 5), (1, dt.datetime(2024, 1, 3), 5), (2, dt.datetime(2024, 1, 1), 0)]
    got = trailing.peak_days(frame(spark, rows), F.col("who"), F.col("at"), F.col("amount"), (1,)).collect()
    assert {(x.entity, str(x.day)) for x in got} == {(1, "2024-01-01"), (1, "2024-01-03"), (2, "2024-01-01")}


def test_empty_and_uncounted(spark):
    for rows in ([], [(1, None, 3), (2, dt.datetime(2024, 1, 1), None)]):
        assert trailing.trailing_totals(frame(spark, rows), F.col("who"), F.col("at"), F.col("amount")).count() == 0

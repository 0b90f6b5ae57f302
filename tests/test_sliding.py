"""Sliding windows and sliding reports against plain loops, and one subscriber with most of the rows."""

import datetime as dt
import random
import re

import pytest
from pyspark.sql import functions as F

from ringfold.operators import rules as R
from ringfold.operators import windows as W
from ringfold.sources import rules as rule_tables

CALLS = "call_id long, caller_id long, ts timestamp_ntz, duration int, cost double"
DAY_MS = 86_400_000
WEEK = dt.timedelta(days=7)


def calls(n, seed, minutes):
    rng = random.Random(seed)
    base = dt.datetime(2023, 12, 25)
    rows = [
        (i, rng.choice([1, 1, 1, 2, 3]), base + dt.timedelta(minutes=rng.randrange(minutes)), rng.choice([None, *range(50)]), rng.choice([None, 0.5, 2.0, 7.25]))
        for i in range(n)
    ]
    return rows + [(n, 1, rows[0][2] + WEEK, 1, 1.0), (n + 1, 1, rows[0][2], 2, 2.0), (n + 2, None, base, 1, 1.0), (n + 3, 1, None, 1, 1.0)]


@pytest.mark.parametrize("seed, minutes, chunk_hours", [(1, 40_000, 6), (2, 2_000, 24), (3, 400_000, 1)])
def test_continuous_is_a_plain_loop(spark, seed, minutes, chunk_hours):
    rows = calls(300, seed, minutes)
    found = {r.call_id: tuple(r)[1:] for r in W.continuous(spark.createDataFrame(rows, CALLS), 7, chunk_hours).collect()}
    known = [r for r in rows if r[1] is not None and r[2] is not None]
    assert len(found) == len(known)
    for call, caller, ts, _, _ in known:
        inside = [r for r in known if r[1] == caller and ts - WEEK < r[2] <= ts]
        durations, costs = ([r[k] for r in inside if r[k] is not None] for k in (3, 4))
        assert found[call] == (caller, len(inside), sum(durations) if durations else None, max(durations, default=None), sum(costs) if costs else None)


def test_one_caller_spreads_over_tasks(spark):
    base = F.lit("2024-01-01").cast("timestamp")
    many = spark.range(60_000).select(
        F.col("id").alias("call_id"), (F.floor(F.col("id") / 1e9) + 7).alias("caller_id"),
        (base + F.make_dt_interval(secs=F.col("id") * 40)).cast("timestamp_ntz").alias("ts"),
        (F.col("id") % 100).cast("int").alias("duration"), F.lit(1.0).alias("cost"),
    )
    found = W.continuous(many, 7)
    plan = found._jdf.queryExecution().executedPlan().toString()
    keys = [re.sub(r"#\d+L?", "", k) for k in re.findall(r"Exchange hashpartitioning\(([^)]*), \d+\)", plan)]
    assert keys and all("," in k or k == "subscriber_id" for k in keys), keys
    assert sum("," not in k for k in keys) == 1  # where the totals of chunks meet
    assert found.agg(F.max("calls"), F.min("sum_dur"), F.max("sum_cost")).first()[:] == (15_120, 0, 15_120.0)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        by_task = [r["count"] for r in W.continuous(many, 7).groupBy(F.spark_partition_id()).count().collect()]
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert len(by_task) == 8 and max(by_task) < 60_000 / 3


def plain(rows, campaigns):
    found = []
    for campaign, start, end, interval, condition in campaigns:
        length = R.INTERVALS[interval] * DAY_MS
        for who in {r[0] for r in rows}:
            last = None
            for at in sorted({r[2] for r in rows if r[0] == who and r[1] == campaign and start <= r[2] < end}):
                if last is None or not length:
                    due = True
                elif condition == "fixed":
                    due = (at - start) // length > (last - start) // length
                else:
                    due = at >= last + length
                if due:
                    last = at
                    found.append((who, campaign, at))
    return sorted(found)


@pytest.mark.parametrize("seed, days, n", [(1, 60, 900), (2, 400, 500), (3, 3, 300), (4, 60, 0)])
def test_reports_are_a_plain_loop(spark, seed, days, n):
    rng = random.Random(seed)
    campaigns = [(c, 5 * DAY_MS * (c % 2), 380 * DAY_MS, ("0", "1d", "2d", "w")[c % 4], ("fixed", "sliding")[c // 4]) for c in range(8)]
    rows = [(rng.choice([1, 1, 1, 2, 3]), rng.randrange(9), rng.randrange(days * 48) * DAY_MS // 48) for _ in range(n)]
    rules = {"campaign": campaigns, "conjunct": [], "conjunct_predicate": [], "predicate": [], "constant": []}
    table = rule_tables.from_rows(spark, rules).campaign
    found = R.reports(spark.createDataFrame(rows, "subscriber_id long, campaign int, at_ms long"), table)
    assert sorted(map(tuple, found.collect())) == plain(rows, campaigns)
    assert "Python" not in found._jdf.queryExecution().executedPlan().toString()

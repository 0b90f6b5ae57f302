"""The wide table against a sequential fold of the calls, and its boundaries by hand."""

import datetime as dt
import random

import pytest

from ringfold.operators import matrix as M
from ringfold.operators import windows as W
from ringfold.sources import calls as C
from ringfold.sources import catalogue as A
from ringfold.sources import dimensions as D

CALLS = "call_id long, caller_id long, cost double, ts timestamp_ntz, duration int, long_distance boolean"
MONDAY = dt.datetime(2024, 1, 15)


def calls_of(spark, rows):
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], CALLS)


def fold(rows, attributes):
    """Each subscriber's state, event by event: a call in a new window resets what is out of it."""
    state = {}
    for caller, cost, ts, duration, far in sorted(rows, key=lambda r: r[2]):
        s = state.setdefault(caller, {})
        s["last_updated"] = ts
        for a in attributes:
            day = ts.date()
            start = day if a.window == "day" else day - dt.timedelta(days=day.weekday())
            if s.get((a.name, "start")) != start:
                s[a.name], s[(a.name, "start")] = (0 if a.aggregate == "sum" else None), start
            if a.filter != "all" and far != (a.filter == "nonlocal"):
                continue
            v = {"call": 1, "dur": duration, "cost": cost}[a.metric]
            old = s[a.name]
            s[a.name] = old + v if a.aggregate == "sum" else v if old is None else (min if a.aggregate == "min" else max)(old, v)
    return state


def random_rows(n=400, subscribers=12, seed=1):
    rng = random.Random(seed)
    return [
        (rng.randrange(subscribers), round(rng.uniform(0.1, 90), 2), MONDAY + dt.timedelta(minutes=rng.randrange(40_000)),
         rng.randrange(1, 100), rng.random() < 0.5)
        for _ in range(n)
    ]


@pytest.mark.parametrize("seed", [1, 2])
def test_wide_table_is_the_fold_in_any_order(spark, seed):
    rows = random_rows(seed=seed)
    attributes = A.generated()
    expected = fold(rows, attributes)
    random.Random(seed).shuffle(rows)
    found = M.wide_table(M.day_partials(calls_of(spark, rows).repartition(5)), attributes).collect()
    assert len(found) == len(expected)
    for r in found:
        for a in attributes:
            want = expected[r.subscriber_id][a.name]
            assert r[a.name] == (pytest.approx(want) if want is not None else None), a.name
        assert r.last_updated == expected[r.subscriber_id]["last_updated"]


def test_partials_of_any_split_merge(spark):
    rows = random_rows()
    whole = M.day_partials(calls_of(spark, rows))
    parts = M.day_partials(calls_of(spark, rows[:150])).unionByName(M.day_partials(calls_of(spark, rows[150:])))
    key = lambda r: (r.caller_id, r.day, r.long_distance)
    for a, b in zip(sorted(whole.collect(), key=key), sorted(M.merged(parts).select(whole.columns).collect(), key=key)):
        a, b = a.asDict(), b.asDict()
        assert a.pop("last_ts") == b.pop("last_ts") and a == pytest.approx(b)


def one(spark, rows, *names, as_of=None):
    attributes = [A.attribute(n) for n in names]
    calls = calls_of(spark, rows)
    wide = M.wide_table_as_of(calls, attributes, as_of) if as_of else M.wide_table(M.day_partials(calls), attributes)
    return [tuple(r[n] for n in names) for r in wide.collect()]


def test_boundaries(spark):
    ms = dt.timedelta(milliseconds=1)
    at = lambda ts: (1, 1.0, ts, 5, False)
    names = ("sum_call_all_day", "sum_call_all_week")
    assert one(spark, [at(MONDAY - ms), at(MONDAY)], *names) == [(1, 1)]  # Monday midnight begins both
    tuesday = MONDAY + dt.timedelta(days=1)
    assert one(spark, [at(tuesday - ms), at(tuesday)], *names) == [(1, 2)]
    assert one(spark, [at(MONDAY), at(MONDAY + dt.timedelta(days=14))], *names) == [(1, 1)]
    late = [at(tuesday), at(MONDAY), at(MONDAY - dt.timedelta(days=3))]  # late calls go to their own windows
    assert one(spark, late, *names) == [(1, 2)]
    assert one(spark, [at(MONDAY)], *names, as_of="2024-01-16 00:00:00") == [(0, 1)]
    assert one(spark, [at(tuesday)], *names, as_of="2024-01-15 12:00:00") == []


def test_filter_resets_and_nulls(spark):
    rows = [(1, 2.0, MONDAY, 9, True), (1, 3.0, MONDAY + dt.timedelta(days=1), 4, False)]
    names = ("max_dur_nonlocal_day", "sum_dur_nonlocal_day", "max_dur_nonlocal_week", "min_cost_local_day")
    assert one(spark, rows, *names) == [(None, 0, 9, 3.0)]
    rows = [(None, 1.0, MONDAY, 1, False), (2, 1.0, None, 1, False), (3, None, MONDAY, None, True)]
    found = one(spark, rows, "sum_call_all_day", "sum_dur_all_day", "max_cost_all_day")
    assert found == [(1, 0, None)]


def test_subscribers_without_calls(spark):
    names = ("sum_call_all_week", "max_cost_all_week")
    wide = M.wide_table(M.day_partials(calls_of(spark, [(1, 2.0, MONDAY, 3, False)])), [A.attribute(n) for n in names])
    subscribers = D.customer_codes(spark.createDataFrame([(1,), (2,)], "c_custkey long"))
    rows = {r.subscriber_id: r for r in M.for_subscribers(wide, subscribers).collect()}
    assert (rows[2].sum_call_all_week, rows[2].max_cost_all_week) == (0, None)
    assert {r.subscriber_id: r.max_cost_all_week for r in M.with_sentinels(M.for_subscribers(wide, subscribers)).collect()}[2] < 0


def test_plan_moves_calls_once(spark):
    plan = M.wide_table(M.day_partials(calls_of(spark, random_rows(20))), A.generated())
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert text.count("Exchange hashpartitioning") == 2  # partials by their key, then by caller


def test_catalogue(spark):
    attributes = A.generated()
    assert len(attributes) == 42 == len({a.name for a in attributes})
    assert A.attribute("sum_dur_local_week").description == "sum(local dur) per week"
    for wrong in ("avg_dur_all_day", "sum_dur_all_month", "sum_size_all_day"):
        with pytest.raises(ValueError):
            A.attribute(wrong)
    metric = spark.createDataFrame([(1, "dur", "uint"), (2, "nonlocal_cost", "double")], "id int, name string, data_type string")
    schema = "id int, metric int, is_pivot boolean, window_type string, window_size string, aggr_fun string, aggr_data_type string"
    rows = [(2, 2, False, "tumb", "w", "max", "double"), (1, 1, False, "tumb", "d", "sum", "uint"), (3, 1, False, "tumb", "d", "sum", "uint")]
    assert A.names(A.load(spark.createDataFrame(rows, schema), metric)) == ["sum_dur_all_day", "max_cost_nonlocal_week"]
    with pytest.raises(ValueError):
        A.load(spark.createDataFrame([(1, 9, False, "tumb", "d", "sum", "uint")], schema), metric)
    with pytest.raises(ValueError):
        A.load(spark.createDataFrame([(1, 1, False, "tumb", "y", "sum", "uint")], schema), metric)
    assert A.as_table(spark, attributes).count() == 42


def test_windows_by_hand(spark):
    day = dt.timedelta(days=1)
    rows = [(1, 1.0, MONDAY, 5, False), (1, 2.0, MONDAY + 6 * day, 7, True), (1, 4.0, MONDAY + 7 * day, 1, False)]
    calls = calls_of(spark, rows)
    weeks = {r.window_start: r.calls for r in W.tumbling(calls, "week").collect()}
    assert weeks == {MONDAY.date(): 2, (MONDAY + 7 * day).date(): 1}
    hops = {r.window_start: r.sum_dur for r in W.stepwise(calls, 7, 7).collect()}
    assert hops == {MONDAY.date(): 12, (MONDAY + 7 * day).date(): 1}
    assert sum(r.calls for r in W.stepwise(calls, 4, 2).collect()) == 2 * len(rows)
    slid = {r.call_id: (r.calls, r.sum_dur, r.max_dur) for r in W.continuous(calls, 7).collect()}
    assert slid == {0: (1, 5, 5), 1: (2, 12, 7), 2: (2, 8, 7)}  # a call exactly seven days ago is out


def test_generated_calls_are_reproducible(spark):
    a, b = (C.generate(spark, 1000, 50, seed=3).repartition(n).orderBy("call_id").collect() for n in (1, 7))
    assert a == b
    assert all(1 <= r.caller_id <= 50 and 0.1 <= r.cost < 100 and 1 <= r.duration <= 10_000 for r in a)
    assert 400 < sum(r.long_distance for r in a) < 600
    assert set(C.CALL.fieldNames()) == set(C.generate(spark, 1, 1).columns)

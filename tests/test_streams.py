"""Streams with state by key, and campaigns evaluated for those who call, against batch results."""

import datetime as dt
import random
import re

import pytest
from pyspark.sql import functions as F

from ringfold.operators import matrix as M
from ringfold.operators import rules as R
from ringfold.plans import registry
from ringfold.sources import calls as C
from ringfold.sources import catalogue as A
from ringfold.sources import rules as rule_tables
from ringfold.sources.store import RangedTable
from ringfold.streaming import reports as report_stream
from ringfold.streaming import matrix as stream
from ringfold.streaming.campaigns import HoldingCampaigns
from ringfold.streaming.evolving import EvolvingPartials
from ringfold.streaming.state import keep_wide, with_state

DAY_MS = 86_400_000
CANDIDATES = "subscriber_id long, campaign int, at_ms long"
RULES = registry.RULES | {
    "campaign": [
        (c, start, 40 * DAY_MS, interval, begins)
        for c, (start, interval, begins) in enumerate(
            ((s, i, b) for s in (0, DAY_MS // 3) for i in ("0", "1d", "2d", "w") for b in ("fixed", "sliding")), 1
        )
    ]
}


def test_streamed_reports_equal_those_of_the_batch(spark, tmp_path):
    """Deliveries out of order within the delay, the stream started again for each."""
    session = with_state(spark)
    campaigns = rule_tables.from_rows(session, RULES).campaign
    rng = random.Random(3)
    rows = [(rng.randrange(6), rng.randrange(1, 18), (1 + rng.randrange(30 * 24)) * 3_600_000) for _ in range(1500)]
    rows += rows[:50]
    deliveries = [[], [], []]
    for r in rows:
        deliveries[min(2, (r[2] + rng.randrange(DAY_MS)) // (11 * DAY_MS))].append(r)
    for k, part in enumerate(deliveries):
        session.createDataFrame(part, CANDIDATES).repartition(3).write.parquet(f"{tmp_path}/arrived/{k}")
        stream = session.readStream.schema(CANDIDATES).parquet(f"{tmp_path}/arrived/*")
        report_stream.report(stream, campaigns, str(tmp_path)).awaitTermination()
        seen = max(r[2] for part in deliveries[: k + 1] for r in part) - DAY_MS
        every = R.reports(session.createDataFrame(rows, CANDIDATES), campaigns)
        want = sorted(tuple(r) for r in every.collect() if r.at_ms < seen)
        found = session.read.schema(CANDIDATES).parquet(f"{tmp_path}/reports")
        assert sorted(map(tuple, found.collect())) == want and len(want) > 200 * (k + 1)
    late = [(0, 1, 0), (None, -1, 100 * DAY_MS)]  # one behind the watermark, and a heartbeat
    session.createDataFrame(late, CANDIDATES).write.parquet(f"{tmp_path}/arrived/3")
    report_stream.report(session.readStream.schema(CANDIDATES).parquet(f"{tmp_path}/arrived/*"), campaigns, str(tmp_path)).awaitTermination()
    found = session.read.schema(CANDIDATES).parquet(f"{tmp_path}/reports")
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, every.collect()))


def events(n, seed, callers=12):
    rng = random.Random(seed)
    base = dt.datetime(2024, 1, 1)
    return [
        (i, base + dt.timedelta(minutes=rng.randrange(30 * 24 * 60)), rng.choice([None, *range(callers)]), rng.choice(["purchase", "view"]), float(rng.randrange(90)), rng.choice(['{"k": 5}', '{"k": 70}', "{}"]))
        for i in range(n)
    ]


def shown(df):
    rows = df.select(*sorted(df.columns)).withColumns({c: F.round(c, 6) for c in df.columns if "cost" in c})
    return sorted(map(str, rows.collect()))


def test_state_equals_partials_on_late_calls_and_batches_again(spark, tmp_path):
    session = with_state(spark)
    attributes = A.generated()
    table = RangedTable(str(tmp_path / "t"), 5)
    rows = events(400, 5)
    for k in range(4):  # any order of times: calls come weeks late
        session.createDataFrame(rows[100 * k : 100 * k + 100], C.EVENT).coalesce(1).write.parquet(f"{tmp_path}/in/events{k}.parquet")
        keep_wide(C.stream_events(session, f"{tmp_path}/in"), attributes, table).awaitTermination()
        calls = C.from_events(session.createDataFrame(rows[: 100 * k + 100], C.EVENT))
        assert shown(table.read(spark)) == shown(M.wide_table(M.day_partials(calls), attributes))
    table.upsert(table.read(spark).where("subscriber_id % 2 = 0"))  # a batch that comes again
    assert shown(table.read(spark)) == shown(M.wide_table(M.day_partials(calls), attributes))


def test_only_who_calls_is_evaluated(spark, tmp_path, monkeypatch):
    rules = rule_tables.from_rows(spark, registry._many_rules(40))
    attributes = A.generated()
    held = HoldingCampaigns(rules, attributes, str(tmp_path), 10)
    rows = events(600, 6, callers=60)
    frame = lambda some: C.from_events(spark.createDataFrame(some, C.EVENT))
    wide = lambda some: M.wide_table(M.day_partials(frame(some)), attributes)
    held.refresh(frame(rows), 0)
    assert shown(held.matches(spark)) == shown(R.matches(wide(rows), rules))
    some = [(*r[:2], (3, 4, 38)[i % 3], *r[3:]) for i, r in enumerate(events(9, 7))]
    read, partials = [], HoldingCampaigns.partials

    def watched(self, spark, ranges):
        found = partials(self, spark, ranges)
        plan = found._jdf.queryExecution().executedPlan().toString()
        read.append((sorted(ranges), bool(re.search(r"PartitionFilters: \[[^\]]*id_range", plan))))
        return found

    monkeypatch.setattr(HoldingCampaigns, "partials", watched)
    before = {f: f.stat().st_mtime_ns for f in tmp_path.glob("holding/rows/*/*.parquet")}
    for _ in range(2):  # the second time changes nothing
        held.refresh(frame(some), 1)
        assert read.pop() == ([0, 3], True)
        assert shown(held.matches(spark)) == shown(R.matches(wide(rows + some), rules))
        assert shown(held.matches(spark, registry.AS_OF_MS)) == shown(R.matches(wide(rows + some), rules, registry.AS_OF_MS))
    after = {f: f.stat().st_mtime_ns for f in tmp_path.glob("holding/rows/*/*.parquet")}
    assert {f.parent.name for f in after if before.get(f) != after[f]} == {"id_range=0", "id_range=3"}
    assert held.compact(spark) == 1 and not list(tmp_path.glob("partials/batch=*"))
    held.refresh(frame([]), 2)
    held.refresh(frame([(1, dt.datetime(2024, 1, 1), None, "view", 1.0, "{}")]), 3)
    assert shown(held.matches(spark)) == shown(R.matches(wide(rows + some), rules))
    more = [(*r[:2], 38, *r[3:]) for r in events(5, 10)]
    held.refresh(frame(more), 4)  # on top of the base
    assert read.pop() == ([3], True)
    assert shown(held.matches(spark)) == shown(R.matches(wide(rows + some + more), rules))


def test_batches_without_rows_and_vacuum(spark, tmp_path):
    root = str(tmp_path)
    nobody = [(1, dt.datetime(2024, 1, 1), None, "view", 1.0, "{}")]
    frame = lambda some: C.from_events(spark.createDataFrame(some, C.EVENT))
    for k, some in enumerate(([], nobody)):
        stream.append_partials(frame(some), k, root)
        assert stream.snapshot(spark, root).count() == 0 and stream.vacuum(spark, root) == -1
    assert stream.compact(spark, root) == 1 and stream.snapshot(spark, root).count() == 0
    rows = events(60, 8)
    for k in range(3):
        stream.append_partials(frame(rows[20 * k : 20 * k + 20]), 2 + k, root)
        assert stream.compact(spark, root) == 2 + k
    want = shown(M.day_partials(frame(rows)))
    assert stream.vacuum(spark, root) == 4 and shown(stream.snapshot(spark, root)) == want
    left = [f.relative_to(tmp_path).parts[:2] for f in tmp_path.rglob("*.parquet")]
    assert set(left) == {("base", "upto=4"), ("bases", "number=4")}
    stream.append_partials(frame(rows[40:]), 4, root)  # comes again
    stream.append_partials(frame(rows[:5]), 5, root)
    assert shown(stream.snapshot(spark, root)) == shown(M.day_partials(frame(rows + rows[:5])))


RATES = [A.DerivedAttribute(a, "rate", f, w) for a in ("sum", "min", "max") for f in A.FILTERS for w in A.WINDOWS]


def test_a_metric_that_comes_in_mid_stream(spark, tmp_path):
    partials = EvolvingPartials(f"{tmp_path}/state")
    rows, rate = events(400, 9), "cost / (duration + 1)"
    for k in range(4):
        spark.createDataFrame(rows[100 * k : 100 * k + 100], C.EVENT).coalesce(1).write.parquet(f"{tmp_path}/in/events{k}.parquet")
        partials.keep_up(spark, f"{tmp_path}/in").awaitTermination()
        if k == 1:
            partials.add_metric(spark, "rate", rate)
            partials.add_metric(spark, "rate", rate)
            assert partials.backfill(spark) == ["rate"] and partials.backfill(spark) == []
    attributes = [*A.generated(), *RATES]
    calls = C.from_events(spark.createDataFrame(rows, C.EVENT))
    want = shown_all(M.wide_table(M.day_partials(calls, {"rate": F.expr(rate)}), attributes))
    assert shown_all(M.wide_table(partials.read(spark), attributes)) == want
    with pytest.raises(ValueError, match="rate"):
        partials.add_metric(spark, "rate", "cost")
    # A batch from before the metric comes again, now with it: what was filled in for it does not count twice.
    again = C.from_events(spark.read.parquet(f"{tmp_path}/in/events1.parquet").withColumn("file", F.lit("f")), "file")
    batch = spark.read.parquet(f"{tmp_path}/state/batches").where(F.exists("files", lambda f: f.contains("events1.parquet"))).first()["of"]
    partials.append(again, batch)
    assert shown_all(M.wide_table(partials.read(spark), attributes)) == want
    with pytest.raises(ValueError):
        A.DerivedAttribute("sum", "two_words", "all", "week")


def shown_all(df):
    rows = df.select(*sorted(df.columns)).withColumns({c: F.round(c, 6) for c, kind in df.dtypes if kind == "double"})
    return sorted(map(str, rows.collect()))


def test_reports_of_a_range_of_subscribers_share_a_key(spark, tmp_path):
    """Each key costs calls to the JVM, so there are fewer keys than subscribers; unknown ones have their own."""
    session = with_state(spark)
    campaigns = rule_tables.from_rows(session, RULES).campaign
    people = [None, 0, -1, 999, 1000, 2**62, 2**62 + 1, *range(40)]
    rows = [(p, c, (3 + i) * DAY_MS + h) for i in range(12) for p in people for c in (1, 5, 6, 8) for h in (0, 0, 7)]
    session.createDataFrame([*rows, (None, -1, 100 * DAY_MS)], CANDIDATES).write.parquet(f"{tmp_path}/arrived/0")
    report_stream.report(session.readStream.schema(CANDIDATES).parquet(f"{tmp_path}/arrived/*"), campaigns, str(tmp_path)).awaitTermination()
    found = session.read.schema(CANDIDATES).parquet(f"{tmp_path}/reports").collect()
    known = [r for r in rows if r[0] is not None]
    want = R.reports(session.createDataFrame(known, CANDIDATES), campaigns).collect()
    assert sorted(map(tuple, (r for r in found if r[0] is not None))) == sorted(map(tuple, want)) and len(want) > 400
    of = lambda who: sorted((r[1], r[2]) for r in found if r[0] == who)
    assert of(None) == of(0) and of(2**62) == of(2**62 + 1) == of(0)
    keys = session.read.format("statestore").option("path", f"{tmp_path}/progress").option("stateVarName", "firing").option("batchId", 0).load()
    assert 0 < keys.count() <= 4 * 5


def test_state_of_a_range_of_subscribers_is_one_value(spark, tmp_path):
    """And only those who call are emitted, with nulls and large numbers as they are."""
    session = with_state(spark)
    attributes = A.generated()
    table = RangedTable(str(tmp_path / "t"), 10)
    day = lambda n, s=0: dt.datetime(2024, 1, n, 0, 0, s)
    first = [(1, day(1), -1, "view", None, "{}"), (2, day(2), 7, "error", 0.1, '{"k": 2147483646}'), (3, day(2, 1), 7, "error", 0.1, '{"k": 2147483646}')]
    first += [(4, day(3), 7, "view", 5.0, '{"k": 1}'), (5, day(3), 2**60 + 1, "view", 1.0, "{}"), (6, day(3), 8, "view", 2.0, '{"k": 3}')]
    second = [(7, day(20), 8, "view", None, "{}"), (8, day(1), 7, "view", 1.0, "{}"), (9, None, 7, "view", 1.0, "{}")]
    for k, rows in enumerate((first, second)):
        session.createDataFrame(rows, C.EVENT).coalesce(1).write.parquet(f"{tmp_path}/in/events{k}.parquet")
        keep_wide(C.stream_events(session, f"{tmp_path}/in"), attributes, table).awaitTermination()
        calls = C.from_events(session.createDataFrame(first + (second if k else []), C.EVENT))
        assert shown(table.read(spark)) == shown(M.wide_table(M.day_partials(calls), attributes))
    held = session.read.format("statestore").option("path", f"{table.root}/progress").option("stateVarName", "partials").load()
    assert held.count() == 3  # ranges


def test_a_range_of_partials_is_one_file(spark, tmp_path):
    """Tasks write no file each to every range: files would grow with the ranges times the tasks."""
    calls = C.from_events(spark.createDataFrame(events(2000, 11, callers=60), C.EVENT).repartition(4))
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        stream.append_partials(calls, 0, str(tmp_path), 10)
        assert len(list(tmp_path.glob("partials/batch=0/*/*.parquet"))) == 6
        stream.compact(spark, str(tmp_path), 10)
        assert len(list(tmp_path.glob("base/upto=0/*/*.parquet"))) == 6
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    assert shown(stream.snapshot(spark, str(tmp_path))) == shown(M.day_partials(calls))

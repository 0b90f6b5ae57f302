"""The seven queries by hand, rules, tables and streams."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from ringfold.functions.values import compared, matches
from ringfold.operators import matrix as M
from ringfold.operators import rules as R
from ringfold.plans import queries as Q
from ringfold.plans import registry
from ringfold.sources import calls as C
from ringfold.sources import catalogue as A
from ringfold.sources import dimensions as D
from ringfold.sources import rules as rule_tables
from ringfold.sources import store as S
from ringfold.storage import new_path
from ringfold.streaming import matrix as stream

NAMES = sorted({n for needs in Q.NEEDS.values() for n in needs})
DAY_MS = 86_400_000


def wide(spark, *rows):
    """Rows of changes to a subscriber in Lausanne without calls."""
    schema = "subscriber_id long, subscription_id short, region_id short, category_id short, value_id short, "
    schema += ", ".join(f"{n} {'double' if 'cost' in n else 'long'}" for n in NAMES)
    out = []
    for i, changes in enumerate(rows, 1):
        base = {n: (None if n.startswith("m") else 0.0 if "cost" in n else 0) for n in NAMES}
        base |= {"subscriber_id": i, "subscription_id": 1, "region_id": 0, "category_id": 0, "value_id": 2} | changes
        out.append(tuple(base[f.split()[0]] for f in schema.split(", ")))
    return spark.createDataFrame(out, schema)


def test_q1_to_q3(spark):
    w = wide(
        spark,
        {"sum_call_local_week": 3, "sum_dur_all_week": 10, "sum_call_all_week": 4, "max_cost_all_week": 7.0, "sum_cost_all_week": 5.0},
        {"sum_call_local_week": 4, "sum_dur_all_week": 20, "sum_call_all_week": 4, "max_cost_all_week": 9.0, "sum_cost_all_week": 1.0},
        {},
    )
    assert Q.q1(w, 2).first().avg_dur == 15.0 and Q.q1(w, 3).first().avg_dur == 20.0
    assert Q.q1(w, 100).first().avg_dur == 0.0
    assert Q.q2(w, 2).first().max_cost == 9.0 and Q.q2(w, 100).first().max_cost is None
    assert [tuple(r) for r in Q.q3(w).collect()] == [(4, 0.2)]  # nobody without calls has a ratio


def test_q4_q5(spark):
    local = {"sum_call_local_week": 2, "sum_dur_local_week": 60, "sum_cost_local_week": 1.5, "sum_cost_nonlocal_week": 4.0}
    w = wide(spark, local, local | {"sum_call_local_week": 4}, local | {"region_id": 4}, local | {"sum_dur_local_week": 50, "category_id": 1})
    assert {r.city: (r.avg_calls, r.sum_dur) for r in Q.q4(w, 1, 50).collect()} == {"Lausanne": (3.0, 120), "Beijing": (2.0, 60)}
    assert Q.q4(w, 1, 10**6).count() == 0
    assert {r.region: (r.local_cost, r.long_cost) for r in Q.q5(w, "contract", "business").collect()} == {
        "EUROPE": (3.0, 8.0), "ASIA": (1.5, 4.0),
    }
    assert Q.q5(w, "prepaid", "business").count() == 0


def test_q6_ties_and_nothing(spark):
    w = wide(spark, {"max_dur_local_day": 5}, {"max_dur_local_day": 9}, {"max_dur_local_day": 9, "region_id": 1}, {"max_dur_local_day": 99, "region_id": 2})
    row = Q.q6(w, "Switzerland").first()
    assert (row.max_dur_local_day, row.id_local_day) == (9, 2)
    assert (row.max_dur_nonlocal_week, row.id_nonlocal_week) == (None, None)
    assert Q.q6(w, "China").first().id_local_day is None


def test_q7(spark):
    cheap = {"sum_call_all_week": 2, "sum_cost_all_week": 2.0, "sum_dur_all_week": 4}
    w = wide(spark, {}, cheap | {"sum_cost_all_week": 3.0}, cheap, cheap, cheap | {"value_id": 1, "sum_cost_all_week": 0.1}, cheap | {"sum_dur_all_week": 0})
    assert tuple(Q.q7(w, "gold", "week").first()) == (3, 0.5)  # the lowest id on ties
    assert Q.q7(w, "platinum", "week").count() == 0 and Q.q7(w, "gold", "day").count() == 0


RULES = {
    "campaign": [(1, 0, 10 * DAY_MS, "w", "fixed"), (2, 0, 30 * DAY_MS, "2d", "sliding"), (3, 5 * DAY_MS, 30 * DAY_MS, "0", "fixed")],
    "conjunct": [(10, 1), (11, 1), (20, 2), (30, 3)],
    "conjunct_predicate": [(100, 10), (101, 10), (102, 11), (102, 20), (101, 30)],
    "predicate": [(100, "sum_call_local_week", "gr", 1), (101, "sum_dur_local_week", "lte", 2), (102, "max_dur_local_day", "gre", 1)],
    "constant": [(1, "5", "int"), (2, "60", "int")],
}


def test_rules(spark):
    rules = rule_tables.from_rows(spark, RULES)
    w = wide(spark, {"sum_call_local_week": 6, "sum_dur_local_week": 60}, {"max_dur_local_day": 5, "sum_dur_local_week": 61}, {"sum_call_local_week": 5})
    found = sorted(map(tuple, R.matches(w, rules).collect()))
    assert found == [(1, 1), (1, 3), (2, 1), (2, 2), (3, 3)]
    assert sorted(map(tuple, R.matches(w, rules, as_of_ms=0).collect())) == [(1, 1), (2, 1), (2, 2)]
    assert sorted(map(tuple, R.matches(w, rules, as_of_ms=10 * DAY_MS).collect())) == [(1, 3), (2, 2), (3, 3)]
    text = {r.campaign: r.condition for r in rule_tables.listing(rules).collect()}
    assert text[1] == "(sum_call_local_week gr 5 AND sum_dur_local_week lte 60) OR (max_dur_local_day gre 5)"


def test_rule_tables_are_checked(spark):
    with pytest.raises(ValueError):
        rule_tables.from_rows(spark, RULES | {"constant": RULES["constant"][:1]})
    rules = rule_tables.from_rows(spark, RULES | {"predicate": [(100, "sum_x", "gr", 1), *RULES["predicate"][1:]]})
    with pytest.raises(ValueError):
        R.matches(wide(spark, {}), rules)
    path = new_path(spark, "rules")
    for name, schema in rule_tables.SCHEMAS.items():
        spark.createDataFrame(RULES[name], schema).write.parquet(f"{path}/{name}.parquet")
    assert rule_tables.load(spark, path).flat().count() == 5


def test_reports(spark):
    campaigns = rule_tables.from_rows(spark, RULES).campaign
    times = [0, 1, DAY_MS, 2 * DAY_MS, 3 * DAY_MS, 7 * DAY_MS, 7 * DAY_MS + 1, 9 * DAY_MS - 1, 10 * DAY_MS]
    rows = [(1, c, t) for c in (1, 2, 3) for t in (*times, times[0])]
    found = R.reports(spark.createDataFrame(rows, "subscriber_id long, campaign int, at_ms long"), campaigns).collect()
    at = {c: sorted(r.at_ms for r in found if r.campaign == c) for c in (1, 2, 3)}
    assert at[1] == [0, 7 * DAY_MS]  # aligned weeks; the campaign ends before day 10
    assert at[2] == [0, 2 * DAY_MS, 7 * DAY_MS, 10 * DAY_MS]  # two days from each report
    assert at[3] == [t for t in times if t >= 5 * DAY_MS]


def test_comparisons(spark):
    df = spark.createDataFrame([(1.0, "lt"), (2.0, "gre"), (None, "lt"), (1.0, "odd")], "v double, op string")
    assert [r[0] for r in df.select(compared(F.col("v"), F.col("op"), F.lit(2.0))).collect()] == [True, True, False, False]
    df = spark.createDataFrame([("abc", "like"), ("abc", "eq"), (None, "like")], "v string, op string")
    assert [r[0] for r in df.select(matches(F.col("v"), F.col("op"), F.lit("a%"))).collect()] == [True, False, False]


def test_populate_and_layout(spark):
    attributes = A.generated()
    assert S.populate(spark, 1, 2, attributes).where("last_updated is null or last_updated > now() + interval 1 minute").count() == 0
    at = F.lit("2024-01-01").cast("timestamp")
    fresh = S.populate(spark, 1, 100, attributes, seed=4, at=at)
    assert fresh.count() == 100 and fresh.schema.fieldNames() == S.wide_schema(attributes).fieldNames()
    assert sorted(fresh.collect()) == sorted(S.populate(spark, 1, 100, attributes, seed=4, at=at).repartition(3).collect())
    row = fresh.first()
    assert row.sum_cost_all_day == 0.0 and row.min_dur_local_week is None
    laid = S.laid_out(fresh, 4).select("subscriber_id", F.spark_partition_id().alias("p")).groupBy("p").agg(F.min("subscriber_id").alias("a"), F.max("subscriber_id").alias("b"))
    spans = sorted((r.a, r.b) for r in laid.collect())
    assert all(x[1] < y[0] for x, y in zip(spans, spans[1:]))
    keys = spark.createDataFrame([(2,), (2,), (7,), (999,)], "subscriber_id long")
    assert sorted(r.subscriber_id for r in S.lookup(fresh, keys).collect()) == [2, 7]


def test_pushdown_reaches_the_scan(spark, tmp_path):
    C.generate(spark, 100, 5).write.parquet(f"{tmp_path}/c")
    plan = S.scan(spark.read.parquet(f"{tmp_path}/c"), ["call_id"], F.col("cost") > 50)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(cost), GreaterThan(cost,50.0)]" in plan and "ReadSchema: struct<call_id:bigint,cost:double>" in plan


def events(spark, folder, n=6):
    base = dt.datetime(2024, 1, 1)
    rows = [(i, base + dt.timedelta(hours=(i * 37) % 900), i % 7, "purchase" if i % 3 else "view", float(i % 11), f'{{"k": {i % 90}}}') for i in range(600)]
    df = spark.createDataFrame(rows, C.EVENT)
    for k in range(n):
        df.where(F.col("event_id") % n == k).coalesce(1).write.parquet(f"{folder}/part{k}")
    return C.from_events(df)


def event_files(tmp_path, n=6):
    target = tmp_path / "flat"
    target.mkdir()
    for k in range(n):
        for i, f in enumerate((tmp_path / f"part{k}").glob("*.parquet")):
            f.rename(target / f"events{k}{i}.parquet")
    return str(target)


def test_stream_is_batch_whatever_is_delivered_twice(spark, tmp_path):
    calls = events(spark, tmp_path)
    folder = event_files(tmp_path)
    root = str(tmp_path / "state")
    stream.keep_up(C.stream_events(spark, folder), root).awaitTermination()
    assert spark.read.parquet(f"{root}/partials").select("batch").distinct().count() == 6
    again = root + "2"
    parts = sorted(p.name for p in (tmp_path / "flat").iterdir())
    for repeat in (0, 1):
        for i, name in enumerate(parts):
            if repeat == 0 or i % 2:
                stream.append_partials(C.from_events(spark.read.parquet(f"{folder}/{name}")), i, again)
    attributes = A.generated()
    want = sorted(map(str, M.wide_table(M.day_partials(calls), attributes).collect()))
    for state in (root, again):
        assert sorted(map(str, M.wide_table(stream.snapshot(spark, state), attributes).collect())) == want
    assert stream.compact(spark, again) == 5
    assert sorted(map(str, M.wide_table(stream.snapshot(spark, again), attributes).collect())) == want


def test_stream_goes_on_after_compaction(spark, tmp_path):
    events(spark, tmp_path)
    folder = event_files(tmp_path)
    late = tmp_path / "late"
    late.mkdir()
    for f in sorted((tmp_path / "flat").iterdir())[3:]:
        f.rename(late / f.name)
    root = str(tmp_path / "state")

    def partials(of):
        rows = of.withColumn("sum_cost", F.round("sum_cost", 6)).select("caller_id", "day", "long_distance", "calls", "sum_dur", "sum_cost", "last_ts")
        return sorted(map(str, rows.collect()))

    stream.keep_up(C.stream_events(spark, folder), root).awaitTermination()
    half = stream.snapshot(spark, root)
    before = partials(half)
    last = stream.compact(spark, root)
    assert last >= 0 and partials(stream.snapshot(spark, root)) == before
    for f in late.iterdir():
        f.rename(tmp_path / "flat" / f.name)
    stream.keep_up(C.stream_events(spark, folder), root).awaitTermination()
    calls = C.from_events(spark.read.parquet(folder))
    want = partials(M.day_partials(calls))
    assert partials(stream.snapshot(spark, root)) == want != before
    assert stream.compact(spark, root) > last and partials(stream.snapshot(spark, root)) == want
    assert partials(half) == before  # a reader of the state before still sees that
    # A batch that is being written, and one of before the base that comes again, do not show.
    more = M.day_partials(calls).withColumn("batch", F.lit(99).cast("long"))
    more.write.mode("append").partitionBy("batch").parquet(f"{root}/partials")
    stream.append_partials(calls, 0, root)
    assert partials(stream.snapshot(spark, root)) == want
    stream._point(spark, f"{root}/commits", 99)
    assert sum(r.calls for r in stream.snapshot(spark, root).select("calls").collect()) == 2 * calls.count()


def test_rules_by_catalogue_and_text(spark):
    tables = {
        "campaign": [(1, 0, 10, "0", "fixed"), (2, 0, 10, "0", "fixed"), (3, 0, 5, "0", "fixed")],
        "conjunct": [(1, 1), (2, 2), (3, 2), (4, 3)],
        "conjunct_predicate": [(1, 1), (2, 1), (3, 2), (4, 3), (1, 4)],
        "metric": [(1, "dur"), (2, "nonlocal_cost")],
        "wt_attribute": [(7, 1, 0, "tumb", "d", "sum", "uint"), (8, 2, 0, "cont", "w", "max", "double")],
        "predicate": [(1, 7, "E", 1), (2, 8, "gre", 2), (3, 8, "lt", 2), (4, 7, "gr", 1)],
        "constant": [(1, "30", "int"), (2, "1.5", "double")],
    }
    rules = rule_tables.from_rows(spark, tables)
    assert sorted(r.attribute for r in rules.flat().select("attribute").distinct().collect()) == ["max_cost_nonlocal_week_cont", "sum_dur_all_day"]
    wide = spark.createDataFrame(
        [(1, 30, 2.0), (2, 30, None), (3, 31, 1.0), (4, None, None)], "subscriber_id long, sum_dur_all_day long, max_cost_nonlocal_week_cont double"
    )
    for limit in (0, 100):
        assert sorted(map(tuple, R.matches(wide, rules, 7, compiled=limit).collect())) == [(1, 1), (3, 2)]
        assert sorted(map(tuple, R.matches(wide, rules, compiled=limit).collect())) == [(1, 1), (1, 3), (2, 3), (3, 2)]
    plan = R.matches(wide, rules)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan
    with pytest.raises(ValueError, match="wt_attribute 9"):
        rule_tables.from_rows(spark, tables | {"predicate": [(1, 9, "gr", 1), *tables["predicate"][1:]]})
    with pytest.raises(ValueError, match="odd"):
        rule_tables.from_rows(spark, tables | {"predicate": [(1, 7, "odd", 1), *tables["predicate"][1:]]})
    text = {
        "campaign": [(1, 0, 10, "0", "fixed"), (2, 0, 10, "0", "fixed")], "conjunct": [(1, 1), (2, 2)], "conjunct_predicate": [(1, 1), (2, 2)],
        "predicate": [(1, "city", "like", 1), (2, "city", "E", 2)], "constant": [(1, "B%n", "string"), (2, "Basel", "string")],
    }
    people = spark.createDataFrame([(1, "Bern"), (2, "Basel"), (3, None)], "subscriber_id long, city string")
    for limit in (0, 100):
        assert sorted(map(tuple, R.matches(people, rule_tables.from_rows(spark, text), compiled=limit).collect())) == [(1, 1), (2, 2)]


def test_descriptions_as_columns(spark):
    table = A.as_table(spark, [*A.generated(), A.attribute("sum_dur_local_week_cont")])
    text = A.described(*(F.col(c) for c in ("aggregate", "metric", "filter", "window")))
    assert table.where(text == F.col("description")).count() == 43
    codes = spark.createDataFrame([("d",), ("w",), ("week",)], "c string")
    assert [r[0] for r in codes.select(A.window_of(F.col("c"))).collect()] == ["day", "week", "week"]


def test_kinds_of_windows(spark):
    base = dt.datetime(2024, 1, 8)
    rows = [(i, base + dt.timedelta(hours=h), 1, "view", 1.0 + i, '{"k": 1}') for i, h in enumerate((0, 30, 100, 168, 190))]
    calls = C.from_events(spark.createDataFrame(rows, C.EVENT))
    names = ["sum_call_all_week", "sum_call_all_week_step", "sum_call_all_week_cont", "max_cost_all_day_cont"]
    row = M.wide_table_of_calls(calls, [A.attribute(n) for n in names]).first()
    assert [row[n] for n in names] == [2, 4, 4, 5.0]
    with pytest.raises(ValueError, match="sum_call_all_day_step"):
        M.wide_table(M.day_partials(calls), [A.attribute("sum_call_all_day_step")])


@pytest.mark.parametrize("files", [1, 3])
def test_stream_reads_a_table_of_one_or_more_files(spark, tmp_path, files):
    rows = spark.read.parquet("/root/testdata/sf0.001/events.parquet").select(*C.EVENT.names)
    rows.repartition(files).write.parquet(f"{tmp_path}/parts")
    table = tmp_path / "table"
    table.mkdir()
    if files == 1:
        next((tmp_path / "parts").glob("*.parquet")).rename(table / "events.parquet")
    else:
        (tmp_path / "parts").rename(table / "events.parquet")
    stream.keep_up(C.stream_events(spark, str(table)), f"{tmp_path}/state").awaitTermination()
    want = M.day_partials(C.read_events(spark, str(table)))
    got = stream.snapshot(spark, f"{tmp_path}/state").select(*want.columns)
    # Sums of doubles depend on the order.
    got, want = (sorted(map(str, df.withColumn("sum_cost", F.round("sum_cost", 6)).collect())) for df in (got, want))
    assert got == want


def test_closed_windows(spark, tmp_path):
    calls = events(spark, tmp_path)
    folder = event_files(tmp_path)
    query = (
        stream.closed_windows(C.stream_events(spark, folder, files_per_batch=6), delay="2 days")
        .writeStream.outputMode("append").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True)
        .format("parquet").start(f"{tmp_path}/out")
    )
    query.awaitTermination()
    got = {(r.subscriber_id, r.window_start): r.calls for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    last = calls.agg(F.max("ts")).first()[0] - dt.timedelta(days=2)
    want = {}
    for r in calls.collect():
        end = dt.datetime.combine(r.ts.date(), dt.time()) + dt.timedelta(days=1)
        if end <= last:
            want[r.caller_id, r.ts.date()] = want.get((r.caller_id, r.ts.date()), 0) + 1
    assert got == want


def test_dimensions(spark):
    coded = D.customer_codes(spark.createDataFrame([(k,) for k in range(200)], "c_custkey long"))
    for name, (key, _, n) in D.DIMENSIONS.items():
        assert D.with_dimension(coded, name).count() == 200 and coded.select(key).distinct().count() == n


def test_registered_names_and_columns():
    queries, sql = registry.queries(), registry.oracle_sql()
    assert set(sql) == set(queries)

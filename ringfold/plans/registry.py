"""Registered queries over the given tables, each with SQL that takes another route to its rows.

The SQL never uses day partials: it joins raw events with each caller's last event.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.values import decoded, encoded, guarded_ratio
from ..operators import matrix as M
from ..operators import rules as R
from ..operators import windows as W
from ..sources import calls as C
from ..sources import catalogue as A
from ..sources import dimensions as D
from ..sources import rules as rule_tables
from ..sources import store as S
from ..storage import new_path
from ..streaming import matrix as stream
from ..streaming import reports as report_stream
from ..streaming import state as state_stream
from ..streaming.campaigns import HoldingCampaigns
from ..streaming.evolving import EvolvingPartials
from . import queries as Q

Query = Callable[[SparkSession, str], DataFrame]
ALL = A.names(A.generated())
AS_OF = "2024-01-17 12:00:00"
AS_OF_MS = 1_705_492_800_000
RULES: dict[str, list[tuple]] = {
    "campaign": [
        (1, 0, 4_102_444_800_000, "0", "fixed"),
        (2, 1_704_067_200_000, 1_706_745_600_000, "w", "fixed"),
        (3, 1_704_067_200_000, 1_706_745_600_000, "2d", "sliding"),
        (4, 1_704_067_200_000, 1_705_276_800_000, "1d", "fixed"),
        (5, 1_704_067_200_000, 1_706_745_600_000, "w", "sliding"),
    ],
    "conjunct": [(10, 1), (11, 1), (20, 2), (30, 3), (31, 3), (32, 3), (40, 4), (50, 5)],
    "conjunct_predicate": [
        (100, 10), (101, 10), (102, 11), (103, 20), (104, 20), (105, 30), (106, 31), (107, 31), (100, 32), (102, 40), (101, 50),
    ],
    "predicate": [
        (100, "sum_call_local_week", "gr", 1), (101, "max_cost_all_week", "gre", 2), (102, "sum_dur_all_day", "gr", 3),
        (103, "min_dur_nonlocal_week", "lt", 4), (104, "sum_call_all_week", "lte", 5), (105, "max_dur_local_day", "gre", 6),
        (106, "sum_cost_nonlocal_day", "gr", 2), (107, "min_cost_all_week", "lt", 7),
    ],
    "constant": [(1, "3", "int"), (2, "80", "int"), (3, "120", "int"), (4, "10", "int"), (5, "9", "int"), (6, "70", "int"), (7, "5", "int")],
}


_METRICS = sorted({(a.metric if a.filter == "all" else f"{a.filter}_{a.metric}") for a in A.generated()})
#: The same rules with predicates that refer to a catalogue table.
RULES_BY_ID: dict[str, list[tuple]] = RULES | {
    "metric": list(enumerate(_METRICS)),
    "wt_attribute": [
        (i, _METRICS.index(a.metric if a.filter == "all" else f"{a.filter}_{a.metric}"), 0, a.kind, a.window[0], a.aggregate, "double")
        for i, a in enumerate(A.generated())
    ],
    "predicate": [(k, ALL.index(name), operator, constant) for k, name, operator, constant in RULES["predicate"]],
}


def _many_rules(campaigns: int) -> dict[str, list[tuple]]:
    """Campaigns of one to five conjuncts of one to five predicates each, on all attributes, with shared predicates."""
    top = {"call": 30, "dur": 160, "cost": 400}
    draw, predicates, constants = 1, {}, {}
    tables: dict[str, list[tuple]] = {"campaign": [], "conjunct": [], "conjunct_predicate": []}

    def drawn(below: int) -> int:
        nonlocal draw
        draw = (draw * 48_271) % (2**31 - 1)
        return (draw >> 8) % below

    for c in range(1, campaigns + 1):
        start = 1_704_067_200_000 + drawn(20) * 86_400_000
        interval, condition = list(R.INTERVALS)[drawn(4)], rule_tables.STARTS[drawn(2)]
        tables["campaign"].append((c, start, start + (1 + drawn(30)) * 86_400_000, interval, condition))
        for _ in range(1 + drawn(5)):
            conjunct = len(tables["conjunct"]) + 1
            tables["conjunct"].append((conjunct, c))
            found = set()
            for _ in range(1 + drawn(5)):
                attribute, operator = ALL[drawn(len(ALL))], ("lt", "lte", "gr", "gre", "gr", "gre", "eq")[drawn(7)]
                constant = constants.setdefault(str(drawn(top[A.attribute(attribute).metric])), len(constants) + 1)
                found.add(predicates.setdefault((attribute, operator, constant), len(predicates) + 1))
            tables["conjunct_predicate"] += [(p, conjunct) for p in sorted(found)]
    tables["predicate"] = [(k, *of) for of, k in predicates.items()]
    tables["constant"] = [(k, value, "int") for value, k in constants.items()]
    return tables


MANY_RULES = _many_rules(300)
MOVING = ("sum_call_all_week_cont", "max_cost_local_day_cont", "sum_dur_all_week_step", "min_dur_nonlocal_week_step", "sum_dur_all_week")


def _customer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/customer.parquet")


def matrix(spark: SparkSession, sf_dir: str, names: Sequence[str] = ALL) -> DataFrame:
    """All customers with the named attributes of their calls."""
    partials = M.day_partials(C.read_events(spark, sf_dir))
    wide = M.wide_table(partials, [A.attribute(n) for n in names])
    return M.for_subscribers(wide, D.customer_codes(_customer(spark, sf_dir)))


def _shown(wide: DataFrame) -> DataFrame:
    """Costs rounded and times as text, to compare."""
    return wide.select(
        "subscriber_id",
        F.date_format("last_updated", "yyyy-MM-dd HH:mm:ss").alias("last_updated"),
        *(F.round(c, 4).alias(c) if "cost" in c else F.col(c) for c in wide.columns if c in ALL),
    )


def _sql_attribute(name: str, last_day: str, last_week: str) -> str:
    a = A.attribute(name)
    value = {"call": "1", "dur": "duration", "cost": "cost"}[a.metric]
    where = f"date_trunc('{a.window}', ts) = {last_day if a.window == 'day' else last_week}"
    if a.filter != "all":
        where += f" AND {'NOT ' if a.filter == 'local' else ''}long_distance"
    found = f"{a.aggregate}({value}) FILTER (WHERE {where})"
    if a.metric == "cost":
        return f"{f'coalesce({found}, 0.0)' if a.aggregate == 'sum' else found} AS {name}"
    if a.aggregate == "sum":
        return f"CAST(coalesce({found}, 0) AS BIGINT) AS {name}"
    return f"CAST({found} AS INTEGER) AS {name}"


CALLS_SQL = """calls AS (
  SELECT event_id AS call_id, user_id AS caller_id, ts, value AS cost,
         CAST(json_extract_string(props, '$.k') AS INTEGER) + 1 AS duration,
         event_type IN ('purchase', 'error') AS long_distance FROM events)"""


def wide_sql(names: Sequence[str]) -> str:
    attributes = ", ".join(_sql_attribute(n, "date_trunc('day', l.last_ts)", "date_trunc('week', l.last_ts)") for n in names)
    return f"""{CALLS_SQL},
last AS (SELECT caller_id, max(ts) AS last_ts FROM calls GROUP BY caller_id),
wide AS (SELECT c.caller_id AS subscriber_id, max(ts) AS last_updated, {attributes}
         FROM calls c JOIN last l ON c.caller_id = l.caller_id GROUP BY c.caller_id)"""


def matrix_sql(names: Sequence[str]) -> str:
    columns = ", ".join(f"coalesce(w.{n}, 0) AS {n}" if n.startswith("sum_") else f"w.{n}" for n in names)
    regions = ", ".join(str(r) for r in D.REGION_INFO)
    plans = ", ".join(str(r) for r in D.SUBSCRIPTION_TYPE)
    return f"""WITH {wide_sql(names)},
region_info(region_id, zip, city, state, country, region) AS (VALUES {regions}),
subscription(subscription_id, subscription, plan_cost, mins, data) AS (VALUES {plans}),
category(category_id, category) AS (VALUES {', '.join(map(str, D.SUBSCRIBER_CATEGORY))}),
val(value_id, value, threshold) AS (VALUES {', '.join(map(str, D.SUBSCRIBER_VALUE))}),
m AS (SELECT c_custkey AS subscriber_id, c_custkey % 4 AS subscription_id, (c_custkey // 7) % 6 AS region_id,
             (c_custkey // 4) % 3 AS category_id, (c_custkey // 12) % 4 AS value_id, w.last_updated, {columns}
      FROM customer LEFT JOIN wide w ON w.subscriber_id = c_custkey)
"""


_found: dict[str, tuple[Query, str | None]] = {}


def _register(name: str, query: Query, sql: str | None) -> None:
    _found[name] = (query, sql)


def _query(name: str, number: str, run: Callable[[DataFrame], DataFrame], sql: str) -> None:
    needs = Q.NEEDS[number]
    _register(name, lambda spark, sf_dir: run(matrix(spark, sf_dir, needs)), matrix_sql(needs) + sql)


def _rounded(df: DataFrame, *columns: str) -> DataFrame:
    """Sums of doubles rounded and dates as text, to compare."""
    dates = {c: F.col(c).cast("string") for c, kind in df.dtypes if kind == "date"}
    return df.withColumns({c: F.round(c, 4) for c in columns} | dates)


for _alpha in (2, 5, 1000):
    _query(
        f"q1_alpha_{_alpha}", "q1", lambda w, a=_alpha: _rounded(Q.q1(w, a), "avg_dur"),
        f"SELECT round(coalesce(avg(sum_dur_all_week), 0.0), 4) AS avg_dur FROM m WHERE sum_call_local_week > {_alpha}",
    )
    _query(
        f"q2_alpha_{_alpha}", "q2", lambda w, a=_alpha: _rounded(Q.q2(w, a), "max_cost"),
        f"SELECT round(max(max_cost_all_week), 4) AS max_cost FROM m WHERE sum_call_all_week > {_alpha}",
    )
_query(
    "q3", "q3", lambda w: _rounded(Q.q3(w), "cost_ratio"),
    "SELECT sum_call_all_week AS calls, round(sum(sum_cost_all_week) / sum(sum_dur_all_week), 4) AS cost_ratio "
    "FROM m GROUP BY sum_call_all_week HAVING sum(sum_dur_all_week) > 0",
)
_query(
    "q4", "q4", lambda w: _rounded(Q.q4(w, 1, 50), "avg_calls"),
    "SELECT city, round(avg(sum_call_local_week), 4) AS avg_calls, CAST(sum(sum_dur_local_week) AS BIGINT) AS sum_dur "
    "FROM m JOIN region_info USING (region_id) WHERE sum_call_local_week > 1 AND sum_dur_local_week > 50 GROUP BY city",
)
for _category in ("business", "private", "company"):
    _query(
        f"q5_{_category}", "q5", lambda w, c=_category: _rounded(Q.q5(w, "contract", c), "local_cost", "long_cost"),
        "SELECT region, round(sum(sum_cost_local_week), 4) AS local_cost, round(sum(sum_cost_nonlocal_week), 4) AS long_cost "
        "FROM m JOIN subscription USING (subscription_id) JOIN category USING (category_id) JOIN region_info USING (region_id) "
        f"WHERE subscription = 'contract' AND category = '{_category}' GROUP BY region",
    )
for _country in ("Switzerland", "Germany", "Argentina", "China"):
    _parts = ", ".join(
        f"max({c}) AS {c}, (SELECT min(subscriber_id) FROM x WHERE {c} = (SELECT max({c}) FROM x)) AS {c.replace('max_dur', 'id')}"
        for c in Q.NEEDS["q6"]
    )
    _query(
        f"q6_{_country.lower()}", "q6", lambda w, c=_country: Q.q6(w, c),
        f", x AS (SELECT * FROM m JOIN region_info USING (region_id) WHERE country = '{_country}') SELECT {_parts} FROM x",
    )
for _value in ("none", "silver", "gold", "platinum"):
    for _window in ("day", "week"):
        _query(
            f"q7_{_value}_{_window}", "q7", lambda w, v=_value, p=_window: _rounded(Q.q7(w, v, p), "ratio"),
            f"SELECT subscriber_id, round(sum_cost_all_{_window} / sum_dur_all_{_window}, 4) AS ratio "
            f"FROM m JOIN val USING (value_id) WHERE value = '{_value}' AND sum_call_all_{_window} <> 0 AND sum_dur_all_{_window} <> 0 "
            f"ORDER BY sum_cost_all_{_window} / sum_dur_all_{_window}, subscriber_id LIMIT 1",
        )

_shown_sql = ", ".join(f"round({n}, 4) AS {n}" if "cost" in n else n for n in ALL)
_wide_rows_sql = f"SELECT subscriber_id, strftime(last_updated, '%Y-%m-%d %H:%M:%S') AS last_updated, {_shown_sql} FROM "


def call_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.read_events(spark, sf_dir).select("call_id", "caller_id", "cost", "duration", "long_distance")


def wide_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    partials = M.day_partials(C.read_events(spark, sf_dir))
    return _shown(M.wide_table(partials, A.generated()))


def wide_table_as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(M.wide_table_as_of(C.read_events(spark, sf_dir), A.generated(), AS_OF))


def all_subscribers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(matrix(spark, sf_dir))


def sentinels(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ("min_dur_local_week", "max_dur_local_week")
    return M.with_sentinels(matrix(spark, sf_dir, names)).select(
        "subscriber_id", *(F.col(n).cast("long").alias(n) for n in names)
    )


def window_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(W.tumbling(C.read_events(spark, sf_dir), "day"), "sum_cost", "min_cost")


def window_week(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(W.tumbling(C.read_events(spark, sf_dir), "week"), "sum_cost", "min_cost")


def window_stepwise(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(W.stepwise(C.read_events(spark, sf_dir), 7, 2), "sum_cost", "min_cost")


def window_continuous(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(W.continuous(C.read_events(spark, sf_dir), 7), "sum_cost")


def scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = ("call_id", "caller_id", "cost")
    return S.scan(C.read_events(spark, sf_dir), columns, (F.col("cost") > 50) & (F.col("ts") >= F.lit("2024-01-10").cast("timestamp_ntz")))


def scan_aggregate(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = (F.count("*").alias("n"), F.round(F.sum("cost"), 4).alias("cost"), F.max("duration").alias("longest"))
    return S.scan_aggregate(C.read_events(spark, sf_dir), parts, F.col("long_distance"))


def footer_aggregates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and extremes of calls by day, of the days of a month's first half, from the footers of a table by day."""
    path = new_path(spark, "by_day")
    calls = C.read_events(spark, sf_dir).withColumn("day", F.dayofmonth("ts"))
    calls.repartition("day").write.partitionBy("day").parquet(path)
    found = S.footer_aggregates(spark, path, ("call_id", "cost", "duration"), "day", F.col("day") <= 15)
    return _rounded(found, "min_cost", "max_cost")


def bucketed_star_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Callers with their codes, from two tables in buckets by subscriber, after an update of one of them by a third."""
    root, name = new_path(spark, "buckets"), f"ringfold_{uuid.uuid4().hex}"
    calls = C.read_events(spark, sf_dir)
    before = M.wide_table(M.day_partials(calls.where(F.col("ts") < F.lit(AS_OF).cast("timestamp_ntz"))), [A.attribute("sum_call_all_week")])
    later = calls.where(F.col("ts") >= F.lit(AS_OF).cast("timestamp_ntz")).select("caller_id").distinct()
    fresh = M.wide_table(M.day_partials(calls.join(later, "caller_id", "left_semi")), [A.attribute("sum_call_all_week")])
    wide, changed, now, codes = (S.BucketedTable(f"{name}_{t}", f"{root}/{t}", 16) for t in ("wide", "changed", "now", "codes"))
    for table, rows in ((wide, before), (changed, fresh), (codes, D.customer_codes(_customer(spark, sf_dir)))):
        table.write(rows)
    wide.upserted(spark, changed, now)
    joined = now.read(spark).join(codes.read(spark), "subscriber_id")
    return D.with_dimension(joined, "value").select("subscriber_id", "value", "sum_call_all_week")


def lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the subscribers who made an expensive call."""
    keys = C.read_events(spark, sf_dir).where("cost > 200").select(F.col("caller_id").alias("subscriber_id"))
    return S.lookup(matrix(spark, sf_dir, ("sum_call_all_week", "sum_dur_all_week")), keys).select(
        "subscriber_id", "sum_call_all_week", "sum_dur_all_week"
    )


def upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table of the first half of the calls, brought up to date for those who call in the second half."""
    calls, names = C.read_events(spark, sf_dir), ("sum_call_all_week", "max_dur_all_week")
    attributes = [A.attribute(n) for n in names]
    at = F.lit(AS_OF).cast("timestamp_ntz")
    table = S.RangedTable(new_path(spark, "wide"), 200)
    table.upsert(M.wide_table(M.day_partials(calls.where(F.col("ts") < at)), attributes))
    changed = calls.where(F.col("ts") >= at).select("caller_id").distinct()
    table.upsert(M.wide_table(M.day_partials(calls.join(changed, "caller_id", "left_semi")), attributes))
    return table.read(spark).select("subscriber_id", *names)


def populate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A fresh table for the range of customer keys: rows, sums, and codes outside their dimension."""
    low, high = _customer(spark, sf_dir).agg(F.min("c_custkey"), F.max("c_custkey")).first()
    wide = S.laid_out(S.populate(spark, low, high, A.generated()), 8)
    wrong = sum((F.when(F.col(k).between(0, n - 1), 0).otherwise(1) for k, _, n in D.DIMENSIONS.values()), F.lit(0))
    return wide.select("subscriber_id", F.col("sum_dur_all_week").alias("sum_dur"), F.col("max_cost_all_day").alias("max_cost"), wrong.cast("long").alias("wrong_codes"))


def star_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = matrix(spark, sf_dir, ("sum_call_all_week",))
    for name in D.DIMENSIONS:
        wide = D.with_dimension(wide, name)
    return wide.groupBy("subscription", "city", "category", "value").agg(
        F.count("*").alias("subscribers"), F.sum("sum_call_all_week").alias("calls")
    )


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Category codes to labels and back."""
    of = dict(D.SUBSCRIBER_CATEGORY)
    coded = D.customer_codes(_customer(spark, sf_dir))
    named = coded.select("subscriber_id", decoded(F.col("category_id"), of).alias("category"))
    return named.withColumn("category_id", encoded(F.col("category"), of).cast("long"))


def cost_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = matrix(spark, sf_dir, ("sum_cost_local_week", "sum_dur_local_week"))
    ratio = guarded_ratio(F.col("sum_cost_local_week"), F.col("sum_dur_local_week"))
    return wide.select("subscriber_id", F.round(ratio, 4).alias("ratio"))


def _rules(spark: SparkSession) -> rule_tables.Rules:
    return rule_tables.from_rows(spark, RULES)


def _rule_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matrix(spark, sf_dir, sorted({p[1] for p in RULES["predicate"]}))


def rule_predicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.predicate_values(_rule_matrix(spark, sf_dir), _rules(spark))


def rule_conjuncts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.conjunct_values(rule_predicates(spark, sf_dir))


def rule_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.matches(_rule_matrix(spark, sf_dir), _rules(spark), AS_OF_MS)


def campaign_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """300 campaigns on all attributes, against every customer."""
    return R.matches(matrix(spark, sf_dir), rule_tables.from_rows(spark, MANY_RULES), AS_OF_MS)


def rule_matches_by_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same rows from rules whose predicates name attributes by their number in a catalogue."""
    rules = rule_tables.from_rows(spark, RULES_BY_ID)
    return R.matches(_rule_matrix(spark, sf_dir), rules, AS_OF_MS, compiled=0)


def described_attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each attribute of a catalogue table, in the order of its ids, adds up to over all callers."""
    tables = {
        name: spark.createDataFrame(RULES_BY_ID[name], schema)
        for name, schema in rule_tables.CATALOGUE_SCHEMAS.items() if name != "predicate"
    }
    attributes = A.load(tables["wt_attribute"].orderBy(F.desc("id")), tables["metric"])
    wide = M.wide_table(M.day_partials(C.read_events(spark, sf_dir)), attributes)
    totals = wide.agg(*(F.sum(F.col(n).cast("double")).alias(n) for n in A.names(attributes)))
    by_name = totals.unpivot([], A.names(attributes), "name", "total")
    known = A.as_table(spark, attributes)
    text = A.described(F.col("aggregate"), F.col("metric"), F.col("filter"), A.window_of(F.col("window")))
    return by_name.join(known, "name").select("attr_id", "name", text.alias("description"), F.round("total", 3).alias("total"))


def listed_campaigns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The condition of each campaign in words, and how many customers it holds for."""
    rules = _rules(spark)
    counts = R.matches(_rule_matrix(spark, sf_dir), rules).groupBy("campaign").agg(F.count("*").alias("subscribers"))
    listed = rule_tables.listing(rules).join(counts, "campaign", "left")
    return listed.select("campaign", "condition", F.coalesce("subscribers", F.lit(0)).alias("subscribers"))


def populate_now(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fresh rows for the range of customer keys are updated at the current time, all at the same."""
    low, high = _customer(spark, sf_dir).agg(F.min("c_custkey"), F.max("c_custkey")).first()
    now = F.current_timestamp()
    age = F.unix_seconds(now) - F.unix_seconds("last_updated")
    rows = S.populate(spark, low, high, A.generated())
    return rows.groupBy().agg(F.count("*").alias("n"), F.count_distinct("last_updated").alias("times"), F.max(F.abs(age) < 3600).alias("is_now"))


def moving_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Continuous and stepwise attributes of a catalogue beside a tumbling one."""
    wide = M.wide_table_of_calls(C.read_events(spark, sf_dir), [A.attribute(n) for n in MOVING])
    return wide.select("subscriber_id", *(F.round(n, 4).alias(n) if "cost" in n else F.col(n) for n in MOVING))


def _candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expensive calls as candidates of every campaign."""
    return C.read_events(spark, sf_dir).where("cost > 60").select(
        F.col("caller_id").alias("subscriber_id"), F.unix_millis(F.col("ts").cast("timestamp")).alias("at_ms"),
        F.explode(F.array(*(F.lit(c[0]) for c in RULES["campaign"]))).alias("campaign"),
    )


def rule_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates reported by their campaign's interval."""
    return R.reports(_candidates(spark, sf_dir), _rules(spark).campaign)


def streamed_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same from a stream: three deliveries, with calls up to a day late, each to a stream that starts again."""
    session = state_stream.with_state(spark)
    root = new_path(session, "reports")
    candidates = _candidates(session, sf_dir)
    arrival = F.col("at_ms") + F.pmod(F.xxhash64("subscriber_id", "at_ms"), F.lit(86_400_000))
    first, last = candidates.agg(F.min("at_ms"), F.max("at_ms") + 86_400_000).first()
    delivery = F.floor((arrival - F.lit(first)) * 3 / F.lit((last or 0) + 1 - (first or 0)))
    heartbeat = session.createDataFrame([(None, 4_102_444_800_000, -1)], candidates.schema)
    for k in range(3):
        rows = candidates.where(delivery == k)
        (rows if k < 2 else rows.unionByName(heartbeat)).write.parquet(f"{root}/arrived/{k}")
        arrived = session.readStream.schema(candidates.schema).parquet(f"{root}/arrived/*")
        report_stream.report(arrived, _rules(session).campaign, root).awaitTermination()
    return spark.read.schema(candidates.schema).parquet(f"{root}/reports").select("subscriber_id", "campaign", "at_ms")


def streamed_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The wide table from state per subscriber."""
    session = state_stream.with_state(spark)
    table = S.RangedTable(new_path(spark, "state"), 1000)
    state_stream.keep_wide(C.stream_events(session, sf_dir), A.generated(), table).awaitTermination()
    return _shown(table.read(spark))


_CALLS_OF = {"all": "true", "local": "NOT long_distance", "nonlocal": "long_distance"}
RATES = tuple(A.DerivedAttribute(a, "rate", f, "week") for a in ("min", "max") for f in A.FILTERS)


def evolving_catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attributes of a metric, cost by duration, that the catalogue gains between two deliveries to a stream."""
    root = new_path(spark, "evolving")
    partials = EvolvingPartials(root)
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select(*C.EVENT.names)
    for k in range(2):
        events.where((F.col("ts") >= F.lit(AS_OF).cast("timestamp_ntz")) == bool(k)).write.parquet(f"{root}/arrived/events{k}.parquet")
        partials.keep_up(spark, f"{root}/arrived", files_per_batch=1000).awaitTermination()
        partials.add_metric(spark, "rate", "cost / duration")
    partials.backfill(spark)
    found = M.wide_table(partials.read(spark), [*RATES, A.attribute("sum_call_all_week")])
    return found.select("subscriber_id", "sum_call_all_week", *(F.round(a.name, 6).alias(a.name) for a in RATES))


def streamed_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Campaigns that hold for callers, by a stream of two deliveries of calls that evaluates only who calls."""
    root = new_path(spark, "holding")
    held = HoldingCampaigns(rule_tables.from_rows(spark, MANY_RULES), A.generated(), root, 200)
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select(*C.EVENT.names)
    for k in range(2):
        events.where((F.col("ts") >= F.lit(AS_OF).cast("timestamp_ntz")) == bool(k)).write.parquet(f"{root}/arrived/events{k}.parquet")
        held.keep_up(C.stream_events(spark, f"{root}/arrived", files_per_batch=1000)).awaitTermination()
    return held.matches(spark, AS_OF_MS)


def streamed_wide_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The wide table from partials that a stream over the event files has written."""
    root = new_path(spark, "stream")
    stream.keep_up(C.stream_events(spark, sf_dir), root).awaitTermination()
    return _shown(M.wide_table(stream.snapshot(spark, root), A.generated()))


def closed_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days that the watermark has closed, as an append-mode stream emits them."""
    root = new_path(spark, "closed")
    query = (
        stream.closed_windows(C.stream_events(spark, sf_dir))
        .writeStream.outputMode("append")
        .option("checkpointLocation", f"{root}/progress")
        .trigger(availableNow=True)
        .format("parquet")
        .start(f"{root}/rows")
    )
    query.awaitTermination()
    return _rounded(spark.read.parquet(f"{root}/rows"), "max_cost")


def _windows_sql(source: str) -> str:
    return (
        "SELECT caller_id AS subscriber_id, CAST(window_start AS VARCHAR) AS window_start, count(*) AS calls, CAST(sum(duration) AS BIGINT) AS sum_dur, "
        f"max(duration) AS max_dur, round(sum(cost), 4) AS sum_cost, round(min(cost), 4) AS min_cost FROM {source} GROUP BY 1, 2"
    )


def rules_sql(tables: dict[str, list[tuple]]) -> str:
    conjuncts, predicates = dict(tables["conjunct"]), {p[0]: p for p in tables["predicate"]}
    constants = {k[0]: k[1] for k in tables["constant"]}
    rows = ", ".join(
        f"({conjuncts[c]}, {c}, {p}, '{predicates[p][1]}', '{predicates[p][2]}', {constants[predicates[p][3]]}.0)"
        for p, c in tables["conjunct_predicate"]
    )
    used = sorted({p[1] for p in tables["predicate"]})
    values = " ".join(f"WHEN '{n}' THEN CAST(m.{n} AS DOUBLE)" for n in used)
    return f"""{matrix_sql(used)},
flat(campaign, conjunct, predicate, attribute, op, v) AS (VALUES {rows}),
pv AS (SELECT subscriber_id, campaign, conjunct, predicate, op, v, CASE attribute {values} END AS x FROM m, flat),
ph AS (SELECT subscriber_id, campaign, conjunct, predicate, coalesce(CASE op WHEN 'lt' THEN x < v WHEN 'lte' THEN x <= v
       WHEN 'gr' THEN x > v WHEN 'gre' THEN x >= v WHEN 'eq' THEN x = v END, false) AS holds FROM pv),
ch AS (SELECT subscriber_id, campaign, conjunct, bool_and(holds) AS holds FROM ph GROUP BY ALL)
"""


def campaigns_sql(tables: dict[str, list[tuple]]) -> str:
    return ", ".join(f"({c[0]}, {c[1]}, {c[2]}, {R.INTERVALS[c[3]] * 86_400_000}, '{c[4]}')" for c in tables["campaign"])


def matches_sql(tables: dict[str, list[tuple]]) -> str:
    return (
        rules_sql(tables)
        + f", k(campaign, vf, vt, len, start) AS (VALUES {campaigns_sql(tables)}) SELECT subscriber_id, ch.campaign FROM ch JOIN k "
        f"ON k.campaign = ch.campaign WHERE vf <= {AS_OF_MS} AND vt > {AS_OF_MS} GROUP BY 1, 2 HAVING bool_or(holds)"
    )


RULES_SQL = rules_sql(RULES)
REPORTS_SQL = f"""WITH RECURSIVE {CALLS_SQL},
k(campaign, vf, vt, len, start) AS (VALUES {campaigns_sql(RULES)}),
c AS (SELECT DISTINCT caller_id AS subscriber_id, campaign, epoch_us(ts) // 1000 AS at_ms, vf, len, start
      FROM calls, k WHERE cost > 60 AND epoch_us(ts) // 1000 >= vf AND epoch_us(ts) // 1000 < vt),
s AS (SELECT subscriber_id, campaign, min(at_ms) AS at_ms FROM c WHERE len > 0 AND start = 'sliding' GROUP BY 1, 2
      UNION ALL
      SELECT s.subscriber_id, s.campaign, min(c.at_ms) FROM s JOIN c ON c.subscriber_id = s.subscriber_id
      AND c.campaign = s.campaign AND c.at_ms >= s.at_ms + c.len GROUP BY 1, 2)
SELECT subscriber_id, campaign, at_ms FROM c WHERE len = 0
UNION ALL SELECT subscriber_id, campaign, min(at_ms) FROM c WHERE len > 0 AND start = 'fixed'
          GROUP BY subscriber_id, campaign, (at_ms - vf) // len
UNION ALL SELECT * FROM s
"""

for _f, _sql in (
    (call_events, f"WITH {CALLS_SQL} SELECT call_id, caller_id, cost, duration, long_distance FROM calls"),
    (wide_table, f"WITH {wide_sql(ALL)} {_wide_rows_sql} wide"),
    (
        wide_table_as_of,
        f"WITH {CALLS_SQL} {_wide_rows_sql} (SELECT caller_id AS subscriber_id, max(ts) AS last_updated, "
        + ", ".join(_sql_attribute(n, f"date_trunc('day', TIMESTAMP '{AS_OF}')", f"date_trunc('week', TIMESTAMP '{AS_OF}')") for n in ALL)
        + f" FROM calls WHERE ts <= TIMESTAMP '{AS_OF}' GROUP BY caller_id)",
    ),
    (all_subscribers, f"{matrix_sql(ALL)} {_wide_rows_sql} m"),
    (
        sentinels,
        matrix_sql(("min_dur_local_week", "max_dur_local_week"))
        + "SELECT subscriber_id, CAST(coalesce(min_dur_local_week, 2147483647) AS BIGINT) AS min_dur_local_week, "
        "CAST(coalesce(max_dur_local_week, -2147483648) AS BIGINT) AS max_dur_local_week FROM m",
    ),
    (window_day, f"WITH {CALLS_SQL} " + _windows_sql("(SELECT *, CAST(ts AS DATE) AS window_start FROM calls)")),
    (window_week, f"WITH {CALLS_SQL} " + _windows_sql("(SELECT *, CAST(date_trunc('week', ts) AS DATE) AS window_start FROM calls)")),
    (
        window_stepwise,
        f"WITH {CALLS_SQL} "
        + _windows_sql(
            "(SELECT c.*, CAST(w AS DATE) AS window_start FROM calls c, generate_series(TIMESTAMP '2023-11-20' + INTERVAL 1 DAY "
            "* (date_diff('day', DATE '2023-11-20', DATE '1970-01-05') % 2), TIMESTAMP '2024-12-31', INTERVAL 2 DAY) g(w) "
            "WHERE ts >= w AND ts < w + INTERVAL 7 DAY)"
        ),
    ),
    (
        window_continuous,
        f"WITH {CALLS_SQL} SELECT a.call_id, a.caller_id AS subscriber_id, count(*) AS calls, CAST(sum(b.duration) AS BIGINT) AS sum_dur, "
        "max(b.duration) AS max_dur, round(sum(b.cost), 4) AS sum_cost FROM calls a JOIN calls b ON a.caller_id = b.caller_id "
        "AND b.ts > a.ts - INTERVAL 7 DAY AND b.ts <= a.ts GROUP BY 1, 2",
    ),
    (scan, f"WITH {CALLS_SQL} SELECT call_id, caller_id, cost FROM calls WHERE cost > 50 AND ts >= TIMESTAMP '2024-01-10'"),
    (scan_aggregate, f"WITH {CALLS_SQL} SELECT count(*) AS n, round(sum(cost), 4) AS cost, max(duration) AS longest FROM calls WHERE long_distance"),
    (
        footer_aggregates,
        f"WITH {CALLS_SQL} SELECT CAST(day(ts) AS INTEGER) AS day, count(*) AS n, min(call_id) AS min_call_id, max(call_id) AS max_call_id, "
        "round(min(cost), 4) AS min_cost, round(max(cost), 4) AS max_cost, min(duration) AS min_duration, max(duration) AS max_duration "
        "FROM calls WHERE day(ts) <= 15 GROUP BY 1",
    ),
    (
        bucketed_star_join,
        matrix_sql(("sum_call_all_week",))
        + "SELECT subscriber_id, value, sum_call_all_week FROM m JOIN val USING (value_id) WHERE last_updated IS NOT NULL",
    ),
    (
        lookup,
        matrix_sql(("sum_call_all_week", "sum_dur_all_week"))
        + "SELECT subscriber_id, sum_call_all_week, sum_dur_all_week FROM m WHERE subscriber_id IN (SELECT caller_id FROM calls WHERE cost > 200)",
    ),
    (
        upsert,
        f"WITH {wide_sql(('sum_call_all_week', 'max_dur_all_week'))} SELECT subscriber_id, sum_call_all_week, max_dur_all_week FROM wide",
    ),
    (
        populate,
        "SELECT CAST(i AS BIGINT) AS subscriber_id, CAST(0 AS BIGINT) AS sum_dur, CAST(NULL AS DOUBLE) AS max_cost, CAST(0 AS BIGINT) AS wrong_codes "
        "FROM (SELECT unnest(generate_series(min(c_custkey), max(c_custkey))) AS i FROM customer)",
    ),
    (
        star_join,
        matrix_sql(("sum_call_all_week",))
        + "SELECT subscription, city, category, value, count(*) AS subscribers, CAST(sum(sum_call_all_week) AS BIGINT) AS calls "
        "FROM m JOIN region_info USING (region_id) JOIN subscription USING (subscription_id) JOIN category USING (category_id) "
        "JOIN val USING (value_id) GROUP BY ALL",
    ),
    (
        labels,
        "SELECT c_custkey AS subscriber_id, CASE (c_custkey // 4) % 3 WHEN 0 THEN 'business' WHEN 1 THEN 'private' ELSE 'company' END AS category, "
        "(c_custkey // 4) % 3 AS category_id FROM customer",
    ),
    (
        cost_ratio,
        matrix_sql(("sum_cost_local_week", "sum_dur_local_week"))
        + "SELECT subscriber_id, CASE WHEN sum_dur_local_week <> 0 THEN round(sum_cost_local_week / sum_dur_local_week, 4) END AS ratio FROM m",
    ),
    (rule_predicates, RULES_SQL + "SELECT * FROM ph"),
    (rule_conjuncts, RULES_SQL + "SELECT * FROM ch"),
    (rule_matches, matches_sql(RULES)),
    (campaign_index, matches_sql(MANY_RULES)),
    (streamed_matches, f"SELECT * FROM ({matches_sql(MANY_RULES)}) WHERE subscriber_id IN (SELECT user_id FROM events)"),
    (rule_matches_by_id, matches_sql(RULES)),
    (
        moving_windows,
        f"WITH {CALLS_SQL} SELECT caller_id AS subscriber_id, count(*) FILTER (ts > l - INTERVAL 7 DAY) AS sum_call_all_week_cont, "
        "round(max(cost) FILTER (ts > l - INTERVAL 1 DAY AND NOT long_distance), 4) AS max_cost_local_day_cont, "
        "CAST(coalesce(sum(duration) FILTER (CAST(ts AS DATE) > CAST(l AS DATE) - 7), 0) AS BIGINT) AS sum_dur_all_week_step, "
        "min(duration) FILTER (CAST(ts AS DATE) > CAST(l AS DATE) - 7 AND long_distance) AS min_dur_nonlocal_week_step, "
        "CAST(coalesce(sum(duration) FILTER (date_trunc('week', ts) = date_trunc('week', l)), 0) AS BIGINT) AS sum_dur_all_week "
        "FROM (SELECT *, max(ts) OVER (PARTITION BY caller_id) AS l FROM calls) GROUP BY 1",
    ),
    (
        evolving_catalogue,
        f"WITH {CALLS_SQL} SELECT caller_id AS subscriber_id, count(*) AS sum_call_all_week, "
        + ", ".join(
            f"round({a.aggregate}(cost / duration) FILTER (WHERE {_CALLS_OF[a.filter]}), 6) AS {a.name}"
            for a in RATES
        )
        + " FROM (SELECT *, max(ts) OVER (PARTITION BY caller_id) AS l FROM calls) WHERE date_trunc('week', ts) = date_trunc('week', l) GROUP BY 1",
    ),
    (
        described_attributes,
        f"WITH {wide_sql(ALL)}, t(attr_id, name, description, total) AS ("
        + " UNION ALL ".join(
            f"SELECT CAST({i} AS INTEGER), '{a.name}', '{a.aggregate}({a.metric if a.filter == 'all' else f'{a.filter} {a.metric}'}) per {a.window}', "
            f"round(sum(CAST({a.name} AS DOUBLE)), 3) FROM wide"
            for i, a in enumerate(A.generated())
        )
        + ") SELECT * FROM t",
    ),
    (
        listed_campaigns,
        RULES_SQL
        + ", shown AS (SELECT campaign, conjunct, '(' || string_agg(attribute || ' ' || op || ' ' || CAST(CAST(v AS INTEGER) AS VARCHAR), ' AND ' ORDER BY predicate) || ')' AS text "
        "FROM flat GROUP BY 1, 2), held AS (SELECT campaign, count(*) AS n FROM (SELECT DISTINCT subscriber_id, campaign FROM ch WHERE holds) GROUP BY 1) "
        "SELECT campaign, string_agg(text, ' OR ' ORDER BY conjunct) AS condition, coalesce(any_value(n), 0) AS subscribers "
        "FROM shown LEFT JOIN held USING (campaign) GROUP BY 1",
    ),
    (populate_now, "SELECT max(c_custkey) - min(c_custkey) + 1 AS n, CAST(1 AS BIGINT) AS times, true AS is_now FROM customer"),
    (rule_reports, REPORTS_SQL),
    (streamed_reports, REPORTS_SQL),
    (streamed_state, f"WITH {wide_sql(ALL)} {_wide_rows_sql} wide"),
    (streamed_wide_table, f"WITH {wide_sql(ALL)} {_wide_rows_sql} wide"),
    (
        closed_days,
        f"WITH {CALLS_SQL} SELECT caller_id AS subscriber_id, CAST(CAST(ts AS DATE) AS VARCHAR) AS window_start, count(*) AS calls, "
        "CAST(sum(duration) AS BIGINT) AS sum_dur, round(max(cost), 4) AS max_cost FROM calls "
        "WHERE CAST(ts AS DATE) + INTERVAL 1 DAY <= (SELECT max(ts) FROM calls) - INTERVAL 1 DAY GROUP BY 1, 2",
    ),
):
    _register(_f.__name__, _f, _sql)


def queries() -> dict[str, Query]:
    return {name: query for name, (query, _) in _found.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in _found.items() if sql}

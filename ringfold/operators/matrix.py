"""The wide table of running aggregates per subscriber, by way of mergeable day partials.

A partial holds what one subscriber's local or long-distance calls of one day add up to. All its
parts are sums, minima, maxima or counts, so partials of any split of the calls, in any order and
however late, merge to the same result. Weeks are whole days, so every attribute follows from them.

"This day" and "this week" are those of a subscriber's last call, or of a given time.
"""

from __future__ import annotations

import datetime
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.time import WINDOWS, day_index, index_of
from ..sources.catalogue import Attribute

KEYS = ("caller_id", "day", "long_distance")
_MERGES = {"calls": F.sum, "sum": F.sum, "min": F.min, "max": F.max, "last": F.max}  # by the first word of a name


def day_partials(calls: DataFrame, metrics: Mapping[str, Column] | None = None, by: Sequence[str] = ()) -> DataFrame:
    """Calls (caller_id, ts, duration, cost, long_distance) as partials; one shuffle, summed before it.

    metrics are further values of a call, by name; by names columns that partials are kept apart by.
    """
    values = {"dur": F.col("duration"), "cost": F.col("cost")} | dict(metrics or {})
    return (
        calls.where("caller_id is not null and ts is not null")
        .withColumn("day", day_index(F.col("ts")))
        .groupBy(*KEYS, *by)
        .agg(
            F.count("*").alias("calls"),
            *(f(v).alias(f"{f.__name__}_{m}") for m, v in values.items() for f in (F.sum, F.min, F.max)),
            F.max("ts").alias("last_ts"),
        )
    )


def merged(partials: DataFrame) -> DataFrame:
    """Partials of the same subscriber, day and kind of call as one."""
    parts = (c for c in partials.columns if c not in KEYS)
    return partials.groupBy(*KEYS).agg(*(_MERGES[c.split("_")[0]](c).alias(c) for c in parts))


def _matching(attribute: Attribute) -> Column:
    if attribute.filter == "all":
        return F.lit(True)
    return F.col("long_distance") == F.lit(attribute.filter == "nonlocal")


def _inside(attribute: Attribute, day: Column, last_day: Column) -> Column:
    """Whether a day is in an attribute's window, if that is the one of last_day.

    A stepwise week moves by days: it is the seven days up to last_day.
    """
    if attribute.kind == "tumb":
        return index_of(day, attribute.window) == index_of(last_day, attribute.window)
    if attribute.kind == "step" and attribute.window == "week":
        return day > last_day - 7
    raise ValueError(f"{attribute.name}: day partials do not tell what is in its window; see wide_table_of_calls")


def aggregate_of(attribute: Attribute, inside: Column) -> Column:
    """An attribute from partials, of those that are inside its window."""
    part = "calls" if attribute.metric == "call" else f"{attribute.aggregate}_{attribute.metric}"
    value = F.when(inside & _matching(attribute), F.col(part))
    if attribute.aggregate == "sum":
        return F.coalesce(F.sum(value), F.lit(0)).alias(attribute.name)
    return (F.min if attribute.aggregate == "min" else F.max)(value).alias(attribute.name)


def wide_table(partials: DataFrame, attributes: Sequence[Attribute]) -> DataFrame:
    """(subscriber_id, last_updated, attributes): the windows are those of each subscriber's last call.

    The last day is found over the same key that the aggregate groups by, so partials move once.
    """
    last = F.max("day").over(Window.partitionBy("caller_id"))
    rows = partials.withColumn("last_day", last)
    inside = {a: _inside(a, F.col("day"), F.col("last_day")) for a in attributes}
    return rows.groupBy(F.col("caller_id").alias("subscriber_id")).agg(
        F.max("last_ts").alias("last_updated"), *(aggregate_of(a, inside[a]) for a in attributes)
    )


def wide_table_of_calls(calls: DataFrame, attributes: Sequence[Attribute]) -> DataFrame:
    """wide_table with continuous attributes, too: their day or week ends at the subscriber's last call.

    Those depend on each call's time, so calls are joined with the last one's; all others, and the time of the last,
    come from partials.
    """
    moving = [a for a in attributes if a.kind == "cont"]
    partials = day_partials(calls)
    rest = wide_table(partials, [a for a in attributes if a.kind != "cont"])
    if not moving:
        return rest
    known = calls.where("caller_id is not null and ts is not null")
    last = partials.groupBy("caller_id").agg(F.max("last_ts").alias("last"))
    rows = known.join(last, "caller_id").withColumn("calls", F.lit(1))
    parts = {"call": "calls", "dur": "duration", "cost": "cost"}
    values = []
    for a in moving:
        inside = F.col("ts") > F.col("last") - F.expr(f"INTERVAL {WINDOWS[a.window]} DAY")
        value = F.when(inside & _matching(a), F.col(parts[a.metric]))
        total = {"sum": F.coalesce(F.sum(value), F.lit(0)), "min": F.min(value), "max": F.max(value)}[a.aggregate]
        values.append(total.alias(a.name))
    found = rest.join(rows.groupBy(F.col("caller_id").alias("subscriber_id")).agg(*values), "subscriber_id")
    return found.select("subscriber_id", "last_updated", *(a.name for a in attributes))


def wide_table_as_of(calls: DataFrame, attributes: Sequence[Attribute], as_of: str) -> DataFrame:
    """The same at a given time: later calls do not count, and the windows are those that hold it."""
    at = F.lit(as_of).cast("timestamp_ntz")
    day = (datetime.datetime.fromisoformat(as_of).date() - datetime.date(1970, 1, 5)).days
    partials = day_partials(calls.where(F.col("ts") <= at))
    inside = {a: _inside(a, F.col("day"), F.lit(day)) for a in attributes}
    return partials.groupBy(F.col("caller_id").alias("subscriber_id")).agg(
        F.max("last_ts").alias("last_updated"), *(aggregate_of(a, inside[a]) for a in attributes)
    )


def for_subscribers(wide: DataFrame, subscribers: DataFrame) -> DataFrame:
    """All subscribers with their codes; those without calls have sums of 0 and null minima and maxima."""
    sums = {c: 0 for c in wide.columns if c.startswith("sum_")}
    return subscribers.join(wide, "subscriber_id", "left").fillna(sums)


def with_sentinels(wide: DataFrame, least: float = -(2.0**31), most: float = 2.0**31 - 1) -> DataFrame:
    """For readers that know no nulls: a maximum of nothing is least, a minimum of nothing is most."""
    return wide.fillna({c: least for c in wide.columns if c.startswith("max_")}).fillna(
        {c: most for c in wide.columns if c.startswith("min_")}
    )

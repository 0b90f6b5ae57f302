"""Attributes over windows other than the current day and week."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.time import day_index, index_of, start_of

_DAY = 86_400


def _totals() -> list[Column]:
    return [
        F.count("*").alias("calls"),
        F.sum("duration").alias("sum_dur"),
        F.max("duration").alias("max_dur"),
        F.sum("cost").alias("sum_cost"),
        F.min("cost").alias("min_cost"),
    ]


def tumbling(calls: DataFrame, window: str) -> DataFrame:
    """Totals of each subscriber in each day or week."""
    index = index_of(day_index(F.col("ts")), window)
    return (
        calls.groupBy(F.col("caller_id").alias("subscriber_id"), start_of(index, window).alias("window_start"))
        .agg(*_totals())
    )


def stepwise(calls: DataFrame, days: int, step: int) -> DataFrame:
    """Totals in hopping windows of some days that begin every step days from Monday 1970-01-05.

    Calls are first summed by day, so each day, not each call, is copied into its windows.
    """
    day = day_index(F.col("ts"))
    daily = calls.groupBy("caller_id", day.alias("day")).agg(*_totals())
    first = F.floor((F.col("day") - days) / step) + 1
    starts = F.sequence(first.cast("int"), F.floor(F.col("day") / step).cast("int"))
    return (
        daily.withColumn("k", F.explode(starts))
        .groupBy(F.col("caller_id").alias("subscriber_id"), start_of(F.col("k") * step, "day").alias("window_start"))
        .agg(
            F.sum("calls").alias("calls"), F.sum("sum_dur").alias("sum_dur"), F.max("max_dur").alias("max_dur"),
            F.sum("sum_cost").alias("sum_cost"), F.min("min_cost").alias("min_cost"),
        )
    )


def _sum(*parts: Column) -> Column:
    """The sum of those that are not null; null if all are."""
    return F.when(F.coalesce(*parts).isNotNull(), sum((F.coalesce(p, F.lit(0)) for p in parts[1:]), F.coalesce(parts[0], F.lit(0))))


def continuous(calls: DataFrame, days: int, chunk_hours: int = 6) -> DataFrame:
    """At each call, totals of the subscriber's calls in the days up to and with it.

    Time is cut into chunks, a whole number of which make up the window. What a call's window holds is the part of
    its own chunk up to it, whole chunks before that, and the part of the chunk a window ago that is not yet
    over. So rows meet by subscriber and chunk, never by subscriber alone: each call once where it
    begins to count and once where it ends, and sums, minima and maxima grow from either side. Only one row a chunk
    meets by subscriber. Calls without a subscriber or a time are left out.
    """
    width, chunk = days * _DAY * 1_000_000, chunk_hours * 3_600_000_000
    if width % chunk or width == chunk:
        raise ValueError(f"{days} days are not two or more chunks of {chunk_hours} hours")
    known = calls.where("caller_id is not null and ts is not null").select(
        "call_id", F.col("caller_id").alias("subscriber_id"), "duration", "cost", F.unix_micros(F.col("ts").cast("timestamp")).alias("at")
    )
    chunk_of = lambda at: F.floor(at / chunk).cast("long")
    totals = (
        known.groupBy("subscriber_id", chunk_of(F.col("at")).alias("chunk"))
        .agg(F.count("*").alias("n"), F.sum("duration").alias("dur"), F.max("duration").alias("most"), F.sum("cost").alias("cost"))
    )
    between = Window.partitionBy("subscriber_id").orderBy("chunk").rangeBetween(1 - width // chunk, -1)
    whole = totals.select(
        "subscriber_id", "chunk", F.sum("n").over(between).alias("n_whole"), F.sum("dur").over(between).alias("dur_whole"),
        F.max("most").over(between).alias("most_whole"), F.sum("cost").over(between).alias("cost_whole"),
    )
    ends = F.array(F.struct(F.lit(True).alias("begins"), F.col("at").alias("mark")), F.struct(F.lit(False).alias("begins"), (F.col("at") + width).alias("mark")))
    marks = known.select("*", F.inline(ends)).withColumn("chunk", chunk_of(F.col("mark")))
    within = Window.partitionBy("subscriber_id", "chunk")
    upto = within.orderBy("mark").rangeBetween(Window.unboundedPreceding, 0)
    after = within.orderBy(F.desc("mark")).rangeBetween(Window.unboundedPreceding, -1)

    def both(aggregate, value: Column, name: str) -> list[Column]:
        return [
            aggregate(F.when(F.col("begins"), value)).over(upto).alias(f"{name}_upto"),
            aggregate(F.when(~F.col("begins"), value)).over(after).alias(f"{name}_after"),
        ]

    parts = marks.select(
        "call_id", "subscriber_id", "chunk", "begins", *both(F.count, F.lit(1), "n"), *both(F.sum, F.col("duration"), "dur"),
        *both(F.max, F.col("duration"), "most"), *both(F.sum, F.col("cost"), "cost"),
    )
    found = parts.where("begins").join(whole, ["subscriber_id", "chunk"])
    of = lambda name: [F.col(f"{name}_{part}") for part in ("upto", "whole", "after")]
    return found.select(
        "call_id", "subscriber_id", _sum(*of("n")).alias("calls"), _sum(*of("dur")).alias("sum_dur"),
        F.greatest(*of("most")).alias("max_dur"), _sum(*of("cost")).alias("sum_cost"),
    )

"""The seven analytical queries over a wide table of subscribers with their dimension keys.

Each needs only the attributes in NEEDS, so wide tables are built with those. Conditions on
dimensions come after broadcast joins with the dimension tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.values import guarded_ratio
from ..sources.dimensions import with_dimension

NEEDS = {
    "q1": ("sum_call_local_week", "sum_dur_all_week"),
    "q2": ("sum_call_all_week", "max_cost_all_week"),
    "q3": ("sum_call_all_week", "sum_cost_all_week", "sum_dur_all_week"),
    "q4": ("sum_call_local_week", "sum_dur_local_week"),
    "q5": ("sum_cost_local_week", "sum_cost_nonlocal_week"),
    "q6": ("max_dur_local_day", "max_dur_local_week", "max_dur_nonlocal_day", "max_dur_nonlocal_week"),
    "q7": (
        "sum_call_all_day", "sum_call_all_week", "sum_dur_all_day", "sum_dur_all_week", "sum_cost_all_day", "sum_cost_all_week",
    ),
}


def q1(wide: DataFrame, alpha: int) -> DataFrame:
    """The mean weekly duration of those with more than alpha local calls; 0 if there are none."""
    return wide.where(F.col("sum_call_local_week") > alpha).agg(
        F.coalesce(F.avg("sum_dur_all_week"), F.lit(0.0)).alias("avg_dur")
    )


def q2(wide: DataFrame, alpha: int) -> DataFrame:
    """The most expensive call of those with more than alpha calls; null if there are none."""
    return wide.where(F.col("sum_call_all_week") > alpha).agg(F.max("max_cost_all_week").alias("max_cost"))


def q3(wide: DataFrame) -> DataFrame:
    """Cost per duration by number of calls; groups without duration are left out."""
    return (
        wide.groupBy(F.col("sum_call_all_week").alias("calls"))
        .agg(F.sum("sum_cost_all_week").alias("cost"), F.sum("sum_dur_all_week").alias("dur"))
        .where("dur > 0")
        .select("calls", (F.col("cost") / F.col("dur")).alias("cost_ratio"))
    )


def q4(wide: DataFrame, alpha: int, beta: int) -> DataFrame:
    """By city the mean number and total duration of local calls, of those above alpha calls and beta in all."""
    return (
        with_dimension(wide, "region")
        .where((F.col("sum_call_local_week") > alpha) & (F.col("sum_dur_local_week") > beta))
        .groupBy("city")
        .agg(F.avg("sum_call_local_week").alias("avg_calls"), F.sum("sum_dur_local_week").alias("sum_dur"))
    )


def q5(wide: DataFrame, subscription: str, category: str) -> DataFrame:
    """By region the cost of local and of long-distance calls of one kind of subscriber."""
    joined = with_dimension(with_dimension(with_dimension(wide, "subscription"), "category"), "region")
    return (
        joined.where((F.col("subscription") == subscription) & (F.col("category") == category))
        .groupBy("region")
        .agg(F.sum("sum_cost_local_week").alias("local_cost"), F.sum("sum_cost_nonlocal_week").alias("long_cost"))
    )


def q6(wide: DataFrame, country: str) -> DataFrame:
    """The longest calls of a country this day and week, and whose they are; the lowest id on ties."""
    best = [F.max(F.struct(F.col(c), -F.col("subscriber_id"))).alias(c) for c in NEEDS["q6"]]
    found = with_dimension(wide, "region").where(F.col("country") == country).agg(*best)
    columns = []
    for c in NEEDS["q6"]:
        longest = F.col(c)[c]
        columns += [
            longest.alias(c),
            F.when(longest.isNotNull(), -F.col(c)["col2"]).alias(c.replace("max_dur", "id")),
        ]
    return found.select(*columns)


def q7(wide: DataFrame, value: str, window: str) -> DataFrame:
    """The subscriber of a value type who pays least per duration; no row if nobody has called."""
    ratio = guarded_ratio(F.col(f"sum_cost_all_{window}"), F.col(f"sum_dur_all_{window}"))
    best = (
        with_dimension(wide, "value")
        .where((F.col("value") == value) & (F.col(f"sum_call_all_{window}") != 0))
        .withColumn("ratio", ratio)
        .where("ratio is not null")
        .agg(F.min(F.struct("ratio", "subscriber_id")).alias("best"))
    )
    return best.where("best is not null").select("best.subscriber_id", "best.ratio")

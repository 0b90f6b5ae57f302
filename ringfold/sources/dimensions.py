"""The four dimension tables, and the codes that subscribers carry.

Each has a handful of rows, fixed here, so joins with them are broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed values: (key, ...) rows of the tables.
SUBSCRIPTION_TYPE = (
    (0, "prepaid", "0", "0", "0"),
    (1, "contract", "10", "120", "10"),
    (2, "contract", "20", "720", "50"),
    (3, "contract", "50", "unlimited", "unlimited"),
)
REGION_INFO = (
    (0, "CH-1000", "Lausanne", "Vaud", "Switzerland", "EUROPE"),
    (1, "CH-8000", "Zurich", "Zurich", "Switzerland", "EUROPE"),
    (2, "DE-80801", "Munich", "Bayern", "Germany", "EUROPE"),
    (3, "ARG-B6500", "Buenos Aires", "Buenos Aires", "Argentina", "SOUTH AMERICA"),
    (4, "CHI-100000", "Beijing", "Beijing", "China", "ASIA"),
    (5, "CHI-101500", "Beijing", "Beijing", "China", "ASIA"),
)
SUBSCRIBER_CATEGORY = ((0, "business"), (1, "private"), (2, "company"))
SUBSCRIBER_VALUE = ((0, "none", 0), (1, "silver", 30), (2, "gold", 80), (3, "platinum", 150))


def subscription_type(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(
        SUBSCRIPTION_TYPE, "subscription_id short, subscription string, plan_cost string, free_call_mins string, data string"
    )


def region_info(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(
        REGION_INFO, "region_id short, zip string, city string, state string, country string, region string"
    )


def subscriber_category(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(SUBSCRIBER_CATEGORY, "category_id short, category string")


def subscriber_value(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(SUBSCRIBER_VALUE, "value_id short, value string, threshold int")


#: Per dimension: its key, its table and how many rows that has.
DIMENSIONS = {
    "subscription": ("subscription_id", subscription_type, len(SUBSCRIPTION_TYPE)),
    "region": ("region_id", region_info, len(REGION_INFO)),
    "category": ("category_id", subscriber_category, len(SUBSCRIBER_CATEGORY)),
    "value": ("value_id", subscriber_value, len(SUBSCRIBER_VALUE)),
}


def with_dimension(wide: DataFrame, name: str) -> DataFrame:
    """wide joined with one of DIMENSIONS on its key."""
    key, table, _ = DIMENSIONS[name]
    return wide.join(F.broadcast(table(wide.sparkSession)), key)


def drawn_codes(subscriber_id: Column, seed: int = 1) -> dict[str, Column]:
    """A row of each dimension for each subscriber, by a seeded hash of the id."""
    return {
        key: F.pmod(F.xxhash64(subscriber_id, F.lit(seed), F.lit(key)), F.lit(n)).cast("short")
        for key, _, n in DIMENSIONS.values()
    }


def customer_codes(customer: DataFrame) -> DataFrame:
    """The given customers as subscribers: codes by fixed arithmetic on their keys."""
    k = F.col("c_custkey")
    return customer.select(
        k.alias("subscriber_id"),
        (k % 4).cast("short").alias("subscription_id"),
        (F.floor(k / 7) % 6).cast("short").alias("region_id"),
        (F.floor(k / 4) % 3).cast("short").alias("category_id"),
        (F.floor(k / 12) % 4).cast("short").alias("value_id"),
    )

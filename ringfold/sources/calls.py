"""Call records: the schema, the given events as calls, generated calls, and streams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

CALL = (
    T.StructType()
    .add("call_id", T.LongType())
    .add("caller_id", T.LongType())
    .add("callee_id", T.LongType())
    .add("cost", T.DoubleType())
    .add("caller_place", T.LongType())
    .add("callee_place", T.LongType())
    .add("ts", T.TimestampType())
    .add("duration", T.IntegerType())
    .add("long_distance", T.BooleanType())
)

EVENT = (
    T.StructType()
    .add("event_id", T.LongType())
    .add("ts", T.TimestampNTZType())
    .add("user_id", T.LongType())
    .add("event_type", T.StringType())
    .add("value", T.DoubleType())
    .add("props", T.StringType())
)


def from_events(events: DataFrame, *more: str) -> DataFrame:
    """Events as calls: the user calls; purchases and errors are long-distance. more: columns to keep beside."""
    return events.select(
        F.col("event_id").alias("call_id"),
        F.col("user_id").alias("caller_id"),
        F.col("value").alias("cost"),
        "ts",
        (F.get_json_object("props", "$.k").cast("int") + 1).alias("duration"),
        F.col("event_type").isin("purchase", "error").alias("long_distance"),
        *more,
    )


def read_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return from_events(spark.read.parquet(f"{sf_dir}/events.parquet"))


def stream_events(spark: SparkSession, folder: str, files_per_batch: int = 1, pattern: str = "events*.parquet") -> DataFrame:
    """The event files of a folder as a stream of calls, a few files to each micro-batch.

    A table that is a folder of part files matches the pattern as a single file does.
    """
    events = (
        spark.readStream.schema(EVENT)
        .option("maxFilesPerTrigger", files_per_batch)
        .parquet(f"{folder}/{pattern}")
    )
    return from_events(events)


def _uniform(key: Column, seed: int, salt: str) -> Column:
    """From 0 up to 1, a fixed function of key, seed and salt."""
    return F.pmod(F.xxhash64(key, F.lit(seed), F.lit(salt)), F.lit(1 << 40)) / F.lit(float(1 << 40))


def generate(spark: SparkSession, n: int, subscribers: int, seed: int = 1, start: str = "2024-01-01") -> DataFrame:
    """n reproducible calls of subscribers 1 to subscribers, a second apart."""
    key = F.col("id")

    def someone(salt: str) -> Column:
        return F.pmod(F.xxhash64(key, F.lit(seed), F.lit(salt)), F.lit(subscribers)) + 1

    return spark.range(n).select(
        key.alias("call_id"),
        someone("caller").alias("caller_id"),
        someone("callee").alias("callee_id"),
        (_uniform(key, seed, "cost") * 99.9 + 0.1).alias("cost"),
        someone("from").alias("caller_place"),
        someone("to").alias("callee_place"),
        F.timestamp_seconds(F.unix_timestamp(F.lit(start), "yyyy-MM-dd") + key).alias("ts"),
        (F.floor(_uniform(key, seed, "duration") * 10_000) + 1).cast("int").alias("duration"),
        (_uniform(key, seed, "distance") < 0.5).alias("long_distance"),
    )

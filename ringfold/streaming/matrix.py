"""Day partials kept up to date from a stream of calls, and reads of them while it runs.

Each micro-batch is summed to partials, written as a folder of its own, and then committed by a row in a
small table. Delivering a batch again overwrites its folder and its commit with the same rows, so each call
counts once; since partials merge in any order, late and reordered calls need no care and no state is held
between batches. Readers merge committed batches alone, so what is being written is not seen.

compact() merges what is committed into a base, and then points to it by a row in another small table. It
may run beside the stream and its readers: batches up to the base no longer count, those after it do, and
the stream goes on where it was. vacuum() then deletes what the newest base stands for, so nothing grows with the
number of batches; readers that began before the base must be done by then.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.matrix import day_partials, merged
from ..sources.store import RANGE
from ..storage import deleted, table_or_none


def append_partials(batch: DataFrame, batch_id: int, root: str, width: int | None = None) -> None:
    """Take in a micro-batch; with a width, in partitions of so many subscribers each, which readers may choose from."""
    rows = _ranged(day_partials(batch), width).withColumn("batch", F.lit(batch_id).cast("long"))
    writer = rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    writer.partitionBy("batch", *_range_columns(width)).parquet(f"{root}/partials")
    _point(batch.sparkSession, f"{root}/commits", batch_id)


def _ranged(partials: DataFrame, width: int | None) -> DataFrame:
    """With a width, the rows of a range together, so that it becomes one file and not one for each task."""
    if width is None:
        return partials
    return partials.withColumn(RANGE, F.floor(F.col("caller_id") / width).cast("long")).repartition(RANGE)


def _range_columns(width: int | None) -> list[str]:
    return [] if width is None else [RANGE]


def _point(spark: SparkSession, path: str, number: int) -> None:
    """Add a number to a table of them, as a folder of its own; adding one again changes nothing."""
    spark.range(1).select(F.current_timestamp().alias("at")).write.mode("overwrite").parquet(f"{path}/number={number}")


def _pointed(spark: SparkSession, path: str) -> list[int]:
    found = table_or_none(spark, path, "number long, at timestamp")
    return [] if found is None else sorted(r["number"] for r in found.select("number").distinct().collect())


def keep_up(calls: DataFrame, root: str, available_now: bool = True, every: str = "10 seconds") -> StreamingQuery:
    """Start keeping the partials under root up to date with a stream of calls."""
    writer = calls.writeStream.foreachBatch(lambda batch, i: append_partials(batch, i, root)).option(
        "checkpointLocation", f"{root}/progress"
    )
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=every)).start()


#: Of calls without rows, whose partials tell no schema.
_NOTHING = (
    "caller_id long, day int, long_distance boolean, calls long, sum_dur long, min_dur int, max_dur int, "
    "sum_cost double, min_cost double, max_cost double, last_ts timestamp_ntz"
)


def _committed(spark: SparkSession, root: str, ranges: Sequence[int] | None = None) -> tuple[DataFrame, int]:
    """Partials of the newest base and of the batches committed after it, and the last batch of all these.

    Of some id ranges alone, if they are given; the partitions of others are not read.
    """
    upto = max(_pointed(spark, f"{root}/bases"), default=-1)
    after = [k for k in _pointed(spark, f"{root}/commits") if k > upto]  # as many as came since the last compact()
    if upto < 0 and not after:
        raise ValueError(f"no batch has been committed under {root}")
    parts = [] if upto < 0 else [spark.read.parquet(f"{root}/base/upto={upto}")]
    rows = table_or_none(spark, f"{root}/partials") if after else None
    if rows is not None:
        parts.append(rows.where(F.col("batch").isin(after)).drop("batch"))
    if ranges is not None:
        parts = [rows.where(F.col(RANGE).isin(*ranges)) for rows in parts]
    parts = [rows.drop(RANGE) for rows in parts] or [spark.createDataFrame([], _NOTHING)]
    return reduce(DataFrame.unionByName, parts), max([upto, *after])


def snapshot(spark: SparkSession, root: str, ranges: Sequence[int] | None = None) -> DataFrame:
    """The merged partials of all batches that are committed now, of some id ranges if they are given."""
    return merged(_committed(spark, root, ranges)[0])


def compact(spark: SparkSession, root: str, width: int | None = None) -> int:
    """Merge the batches that are committed now into a base that stands for them; the number of the last.

    width is the one that the batches were appended with.
    """
    rows, last = _committed(spark, root)
    writer = _ranged(merged(rows), width).write.mode("overwrite")
    writer.partitionBy(*_range_columns(width)).parquet(f"{root}/base/upto={last}")
    _point(spark, f"{root}/bases", last)
    return last


def vacuum(spark: SparkSession, root: str) -> int:
    """Delete the batches, commits and bases that the newest base stands for; its number, -1 if there is none."""
    bases = _pointed(spark, f"{root}/bases")
    upto = max(bases, default=-1)
    for k in (k for k in _pointed(spark, f"{root}/commits") if k <= upto):
        deleted(spark, f"{root}/partials/batch={k}")
        deleted(spark, f"{root}/commits/number={k}")
    for k in (k for k in bases if k < upto):
        deleted(spark, f"{root}/base/upto={k}")
        deleted(spark, f"{root}/bases/number={k}")
    return upto


def closed_windows(calls: DataFrame, delay: str = "1 day", length: str = "1 day", anchor: str | None = None) -> DataFrame:
    """Totals of each subscriber's windows that no call can change any more, in append mode.

    length and anchor as window() takes them: "7 days" and "4 days" are weeks from Monday.
    """
    window = F.window("at", length, startTime=anchor) if anchor else F.window("at", length)
    return (
        calls.withColumn("at", F.col("ts").cast("timestamp"))
        .withWatermark("at", delay)
        .groupBy(F.col("caller_id").alias("subscriber_id"), window.alias("window"))
        .agg(F.count("*").alias("calls"), F.sum("duration").alias("sum_dur"), F.max("cost").alias("max_cost"))
        .select("subscriber_id", F.to_date("window.start").alias("window_start"), "calls", "sum_dur", "max_cost")
    )

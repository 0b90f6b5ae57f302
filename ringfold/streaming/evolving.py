"""Day partials under a running stream whose catalogue gains metrics.

A metric is a name and an SQL expression over a call; attributes of it are DerivedAttributes. The metrics are a table
that each micro-batch reads, so a new one is in all later batches without a restart. Each batch is committed by
a row that says which metrics its partials hold and which files its calls came from. backfill() computes what
batches lack from those files, into folders by metric and batch, and readers merge both: files of different
columns become one table in which what a batch lacks is null, and nulls add nothing.

Delivering a batch again, or filling it again, overwrites its folder. Where a batch has come again with a metric that
was filled in before, its own partials count and the filled ones do not.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.matrix import KEYS, day_partials, merged
from ..sources.calls import EVENT, from_events
from ..storage import table_or_none

_BATCHES = "batch long, holds array<string>, files array<string>"


class EvolvingPartials:
    def __init__(self, root: str):
        self.root = root

    def metrics(self, spark: SparkSession) -> dict[str, str]:
        found = table_or_none(spark, f"{self.root}/metrics", "name string, value string")
        return {} if found is None else {r["name"]: r["value"] for r in found.collect()}

    def add_metric(self, spark: SparkSession, name: str, value: str) -> None:
        """From the next micro-batch on; adding the same again changes nothing, another value under the name raises."""
        known = self.metrics(spark)
        if known.get(name, value) != value:
            raise ValueError(f"metric {name} is {known[name]} already")
        if name not in known:
            spark.createDataFrame([(name, value)], "name string, value string").coalesce(1).write.mode("append").parquet(f"{self.root}/metrics")

    def append(self, calls: DataFrame, batch_id: int) -> None:
        """Take in a micro-batch of calls with the file of each."""
        spark = calls.sparkSession
        metrics = self.metrics(spark)
        self._put(day_partials(calls, {m: F.expr(v) for m, v in metrics.items()}), batch_id, "partials")
        files = [r["file"] for r in calls.select("file").distinct().collect()]  # as many as a batch may have
        row = spark.createDataFrame([(batch_id, sorted(metrics), files)], _BATCHES).withColumnRenamed("batch", "of")
        self._put(row.withColumn("batch", F.col("of")), batch_id, "batches")

    def _put(self, rows: DataFrame, batch_id: int, name: str) -> None:
        writer = rows.withColumn("batch", F.lit(batch_id).cast("long")).write.mode("overwrite").partitionBy("batch")
        writer.option("partitionOverwriteMode", "dynamic").parquet(f"{self.root}/{name}")

    def keep_up(self, spark: SparkSession, folder: str, files_per_batch: int = 1) -> StreamingQuery:
        """Start following the event files of a folder."""
        events = spark.readStream.schema(EVENT).option("maxFilesPerTrigger", files_per_batch).parquet(f"{folder}/events*.parquet")
        calls = from_events(events.select("*", F.col("_metadata.file_path").alias("file")), "file")
        writer = calls.writeStream.foreachBatch(self.append).option("checkpointLocation", f"{self.root}/progress")
        return writer.trigger(availableNow=True).start()

    def _batches(self, spark: SparkSession) -> DataFrame:
        found = table_or_none(spark, f"{self.root}/batches", f"of long, {_BATCHES}")
        return spark.createDataFrame([], _BATCHES) if found is None else found.select("batch", "holds", "files")

    def backfill(self, spark: SparkSession) -> list[str]:
        """Compute metrics for the committed batches that hold neither them nor what fills them in; the metrics filled."""
        done = table_or_none(spark, f"{self.root}/filled", "metric string, batch long")
        found = []
        for metric, value in self.metrics(spark).items():
            lacking = self._batches(spark).where(~F.array_contains("holds", metric))
            if done is not None:
                lacking = lacking.join(done.where(F.col("metric") == metric).select("batch").distinct(), "batch", "left_anti")
            files = lacking.select("batch", F.explode("files").alias("file"))
            paths = [r["file"] for r in files.select("file").distinct().collect()]
            if not paths:
                continue
            events = spark.read.schema(EVENT).parquet(*paths).select("*", F.col("_metadata.file_path").alias("file"))
            calls = from_events(events, "file").join(files, "file")
            rows = day_partials(calls, {metric: F.expr(value)}, by=("batch",))
            columns = [*KEYS, "batch", *(f"{a}_{metric}" for a in ("sum", "min", "max"))]
            writer = rows.select(F.lit(metric).alias("metric"), *columns).write.mode("overwrite").partitionBy("metric", "batch")
            writer.option("partitionOverwriteMode", "dynamic").parquet(f"{self.root}/filled")
            found.append(metric)
        return found

    def read(self, spark: SparkSession) -> DataFrame:
        """The merged partials of all committed batches, with the metrics they hold or that were filled in."""
        batches = self._batches(spark)
        parts = spark.read.option("mergeSchema", True).parquet(f"{self.root}/partials")
        parts = [parts.join(batches.select("batch"), "batch", "left_semi").drop("batch")]
        if table_or_none(spark, f"{self.root}/filled", "metric string, batch long") is not None:
            filled = spark.read.option("mergeSchema", True).parquet(f"{self.root}/filled")
            lacks = batches.select("batch", "holds").join(filled, "batch").where(~F.array_contains("holds", F.col("metric")))
            parts.append(lacks.drop("batch", "holds", "metric"))
        return merged(reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts))

"""Campaigns that hold for each subscriber, kept up to date for those who call.

A micro-batch adds partials of its calls, as streaming.matrix keeps them, in partitions by id range. Then only the
subscribers in it are derived and evaluated again: their partials are read from the ranges they are in, become
wide rows, and go through the campaign index; the result replaces theirs in a table by id range. All others
stand as they are. Delivering a batch again overwrites its partials and puts the same results in place. compact()
keeps what a micro-batch has to list and read from growing with the number of batches.

Validity is no part of what is kept, as it changes without calls; readers give a time.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.campaign_index import matching
from ..operators.matrix import wide_table
from ..operators.rules import valid_at
from ..sources.catalogue import Attribute
from ..sources.rules import Rules
from ..sources.store import RANGE, RangedTable
from ..storage import table_or_none
from . import matrix as partials


class HoldingCampaigns:
    """The table under root/holding, and the partials under root/partials and root/base that it follows from."""

    def __init__(self, rules: Rules, attributes: Sequence[Attribute], root: str, width: int):
        """width: ids to a range. The rules are read now, and those of a micro-batch are the same for all."""
        self.rules, self.attributes, self.root, self.width = rules, attributes, root, width
        self.flat = rules.flat().collect()  # they become the index that every task has
        self.holding = RangedTable(f"{root}/holding", width)

    def refresh(self, batch: DataFrame, batch_id: int) -> None:
        """Take in the calls of a micro-batch."""
        spark = batch.sparkSession
        partials.append_partials(batch, batch_id, self.root, self.width)
        new = table_or_none(spark, f"{self.root}/partials/batch={batch_id}")
        if new is None:  # nobody has called
            return
        touched = new.select("caller_id").distinct()
        hit = [r[RANGE] for r in new.select(RANGE).distinct().collect()]
        wide = wide_table(self.partials(spark, hit).join(touched, "caller_id", "left_semi"), self.attributes)
        found = matching(wide, self.flat).groupBy("subscriber_id").agg(F.array_sort(F.collect_set("campaign")).alias("campaigns"))
        every = touched.withColumnRenamed("caller_id", "subscriber_id").join(found, "subscriber_id", "left")
        self.holding.upsert(every.withColumn("campaigns", F.coalesce("campaigns", F.array().cast("array<int>"))))

    def partials(self, spark: SparkSession, ranges: Sequence[int]) -> DataFrame:
        """The merged partials of some id ranges; others are not read."""
        return partials.snapshot(spark, self.root, ranges)

    def compact(self, spark: SparkSession) -> int:
        """Merge the batches so far, and delete them; not while a micro-batch is under way."""
        last = partials.compact(spark, self.root, self.width)
        partials.vacuum(spark, self.root)
        return last

    def keep_up(self, calls: DataFrame) -> StreamingQuery:
        """Start following a stream of calls."""
        writer = calls.writeStream.foreachBatch(self.refresh).option("checkpointLocation", f"{self.root}/progress")
        return writer.trigger(availableNow=True).start()

    def matches(self, spark: SparkSession, as_of_ms: int | None = None) -> DataFrame:
        """(subscriber_id, campaign) of campaigns that hold, of those valid at a time if one is given."""
        found = self.holding.read(spark).select("subscriber_id", F.explode("campaigns").alias("campaign"))
        if as_of_ms is None:
            return found
        valid = valid_at(self.rules.campaign, as_of_ms).select(F.col("id").alias("campaign"))
        return found.join(valid, "campaign", "left_semi").select("subscriber_id", "campaign")

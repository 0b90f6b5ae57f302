"""Tables of subscribers: layout, bulk load, reads, and updates of the id ranges that a change touches."""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..storage import deleted, stored, table_or_none
from .catalogue import Attribute
from .dimensions import DIMENSIONS, drawn_codes

_TYPES = {"call": T.LongType(), "dur": T.LongType(), "cost": T.DoubleType()}


def wide_schema(attributes: Sequence[Attribute]) -> T.StructType:
    """The wide table: key, last update, attributes, dimension keys."""
    schema = T.StructType().add("subscriber_id", T.LongType(), False).add("last_updated", T.TimestampType())
    for a in attributes:
        kind = T.IntegerType() if a.metric == "dur" and a.aggregate != "sum" else _TYPES[a.metric]
        schema = schema.add(a.name, kind)
    for key, _, _ in DIMENSIONS.values():
        schema = schema.add(key, T.ShortType())
    return schema


def populate(
    spark: SparkSession, lowest: int, highest: int, attributes: Sequence[Attribute], seed: int = 1, at: Column | None = None
) -> DataFrame:
    """A row for each id of an inclusive range: sums 0, minima and maxima null, codes drawn, updated at a time (now)."""
    codes = drawn_codes(F.col("id"), seed)
    columns = []
    for field in wide_schema(attributes):
        if field.name == "subscriber_id":
            value = F.col("id")
        elif field.name == "last_updated":
            value = F.current_timestamp() if at is None else at
        elif field.name in codes:
            value = codes[field.name]
        else:
            value = F.lit(0) if field.name.startswith("sum_") else F.lit(None)
        columns.append(value.cast(field.dataType).alias(field.name))
    return spark.range(lowest, highest + 1).select(*columns)


def laid_out(wide: DataFrame, partitions: int) -> DataFrame:
    """Equal ranges of ids, sorted, so that files have disjoint statistics."""
    return wide.repartitionByRange(partitions, "subscriber_id").sortWithinPartitions("subscriber_id")


def scan(wide: DataFrame, columns: Sequence[str], where: Column | None = None) -> DataFrame:
    rows = wide if where is None else wide.where(where)
    return rows.select(*columns)


def scan_aggregate(wide: DataFrame, aggregates: Sequence[Column], where: Column | None = None) -> DataFrame:
    return (wide if where is None else wide.where(where)).agg(*aggregates)


def lookup(wide: DataFrame, keys: DataFrame, key: str = "subscriber_id") -> DataFrame:
    """The rows whose ids are among keys, each once."""
    return wide.join(keys.select(key).distinct(), key, "left_semi")


RANGE = "id_range"


@dataclass(frozen=True)
class RangedTable:
    """Rows with a unique key, in Parquet partitions of `width` keys each, under root/rows.

    An update reads and writes only the partitions that hold a changed key. It first writes the new rows of
    these to root/pending, then the list of them to root/plan, and then overwrites the partitions. From
    the moment the plan is whole the update will be done: whoever updates next finishes it first, and doing so twice
    changes nothing. An update that died before that has left the rows as they were. There is one writer at a time;
    width should leave no more than some ten thousand ranges, as their numbers meet at the driver.
    """

    root: str
    width: int
    key: str = "subscriber_id"

    def ranged(self, rows: DataFrame) -> DataFrame:
        return rows.withColumn(RANGE, F.floor(F.col(self.key) / self.width).cast("long"))

    def read(self, spark: SparkSession) -> DataFrame:
        return spark.read.parquet(f"{self.root}/rows").drop(RANGE)

    def lookup(self, keys: DataFrame) -> DataFrame:
        """The rows whose keys are among keys, from their partitions alone."""
        wanted = self.ranged(keys.select(self.key).distinct())
        rows = keys.sparkSession.read.parquet(f"{self.root}/rows")
        return rows.where(F.col(RANGE).isin(self._hit(wanted))).join(wanted.drop(RANGE), self.key, "left_semi").drop(RANGE)

    def upsert(self, changed: DataFrame) -> list[int]:
        """Put changed rows in place of those with their keys, or beside them; the ranges written.

        changed has the table's columns, in any order; a null key, or one that occurs twice, raises.
        """
        spark = changed.sparkSession
        self.recover(spark)
        rows = self.ranged(stored(changed, "changed"))
        twice = rows.groupBy(self.key).count().where(f"count > 1 or {self.key} is null").first()
        if twice:
            raise ValueError(f"{self.key} {twice[0]} is not unique among the changed rows")
        hit = self._hit(rows)
        if not hit:
            return hit
        before = table_or_none(spark, f"{self.root}/rows", rows.schema)
        if before is not None:
            kept = before.where(F.col(RANGE).isin(hit)).join(rows.select(self.key), self.key, "left_anti")
            rows = kept.unionByName(rows)
        write = uuid.uuid4().hex
        self._by_range(rows.repartition(RANGE).sortWithinPartitions(RANGE, self.key), f"{self.root}/pending/{write}")
        plan = spark.createDataFrame([(r, len(hit), write) for r in hit], "id_range long, ranges long, write string")
        plan.coalesce(1).write.mode("overwrite").parquet(f"{self.root}/plan")
        self.recover(spark)
        return hit

    def recover(self, spark: SparkSession) -> None:
        """Finish an update whose plan is whole; drop what an unfinished one has left."""
        plan = table_or_none(spark, f"{self.root}/plan", "id_range long, ranges long, write string")
        rows = [] if plan is None else plan.collect()
        if rows and len(rows) == rows[0]["ranges"]:
            pending = spark.read.parquet(f"{self.root}/pending/{rows[0]['write']}")
            self._by_range(pending, f"{self.root}/rows", overwrite=True)
        deleted(spark, f"{self.root}/plan")
        deleted(spark, f"{self.root}/pending")

    def _hit(self, rows: DataFrame) -> list[int]:
        return sorted(r[RANGE] for r in rows.select(RANGE).distinct().collect())

    @staticmethod
    def _by_range(rows: DataFrame, path: str, overwrite: bool = False) -> None:
        writer = rows.write.mode("overwrite" if overwrite else "error").option("partitionOverwriteMode", "dynamic")
        writer.partitionBy(RANGE).parquet(path)


@dataclass(frozen=True)
class BucketedTable:
    """A catalogue table in files by a hash of its key, under path: equal keys of tables with as many buckets meet in
    the same task, so joins on the key move nothing, nor does writing their result to another such table."""

    name: str
    path: str
    buckets: int
    key: str = "subscriber_id"

    def write(self, rows: DataFrame) -> None:
        """Rows that are not yet by key are dealt to their buckets first, one file to each."""
        by_key = rows.repartition(self.buckets, self.key)
        self._save(by_key)

    def _save(self, rows: DataFrame) -> None:
        writer = rows.write.bucketBy(self.buckets, self.key).sortBy(self.key).format("parquet").mode("error")
        writer.option("path", self.path).saveAsTable(self.name)

    def read(self, spark: SparkSession) -> DataFrame:
        return spark.table(self.name)

    def upserted(self, spark: SparkSession, changed: BucketedTable, to: BucketedTable) -> None:
        """Write to another table the rows of this one, those of changed in place of theirs; buckets as many in all three.

        changed has the columns of this table. The next version is a table of its own, so readers of this one go on.
        """
        if not self.buckets == changed.buckets == to.buckets:
            raise ValueError(f"{self.buckets}, {changed.buckets} and {to.buckets} buckets do not meet")
        old, new = self.read(spark).alias("old"), changed.read(spark).withColumn("_new", F.lit(True)).alias("new")
        joined = old.join(new, self.key, "full")
        columns = [self.key] + [c for c in self.read(spark).columns if c != self.key]
        to._save(joined.select(self.key, *(F.when(F.col("_new"), F.col(f"new.{c}")).otherwise(F.col(f"old.{c}")).alias(c) for c in columns[1:])))


def footer_session(spark: SparkSession) -> SparkSession:
    """A session that reads Parquet with the scan that answers count, min and max from the files' footers."""
    session = spark.newSession()
    session.conf.set("spark.sql.sources.useV1SourceList", "")
    session.conf.set("spark.sql.parquet.aggregatePushdown", "true")
    for name in ("spark.sql.session.timeZone", "spark.sql.shuffle.partitions"):
        if (value := spark.conf.get(name, None)) is not None:
            session.conf.set(name, value)
    return session


def footer_aggregates(spark: SparkSession, path: str, columns: Sequence[str], by: str | None = None, where: Column | None = None) -> DataFrame:
    """Rows n, and min_ and max_ of columns, of a Parquet table, computed at the storage: no data page is read.

    by and where may name columns that the table is partitioned by, no others; columns are numbers, booleans or
    dates. What the footers cannot answer raises, in place of a scan.
    """
    parts = [F.count("*").alias("n"), *(f(c).alias(f"{f.__name__}_{c}") for c in columns for f in (F.min, F.max))]
    rows = footer_session(spark).read.parquet(path)
    rows = rows if where is None else rows.where(where)
    found = rows.groupBy(by).agg(*parts) if by else rows.agg(*parts)
    plan = found._jdf.queryExecution().executedPlan().toString()
    if "PushedAggregation: [COUNT(*)" not in plan:
        raise ValueError(f"the footers of {path} do not answer for {', '.join(columns)} by {by} where {where}")
    return found

"""The wide table from state per subscriber: the other plan beside day partials in files.

The state of a subscriber are partials by day and kind of call, of the week of the last
call alone: what is older is in no current window, and a later call only moves the windows on. So calls that
come late, in any order, change what they should, and a subscriber keeps 14 rows at most. Those of a range of ids
are one value, as a key of its own for each subscriber would cost several calls to the JVM. Each micro-batch
emits the partials of the subscribers that it touches; their wide rows replace those in a table by id range.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..functions.time import day_index
from ..operators.matrix import wide_table
from ..sources.catalogue import Attribute
from ..sources.store import RANGE, RangedTable

_PARTS = "calls long, sum_dur long, min_dur int, max_dur int, sum_cost double, min_cost double, max_cost double, last_us long"
_PARTIALS = f"caller_id long, day int, long_distance boolean, {_PARTS}"
_NAMES = [c.split()[0] for c in _PARTS.split(", ")]
_KEY = ["caller_id", "day", "long_distance"]
_TYPES = {"long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(), "double": pa.float64()}
_SCHEMA = pa.schema([(name, _TYPES[kind]) for name, kind in (c.split() for c in _PARTIALS.split(", "))])
_CALL = pa.schema([*(_SCHEMA.field(n) for n in _KEY), ("duration", pa.int32()), ("cost", pa.float64()), ("last_us", pa.int64())])
_NULLABLE = {pa.int64(): pd.Int64Dtype(), pa.int32(): pd.Int32Dtype()}


def with_state(spark: SparkSession) -> SparkSession:
    """A session of its own whose streams keep state in RocksDB, as stateful processors need it."""
    session = spark.newSession()
    session.conf.set(
        "spark.sql.streaming.stateStore.providerClass",
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    )
    for name in ("spark.sql.session.timeZone", "spark.sql.shuffle.partitions"):
        if (value := spark.conf.get(name, None)) is not None:
            session.conf.set(name, value)
    return session


def _partials(calls: pd.DataFrame) -> pa.Table:
    """Each call as a partial."""
    of = pa.Table.from_pandas(calls, _CALL, preserve_index=False)
    dur, cost = of["duration"], of["cost"]
    one = pa.array(np.ones(len(of), np.int64))
    parts = [one, dur.cast(pa.int64()), dur, dur, cost, cost, cost, of["last_us"]]
    return pa.table([of["caller_id"], of["day"], of["long_distance"], *parts], _SCHEMA.names)


def _merged(partials: pa.Table) -> pa.Table:
    """Partials of the same subscriber, day and kind of call as one, of the week of the subscriber's last call."""
    sums = partials.group_by(_KEY).aggregate([(n, n.split("_")[0].replace("calls", "sum").replace("last", "max")) for n in _NAMES])
    rows = sums.select([*_KEY, *sums.column_names[len(_KEY) :]]).rename_columns(_SCHEMA.names).cast(_SCHEMA)
    _, at = np.unique(rows["caller_id"].to_numpy(), return_inverse=True)
    week = rows["day"].to_numpy() // 7
    last = np.full(len(rows), -(1 << 31))
    np.maximum.at(last, at, week)
    return rows.filter(pa.array(week == last[at]))


class WeekOfPartials(StatefulProcessor):
    """The state is one value for a range of subscribers, as each access to it is a call to the JVM."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("partials", "arrow binary")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        held = self.state.get()
        merged = pa.ipc.open_stream(held[0]).read_all() if held else _SCHEMA.empty_table()
        touched = np.zeros(0, np.int64)
        for part in rows:
            touched = np.union1d(touched, part["caller_id"].to_numpy())
            merged = _merged(pa.concat_tables([merged, _partials(part)]))
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, _SCHEMA) as writer:
            writer.write_table(merged)
        self.state.update((sink.getvalue().to_pybytes(),))
        found = merged.filter(pa.array(np.isin(merged["caller_id"].to_numpy(), touched)))
        yield found.to_pandas(types_mapper=_NULLABLE.get)

    def close(self) -> None:
        pass


def touched_partials(calls: DataFrame, width: int) -> DataFrame:
    """The current partials of the subscribers in each micro-batch of a stream of calls, in update mode.

    width: ids to a key of the state; it stays the same for a stream that starts again.
    """
    each = calls.where("caller_id is not null and ts is not null and long_distance is not null").select(
        F.floor(F.col("caller_id") / width).cast("long").alias(RANGE), "caller_id", day_index(F.col("ts")).alias("day"),
        "long_distance", "duration", "cost", F.unix_micros(F.col("ts").cast("timestamp")).alias("last_us"),
    )
    return each.groupBy(RANGE).transformWithStateInPandas(WeekOfPartials(), _PARTIALS, "Update", "None")


def keep_wide(calls: DataFrame, attributes: Sequence[Attribute], table: RangedTable) -> StreamingQuery:
    """Start keeping a wide table up to date with a stream of calls, of a session with_state().

    A batch that is delivered again puts the same rows in place of themselves.
    """

    def put(rows: DataFrame, batch_id: int) -> None:
        timed = rows.withColumn("last_ts", F.timestamp_micros("last_us").cast("timestamp_ntz")).drop("last_us")
        table.upsert(wide_table(timed, attributes))

    writer = touched_partials(calls, table.width).writeStream.outputMode("update").foreachBatch(put)
    return writer.option("checkpointLocation", f"{table.root}/progress").trigger(availableNow=True).start()

"""Reports of campaign matches from a stream of candidates: at most one for each firing interval.

State is kept by campaign and range of subscribers, of each subscriber the candidates that the watermark has not passed
yet, and when the current firing interval ends: a key of its own for each subscriber would cost several calls to the
JVM. A timer at the first candidate's time decides on those that nothing earlier can precede any more, so
reports do not depend on the order of arrival; a timer at the last interval's end drops the state. Candidates later than
the watermark's delay are dropped, as everywhere in Spark.

Reports are those of operators.rules.reports() for all times that the watermark has passed. A
candidate of an unknown campaign is reported nowhere but moves the watermark, so it may serve as a heartbeat.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..operators.rules import with_intervals
from ..sources.store import RANGE
from .state import with_state

_REPORT = "subscriber_id long, campaign int, at_ms long"
WIDTH = 1000


class Firing(StatefulProcessor):
    """The state is one value for a campaign and a range of subscribers, as each access to it is a call to the JVM."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("firing", "until binary, waiting binary")

    def _read(self) -> tuple[np.ndarray, np.ndarray]:
        """Rows of longs: subscriber and end of the current interval; subscriber, next_ms and at_ms of what waits."""
        until, waiting = self.state.get() or (b"", b"")
        return np.frombuffer(until, "<i8").reshape(-1, 2), np.frombuffer(waiting, "<i8").reshape(-1, 3)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        until, waiting = self._read()
        before = waiting[:, 2].min() if len(waiting) else None
        for part in rows:
            waiting = _firsts(np.vstack([waiting, part[["of_id", "next_ms", "at_ms"]].to_numpy(np.int64)]))
        self._write(until, waiting)
        if (first := waiting[:, 2].min()) != before:
            self.handle.registerTimer(int(first))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        until, waiting = self._read()
        passed = max(timerValues.getCurrentWatermarkInMs(), expiredTimerInfo.getExpiryTimeInMs() + 1)
        due = waiting[:, 2] < passed
        ends, found = dict(until.tolist()), []
        for who, after, at in waiting[due][np.lexsort((waiting[due, 2], waiting[due, 0]))].tolist():
            if at >= ends.get(who, at):
                found.append((who, at))
                ends[who] = after
        waiting = waiting[~due]
        ends = {who: end for who, end in ends.items() if end > passed}  # others have ended: what comes now is later
        if ends or len(waiting):
            self._write(np.array(list(ends.items()), np.int64), waiting)
            self.handle.registerTimer(int(waiting[:, 2].min()) if len(waiting) else max(ends.values()))
        else:
            self.state.clear()
        if found:
            campaign, nobody, _ = key
            frame = pd.DataFrame(found, columns=["subscriber_id", "at_ms"]).assign(campaign=campaign)
            yield (frame.assign(subscriber_id=None) if nobody else frame)[["subscriber_id", "campaign", "at_ms"]]

    def _write(self, until: np.ndarray, waiting: np.ndarray) -> None:
        self.state.update((until.astype("<i8").tobytes(), waiting.astype("<i8").tobytes()))

    def close(self) -> None:
        pass


def _firsts(waiting: np.ndarray) -> np.ndarray:
    """Of candidates that would begin the same interval, as in a fixed one, the first is enough."""
    waiting = waiting[np.lexsort(waiting.T[::-1])]
    return waiting[np.append(True, (waiting[1:, :2] != waiting[:-1, :2]).any(axis=1))[: len(waiting)]]


def reported(candidates: DataFrame, campaigns: DataFrame, delay: str = "1 day", width: int = WIDTH) -> DataFrame:
    """(subscriber_id, campaign, at_ms) of a stream of candidates with these columns, in append mode.

    width: ids to a key of the state; it stays the same for a stream that starts again.
    """
    timed = candidates.select("subscriber_id", "campaign", "at_ms", F.timestamp_millis("at_ms").alias("at")).withWatermark("at", delay)
    rows = with_intervals(timed, campaigns).withColumn(
        "next_ms",  # when the interval that a report at this time begins is over
        F.when(F.col("interval_ms") == 0, F.col("at_ms") + 1)
        .when(F.col("firing_start_condition") == "sliding", F.col("at_ms") + F.col("interval_ms"))
        .otherwise(F.expr("valid_from + ((at_ms - valid_from) div interval_ms + 1) * interval_ms")),
    )
    of = F.coalesce("subscriber_id", F.lit(0)).cast("long")  # pandas has no nulls among longs, so they have a key of their own
    keyed = rows.select(
        "campaign", F.isnull("subscriber_id").alias("nobody"), F.floor(of / width).cast("long").alias(RANGE),
        of.alias("of_id"), "at_ms", "next_ms", "at",
    ).groupBy("campaign", "nobody", RANGE)
    return keyed.transformWithStateInPandas(Firing(), _REPORT, "Append", "EventTime")


def report(candidates: DataFrame, campaigns: DataFrame, root: str, delay: str = "1 day", width: int = WIDTH) -> StreamingQuery:
    """Start writing reports to root/reports; candidates must be a stream of a session with_state()."""
    writer = reported(candidates, campaigns, delay, width).writeStream.outputMode("append").option("checkpointLocation", f"{root}/progress")
    return writer.trigger(availableNow=True).format("parquet").start(f"{root}/reports")

"""Days and weeks as numbers. Day 0 is Monday 1970-01-05, so a week is seven whole days.

Windows are half-open: midnight belongs to the day that begins. Timestamps without a zone are taken
as they stand; those with one by the session's zone, which should be UTC.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ANCHOR = "1970-01-05"
WINDOWS = {"day": 1, "week": 7}


def day_index(ts: Column) -> Column:
    return F.datediff(ts.cast("date"), F.lit(ANCHOR).cast("date"))


def index_of(day: Column, window: str) -> Column:
    """The number of the tumbling window that holds a day."""
    length = WINDOWS[window]
    return day if length == 1 else F.floor(day / length).cast("int")


def start_of(index: Column, window: str) -> Column:
    """The first date of a tumbling window."""
    return F.date_add(F.lit(ANCHOR).cast("date"), (index * WINDOWS[window]).cast("int"))

"""What the corpus operators share: storage that every executor sees, global order, word splitting."""

from __future__ import annotations

from collections.abc import Callable, Hashable, Iterator
from typing import TypeVar

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..storage import new_path, shared_dir, stored

__all__ = [
    "FOLDED", "WORD", "laid_out", "make_way", "long_id", "lower_ascii", "new_path", "of_worker", "partition_of", "perhaps_among",
    "removed", "running_start", "shared_dir", "stored", "text_runs", "text_slices",
]

#: A word is a run of anything but ASCII white space; the same class as bytes.split().
WORD = r"[^\x20\x09-\x0D]+"
#: For bytes.translate(): A-Z lower-cased, ASCII letters, digits and other characters kept, all else a space.
FOLDED = bytes(ord(chr(i).lower()) if chr(i).isalnum() else 32 for i in range(128)) + bytes(range(128, 256))
_T = TypeVar("_T")
_kept: dict[Hashable, object] = {}
_MARKS, _MARKS_EACH = 1 << 25, 1 << 15  # bits of perhaps_among(), and of each of its bitmaps
_ROW_BITS = 33  # monotonically_increasing_id() keeps the partition above these bits


def removed(df: DataFrame) -> None:
    """Delete the files of a stored DataFrame that nothing reads any more."""
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        jvm_path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
        jvm_path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(jvm_path, True)


def laid_out(df: DataFrame, *order: str | Column, at: str) -> DataFrame:
    """df range-partitioned and sorted by order, with at: a long that ascends along that order.

    at holds the partition and the row in it. It is only stable once the result is stored.
    """
    return (
        df.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .withColumn(at, F.monotonically_increasing_id())
    )


def partition_of(at: str) -> Column:
    return F.shiftright(F.col(at), _ROW_BITS)


def running_start(df: DataFrame, at: str, value: str, out: str) -> DataFrame:
    """df (stored, with at from laid_out) plus out: the sum of value over all rows before, as long.

    Each range partition is summed on its own; only one row per partition meets in one task.
    """
    part = df.withColumn("_part", partition_of(at))
    whole = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sums = (
        part.groupBy("_part")
        .agg(F.sum(value).alias("_sum"))
        .select("_part", F.coalesce(F.sum("_sum").over(whole), F.lit(0)).alias("_before"))
    )
    within = Window.partitionBy("_part").orderBy(at).rowsBetween(Window.unboundedPreceding, -1)
    return (
        part.withColumn("_in", F.coalesce(F.sum(value).over(within), F.lit(0)))
        .join(F.broadcast(sums), "_part")  # a row per range partition
        .withColumn(out, (F.col("_before") + F.col("_in")).cast("long"))
        .drop("_part", "_before", "_in")
    )


def perhaps_among(df: DataFrame, key: Column, keys: DataFrame) -> DataFrame:
    """df plus _perhaps: false for most rows whose key is not the only column of keys, true for all whose key is.

    So that a join need not move the others. Keys become bits that all tasks have, 4 MB for any number of keys.
    """

    def place(of: Column) -> Column:
        return F.pmod(F.xxhash64(of), F.lit(_MARKS))

    marked = keys.select(place(F.col(keys.columns[0])).alias("_place"))
    marks = marked.groupBy(F.expr(f"_place div {_MARKS_EACH}").alias("_part")).agg(
        F.bitmap_construct_agg(F.expr(f"_place % {_MARKS_EACH}")).alias("_marks")
    )
    byte = F.expr(f"conv(hex(substring(_marks, CAST(_place % {_MARKS_EACH} div 8 AS INT) + 1, 1)), 16, 10)").cast("long")
    bit = byte.bitwiseAND(F.expr("shiftleft(1L, CAST(_place % 8 AS INT))")) != 0
    placed = df.withColumn("_place", place(key)).withColumn("_of", F.expr(f"_place div {_MARKS_EACH}"))
    found = placed.join(F.broadcast(marks), F.col("_of") == F.col("_part"), "left")
    return found.withColumn("_perhaps", F.coalesce(bit, F.lit(False))).drop("_place", "_of", "_part", "_marks")


def long_id(df: DataFrame, name: str) -> Column:
    return df[name].cast(T.LongType())


def lower_ascii(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def text_slices(texts: list[str | None], least: int = 2 << 20) -> Iterator[tuple[int, int]]:
    """Bounds of runs of texts of about least characters; a longer text is a run of its own."""
    start = size = 0
    for i, t in enumerate(texts):
        size += len(t or "")
        if size >= least:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def text_runs(texts: pa.Array, least: int = 2 << 20) -> Iterator[tuple[int, list[str | None]]]:
    """Where each run of about least characters begins, and its texts; a batch is not held as Python's strings, too."""
    sizes = pc.fill_null(pc.utf8_length(texts), 0).to_pylist()
    start = size = 0
    for i, n in enumerate(sizes):
        size += n
        if size >= least or i + 1 == len(sizes):
            yield start, texts.slice(start, i + 1 - start).to_pylist()
            start, size = i + 1, 0


def of_worker(key: Hashable, make: Callable[[], _T]) -> _T:
    """What make() gives, kept in a Python worker until something else is asked for.

    So the tasks of a stage share a cache, and the caches of stages in a row do not add up.
    """
    if key not in _kept:
        _kept.clear()
        _kept[key] = make()
    return _kept[key]


def make_way(df: DataFrame, *names: str) -> DataFrame:
    """df with its own columns of those names, if any, as <name>_before (_before_before if that is taken, too)."""
    for name in names:
        taken = {c.lower(): c for c in df.columns}
        if name.lower() in taken:
            other = f"{name}_before"
            while other.lower() in taken:
                other += "_before"
            df = df.withColumnRenamed(taken[name.lower()], other)
    return df

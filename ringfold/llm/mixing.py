"""Mixing sources to target weights along a time-varying curriculum.

Sources take shares of all words by weight, at most max_repeats times their own; what is above is
reshared. Every document of a source is taken whole floor(target / source size) times, and a prefix
of the source in a fixed pseudo-random order once more, so that its words come within half a
document of the target. Each copy then gets a training position: the source's weight schedule is
integrated, and the words of the source before the copy are carried back through that integral.
Ordering all copies by position plays every source at its scheduled rate.

Nothing needs the rows of a source together: all documents are range-partitioned by source and
order, and running sums are carried between partitions.

Defined results: a null or empty text has size 0 and is taken 0 times its size; a null source is a
source of its own, the last; equal rows are decided one by one, like others; without any words all
targets are 0; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import WORD, laid_out, make_way, perhaps_among, running_start, stored

Schedule = Sequence[tuple[float, float]]
#: Weight over training time from 0 to 1, by the source's place modulo the schedules: rising, even, falling.
SCHEDULES: tuple[Schedule, ...] = (((0.0, 0.5), (1.0, 1.5)), ((0.0, 1.0), (1.0, 1.0)), ((0.0, 1.5), (1.0, 0.5)))


#: Columns that curriculum() adds.
ADDED = ("copy", "position")


def _by_place(values: Sequence[float]) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (F.col("place") % len(values) + 1).cast("int"))


def source_targets(units: DataFrame, weights: Sequence[int], max_repeats: int) -> DataFrame:
    """(source, source_size, source_start, place, target) of each source of units (source, words)."""
    sizes = units.groupBy("source").agg(F.sum("words").alias("source_size")).withColumn("one", F.lit(1))
    placed = stored(laid_out(sizes, F.col("source").asc_nulls_last(), at="at"), "sources")
    placed = running_start(placed, "at", "one", "place")
    starts = running_start(placed, "at", "source_size", "source_start")
    sources = stored(
        starts.select("source", "source_size", "source_start", "place", _by_place(weights).alias("weight")), "sources"
    )
    most = F.col("source_size") * max_repeats
    level, capped = None, F.lit(False)
    while True:  # each round caps at least one source more
        total, held, free, n = sources.agg(
            F.sum("source_size"),
            F.sum(F.when(capped, most).otherwise(0)),
            F.sum(F.when(capped, 0).otherwise(F.col("weight"))),
            F.count(F.when(capped, 1)),
        ).first()
        if not free:
            share = F.lit(0.0)
        else:
            left = F.lit(total - held).cast("long")  # a literal below 2^31 is an int, and its product would overflow
            share = (left * F.col("weight")).cast("double") / F.lit(free)
        if n == level or not free:
            break
        level, capped = n, capped | (share > most)
    target = F.when(capped, most.cast("double")).otherwise(share)
    return sources.select("source", "source_size", "source_start", "place", target.alias("target"))


def _size(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text.cast("string"), F.lit("")), F.lit(WORD)).cast("long")


def _decided(rows: DataFrame) -> DataFrame:
    """rows plus again and copies, from their before and size, and the passes and target of their source."""
    rest = F.col("target") - F.col("passes") * F.col("source_size")
    return rows.withColumn("again", F.col("before") + F.col("size") / 2 < rest).withColumn(
        "copies", F.col("passes") + F.col("again").cast("long")
    )


def plan(docs: DataFrame, weights: Sequence[int] = (5, 2, 1), max_repeats: int = 3) -> DataFrame:
    """A row for each row of docs (doc_id, text, source): its copies and where they stand.

    size: words; tie: a hash of the text; nth: its number among equal rows, from 0; n: rows that it is, 1;
    copies: how often it is taken; before: words of the source that stand before it; again: whether it is in
    the extra pass. Of equal rows a later one is never taken more often.
    """
    units = (
        docs.select("doc_id", "source", _size(docs["text"]).alias("size"), F.xxhash64("text").alias("tie"))
        .groupBy("doc_id", "source", "size", "tie")
        .agg(F.count("*").alias("equal"))
        .withColumn("words", F.col("size") * F.col("equal"))
        .withColumn("order", F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")))
    )
    order = (F.col("source").asc_nulls_last(), "order", "doc_id", "size", "tie")
    placed = stored(laid_out(units, *order, at="at"), "mixing")
    targets = source_targets(placed, weights, max_repeats)
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    rows = (
        running_start(placed, "at", "words", "before_all")
        .withColumnRenamed("source", "_source")
        .join(targets, F.col("_source").eqNullSafe(F.col("source")))
        .withColumn("nth", F.explode(F.sequence(F.lit(0).cast("long"), F.col("equal") - 1)))
        .withColumn("before", F.col("before_all") - F.col("source_start") + F.col("nth") * F.col("size"))
        .withColumn("passes", F.floor(ratio))
    )
    return _decided(rows).select(
        *("doc_id", "source", "size", "tie", "nth", F.lit(1).cast("long").alias("n"), "before", "again"),
        *("place", "source_size", "target", "passes", "copies"),
    )


def position(share: Column, place: Column, schedules: Sequence[Schedule] = SCHEDULES) -> Column:
    """The time from 0 to 1 at which a source has played share of its words, by its schedule.

    A schedule is linear between its knots (time, weight), so its integral is a quadratic in each
    piece, and is inverted there.
    """
    by_schedule = []
    for knots in schedules:
        pieces = [(t, u, v, w) for (t, v), (u, w) in zip(knots, knots[1:])]
        areas = [(u - t) * (v + w) / 2 for t, u, v, w in pieces]
        done, time = 0.0, F.lit(float(knots[-1][0]))
        steps = []
        for (t, u, v, w), area in zip(pieces, areas):
            need = share * F.lit(sum(areas)) - F.lit(done)
            slope = (w - v) / (u - t)
            root = F.sqrt(F.greatest(F.lit(v * v) + F.lit(2 * slope) * need, F.lit(0.0))) + F.lit(v)
            steps.append((need <= area, F.lit(t) + F.when(root > 0, F.lit(2.0) * need / root).otherwise(0.0)))
            done += area
        for inside, at in reversed(steps):
            time = F.when(inside, at).otherwise(time)
        by_schedule.append(time)
    found = by_schedule[-1]
    for i, time in enumerate(by_schedule[:-1]):
        found = F.when(place % len(by_schedule) == i, time).otherwise(found)
    return found


def _mix(docs: DataFrame, planned: DataFrame, schedules: Sequence[Schedule] = SCHEDULES) -> DataFrame:
    """curriculum() with each row of docs as one value, _row, and what tells it from others: _unit and nth."""

    def unit(of: DataFrame, tie: Column) -> Column:
        tie = F.coalesce(tie, F.lit(0).cast("long"))  # never null on either side, or the join would cast one and move rows twice
        return F.struct(of["doc_id"].alias("doc_id"), of["source"].alias("source"), tie.alias("tie")).alias("_unit")

    firsts = planned.where("nth = 0 AND copies > 0").select(
        unit(planned, planned["tie"]), "size", "before", "place", "source_size", "target", "passes"
    )
    rows = docs.select(F.struct(*(docs[c] for c in docs.columns)).alias("_row"), unit(docs, F.xxhash64(docs["text"])))
    rows = perhaps_among(rows, F.col("_unit"), firsts.select("_unit")).where("_perhaps").drop("_perhaps")
    key = ("doc_id", "text", "source")
    rest = [F.col("_row")[c] for c, kind in docs.dtypes if c.lower() not in key and "map<" not in kind and "variant" not in kind]
    equal = Window.partitionBy("_unit").orderBy(*rest or ["_unit"])  # rows that are equal but for the rest, in one order
    each = (
        rows.join(firsts, "_unit")
        .withColumn("nth", (F.row_number().over(equal) - 1).cast("long"))
        .withColumn("before", F.col("before") + F.col("nth") * F.col("size"))
    )
    extra = F.col("source_size") * F.col("passes")
    start = F.when(F.col("copy") < F.col("passes"), F.col("copy") * F.col("source_size")).otherwise(extra)
    share = (start + F.col("before")) / F.greatest(F.col("target"), extra.cast("double"), F.lit(1.0))
    copies = (
        _decided(each)
        .where("copies > 0")
        .withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)))
        .select("_row", "_unit", "nth", "copy", position(F.least(share, F.lit(1.0)), F.col("place"), schedules).alias("position"))
    )
    order = ("position", "_unit.doc_id", "copy")
    return copies.repartitionByRange(*order).sortWithinPartitions(*order)


def curriculum(docs: DataFrame, planned: DataFrame, schedules: Sequence[Schedule] = SCHEDULES) -> DataFrame:
    """The rows of docs as often as they are taken, in training order.

    Added: copy (from 0) and position; columns of docs with these names stay as <name>_before. Partitions
    hold ascending ranges of position. Only texts that are taken are moved: once to their plan, once into order.
    """
    own = make_way(docs, *ADDED)
    return _mix(docs, planned, schedules).select(
        *(F.col("_row")[c].alias(n) for c, n in zip(docs.columns, own.columns)), "copy", "position"
    )


def stored_order(docs: DataFrame) -> DataFrame:
    """docs, read from the files that a sorted DataFrame was written to, with place: the row's number in that order.

    Spark writes partitions in order to files whose names ascend, but reads them in any order; a row's file
    and its number therein tell where it stood. The files' row counts are summed, a row a file.
    """
    docs = make_way(docs, "place")
    rows = docs.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_row"))
    files = rows.groupBy("_file").agg(F.count("*").alias("_rows"))
    before = F.sum("_rows").over(Window.orderBy("_file").rowsBetween(Window.unboundedPreceding, -1))
    starts = stored(files.select(F.col("_file").alias("_of"), F.coalesce(before, F.lit(0)).alias("_start")), "starts")
    if starts.count() <= 100_000:  # files; then texts need not move
        starts = F.broadcast(starts)
    found = rows.join(starts, F.col("_file") == F.col("_of"))
    return found.select(*docs.columns, (F.col("_start") + F.col("_row")).cast("long").alias("place"))


def taken(docs: DataFrame, weights: Sequence[int] = (5, 2, 1), max_repeats: int = 3) -> DataFrame:
    """The contract's row of each document, and the position of its first copy (null: not taken).

    The mix is written in training order, each copy with its text and the words counted in it; taken and
    position are what its files hold of the document.
    """
    key = ("doc_id", "source", "tie", "nth")
    docs = docs.select("doc_id", "source", "text")
    planned = stored(plan(docs, weights, max_repeats), "plan")
    text = F.col("_row.text")
    mixed = stored(
        _mix(docs, planned).select("_unit.doc_id", "_unit.source", "_unit.tie", "nth", text, _size(text).alias("words"), "copy", "position"),
        "mix", compression="zstd",
    )
    nothing = (F.lit(None).cast(kind).alias(c) for c, kind in (("size", "long"), ("source_size", "long"), ("target", "double")))
    copies = mixed.select(*key, *nothing, "words", "position")
    wanted = planned.select(
        *key, "size", "source_size", "target", F.lit(0).cast("long").alias("words"), F.lit(None).cast("double").alias("position")
    )
    return (
        wanted.unionByName(copies)
        .groupBy(*key)
        .agg(
            *(F.max(c).alias(c) for c in ("size", "source_size", "target")),
            F.sum("words").alias("taken"), F.round(F.min("position"), 9).alias("position"),
        )
        .select("doc_id", "size", "source_size", "target", "taken", "position")
    )


TAKEN_SQL = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
         md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS ord FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS s FROM d GROUP BY source),
w AS (SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3
                WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS w FROM s),
o AS (SELECT *, row_number() OVER (ORDER BY 3.0 * s / w, source NULLS LAST) AS k FROM w),
r AS (
  SELECT *, CAST((SELECT sum(s) FROM s) - coalesce(sum(3 * s) OVER b, 0) AS BIGINT) AS rem,
         CAST((SELECT sum(w) FROM w) - coalesce(sum(w) OVER b, 0) AS BIGINT) AS free
  FROM o WINDOW b AS (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f AS (SELECT * FROM r WHERE CAST(rem * w AS DOUBLE) / free <= 3 * s ORDER BY k LIMIT 1),
t AS (
  SELECT r.source, r.s, CASE WHEN r.k < f.k THEN CAST(3 * r.s AS DOUBLE)
                        ELSE CAST(f.rem * r.w AS DOUBLE) / f.free END AS target FROM r, f),
c AS (
  SELECT d.*, t.s, t.target, CASE WHEN t.s > 0 THEN CAST(floor(t.target / t.s) AS BIGINT) ELSE 0 END AS passes,
         CAST(coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.ord, d.doc_id, d.size
              ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS before
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
p AS (SELECT *, passes + CASE WHEN before + size / 2.0 < target - passes * s THEN 1 ELSE 0 END AS copies FROM c),
x AS (SELECT *, least(before / greatest(target, 1.0), 1.0) AS share,
             (SELECT count(*) FROM s WHERE s.source < p.source OR (p.source IS NULL AND s.source IS NOT NULL)) % 3 AS place
      FROM p)
SELECT doc_id, CAST(size AS BIGINT) AS size, s AS source_size, target, CAST(size * copies AS BIGINT) AS taken,
       CASE WHEN copies > 0 THEN round(CASE place
            WHEN 0 THEN 2.0 * share / (sqrt(0.25 + 2.0 * share) + 0.5)
            WHEN 1 THEN 2.0 * share / 2.0
            ELSE 2.0 * share / (sqrt(2.25 - 2.0 * share) + 1.5) END, 9) END AS position
FROM x
"""

"""Which subscribers match which campaigns, and when a match is reported."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..functions.values import compared, matches as text_matches
from ..sources.rules import INTERVALS, TEXT_TYPES, Rules
from ..storage import stored
from .campaign_index import matching

_DAY_MS = 86_400_000


def predicate_values(wide: DataFrame, rules: Rules) -> DataFrame:
    """(subscriber_id, campaign, conjunct, predicate, holds): predicates on null attributes are false.

    Only attributes that rules name are unpivoted; the rules are the small side of the join.
    """
    flat = rules.flat()
    used = sorted(r["attribute"] for r in flat.select("attribute").distinct().collect())  # columns of wide
    _known(wide, used)
    each = [
        F.struct(F.lit(a).alias("attribute"), _number(wide, a).alias("measured"), F.col(a).cast("string").alias("said"))
        for a in used
    ]
    values = wide.select("subscriber_id", F.explode(F.array(*each)).alias("of")).select("subscriber_id", "of.*")
    return values.join(flat, "attribute").select(
        "subscriber_id", "campaign", "conjunct", "predicate",
        F.when(F.col("data_type").isin(*TEXT_TYPES), text_matches(F.col("said"), F.col("operator"), F.col("value")))
        .otherwise(compared(F.col("measured"), F.col("operator"), F.expr("try_cast(value AS double)")))
        .alias("holds"),
    )


def _known(wide: DataFrame, used: list[str]) -> None:
    if missing := [a for a in used if a not in wide.columns]:
        raise ValueError(f"rules name attributes that the table does not have: {missing}")


def _number(wide: DataFrame, name: str) -> Column:
    """A column as a double; null where it is text."""
    return F.lit(None).cast("double") if isinstance(wide.schema[name].dataType, T.StringType) else F.col(name).cast("double")


def conjunct_values(predicates: DataFrame) -> DataFrame:
    """A conjunct holds if all its predicates do."""
    return predicates.groupBy("subscriber_id", "campaign", "conjunct").agg(F.bool_and("holds").alias("holds"))


def campaign_values(conjuncts: DataFrame) -> DataFrame:
    """A campaign holds if any of its conjuncts does."""
    return conjuncts.groupBy("subscriber_id", "campaign").agg(F.bool_or("holds").alias("holds"))


def valid_at(campaigns: DataFrame, as_of_ms: int) -> DataFrame:
    return campaigns.where((F.col("valid_from") <= as_of_ms) & (F.col("valid_to") > as_of_ms))


def matches(wide: DataFrame, rules: Rules, as_of_ms: int | None = None, compiled: int = 300_000) -> DataFrame:
    """(subscriber_id, campaign) of campaigns that hold, of those valid at a time if one is given.

    Up to `compiled` predicates (some 60 MB) become an index that goes to all tasks, and nothing is shuffled;
    more are joined and grouped, with the same result.
    """
    valid = None if as_of_ms is None else valid_at(rules.campaign, as_of_ms).select(F.col("id").alias("campaign"))
    flat = rules.flat() if valid is None else rules.flat().join(valid, "campaign", "left_semi")
    rows = flat.limit(compiled + 1).collect()
    if len(rows) <= compiled:
        _known(wide, sorted({r["attribute"] for r in rows}))
        return matching(wide, rows)
    found = campaign_values(conjunct_values(predicate_values(wide, rules))).where("holds").drop("holds")
    if valid is None:
        return found
    return found.join(valid, "campaign", "left_semi").select("subscriber_id", "campaign")


_KEY = ("subscriber_id", "campaign")


def _hops(rows: DataFrame) -> DataFrame:
    """(subscriber_id, campaign, at_ms, next_ms): of each candidate the first one an interval later or more.

    Time is cut into chunks of an interval, so that one lies in the chunk after the candidate's own, at or after a
    mark there, or else is the first of a later chunk. Rows meet by chunk; one row a chunk meets by key.
    """
    chunk = lambda at: F.floor(at / F.col("interval_ms")).cast("long")
    firsts = rows.groupBy(*_KEY, chunk(F.col("at_ms")).alias("chunk")).agg(F.min("at_ms").alias("first_ms"))
    later = Window.partitionBy(*_KEY).orderBy("chunk")
    beyond = firsts.select(  # the first candidate after the next chunk, by the chunk of the mark
        *_KEY, (F.col("chunk") + 1).alias("chunk"),
        F.when(F.lead("chunk").over(later) > F.col("chunk") + 1, F.lead("first_ms").over(later))
        .otherwise(F.lead("first_ms", 2).over(later)).alias("beyond_ms"),
    )
    own = F.struct(F.lit(1).alias("candidate"), F.col("at_ms").alias("mark_ms"))
    ends = F.struct(F.lit(0).alias("candidate"), (F.col("at_ms") + F.col("interval_ms")).alias("mark_ms"))
    marks = rows.select("*", F.inline(F.array(own, ends))).withColumn("chunk", chunk(F.col("mark_ms")))
    back = Window.partitionBy(*_KEY, "chunk").orderBy(F.desc("mark_ms"), F.desc("candidate"))
    back = back.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    inside = F.min(F.when(F.col("candidate") == 1, F.col("mark_ms"))).over(back)
    found = marks.withColumn("inside_ms", inside).where("candidate = 0").join(beyond, [*_KEY, "chunk"])
    return found.select(*_KEY, "at_ms", F.coalesce("inside_ms", "beyond_ms").alias("next_ms"))


def _sliding_reports(rows: DataFrame) -> DataFrame:
    """Of rows (subscriber_id, campaign, at_ms, interval_ms) the first of each key, and what its hops lead to.

    Hops are doubled: after k rounds all reports within 2^k - 1 hops of the first are found. No two
    reports are in a chunk of an interval, so the chunks that a key can have tell how many rounds there are.
    """
    span = F.max(F.floor(F.col("at_ms") / F.col("interval_ms"))) - F.min(F.floor(F.col("at_ms") / F.col("interval_ms"))) + 1
    reached = rows.groupBy(*_KEY).agg(F.min("at_ms").alias("at_ms"))
    chunks = rows.groupBy("interval_ms").agg(span.alias("chunks")).agg(F.max("chunks")).first()[0] or 0
    hops = stored(_hops(rows).where("next_ms is not null"), "hops")
    for k in range(int(chunks - 1).bit_length() if chunks else 0):
        if k:
            onward = hops.select(*_KEY, F.col("at_ms").alias("next_ms"), F.col("next_ms").alias("onward_ms"))
            hops = stored(hops.join(onward, [*_KEY, "next_ms"]).select(*_KEY, "at_ms", F.col("onward_ms").alias("next_ms")), "hops")
        both = F.explode(F.array_compact(F.array("at_ms", "next_ms")))
        reached = reached.join(hops, [*_KEY, "at_ms"], "left").select(*_KEY, both.alias("at_ms"))
    return reached


def with_intervals(candidates: DataFrame, campaigns: DataFrame) -> DataFrame:
    """candidates while their campaign is valid, with its valid_from, interval_ms and firing_start_condition."""
    interval = F.create_map(*(F.lit(x) for k, v in INTERVALS.items() for x in (k, v * _DAY_MS)))
    known = campaigns.select(
        F.col("id").alias("campaign"), "valid_from", "valid_to", "firing_start_condition",
        interval[F.col("firing_interval")].cast("long").alias("interval_ms"),
    )
    # A row per campaign; broadcast where its size allows.
    return candidates.join(known, "campaign").where("at_ms >= valid_from and at_ms < valid_to")


def reports(candidates: DataFrame, campaigns: DataFrame) -> DataFrame:
    """Of candidate matches (subscriber_id, campaign, at_ms) those reported: one per firing interval.

    Intervals are aligned to the campaign's start (fixed) or begin at the last report (sliding).
    Fixed ones are arithmetic; sliding ones follow hops from report to report.
    """
    rows = with_intervals(candidates.select("subscriber_id", "campaign", "at_ms").distinct(), campaigns)
    columns = ("subscriber_id", "campaign", "at_ms")
    always = rows.where("interval_ms = 0").select(*columns)
    period = F.floor((F.col("at_ms") - F.col("valid_from")) / F.col("interval_ms"))
    fixed = (
        rows.where("interval_ms > 0 and firing_start_condition = 'fixed'")
        .groupBy("subscriber_id", "campaign", period.alias("period"))
        .agg(F.min("at_ms").alias("at_ms"))
        .select(*columns)
    )
    sliding = rows.where("interval_ms > 0 and firing_start_condition = 'sliding'").select(*columns, "interval_ms")
    sliding = _sliding_reports(stored(sliding, "candidates"))
    return always.unionByName(fixed).unionByName(sliding)

"""The catalogue of attributes: which aggregate of which metric, over which calls and window.

A row describes one column of the wide table. Catalogues are tables (wt_attribute and metric) or
generated; both give the same list of attributes, from which column expressions are built.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

AGGREGATES = ("sum", "min", "max")
METRICS = ("call", "dur", "cost")
FILTERS = ("all", "local", "nonlocal")
WINDOWS = ("day", "week")
#: The words of a catalogue table.
WINDOW_SIZES = {"d": "day", "w": "week"}
WINDOW_TYPES = ("tumb", "step", "cont")


@dataclass(frozen=True, order=True)
class Attribute:
    aggregate: str
    metric: str
    filter: str
    window: str
    kind: str = "tumb"

    def __post_init__(self) -> None:
        known = (AGGREGATES, self._metrics(), FILTERS, WINDOWS, WINDOW_TYPES)
        for value, allowed in zip((self.aggregate, self.metric, self.filter, self.window, self.kind), known):
            if value not in allowed:
                raise ValueError(f"{value!r} is none of {allowed}")

    def _metrics(self) -> Sequence[str]:
        return METRICS

    @property
    def name(self) -> str:
        tail = "" if self.kind == "tumb" else f"_{self.kind}"
        return f"{self.aggregate}_{self.metric}_{self.filter}_{self.window}{tail}"

    @property
    def description(self) -> str:
        of = self.metric if self.filter == "all" else f"{self.filter} {self.metric}"
        return f"{self.aggregate}({of}) per {self.window}"


@dataclass(frozen=True, order=True)
class DerivedAttribute(Attribute):
    """An attribute of a metric that is computed from calls by an expression; see streaming.evolving."""

    def _metrics(self) -> Sequence[str]:
        return (self.metric,) if self.metric.isidentifier() and "_" not in self.metric else ()


def attribute(name: str) -> Attribute:
    return Attribute(*name.split("_"))


def generated() -> list[Attribute]:
    """All attributes: calls are only summed, so 42."""
    return [
        Attribute(a, m, f, w)
        for w in WINDOWS
        for f in FILTERS
        for m in METRICS
        for a in AGGREGATES
        if m != "call" or a == "sum"
    ]


def as_table(spark: SparkSession, attributes: Iterable[Attribute]) -> DataFrame:
    rows = [(i, x.aggregate, x.metric, x.filter, x.window, x.kind, x.name, x.description) for i, x in enumerate(attributes)]
    return spark.createDataFrame(
        rows, "attr_id int, aggregate string, metric string, filter string, window string, kind string, name string, description string"
    )


def load(wt_attribute: DataFrame, metric: DataFrame) -> list[Attribute]:
    """Attributes in the order of their ids, each once; unknown words and metrics raise.

    Metric names are like dur, local_dur or nonlocal_dur; a missing prefix means all calls.
    """
    rows = (
        wt_attribute.join(metric.select(F.col("id").alias("metric"), F.col("name").alias("metric_name")), "metric", "left")
        .orderBy("id")
        .select("metric_name", "window_type", "window_size", "aggr_fun")
        .collect()  # the catalogue becomes columns, so it fits the driver
    )
    found: dict[Attribute, None] = {}
    for row in rows:
        if row["metric_name"] is None:
            raise ValueError("an attribute of a metric that is not in the table")
        prefix, _, of = row["metric_name"].rpartition("_")
        window = WINDOW_SIZES.get(row["window_size"], row["window_size"])
        found[Attribute(row["aggr_fun"], of, prefix or "all", window, row["window_type"])] = None
    return list(found)


def window_of(code: Column) -> Column:
    """The window that a catalogue table's word stands for; other words stay."""
    return F.coalesce(*(F.when(code == k, F.lit(v)) for k, v in WINDOW_SIZES.items()), code)


def described(aggregate: Column, metric: Column, filter: Column, window: Column) -> Column:
    """Attribute.description over the columns of as_table()."""
    of = F.when(filter == "all", metric).otherwise(F.concat_ws(" ", filter, metric))
    return F.concat(aggregate, F.lit("("), of, F.lit(") per "), window)


def named(wt_attribute: DataFrame, metric: DataFrame) -> DataFrame:
    """(id, name) of each row of a catalogue table, as load() names them; rows of unknown metrics are left out."""
    parts = F.split("metric_name", "_")
    return wt_attribute.join(metric.select(F.col("id").alias("metric"), F.col("name").alias("metric_name")), "metric").select(
        "id",
        F.concat_ws(
            "_", "aggr_fun", F.element_at(parts, -1), F.when(F.size(parts) > 1, F.get(parts, 0)).otherwise("all"), window_of(F.col("window_size")),
            F.when(F.col("window_type") != "tumb", F.col("window_type")),
        ).alias("name"),
    )


def names(attributes: Sequence[Attribute]) -> list[str]:
    return [a.name for a in attributes]

"""The tables of campaign rules: a campaign holds if any of its conjuncts does, a conjunct if all its predicates do."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.values import OPERATORS
from . import catalogue

#: Firing intervals in days (0 reports every match), and where a period begins.
INTERVALS = {"0": 0, "1d": 1, "2d": 2, "w": 7}
STARTS = ("fixed", "sliding")
#: Constants of these types are compared as text (eq, E, like), all others as numbers.
TEXT_TYPES = ("string", "text", "char", "varchar")
_TEXT_OPERATORS = ("eq", "E", "like")
#: predicate names an attribute of the wide table, or (wt_attribute) the catalogue's row of it.
SCHEMAS = {
    "campaign": "id int, valid_from long, valid_to long, firing_interval string, firing_start_condition string",
    "conjunct": "id int, campaign int",
    "conjunct_predicate": "predicate int, conjunct int",
    "predicate": "id int, attribute string, operator string, constant int",
    "constant": "id int, value string, data_type string",
}
CATALOGUE_SCHEMAS = {
    "predicate": "id int, wt_attribute int, operator string, constant int",
    "wt_attribute": "id int, metric int, is_pivot int, window_type string, window_size string, aggr_fun string, aggr_data_type string",
    "metric": "id int, name string",
}
_ARROW = {"int": pa.int32(), "long": pa.int64(), "string": pa.string()}
_REFERENCES = (
    ("conjunct", "campaign", "campaign"),
    ("conjunct_predicate", "conjunct", "conjunct"),
    ("conjunct_predicate", "predicate", "predicate"),
    ("predicate", "constant", "constant"),
)


@dataclass(frozen=True)
class Rules:
    campaign: DataFrame
    conjunct: DataFrame
    conjunct_predicate: DataFrame
    predicate: DataFrame
    constant: DataFrame
    wt_attribute: DataFrame | None = None  # (id, name), where predicates refer to it

    def checked(self) -> Rules:
        """Raises where a row refers to one that is missing, or says what would never hold or never be reported."""
        more = () if self.wt_attribute is None else (("predicate", "wt_attribute", "wt_attribute"),)
        for table, column, allowed in (
            ("predicate", "operator", OPERATORS),
            ("campaign", "firing_interval", tuple(INTERVALS)),
            ("campaign", "firing_start_condition", STARTS),
        ):
            if row := getattr(self, table).where(F.col(column).isNull() | ~F.col(column).isin(*allowed)).first():
                raise ValueError(f"{table} {row['id']}: {row[column]!r} is none of {allowed}")
        if row := self.campaign.where("valid_from is null or valid_to is null").first():
            raise ValueError(f"campaign {row['id']}: valid_from and valid_to are needed")
        for table, column, of in (*_REFERENCES, *more):
            ids = getattr(self, of).select(F.col("id").alias(column))
            if row := getattr(self, table).join(ids, column, "left_anti").first():
                raise ValueError(f"{table}: {column} {row[column]} is not in {of}")
        self._check_constants()
        return self

    def _check_constants(self) -> None:
        text = F.coalesce(F.col("data_type").isin(*TEXT_TYPES), F.lit(False))
        number = F.col("value").try_cast("double")
        finite = F.coalesce(F.abs(number) < float("inf"), F.lit(False))  # NaN is larger
        if row := self.constant.where(~text & ~finite | text & F.col("value").isNull()).first():
            raise ValueError(f"constant {row['id']}: {row['value']!r} is no {row['data_type']}")
        of = self.predicate.join(self.constant.select(F.col("id").alias("constant"), "value", "data_type"), "constant")
        misplaced = F.when(text, ~F.col("operator").isin(*_TEXT_OPERATORS)).otherwise(F.col("operator") == "like")
        if row := of.where(misplaced).first():
            raise ValueError(f"predicate {row['id']}: {row['operator']!r} of a constant of type {row['data_type']}")

    def flat(self) -> DataFrame:
        """(campaign, conjunct, predicate, attribute, operator, value, data_type) of each predicate in each conjunct."""
        predicate = self.predicate.withColumnRenamed("id", "predicate")
        if self.wt_attribute is not None:
            predicate = predicate.join(
                self.wt_attribute.select(F.col("id").alias("wt_attribute"), F.col("name").alias("attribute")), "wt_attribute"
            )
        return (
            self.conjunct.select(F.col("id").alias("conjunct"), "campaign")
            .join(self.conjunct_predicate, "conjunct")
            .join(predicate, "predicate")
            .join(self.constant.select(F.col("id").alias("constant"), "value", "data_type"), "constant")
            .select("campaign", "conjunct", "predicate", "attribute", "operator", "value", "data_type")
        )


def _of(read: Callable[[str, str], DataFrame], by_id: bool) -> Rules:
    schemas = SCHEMAS | (CATALOGUE_SCHEMAS if by_id else {})
    tables = {name: read(name, schema) for name, schema in schemas.items()}
    if by_id:
        tables["wt_attribute"] = catalogue.named(tables["wt_attribute"], tables.pop("metric"))
    return Rules(**tables).checked()


def load(spark: SparkSession, folder: str) -> Rules:
    """From Parquet files; where predicate has wt_attribute, from wt_attribute and metric as well."""
    by_id = "wt_attribute" in spark.read.parquet(f"{folder}/predicate.parquet").columns
    return _of(lambda name, schema: spark.read.schema(schema).parquet(f"{folder}/{name}.parquet"), by_id)


def from_rows(spark: SparkSession, tables: dict[str, Sequence[tuple]]) -> Rules:
    """From rows in the driver, which become local tables of known size: Spark joins them without shuffles."""

    def local(name: str, schema: str) -> DataFrame:
        names, kinds = zip(*(field.split() for field in schema.split(", ")))
        columns = zip(*tables[name]) if tables[name] else ((),) * len(names)
        arrays = [pa.array(c, _ARROW[kind]) for c, kind in zip(columns, kinds, strict=True)]
        return spark.createDataFrame(pa.table(arrays, list(names)))

    return _of(local, "wt_attribute" in tables)


def listing(rules: Rules) -> DataFrame:
    """(campaign, condition): predicates joined by AND, conjuncts by OR, in the order of their ids."""
    text = F.concat_ws(" ", "attribute", "operator", "value")
    conjuncts = (
        rules.flat()
        .groupBy("campaign", "conjunct")
        .agg(F.array_sort(F.collect_list(F.struct("predicate", text.alias("text")))).alias("parts"))
        .select("campaign", "conjunct", F.concat(F.lit("("), F.concat_ws(" AND ", "parts.text"), F.lit(")")).alias("text"))
    )
    return conjuncts.groupBy("campaign").agg(
        F.concat_ws(" OR ", F.array_sort(F.collect_list(F.struct("conjunct", "text")))["text"]).alias("condition")
    )

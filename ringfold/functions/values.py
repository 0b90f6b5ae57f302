"""Scalar expressions that queries and rules share."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F


#: A rule's comparisons; eq may be written E.
OPERATORS = ("lt", "lte", "gr", "gre", "eq", "E", "like")


def guarded_ratio(numerator: Column, denominator: Column) -> Column:
    """A double; null where the denominator is 0 or null."""
    return F.try_divide(numerator.cast("double"), denominator.cast("double"))


def compared(value: Column, operator: Column, constant: Column) -> Column:
    """A rule's comparison; unknown operators and null values are false."""
    found = (
        F.when(operator == "lt", value < constant)
        .when(operator == "lte", value <= constant)
        .when(operator == "gr", value > constant)
        .when(operator == "gre", value >= constant)
        .when(operator.isin("eq", "E"), value == constant)
        .otherwise(F.lit(False))
    )
    return F.coalesce(found, F.lit(False))


def matches(value: Column, operator: Column, pattern: Column) -> Column:
    """The comparison of text constants: eq or like."""
    found = F.when(operator == "like", F.like(value, pattern)).when(operator.isin("eq", "E"), value == pattern)
    return F.coalesce(found, F.lit(False))


def decoded(code: Column, labels: Mapping[int, str]) -> Column:
    return F.create_map(*(F.lit(x) for pair in labels.items() for x in pair))[code.cast("int")]


def encoded(label: Column, labels: Mapping[int, str]) -> Column:
    codes = {v: k for k, v in labels.items()}
    return F.create_map(*(F.lit(x) for pair in codes.items() for x in pair))[label].cast("short")

"""Connected components of a distributed edge list."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored


def connected_components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, component): of every node of edges the smallest node that it can reach.

    Alternating large-star and small-star rounds, of which about log(n) are needed. Each is an
    aggregate and a join on the node, so that the edges of a hub can be split between tasks, and
    each is written before the next. Loops and repeated edges are allowed; rows with a null end
    are left out; no edges give no rows.
    """
    found = stored(
        edges.where(F.col(a) != F.col(b))
        .select(F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo"))
        .distinct(),
        "edges",
    )
    mark = None
    while (now := _mark(found)) != mark:
        mark = now
        found = stored(_small_star(_large_star(found)), "edges")
    return found.select(F.col("hi").alias("node"), F.col("lo").alias("component")).union(
        found.select("lo", "lo").distinct()
    )


def _mark(edges: DataFrame) -> tuple:
    return tuple(
        edges.agg(
            F.count("*"),
            F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)")),
        ).first()
    )


def _large_star(edges: DataFrame) -> DataFrame:
    """Link the larger neighbours of each node to the smallest of it and its neighbours."""
    both = edges.select(F.col("hi").alias("u"), F.col("lo").alias("v")).union(edges.select("lo", "hi"))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return (
        both.where("v > u")
        .join(least, "u")
        .select(F.col("v").alias("hi"), F.col("m").alias("lo"))
        .distinct()
    )


def _small_star(edges: DataFrame) -> DataFrame:
    """Link each node and its smaller neighbours to the smallest of these."""
    least = edges.groupBy("hi").agg(F.min("lo").alias("m"))
    return (
        edges.join(least, "hi")
        .select("lo", "m")
        .where("lo > m")
        .union(least)
        .toDF("hi", "lo")
        .distinct()
    )

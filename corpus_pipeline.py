"""Five operators in a row over documents; each stage's rows are written before the next reads them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ringfold.llm import bpe, minhash, mixing, quality, toxicity
from ringfold.llm.common import make_way, stored
from ringfold.llm.registry import VOCABULARY, table

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity classifier rejects go."""
    return toxicity.keep_clean(docs, table(spark, sf_dir, "labels"))


def drop_poor(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document with the smallest id stays."""
    return minhash.keep_one(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's target asks for, written in training order."""
    own = make_way(docs, *mixing.ADDED).columns
    mixed = mixing.curriculum(docs, mixing.plan(docs))
    return mixed.select(*(F.col(o).alias(c) for o, c in zip(own, docs.columns)))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, checked by decoding them, and its place in the training order."""
    coded = mixing.stored_order(docs).withColumn("coded", bpe.checked(F.col("text"), VOCABULARY))
    ids = F.col("coded.ids")
    return coded.select(
        "place", "doc_id", "lang", "source", ids.alias("ids"), F.size(ids).cast("long").alias("n_tokens"), "coded.decodes"
    )


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", drop_toxic),
    ("quality", drop_poor),
    ("near_duplicates", drop_copies),
    ("mixing", mix),
    ("bpe", encode),
]

#: Trained models and merges are not expressible in SQL.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)

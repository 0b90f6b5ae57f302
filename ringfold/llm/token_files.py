"""Token ids as Parquet lists, in document order, and selective reads of them.

Files are Spark's own Parquet: version 2 pages, so that integers are dictionary or delta encoded,
with bounded row groups and pages and a page index, which lets a reader skip pages by doc_id and
read counts without touching ids.

Columns: the document's key, position (ascends along the order), n_tokens and ids. Rows ascend by
key over the files in name order; null keys come first, rows of equal key stand by their text.
Null and empty texts have the end id alone. An empty table gives files without rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Sequence
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import ChunkEncoder, encode_with, library
from .common import laid_out, new_path, running_start


def library_encoder(path: str) -> ChunkEncoder:
    """Ids by the tokenizers library, which is asked once for each chunk that is not in the cache."""
    tokenizer = library(path)

    def fresh(chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        found = [e.ids for e in tokenizer.encode_batch_fast(chunks, add_special_tokens=False)]
        lens = np.fromiter(map(len, found), np.int64, len(found))
        return np.fromiter(chain.from_iterable(found), np.int32, int(lens.sum())), lens

    special = {t.content: i for i, t in tokenizer.get_added_tokens_decoder().items()}
    return ChunkEncoder(fresh, special)


def write(
    docs: DataFrame,
    path: str,
    vocabulary: str,
    key: str = "doc_id",
    text: str = "text",
    end_id: int = 0,
    row_group_bytes: int = 32 << 20,
    page_bytes: int = 256 << 10,
    page_rows: int = 2_000,
) -> None:
    """Write the ids of docs to path. Texts are put in order first, so that only they are shuffled."""
    texts = docs.select(docs[key].alias("doc_id"), docs[text].cast("string").alias("text"))
    ids = encode_with(library_encoder, vocabulary, F.col("text"), end_id)
    (
        laid_out(texts, "doc_id", F.xxhash64("text"), F.length("text"), at="position")
        .select("doc_id", "position", ids.alias("ids"))
        .select("doc_id", "position", F.size("ids").alias("n_tokens"), "ids")
        .write.option("parquet.writer.version", "v2")
        .option("parquet.enable.dictionary", "true")
        .option("parquet.block.size", row_group_bytes)
        .option("parquet.page.size", page_bytes)
        .option("parquet.page.row.count.limit", page_rows)
        .option("compression", "zstd")
        .parquet(path)
    )


def read(
    spark: SparkSession,
    path: str,
    first: int | None = None,
    last: int | None = None,
    columns: Sequence[str] = ("doc_id", "position", "n_tokens", "ids"),
) -> DataFrame:
    """Documents with ids from first to last (None: from the start, to the end), and only those columns.

    Both bounds are pushed to the scan. As files ascend by doc_id it opens only row groups, and by the
    page indexes only pages, that can hold such documents; ids are not touched unless asked for.
    """
    found = spark.read.parquet(path)
    if first is not None:
        found = found.where(F.col("doc_id") >= first)
    if last is not None:
        found = found.where(F.col("doc_id") <= last)
    return found.select(*columns)


def read_some(spark: SparkSession, path: str, wanted: DataFrame) -> DataFrame:
    """Documents whose ids are in wanted (doc_id): a scan within its bounds, then a semi-join."""
    first, last = wanted.agg(F.min("doc_id"), F.max("doc_id")).first()
    return read(spark, path, first, last).join(wanted.select("doc_id"), "doc_id", "left_semi")


def starts(tokens: DataFrame) -> DataFrame:
    """Rows of read() with start: the ids of all documents before, from the counts alone."""
    return running_start(tokens, "position", "n_tokens", "start")


def checksums(tokens: DataFrame, ids: str = "ids", out: str = "ids_crc32") -> DataFrame:
    """tokens with out: the CRC-32 of each list as little-endian unsigned 32-bit integers."""

    @F.arrow_udf("long")
    def crc(lists: pa.Array) -> pa.Array:
        flat = lists.flatten().to_numpy(zero_copy_only=False).astype("<u4").tobytes()
        ends = np.cumsum(lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)) * 4
        begins = np.append(0, ends[:-1])
        view = memoryview(flat)
        return pa.array([zlib.crc32(view[a:b]) for a, b in zip(begins, ends)], pa.int64())

    return tokens.withColumn(out, crc(tokens[ids]))


def round_trip(docs: DataFrame, vocabulary: str) -> DataFrame:
    """The contract's rows: write docs, read the files back, and tell where each document stands."""
    spark = docs.sparkSession
    path = new_path(spark, "tokens")
    write(docs, path, vocabulary)
    files = checksums(read(spark, path)).select("doc_id", "position", "n_tokens", "ids_crc32")
    return starts(files).select("doc_id", "start", F.col("n_tokens").cast("long"), "ids_crc32")

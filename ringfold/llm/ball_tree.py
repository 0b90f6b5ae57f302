"""Exact top-k inner-product search: a ball tree per shard, searched by branch and bound.

Vectors are dealt to shards by id. Each query is first searched in its own shard; the k-th score
found there goes with it to all other shards, where it prunes from the start. In a shard each query has an
upper bound for every node, q.c + |q| r: it first reads the leaf under the best child at each node, nodes
whose bound is below its k-th score are cut off with all that is under them, and the leaves that remain are
read in the order of their bounds while the k-th score rises. The bounds of a batch of queries are one
matrix product. A task holds one shard, of shard_bytes at most, and one batch of queries at a time.

Defined results: vectors that are null or hold null or non-finite components take no part; only
vectors of equal length are compared, and empty ones with none; rows of the query's own id are no candidates
(nor is another vector under that id; an id with two vectors asks and answers with both); exact repeats of
a row count once; fewer candidates than k are all returned; no vectors give no rows. Scores are
64-bit integers: the components' products must sum to less than 2^63.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import stored

LEAF, BLOCK = 128, 1024
_NONE = np.iinfo(np.int64).min
_EXACT = float(1 << 53)
_FOUND = "query_id long, vec_id long, score long"


class BallTree:
    """A balanced tree over rows of integers; node i has children 2i+1 and 2i+2."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, leaf: int = LEAF):
        self.depth = max(0, int(np.ceil(np.log2(max(1, len(ids)) / leaf))))
        order = np.arange(len(ids))
        exact = vectors.astype(np.float64)
        spans = [(0, len(ids))]
        centers, radii = [], []
        for level in range(self.depth + 1):
            following = []
            for a, b in spans:
                rows = exact[order[a:b]]
                center = rows.mean(axis=0) if b > a else np.zeros(vectors.shape[1])
                away = np.sqrt(((rows - center) ** 2).sum(axis=1))
                centers.append(center)
                radii.append(away.max(initial=0.0))
                if level < self.depth:
                    middle = (a + b) // 2
                    if b - a > 1:
                        far = rows[away.argmax()]
                        axis = rows[((rows - far) ** 2).sum(axis=1).argmax()] - far
                        split = np.argpartition(rows @ axis, middle - a)
                        order[a:b] = order[a:b][split]
                    following += [(a, middle), (middle, b)]
            spans = following or spans
        self.centers, self.radii, self.spans = np.array(centers), np.array(radii), spans
        self.sizes = np.sqrt((self.centers**2).sum(axis=1)) + self.radii
        self.ids, self.vectors = ids[order], vectors[order]
        self.compared = 0  # rows that have been scored, over all queries
        self.most = float(np.abs(exact).max(initial=0.0))

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        """An upper bound of q.v for each query (row) in each node (column), safe against rounding."""
        norms = np.sqrt((queries**2).sum(axis=1))
        return queries @ self.centers.T + norms[:, None] * (self.radii + 1e-9 * self.sizes) + 1e-6

    def scores(self, queries: np.ndarray, leaf: int) -> np.ndarray:
        a, b = self.spans[leaf]
        rows = self.vectors[a:b]
        if self.most * float(np.abs(queries).max(initial=0)) * max(1, rows.shape[1]) < _EXACT:
            return np.rint(queries.astype(np.float64) @ rows.T.astype(np.float64)).astype(np.int64)
        return queries @ rows.T

    def search(self, query_ids: np.ndarray, queries: np.ndarray, floor: np.ndarray, k: int):
        """(query row, vec_id, score) of each query's k best here that reach its floor."""
        n = len(query_ids)
        best = np.full((n, k), _NONE)
        best_ids = np.full((n, k), np.iinfo(np.int64).max)
        bounds = self.bounds(queries.astype(np.float64))
        every = np.arange(n)
        first_leaf = 2**self.depth - 1

        def read(rows: np.ndarray, leaf: int) -> None:
            a, b = self.spans[leaf]
            self.compared += len(rows) * (b - a)
            found = self.scores(queries[rows], leaf)
            ids = np.broadcast_to(self.ids[a:b], found.shape)
            found = np.where(ids == query_ids[rows, None], _NONE, found)
            better = (found >= np.maximum(best[rows, -1], floor[rows])[:, None]).any(axis=1)
            rows, found, ids = rows[better], found[better], ids[better]
            found = np.concatenate([best[rows], found], axis=1)
            ids = np.concatenate([best_ids[rows], ids], axis=1)
            top = np.lexsort((ids, ~found), axis=-1)[:, :k]
            best[rows] = np.take_along_axis(found, top, axis=1)
            best_ids[rows] = np.take_along_axis(ids, top, axis=1)

        def read_all(rows: np.ndarray, leaves: np.ndarray) -> None:
            order = np.argsort(leaves, kind="stable")
            cuts = np.flatnonzero(np.diff(leaves[order])) + 1
            for part in np.split(order, cuts):
                if len(part):
                    read(rows[part], int(leaves[part[0]]))

        near = np.zeros(n, np.int64)  # the leaf under the best child at each node
        for _ in range(self.depth):
            left, right = bounds[every, 2 * near + 1], bounds[every, 2 * near + 2]
            near = 2 * near + np.where(left >= right, 1, 2)
        near -= first_leaf
        read_all(every, near)

        rows, nodes = every, np.zeros(n, np.int64)
        bound = bounds[:, 0]
        for level in range(self.depth + 1):
            alive = bound >= np.maximum(best[rows, -1], floor[rows])
            rows, nodes, bound = rows[alive], nodes[alive], bound[alive]
            if level < self.depth:
                rows = np.repeat(rows, 2)
                nodes = np.repeat(2 * nodes, 2) + np.tile([1, 2], len(nodes))
                bound = bounds[rows, nodes]
        leaves = nodes - first_leaf
        new = leaves != near[rows]
        rows, leaves, bound = rows[new], leaves[new], bound[new]
        order = np.lexsort((-bound, rows))
        rows, leaves, bound = rows[order], leaves[order], bound[order]
        starts = np.flatnonzero(np.append(True, rows[1:] != rows[:-1])) if len(rows) else np.zeros(0, np.int64)
        place = np.arange(len(rows)) - np.repeat(starts, np.diff(np.append(starts, len(rows))))
        done, width = 0, 1
        while len(rows) and done <= place.max():  # best bounds first, in growing steps
            now = (place >= done) & (place < done + width) & (bound >= np.maximum(best[rows, -1], floor[rows]))
            read_all(rows[now], leaves[now])
            done, width = done + width, 2 * width
        row, column = np.nonzero((best > _NONE) & (best >= floor[:, None]))
        return row, best_ids[row, column], best[row, column]


def _searcher(k: int):
    """Rows of a shard come before its queries; (dim, shard, kind) are sorted."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, tree, parts = None, None, []
        for batch in batches:
            dim, shard, kind, ids, floor = (
                batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1, 2, 3, 5)
            )
            vectors = batch.column(4)
            if not len(ids):
                continue
            change = (dim[1:] != dim[:-1]) | (shard[1:] != shard[:-1]) | (kind[1:] != kind[:-1])
            cuts = np.concatenate([[0], np.flatnonzero(change) + 1, [len(ids)]])
            for a, b in zip(cuts[:-1], cuts[1:]):
                if (dim[a], shard[a]) != at:
                    at, tree, parts = (dim[a], shard[a]), None, []
                flat = vectors.slice(a, b - a).flatten().to_numpy(zero_copy_only=False)
                rows = flat.reshape(b - a, dim[a])
                if kind[a] == 0:
                    parts.append((ids[a:b], rows))
                    continue
                if tree is None:
                    if not parts:
                        continue
                    own, data = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
                    both = np.unique(np.column_stack([own, data]), axis=0) if len(np.unique(own)) < len(own) else None
                    tree = BallTree(own, data) if both is None else BallTree(both[:, 0], both[:, 1:])
                    parts = []
                for s in range(a, b, BLOCK):
                    e = min(b, s + BLOCK)
                    row, found, score = tree.search(ids[s:e], rows[s - a : e - a], floor[s:e], k)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(ids[s:e][row]), pa.array(found), pa.array(score)], ["query_id", "vec_id", "score"]
                    )

    return search


def integer_vectors(df: DataFrame, vec_id: str, embedding: str, scale: int) -> DataFrame:
    """(id, dim, vec): floor(scale * x) of each component x, taken as double."""
    fine = F.forall(embedding, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    vec = F.transform(embedding, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")).cast("long"))
    return (
        df.where(F.col(embedding).isNotNull() & F.col(vec_id).isNotNull() & fine)
        .select(F.col(vec_id).cast("long").alias("id"), F.size(embedding).alias("dim"), vec.alias("vec"))
        .where("dim > 0")
    )


def top_k(
    vectors: DataFrame,
    is_query: Column,
    k: int = 10,
    vec_id: str = "vec_id",
    embedding: str = "embedding",
    scale: int = 1024,
    target_shards: int = 64,
    shard_rows: tuple[int, int] = (1024, 262_144),
    shard_bytes: int = 256 << 20,
) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best rows of vectors for each that is_query marks."""
    exact = integer_vectors(vectors, vec_id, embedding, scale)
    n, longest = vectors.agg(F.count("*"), F.max(F.size(embedding))).first()
    most = max(1, min(shard_rows[1], shard_bytes // (8 * max(1, longest or 1))))
    size = min(max(-(-n // target_shards), shard_rows[0]), most)
    shards = max(1, -(-n // size))
    exact = exact.withColumn("shard", F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int"))
    queries = integer_vectors(vectors.where(is_query), vec_id, embedding, scale).withColumn(
        "home", F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int")
    )
    columns = ("dim", "shard", "kind", "id", "vec", "floor")
    data = exact.withColumns({"kind": F.lit(0), "floor": F.lit(_NONE)}).select(*columns)

    def searched(asked: DataFrame) -> DataFrame:
        return (
            data.union(asked.withColumn("kind", F.lit(1)).select(*columns))
            .repartition("dim", "shard")
            .sortWithinPartitions("dim", "shard", "kind")
            .mapInArrow(_searcher(k), _FOUND)
        )

    at_home = queries.withColumn("shard", F.col("home")).withColumn("floor", F.lit(_NONE))
    first = stored(searched(at_home), "home")
    kth = first.groupBy("query_id").agg(
        F.when(F.count("*") >= k, F.min("score")).otherwise(F.lit(_NONE)).alias("floor")
    )
    away = (
        queries.join(kth, F.col("id") == F.col("query_id"), "left")
        .withColumn("floor", F.coalesce("floor", F.lit(_NONE)))
        .withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
        .where("shard != home")
    )
    found = first.union(searched(away)) if shards > 1 else first
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (
        found.distinct()
        .withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )


TOP_K_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id,
         CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
WHERE rank <= 10
"""

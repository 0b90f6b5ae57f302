"""Ranked search of all documents for many items at once, by pipelined term partitioning.

An inverted index is built in blocks of documents: for each term of a block the places of its
documents (numbered by ascending doc_id), its occurrences and the documents' lengths. The terms that
items ask for are dealt to owners, rarest first. A bundle of items goes through the owners one after
the other; for each block of documents it carries sparse accumulators, (place, integer score), and
each owner adds the contributions of its own terms to them in a cogroup. What one owner passes on is
only what can still reach the k best: a place is dropped where its score and the most that later owners can
add stay below the k-th score of its block, so common terms, which come last, create few new accumulators.
The last owner passes on the k best places of each block, and a ranked window selects from those.

All scores are sums of integers, so neither blocks nor owners change them.

Defined results: null and texts without terms count nowhere; an item without terms, or whose
terms no document holds, has no rows; every row is a document (and every row an item) of its own, also where
ids repeat; null doc_ids rank after all others of equal score.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Callable, Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import FOLDED, lower_ascii, stored

TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: A block ends at so many documents, or postings; a bundle has so many items.
BLOCK, POSTINGS, BUNDLE_BITS = 8192, 1 << 21, 8
OWNERS = (0.5, 0.8, 0.95)  # quantiles of document frequency between which owners have their terms
#: Bytes of distinct terms up to which tasks get the items' vocabulary, and leave out what no item asks for.
VOCABULARY_BYTES = 16 << 20
_INDEX = "block long, term string, df int, most int, least int, at array<int>, tf array<int>, n array<int>, ids array<long>"
_CARRIED = "bundle long, block long, slot int, rest long, at array<int>, score array<long>"


def _lists(values: np.ndarray, ends: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pa.array(values, kind))


class _Block:
    """Postings of documents that stand together in a partition."""

    def __init__(self, wanted: frozenset[bytes] | None, size: int):
        self.wanted, self.size = wanted, size
        self.ids: list[int | None] = []
        self.n: list[int] = []
        self.terms: defaultdict[bytes, int] = defaultdict(count().__next__)
        self.each: list[int] = []  # postings of each document
        self.term: list[int] = []
        self.tf: list[int] = []

    def add(self, doc_id: int | None, words: list[bytes]) -> None:
        counts = Counter(words)
        held = counts.keys() if self.wanted is None else counts.keys() & self.wanted
        self.ids.append(doc_id)
        self.n.append(len(words))
        self.each.append(len(held))
        self.term += map(self.terms.__getitem__, held)
        self.tf += map(counts.__getitem__, held)

    def full(self) -> bool:
        return len(self.ids) >= self.size or len(self.term) >= POSTINGS

    def rows(self, block: int) -> pa.RecordBatch:
        """A row for each term, and one without term for the documents."""
        size = len(self.ids)
        order = sorted(range(size), key=lambda i: (self.ids[i] is None, self.ids[i] or 0))
        place = np.empty(size, np.int32)
        place[order] = np.arange(size, dtype=np.int32)
        lengths = np.array(self.n, np.int32)
        term, tf = np.array(self.term, np.int64), np.array(self.tf, np.int32)
        doc = np.repeat(np.arange(size), self.each)
        by_term = np.argsort(term, kind="stable")
        doc, tf = doc[by_term], tf[by_term]
        df = np.bincount(term, minlength=len(self.terms))
        ends = np.cumsum(df)
        starts = ends - df
        at, n = place[doc], lengths[doc]
        most = np.maximum.reduceat(tf, starts) if len(df) else df
        least = np.minimum.reduceat(n, starts) if len(df) else df
        nothing = np.append(ends, ends[-1:] if len(ends) else [0])
        columns = [
            pa.array([block] * (len(df) + 1), pa.int64()),
            pa.array([*self.terms, None], pa.string()),
            pa.array(np.append(df, size), pa.int32()),
            pa.array(np.append(most, 0), pa.int32()),
            pa.array(np.append(least, 0), pa.int32()),
            _lists(at, nothing, pa.int32()),
            _lists(tf, nothing, pa.int32()),
            _lists(np.concatenate([n, lengths[order]]), np.append(ends, len(n) + size), pa.int32()),
            _lists_of_last([self.ids[i] for i in order], len(df)),
        ]
        return pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in _INDEX.split(", ")])


def _lists_of_last(values: list, empty: int) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array([0] * (empty + 1) + [len(values)], pa.int32()), pa.array(values, pa.int64()))


def index(docs: DataFrame, wanted: frozenset[bytes] | None = None, size: int = BLOCK) -> DataFrame:
    """The inverted index of docs (doc_id, text), of the wanted terms or of all; to be stored before use."""

    def postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 33
        block = _Block(wanted, size)
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary())):
                if words := (text.as_py() or b"").translate(FOLDED).split():
                    block.add(doc_id, words)
                    if block.full():
                        yield block.rows(number)
                        number, block = number + 1, _Block(wanted, size)
        if block.ids:
            yield block.rows(number)

    columns = docs.select(docs["doc_id"].cast("long"), docs["text"].cast("string"))
    return columns.mapInArrow(postings, _INDEX)


def _asked(items: DataFrame) -> DataFrame:
    """(item, item_id, term): each term of an item once; item numbers the rows."""
    terms = F.array_distinct(F.regexp_extract_all(lower_ascii(items["text"].cast("string")), F.lit(TERM), F.lit(0)))
    rows = items.select(F.monotonically_increasing_id().alias("item"), items["item_id"], terms.alias("terms"))
    return stored(rows.select("item", "item_id", F.explode("terms").alias("term")), "asked")


def _vocabulary(asked: DataFrame) -> frozenset[bytes] | None:
    terms = asked.select("term").distinct()
    if (terms.agg(F.sum(F.octet_length("term"))).first()[0] or 0) > VOCABULARY_BYTES:
        return None
    return frozenset(r["term"].encode() for r in terms.collect())


def _weighed(found: DataFrame, asked: DataFrame, documents: int, length: int) -> DataFrame:
    """(bundle, term, owner, w, slots, rests): of each term the items of a bundle that ask for it.

    rests holds the most that the owners after this one can add to a document's score for each of them.
    """
    df = found.where("term is not null").groupBy("term").agg(
        F.sum("df").alias("df"), F.max("most").cast("long").alias("tf"), F.min("least").cast("long").alias("n")
    )
    m = f"(10 + (90 * n * {documents}L) div {length}L)"
    rows = asked.join(df, "term").select(
        "item", "term", "df",
        F.floor(F.lit(1000) * F.log((F.lit(2.0) * documents + 2) / (F.lit(2) * F.col("df") + 1))).cast("long").alias("w"),
        F.expr(f"(1000000000 * tf) div (1000 * tf + 8 * {m})").alias("impact"),  # of no document more
    )
    rows = stored(rows, "weighed")
    cuts = rows.select("term", "df").distinct().agg(F.percentile_approx("df", list(OWNERS))).first()[0] or []
    owner = sum((F.when(F.col("df") > cut, 1).otherwise(0) for cut in cuts), F.lit(0))
    after = Window.partitionBy("item").orderBy(F.desc("owner")).rangeBetween(Window.unboundedPreceding, -1)
    rest = F.coalesce(F.sum(F.col("w") * F.col("impact")).over(after), F.lit(0))
    return (
        rows.withColumn("owner", owner)
        .withColumn("rest", rest)
        .groupBy(F.shiftright("item", BUNDLE_BITS).alias("bundle"), "term", "owner", "w")
        .agg(F.array_sort(F.collect_list(F.struct((F.col("item") % (1 << BUNDLE_BITS)).cast("int").alias("slot"), "rest"))).alias("of"))
        .select("bundle", "term", "owner", "w", F.col("of.slot").alias("slots"), F.col("of.rest").alias("rests"))
    )


def _parts(column: pa.ChunkedArray) -> Callable[[int], np.ndarray]:
    """The lists of a column as slices of one array."""
    lists = column.combine_chunks()
    ends, values = lists.offsets.to_numpy(), lists.values.to_numpy()
    return lambda i: values[ends[i] : ends[i + 1]]


def owned(documents: int, length: int, k: int, last: bool) -> Callable[[tuple, pa.Table, pa.Table], pa.Table]:
    """One owner's part: accumulators of a bundle and block, and the owner's postings there, to accumulators."""

    def add(key: tuple, carried: pa.Table, postings: pa.Table) -> pa.Table:
        at, tf, n = (_parts(postings.column(c)) for c in ("at", "tf", "n"))
        slots, rests = _parts(postings.column("slots")), _parts(postings.column("rests"))
        places, scores = _parts(carried.column("at")), _parts(carried.column("score"))
        size = 1 + max((int(x(i).max(initial=0)) for x, t in ((at, postings), (places, carried)) for i in range(len(t))), default=0)
        total: defaultdict[int, np.ndarray] = defaultdict(lambda: np.zeros(size, np.int64))
        rest: dict[int, int] = {}
        for i, (slot, left) in enumerate(zip(carried.column("slot").to_pylist(), carried.column("rest").to_pylist())):
            total[slot][places(i)] = scores(i)
            rest[slot] = left
        for i, w in enumerate(postings.column("w").to_pylist()):
            here, f = at(i), tf(i).astype(np.int64)
            m = 10 + (90 * n(i).astype(np.int64) * documents) // length
            gain = w * ((1_000_000_000 * f) // (1000 * f + 8 * m))
            for slot, left in zip(slots(i).tolist(), rests(i).tolist()):
                total[slot][here] += gain
                rest[slot] = left
        found = []
        for slot, sums in total.items():
            kept = np.flatnonzero(sums)
            if len(kept) > k:
                of = sums[kept]
                kth = np.partition(of, len(of) - k)[len(of) - k]
                kept = kept[of + (0 if last else rest[slot]) >= kth]
                if last:  # of equal scores the first places, which are the smallest ids
                    kept = np.sort(kept[np.lexsort((kept, -sums[kept]))[:k]])
            if len(kept):
                found.append((slot, rest[slot], kept, sums[kept]))
        ends = np.cumsum([len(x[2]) for x in found], dtype=np.int64)
        flat = [np.concatenate([x[j] for x in found]) if found else np.zeros(0, np.int64) for j in (2, 3)]
        columns = [
            pa.array([key[0].as_py()] * len(found), pa.int64()),
            pa.array([key[1].as_py()] * len(found), pa.int64()),
            pa.array([x[0] for x in found], pa.int32()),
            pa.array([x[1] for x in found], pa.int64()),
            _lists(flat[0], ends, pa.int32()),
            _lists(flat[1], ends, pa.int64()),
        ]
        return pa.Table.from_arrays(columns, [c.split()[0] for c in _CARRIED.split(", ")])

    return add


def search(docs: DataFrame, items: DataFrame, k: int = 10, block: int = BLOCK) -> DataFrame:
    """(item_id, rank, doc_id, score): the k best documents (doc_id, text) of each item (item_id, text)."""
    spark = docs.sparkSession
    asked = _asked(items)
    found = stored(index(docs, _vocabulary(asked), block), "index")
    blocks = found.where("term is null")
    documents, length = blocks.agg(F.sum("df"), F.sum(F.aggregate("n", F.lit(0).cast("long"), lambda a, x: a + x))).first()
    carried = spark.createDataFrame([], _CARRIED)
    if documents:
        terms = stored(_weighed(found, asked, documents, length), "terms")
        for owner in range(len(OWNERS) + 1):
            postings = found.where("term is not null").join(terms.where(F.col("owner") == owner), "term").select(
                "bundle", "block", "w", "slots", "rests", "at", "tf", "n"
            )
            add = owned(documents, length, k, owner == len(OWNERS))
            carried = carried.groupBy("bundle", "block").cogroup(postings.groupBy("bundle", "block")).applyInArrow(add, _CARRIED)
    item = F.shiftleft("bundle", BUNDLE_BITS) + F.col("slot")
    best = carried.join(blocks.select("block", "ids"), "block").select(
        item.alias("item"), F.explode(F.arrays_zip(F.transform("at", lambda a: F.get("ids", a)).alias("doc_id"), "score")).alias("of")
    )
    order = Window.partitionBy("item").orderBy(F.desc("of.score"), F.asc_nulls_last("of.doc_id"))
    ranked = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.join(asked.select("item", "item_id").distinct(), "item").select(
        "item_id", "rank", F.col("of.doc_id").alias("doc_id"), F.col("of.score").alias("score")
    )


_SPLIT = f"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{TERM}')"
SEARCH_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_SPLIT} AS ws FROM documents),
n AS (SELECT r, doc_id, ws, len(ws) AS n FROM d WHERE len(ws) > 0),
t AS (SELECT count(*) AS documents, CAST(sum(n) AS BIGINT) AS length FROM n),
p AS (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(ws) AS term FROM n) GROUP BY r, term),
w AS (SELECT term, CAST(floor(1000 * ln((2.0 * documents + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM p, t GROUP BY term, documents),
q AS (SELECT DISTINCT item_id, unnest({_SPLIT}) AS term FROM benchmark),
s AS (
  SELECT item_id, doc_id, r, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * documents) // length)))) AS BIGINT) AS score
  FROM q JOIN w USING (term) JOIN p USING (term) JOIN n USING (r), t GROUP BY item_id, doc_id, r)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0)
WHERE rank <= 10
"""

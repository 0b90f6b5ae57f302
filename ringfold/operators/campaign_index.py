"""All campaigns over a row at once: sorted constants per attribute, and bitmaps of the conjuncts that fail.

The predicates of an attribute become thresholds: x > c is x >= the double after c, x < c is x <= the
one before it. Thresholds of a direction are sorted, equal ones are one. A binary search tells how many of
them a value satisfies; for each such number there is a bitmap of the conjuncts that have a threshold among the
others. A conjunct holds if no attribute's bitmap names it, a campaign if any of its conjuncts does. So
a predicate is never evaluated by itself, and a row costs a search and a few words of bitmap for
each attribute, whatever the number of predicates on it.

Campaigns are cut into chunks of about CHUNK conjuncts, each with an index of its own, so the whole takes
memory in proportion to the predicates (some 200 bytes each). Text comparisons are evaluated by Spark, each
distinct one once, and enter as attributes of 0 and 1.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterator, Sequence
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from ..functions.values import matches as text_matches
from ..sources.rules import TEXT_TYPES

CHUNK = 1024
#: Operators: whether a value must be at least or at most its threshold, and how a constant becomes one.
_AT_LEAST: dict[str, Callable[[float], float]] = {"gre": float, "gr": lambda c: np.nextafter(c, np.inf)}
_AT_MOST: dict[str, Callable[[float], float]] = {"lte": float, "lt": lambda c: np.nextafter(c, -np.inf)}
Predicate = tuple[int, str, str, float]  # the conjunct's bit, column, operator, constant


class _Thresholds:
    """The thresholds of a column in one direction; fails[r] for a value that r of them do not exceed (or equal)."""

    def __init__(self, kind: str, of: dict[float, list[int]], words: int):
        self.kind = kind
        self.sorted = np.array(sorted(of))
        bits = np.zeros((len(of) + 1, words), np.uint64)  # the last row stays empty
        for i, t in enumerate(self.sorted.tolist()):
            for bit in of[t]:
                bits[i, bit >> 6] |= np.uint64(1 << (bit & 63))
        before = np.roll(np.bitwise_or.accumulate(bits, axis=0), 1, axis=0)
        before[0] = 0
        since = np.bitwise_or.accumulate(bits[::-1], axis=0)[::-1]
        if kind == "least":
            self.fails = since
        elif kind == "most":
            self.fails = before
        else:  # all but one, or all
            self.fails = before | np.vstack([since[1:], np.zeros((1, words), np.uint64)])
        self.null = 0 if kind == "least" else len(of)

    def of(self, values: np.ndarray, null: np.ndarray) -> np.ndarray:
        """The bitmap of each value; NaN is larger than any number, as in Spark."""
        rank = np.searchsorted(self.sorted, values, "right" if self.kind == "least" else "left")
        if self.kind == "equal":
            hit = self.sorted[np.minimum(rank, len(self.sorted) - 1)] == values
            rank = np.where(hit, rank, len(self.sorted))
        return self.fails[np.where(null, self.null, rank)]


class Chunk:
    """The index of some campaigns: (campaign, conjunct) pairs in order, and their predicates."""

    def __init__(self, conjuncts: Sequence[tuple[int, int]], predicates: Sequence[Predicate]):
        self.size = len(conjuncts)
        firsts = [(i, c) for i, (c, _) in enumerate(conjuncts) if i == 0 or conjuncts[i - 1][0] != c]
        self.firsts = np.array([i for i, _ in firsts])
        self.campaigns = np.array([c for _, c in firsts], np.int32)
        self.words = (self.size + 63) // 64
        found: dict[tuple[str, str], dict[float, list[int]]] = defaultdict(lambda: defaultdict(list))
        for bit, column, operator, constant in predicates:
            if operator in _AT_LEAST:
                found[column, "least"][_AT_LEAST[operator](constant)].append(bit)
            elif operator in _AT_MOST:
                found[column, "most"][_AT_MOST[operator](constant)].append(bit)
            else:
                found[column, "equal"][constant].append(bit)
        self.thresholds = [(column, _Thresholds(kind, of, self.words)) for (column, kind), of in sorted(found.items())]

    def holding(self, columns: dict[str, tuple[np.ndarray, np.ndarray]], rows: int) -> tuple[np.ndarray, np.ndarray]:
        """Rows and campaigns, as pairs, of the campaigns that hold."""
        fails = np.zeros((rows, self.words), np.uint64)
        for column, thresholds in self.thresholds:
            fails |= thresholds.of(*columns[column])
        bits = np.unpackbits((~fails).astype("<u8").view(np.uint8), axis=1, bitorder="little")[:, : self.size]
        row, campaign = np.nonzero(np.bitwise_or.reduceat(bits, self.firsts, axis=1))
        return row, self.campaigns[campaign]


def chunks(predicates: Sequence[tuple[int, int, str, str, float]], size: int = CHUNK) -> list[Chunk]:
    """Of (campaign, conjunct, column, operator, constant); a campaign is in one chunk, a chunk has a campaign at least."""
    found: list[Chunk] = []
    conjuncts: list[tuple[int, int]] = []
    inside: list[Predicate] = []
    for _, rows in groupby(sorted(predicates, key=lambda p: p[:2]), key=lambda p: p[0]):
        of = list(rows)
        own = list(dict.fromkeys(p[:2] for p in of))
        if conjuncts and len(conjuncts) + len(own) > size:
            found.append(Chunk(conjuncts, inside))
            conjuncts, inside = [], []
        bit = {c: len(conjuncts) + i for i, c in enumerate(own)}
        conjuncts += own
        inside += [(bit[p[:2]], *p[2:]) for p in of]
    return [*found, Chunk(conjuncts, inside)] if conjuncts else found


def matching(wide: DataFrame, flat: Sequence[Row]) -> DataFrame:
    """(subscriber_id, campaign) of the campaigns in rows of Rules.flat() that hold; nothing is shuffled."""
    kinds = dict(wide.dtypes)
    columns: dict[str, Column] = {}
    texts: dict[tuple[str, str, str], str] = {}
    predicates = []
    for r in flat:
        operator = "eq" if r["operator"] == "E" else r["operator"]
        if r["data_type"] in TEXT_TYPES:
            of = (r["attribute"], operator, r["value"])
            if of not in texts:
                texts[of] = name = f"text_{len(texts)}"
                test = text_matches(F.col(r["attribute"]).cast("string"), F.lit(operator), F.lit(r["value"]))
                columns[name] = test.cast("double").alias(name)
            predicates.append((r["campaign"], r["conjunct"], texts[of], "gre", 1.0))
        else:
            name = f"number_{r['attribute']}"
            if name not in columns:
                value = F.lit(None) if kinds[r["attribute"]] == "string" else F.col(r["attribute"])
                columns[name] = value.cast("double").alias(name)
            predicates.append((r["campaign"], r["conjunct"], name, operator, float(r["value"])))
    parts = chunks(predicates)
    names = list(columns)

    def held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = {
                name: (column.fill_null(0.0).to_numpy(zero_copy_only=False), column.is_null().to_numpy(zero_copy_only=False))
                for name, column in zip(names, batch.columns[1:])
            }
            for part in parts:
                row, campaign = part.holding(values, batch.num_rows)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(row)), pa.array(campaign)], ["subscriber_id", "campaign"]
                )

    return wide.select("subscriber_id", *columns.values()).mapInArrow(held, f"subscriber_id {kinds['subscriber_id']}, campaign int")

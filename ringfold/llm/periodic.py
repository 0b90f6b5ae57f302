"""Runs of repeated words, found by block convolution at dyadic scales.

A run is a stretch of words with smallest period q (words q apart are identical) that no neighbouring
word extends, of at least LEAST words and REPEATS periods. At scale b, which serves the periods from b
to 2b - 1 (the first, of 8, those from 1 to 15), the words are cut into blocks of b. Any run of such a period
holds a whole block whose words all come again q later. The sums of squared differences between a block
and the window behind it, at all distances at once, come from one exact convolution by a number-theoretic
transform; distances without mismatch are seeds. Each seed is extended, by comparisons, to the stretch that keeps its period.

Squared differences are of small codes of words, so that a sum stays below the transform's prime; words
that share a code can only add seeds, which are compared before they are extended. Blocks with a word that does
not come again within the window, and blocks well inside a run already known, have no new seeds and are left out.

Defined results: null is the empty text; texts without LEAST words have no runs; a word is
collapsed if a run holds it after that run's first period.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from functools import cache
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD, make_way, text_slices

LEAST, REPEATS = 24, 3
#: A prime, 15 * 2^27 + 1, and a generator of its roots of unity.
PRIME, ROOT = 2_013_265_921, 31
#: Words of a transform's batch.
_BATCH = 1 << 19
_RUN = pa.list_(pa.struct([("start", pa.int32()), ("length", pa.int32()), ("period", pa.int32())]))


@cache
def _roots(size: int, inverse: bool) -> np.ndarray:
    """The powers 0 .. size/2 - 1 of a root of unity of order size."""
    root = pow(ROOT, (PRIME - 1) // size, PRIME)
    root = pow(root, PRIME - 2, PRIME) if inverse else root
    powers = np.ones(max(1, size // 2), np.int64)
    done = 1
    while done < len(powers):
        powers[done : 2 * done] = powers[:done] * pow(root, done, PRIME) % PRIME
        done *= 2
    return powers


def transformed(rows: np.ndarray) -> np.ndarray:
    """The transform of each row, in bit-reversed order; row lengths are powers of two."""
    x = rows
    many, size = rows.shape
    half = size // 2
    while half:
        pairs = x.reshape(many, -1, 2, half)
        a, b = pairs[:, :, 0], pairs[:, :, 1]
        x = np.stack([(a + b) % PRIME, (a - b) * _roots(2 * half, False) % PRIME], axis=2).reshape(many, size)
        half //= 2
    return x


def restored(rows: np.ndarray) -> np.ndarray:
    """The inverse of transformed()."""
    x = rows
    many, size = rows.shape
    half = 1
    while half < size:
        pairs = x.reshape(many, -1, 2, half)
        a, b = pairs[:, :, 0], pairs[:, :, 1] * _roots(2 * half, True) % PRIME
        x = np.stack([(a + b) % PRIME, (a - b) % PRIME], axis=2).reshape(many, size)
        half *= 2
    return x * pow(size, PRIME - 2, PRIME) % PRIME


def mismatches(blocks: np.ndarray, windows: np.ndarray, distances: int) -> np.ndarray:
    """The sum of squared differences of each block and its window at each shift from 0, below PRIME."""
    many, b = blocks.shape
    size = 1 << (windows.shape[1] - 1).bit_length()
    turned, padded = np.zeros((2, many, size), np.int64)
    turned[:, 0] = blocks[:, 0]
    turned[:, size - b + 1 :] = blocks[:, :0:-1]
    padded[:, : windows.shape[1]] = windows
    products = restored(transformed(turned) * transformed(padded) % PRIME)[:, :distances]
    sums = np.concatenate([np.zeros((many, 1), np.int64), np.cumsum(windows**2, axis=1)], axis=1)
    own = (blocks**2).sum(axis=1, keepdims=True)
    return (own + sums[:, b : b + distances] - sums[:, :distances] - 2 * products) % PRIME


class Finder:
    """The runs in an array of word numbers; a number that occurs once separates texts."""

    def __init__(self, words: np.ndarray, longest: int):
        """longest: of the texts, in words."""
        self.words, self.longest = words, longest
        n = len(words)
        order = np.argsort(words, kind="stable")
        again = np.full(n, n, np.int64)  # distance to the word's next occurrence
        same = words[order[1:]] == words[order[:-1]]
        again[order[:-1][same]] = np.diff(order)[same]
        self.again = again
        self.found: dict[tuple[int, int], int] = {}  # (start, period) of a run: its end
        self.until = np.zeros(n + 1, np.int64)  # where the known run of smallest period that holds a word ends
        self.period = np.zeros(n + 1, np.int64)

    def runs(self) -> list[tuple[int, int, int]]:
        """(start, length, period) in the order of start, period."""
        b = 8
        while (1 if b == 8 else b) * REPEATS <= self.longest and LEAST <= self.longest:
            self._scale(b)
            b *= 2
        return sorted((s, e - s, q) for (s, q), e in self.found.items())

    def _scale(self, b: int) -> None:
        n, least = len(self.words), 1 if b == 8 else b
        starts = np.arange(0, n - b - least + 1, b)
        if not len(starts):
            return
        farthest = np.maximum.reduceat(self.again, np.arange(0, n, b))[: len(starts)]
        starts = starts[farthest < 2 * b]
        # in a run of a period of b at most, the block comes again at that period's multiples alone
        inside = (self.period[starts] > 0) & (self.period[starts] <= b) & (self.until[starts] >= np.minimum(n, starts + 3 * b - 1))
        starts = starts[~inside]
        span = 2 * b - least + b - 1  # of a window
        colours = max(1, min(1 << 15, int(((PRIME - 1) // b) ** 0.5) - 1))
        codes = np.concatenate([self.words % colours + 1, np.zeros(span + 2 * b, np.int64)])
        step = max(1, _BATCH // (1 << (span - 1).bit_length()))
        seeds = []
        for i in range(0, len(starts), step):
            at = starts[i : i + step, None]
            sums = mismatches(codes[at + np.arange(b)], codes[at + least + np.arange(span)], 2 * b - least)
            block, distance = np.nonzero(sums == 0)
            seeds += zip((distance + least).tolist(), at[block, 0].tolist())
        for q, i in sorted(seeds):
            self._extend(i, q, b)

    def _extend(self, i: int, q: int, b: int) -> None:
        known = int(self.period[i])
        if known and q % known == 0 and self.until[i] >= i + q + b:
            return
        x = self.words
        if not np.array_equal(x[i : i + b], x[i + q : i + q + b]):
            return  # words that share a code
        start, end = i - self._kept(i, q, -1), i + b + self._kept(i + b, q, 1) + q
        if end - start < max(LEAST, REPEATS * q) or (start, q) in self.found:
            return
        self.found[start, q] = end
        free = (self.period[start:end] == 0) | (self.until[start:end] < end)
        self.period[start:end][free] = q
        self.until[start:end][free] = end

    def _kept(self, at: int, q: int, way: int) -> int:
        """How many words from at (onward, or before it) equal those q later."""
        x, kept, step = self.words, 0, 64
        while True:
            a, z = (at + kept, min(at + kept + step, len(x) - q)) if way > 0 else (max(0, at - kept - step), at - kept)
            if z <= a:
                return kept
            differ = np.flatnonzero(x[a:z] != x[a + q : z + q])
            if len(differ):
                return kept + int(differ[0] if way > 0 else z - a - 1 - differ[-1])
            kept, step = kept + z - a, 2 * step


def of_texts(texts: list[bytes | None]) -> tuple[list[list[tuple[int, int, int]]], list[list[bytes]]]:
    """The runs and the words of each text."""
    numbers: defaultdict[bytes, int] = defaultdict(count(len(texts)).__next__)
    split = [(t or b"").split() for t in texts]
    flat = np.empty(sum(map(len, split)) + len(texts), np.int64)
    begins = []
    at = 0
    for i, words in enumerate(split):
        begins.append(at)
        flat[at : at + len(words)] = np.fromiter(map(numbers.__getitem__, words), np.int64, len(words))
        at += len(words) + 1
        flat[at - 1] = i  # once in all: no stretch crosses it
    found: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    runs = Finder(flat, max(map(len, split), default=0)).runs()
    owners = np.searchsorted(begins, [r[0] for r in runs], "right") - 1
    for (start, length, period), i in zip(runs, owners.tolist()):
        found[i].append((start - begins[i], length, period))
    return found, split


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words outside runs and in their first periods, one space between them."""
    if runs:
        kept = np.ones(len(words), bool)
        for start, length, period in runs:
            kept[start + period : start + length] = False
        words = [words[i] for i in np.flatnonzero(kept)]
    return b" ".join(words)


def find(docs: DataFrame) -> DataFrame:
    """docs with n_words, runs (start, length, period; by start, then period) and collapsed, the text without repeats."""

    @F.arrow_udf("struct<n_words: int, runs: array<struct<start: int, length: int, period: int>>, collapsed: string>")
    def searched(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in batches:
            texts = column.cast(pa.binary()).to_pylist()
            counts, runs, left = [], [], []
            for a, b in text_slices(texts):
                found, split = of_texts(texts[a:b])
                counts += map(len, split)
                runs += ([dict(zip(("start", "length", "period"), r)) for r in each] for each in found)
                left += map(collapsed, split, found)
            parts = [pa.array(counts, pa.int32()), pa.array(runs, _RUN), pa.array(left, pa.string())]
            yield pa.StructArray.from_arrays(parts, ["n_words", "runs", "collapsed"])

    free = make_way(docs, "n_words", "runs", "collapsed", "_searched")
    return free.withColumn("_searched", searched(F.col("text").cast("string"))).select(
        *free.columns, *(F.col(f"_searched.{c}").alias(c) for c in ("n_words", "runs", "collapsed"))
    )


def repeated(docs: DataFrame) -> DataFrame:
    """docs with the contract's planted periods: in one of ten texts, by crc32 of doc_id, the words from one on repeat."""
    h = F.crc32(F.col("doc_id").cast("long").cast("string"))
    g, n = F.floor(h / 10), F.size("_words")
    # Columns of their own, used more than once, so that they are not put into the lambda and found for each word.
    rows = docs.withColumn("_words", F.when(h % 10 == 0, F.regexp_extract_all("text", F.lit(WORD), F.lit(0))))
    rows = rows.withColumn("_at", F.when(n > 0, F.struct((g % n).cast("int").alias("a"), (3 + g % 8).alias("parts"))))
    rows = rows.withColumn("_p", (1 + F.floor((n - F.col("_at.a")) / F.col("_at.parts"))).cast("int"))
    a, p = F.col("_at.a"), F.col("_p")
    places = F.sequence(F.lit(0), n - 1)
    planted = F.transform(places, lambda i: F.get("_words", F.when(i < a, i).otherwise(a + (i - a) % p)))
    text = F.when(n > 0, F.array_join(planted, " ")).otherwise(F.col("text"))
    return rows.withColumn("text", text).drop("_words", "_at", "_p")


def digests(docs: DataFrame) -> DataFrame:
    """The contract's row of each document, of its text with planted periods."""
    found = find(repeated(docs.select("doc_id", docs["text"].cast("string").alias("text"))).select("doc_id", "text"))
    none = F.lit(None).cast("struct<start: int, length: int, period: int>")
    top = F.aggregate(  # in their order, so the first of equal ratios stays
        "runs",
        none,
        lambda best, r: F.when(
            best.isNull() | (r["length"].cast("long") * best["period"] > best["length"].cast("long") * r["period"]), r
        ).otherwise(best),
    )
    listed = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    return found.withColumn("_top", top).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        *(F.col(f"_top.{c}").cast("long").alias(c) for c in ("start", "length", "period")),
        F.expr("(1000L * _top.length) div _top.period").alias("exponent_milli"),
        F.sha2(F.when(F.size("runs") > 0, F.concat(listed, F.lit("\n"))).otherwise(""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )

"""Toxicity by compression distance between two zstandard dictionaries.

Both dictionaries begin with the same ordinary text. Behind it the ordinary one has a dictionary trained
on further ordinary text, the toxic one a dictionary trained on windows of toxic documents. A window is a
run of `window` words of the text, each between two marks, so that whole words are long matches; what a
window gains is its compressed length with the ordinary dictionary less that with the toxic one. Windows
are compressed between two copies of a phrase that both dictionaries end with, since zstandard stores very
short input as it is.

Most windows of toxic documents are ordinary, so the toxic dictionary is trained in rounds. The first takes
the windows that the ordinary dictionary compresses worst. In each round the documents are dealt to folds,
a dictionary trained on the other folds compresses a fold's windows, and those go on whose gain hardly any
(`share`) ordinary window reaches. No word is counted or listed: what is toxic is told by compressed lengths alone.

A document's evidence is the sum over its distinct windows of the log likelihood ratio of their gains, where
gains of no more than 0 say nothing. A logistic curve over evidence and length, fitted to documents that the
dictionary in use had not seen, gives the score; it is shifted so that the best training threshold is at CUT.

The fit takes at most max_docs documents of each class, and of those in a fixed pseudo-random order as many as
have max_bytes of text in all; near copies among them are taken once. Scores take whole texts.

Defined results: texts that are null, empty or white space have no windows and score as such; ids may be null
or repeated; words of any length are compressed whole; without training documents of both classes every score
is 0; an empty table gives no rows. Columns of any name pass through keep_clean untouched.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import of_worker, text_runs
from .minhash import shingle_sets

CUT = 0.7
_CARRIER = b" of the and for with that this from "
_LOW, _HIGH = -4, 8  # gains beyond count as these
_CACHE_BYTES = 64 << 20  # of windows whose gains a task remembers
_AT_ONCE = 50_000
_FOLDS, _ROUNDS = 3, 6
_THREADS = 4  # of the driver, for the fit
_BASE_BYTES, _TRAINED_BYTES = 256 << 10, 4096
_SEGMENT, _MATCHED = 24, 6  # the trainer's segment and the runs that it counts


def held_out(doc_id: Column) -> Column:
    """The documents whose labels are never learned from."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(3)) == 1


def words_of(text: str | None) -> list[bytes]:
    return (text or "").lower().encode("utf-8", "replace").split()


def windows_of(words: list[bytes], window: int) -> list[bytes]:
    """Runs of window words, end to end, each word between two bytes that no text has."""
    return [b"".join(b"\x01\x02" + w + b"\x03\x04" for w in words[i : i + window]) for i in range(0, len(words), window)]


@dataclass(frozen=True)
class Dictionaries:
    """Raw contents: what both begin with, and what follows in each."""

    base: bytes
    toxic: bytes
    ordinary: bytes


def _compressor(content: bytes) -> zstandard.ZstdCompressor:
    parameters = zstandard.ZstdCompressionParameters(
        window_log=20, hash_log=17, chain_log=18, search_log=5, min_match=3, strategy=zstandard.STRATEGY_BTOPT,
        write_checksum=False, write_content_size=False, write_dict_id=False,
    )
    data = zstandard.ZstdCompressionDict(content + _CARRIER, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    data.precompute_compress(compression_params=parameters)
    return zstandard.ZstdCompressor(compression_params=parameters, dict_data=data)


@lru_cache(maxsize=1)
def _compressors(of: Dictionaries) -> tuple[zstandard.ZstdCompressor, zstandard.ZstdCompressor]:
    return _compressor(of.base + of.toxic), _compressor(of.base + of.ordinary)


def _lengths(compressor: zstandard.ZstdCompressor, windows: list[bytes], threads: int = 1) -> np.ndarray:
    """Compressed lengths of windows, each different one compressed once."""
    lengths = dict.fromkeys(windows, 0)
    different = list(lengths)
    for at in range(0, len(different), _AT_ONCE):
        some = different[at : at + _AT_ONCE]
        framed = [_CARRIER + w + _CARRIER for w in some]
        lengths.update(zip(some, map(len, compressor.multi_compress_to_buffer(framed, threads=threads))))
    return np.fromiter(map(lengths.__getitem__, windows), np.int64, len(windows))


class Gains:
    """Gains of windows; those met before are remembered up to a number of bytes."""

    def __init__(self, of: Dictionaries):
        self.of, self.known, self.bytes = of, {}, 0

    def counts(self, texts: list[list[bytes]]) -> np.ndarray:
        """How many distinct windows of each text have each gain from _LOW to _HIGH."""
        each = [set(x) for x in texts]
        new = list(set().union(*each).difference(self.known)) if each else []
        if new:
            self.bytes += sum(map(len, new)) + 120 * len(new)
            if self.bytes > _CACHE_BYTES:
                self.known.clear()
                new = list(set().union(*each))
                self.bytes = sum(map(len, new)) + 120 * len(new)
            toxic, ordinary = _compressors(self.of)
            gained = np.clip(_lengths(ordinary, new) - _lengths(toxic, new), _LOW, _HIGH) - _LOW
            self.known.update(zip(new, gained.tolist()))
        found = np.zeros((len(texts), _HIGH - _LOW + 1), np.int64)
        for i, windows in enumerate(each):
            found[i] = np.bincount(np.fromiter(map(self.known.__getitem__, windows), np.int64, len(windows)), minlength=found.shape[1])
        return found


def _mixed(items: list) -> list:
    """The same items in a fixed order that does not follow the documents'."""
    return [items[i] for i in np.random.Generator(np.random.PCG64(7)).permutation(len(items))]


def trained(windows: list[bytes], size: int = _TRAINED_BYTES) -> bytes:
    """Content of a dictionary that zstandard trains on windows; too few of them are taken as they are."""
    windows = _mixed(windows)
    samples = [b"".join(windows[i : i + 8]) for i in range(0, len(windows), 8)]
    try:
        made = zstandard.train_dictionary(size, samples, k=_SEGMENT, d=_MATCHED).as_bytes()
        return made[-(size - 300) :]  # without its entropy tables, which stand first
    except zstandard.ZstdError:
        return b"".join(samples)[: size - 300]


def toxic_windows(
    toxic: list[list[bytes]], ordinary: list[bytes], base: bytes, plain: bytes, share: float, rounds: int = _ROUNDS
) -> tuple[list[bytes], list[Dictionaries]]:
    """Windows of toxic documents that are toxic by their gains, and for each fold dictionaries that have not seen it."""
    folds = [[w for d in toxic[k::_FOLDS] for w in d] for k in range(_FOLDS)]
    tested = [ordinary[k::_FOLDS] for k in range(_FOLDS)]  # each dictionary is tried on a part of them
    without = _compressor(base + plain)
    of_ordinary = [_lengths(without, t, _THREADS) for t in tested]
    lengths = [_lengths(without, f, _THREADS) for f in folds]
    worst = np.quantile(np.concatenate(of_ordinary), 0.75) if ordinary else 0
    kept = [[w for w, n in zip(f, ls) if n >= worst] for f, ls in zip(folds, lengths)]
    unseen: list[Dictionaries] = []
    for _ in range(rounds):
        unseen = [
            Dictionaries(base, trained([w for j, ws in enumerate(kept) if j != k for w in ws]), plain) for k in range(_FOLDS)
        ]
        made = [_compressor(base + d.toxic) for d in unseen]
        gains = [n - _lengths(c, f, _THREADS) for c, f, n in zip(made, folds, lengths)]
        usual = np.concatenate([n - _lengths(c, t, _THREADS) for c, t, n in zip(made, tested, of_ordinary)])
        least = next((g for g in range(1, _HIGH) if (usual >= g).mean() <= share), _HIGH)
        following = [[w for w, g in zip(f, gs) if g >= least] for f, gs in zip(folds, gains)]
        if not any(following):
            break
        kept = following
    return [w for ws in kept for w in ws], unseen


@dataclass(frozen=True)
class Model:
    dictionaries: Dictionaries | None
    window: int = 1
    ratios: tuple[float, ...] = ()
    weights: tuple[float, ...] = ()
    bias: float = 0.0

    def features(self, counts: np.ndarray) -> np.ndarray:
        """Evidence, its density and length, from rows of gain counts."""
        evidence = counts @ np.array(self.ratios)
        n = counts.sum(axis=1)
        return np.column_stack([np.clip(evidence, -30, 30) / 10, evidence / np.sqrt(n + 5), np.log1p(n) / 10])

    def scorer(self) -> Callable[[pa.Array], np.ndarray]:
        """A function of texts."""
        if self.dictionaries is None:
            return lambda texts: np.zeros(len(texts))
        gains = of_worker(self.dictionaries, lambda: Gains(self.dictionaries))
        weights = np.array(self.weights)

        def scores(texts: pa.Array) -> np.ndarray:
            found = [np.zeros(0)]
            for _, some in text_runs(texts):
                counts = gains.counts([windows_of(words_of(t), self.window) for t in some])
                found.append(_sigmoid(self.features(counts) @ weights + self.bias))
            return np.concatenate(found)

        return scores


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -500, 500)))


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    """Weights and, last, the bias of a logistic curve by Newton's method; classes weigh the same."""
    x = np.column_stack([x, np.ones(len(x))])
    weight = np.where(y == 1, 0.5 / max(1, y.sum()), 0.5 / max(1, (1 - y).sum())) * len(y)
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = _sigmoid(x @ w)
        slope = x.T @ (weight * (p - y)) + ridge * w
        curve = (x * (weight * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(curve, slope)
        w -= step * min(1.0, 5 / max(1e-9, np.abs(step).max()))
        if np.abs(step).max() < 1e-6:
            break
    return w


def _originals(documents: list[tuple[str, int]]) -> list[tuple[str, int]]:
    """Without those that share more than a fifth of their shingles with what stands before them."""
    sets = [shingle_sets([text])[0] for text, _ in documents]
    sizes = np.array([len(s) for s in sets], np.int64)
    flat, own = np.concatenate([np.zeros(0, np.uint64), *sets]), np.repeat(np.arange(len(sets)), sizes)
    del sets
    order = np.argsort(flat, kind="stable")
    again = order[1:][flat[order[1:]] == flat[order[:-1]]]  # all occurrences of a shingle but its first
    met = np.bincount(own[again], minlength=len(sizes))
    return [d for d, n, m in zip(documents, sizes.tolist(), met.tolist()) if m <= n / 5]


def fit(documents: list[tuple[str, int]], totals: tuple[int, int], window: int = 1, share: float = 0.002) -> Model:
    """A model from (text, label) in any fixed order, and how many training documents of label 0 and 1 there are."""
    same: dict[bytes, bytes] = {}  # a window is one object, however often it comes
    each = [([same.setdefault(w, w) for w in windows_of(words_of(t), window)], label) for t, label in _originals(documents)]
    ordinary, toxic = ([w for w, label in each if label == k and w] for k in (0, 1))
    if not ordinary or not toxic:
        return Model(None)
    # Half of the ordinary documents are the base, a sixth trains, and a third tells how ordinary windows do.
    half, third = -(-len(ordinary) // 2), max(1, len(ordinary) // 3)
    base = b"".join(w for d in ordinary[:half] for w in d)[:_BASE_BYTES]
    plain = trained([w for d in ordinary[half:-third] or ordinary for w in d])
    tested = ordinary[-third:]
    kept, unseen = toxic_windows(toxic, [w for d in tested for w in d], base, plain, share)
    dictionaries = Dictionaries(base, trained(kept), plain)
    counts = [np.concatenate([Gains(d).counts(tested) for d in unseen])]
    counts.append(np.concatenate([Gains(d).counts(toxic[k::_FOLDS]) for k, d in enumerate(unseen)]))
    rates = [(c.sum(axis=0) + 0.5) / (c.sum() + 0.5 * c.shape[1]) for c in counts]
    ratios = np.log(rates[1] / rates[0])
    ratios[: 1 - _LOW] = 0.0
    model = Model(dictionaries, window, tuple(ratios.tolist()))
    x = model.features(np.concatenate(counts))
    y = np.repeat([0.0, 1.0], [len(c) for c in counts])
    *weights, bias = _logistic(x, y).tolist()
    logits = x @ np.array(weights) + bias
    order = np.argsort(-logits, kind="stable")
    # The sample's documents stand for all: each class weighs what it has.
    weight = np.repeat([n / len(c) for n, c in zip(totals, counts)], [len(c) for c in counts])
    hits = np.cumsum((y * weight)[order])
    f1 = 2 * hits / (np.cumsum(weight[order]) + totals[1])
    best = int(f1.argmax())
    below = logits[order[best + 1]] if best + 1 < len(y) else logits[order[best]] - 1
    threshold = (logits[order[best]] + below) / 2
    return Model(dictionaries, window, model.ratios, tuple(weights), float(bias - threshold + np.log(CUT / (1 - CUT))))


def training_sample(docs: DataFrame, known: DataFrame, max_docs: int, max_bytes: int) -> list[tuple[str, int]]:
    """(text, label) of at most max_docs rows of each class, and of those as many as have max_bytes in all."""
    texts = docs.select(docs["doc_id"], F.coalesce(docs["text"].cast("string"), F.lit("")).alias("text"))
    sample = []
    for label in (0, 1):
        ids = known.where(F.col("toxic") == label).select("doc_id", F.xxhash64("doc_id").alias("at"))
        chosen = ids.orderBy("at", "doc_id").limit(max_docs)
        rows = (
            texts.join(F.broadcast(chosen), "doc_id")  # max_docs ids at most
            .select("at", "doc_id", "text")
            .orderBy("at", "doc_id", F.xxhash64("text"))
            .limit(max_docs)
        )
        before = F.sum(F.octet_length("text")).over(Window.orderBy("at", "doc_id", F.xxhash64("text")))
        found = rows.select("at", "doc_id", "text", before.alias("upto")).where(F.col("upto") <= max_bytes).collect()
        sample += [(r["at"], str(r["doc_id"]), r["text"], label) for r in found]
    return [(text, label) for _, _, text, label in sorted(sample)]


def train(
    docs: DataFrame, labels: DataFrame, max_docs: int = 2000, max_bytes: int = 64 << 20, window: int = 1, share: float = 0.002
) -> Model:
    """Fit to a bounded sample of the labelled documents that are not held out."""
    known = (
        labels.where(~held_out(F.col("doc_id")) & F.col("toxic").isin(0, 1))
        .select("doc_id", F.col("toxic").cast("int").alias("toxic"))
        .distinct()
    )
    totals = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    if len(totals) < 2:
        return Model(None)
    return fit(training_sample(docs, known, max_docs, max_bytes), (totals[0], totals[1]), window, share)


def score(text: Column, model: Model) -> Column:
    @F.arrow_udf("double")
    def scores(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        of = model.scorer()
        for texts in batches:
            yield pa.array(of(texts), pa.float64())

    return scores(text.cast("string"))


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) of each document."""
    model = train(docs, labels)
    scored = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), score(docs["text"], model).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= CUT).cast("int"))


def keep_clean(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that are not predicted to be toxic, with their own columns."""
    rows = docs.select(F.struct(*(docs[c] for c in docs.columns)).alias("row"), score(docs["text"], train(docs, labels)).alias("score"))
    return rows.where(F.col("score") < CUT).select(*(F.col(f"row.{c}").alias(c) for c in docs.columns))

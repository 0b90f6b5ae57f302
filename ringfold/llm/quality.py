"""Quality by hierarchical empirical Bayes: a document's own evidence over its site's prior.

Evidence is a log likelihood ratio of binned properties of the whole text, counted by label in one
grouped aggregate and tempered, since the properties overlap. Priors are shrunk twice: a site's
share of good documents towards the global share, a path's within the site towards the site's. How
strongly follows from how much sites (paths) differ beyond their binomial noise, by the method of
moments. A document's own share is left out of the priors that it is judged by.

All documents count in the priors; labels only fit the evidence and the global share, and only those
that are not held out. Site and path are any columns (here source and lang).

Defined results: a null or empty text has the properties of an empty one; null sites and paths are
groups of their own; without labels of both classes all evidence is 0 and all documents score the
prior of 0.5, which is kept; an empty table gives no rows.
"""

from __future__ import annotations

import math
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import removed, stored, text_runs

BINS = 16
PROPERTIES = ("upper", "digits", "symbols", "symbol_ends", "recurring", "repeats", "repeated_lines", "bars")
#: Added to what a share is of, so that a few words say little.
_PRIOR_WORDS, _PRIOR_CHARS = 4, 40
_letters = np.zeros(256, bool)
_letters[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_spaces = np.zeros(256, bool)
_spaces[[32, *range(9, 14)]] = True


def properties(text: str | None) -> list[float]:
    """Shares from 0 to 1, in the order of PROPERTIES."""
    data = (text or "").encode("utf-8", "replace")
    words = data.split()
    if not words:
        return [0.0] * len(PROPERTIES)
    counts = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    inked = int(counts[~_spaces].sum()) + _PRIOR_CHARS
    letters = int(counts[_letters].sum()) + _PRIOR_CHARS
    lines = [x for x in data.split(b"\n") if x.strip()]
    n = len(words)
    ends = sum(1 for w in words if len(w) > 2 and w[-1] < 128 and w[-1] == w[-2] and not _letters[w[-1]])
    return [
        max(0, int(counts[65:91].sum()) - 1) / letters,
        int(counts[48:58].sum()) / inked,
        int(counts[~_letters & ~_spaces].sum()) / inked,
        ends / (n + _PRIOR_WORDS),
        (n - len(set(words))) / (n + _PRIOR_WORDS),
        sum(map(bytes.__eq__, words, words[1:])) / (n + _PRIOR_WORDS),
        (len(lines) - len(set(lines))) / (len(lines) + _PRIOR_WORDS),
        int(counts[124]) / inked,
    ]


def bins_of(text: Column) -> Column:
    """The bin, from 0 to BINS - 1, of each property; shares near 0 are told apart."""

    @F.arrow_udf("array<int>")
    def found(texts: pa.Array) -> pa.Array:
        values = np.array([properties(t) for _, some in text_runs(texts) for t in some]).reshape(-1, len(PROPERTIES))
        binned = np.minimum((np.sqrt(values) * BINS).astype(np.int32), BINS - 1)
        return pa.array(list(binned), pa.list_(pa.int32()))

    return found(text.cast("string"))


def held_out(doc_id: Column) -> Column:
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(3)) == 1


class Evidence:
    """Log likelihood ratios by property and bin, and the share of good documents."""

    def __init__(self, table: list[list[float]], share: float):
        self.table, self.share = table, share

    def of(self, bins: Column) -> Column:
        flat = F.array(*(F.lit(float(x)) for x in chain.from_iterable(self.table)))
        steps = [F.get(flat, F.get(bins, i) + i * BINS) for i in range(len(PROPERTIES))]
        # Never null, and Spark is to see that: a filter on nulls, inferred from a join, would bin all texts once more.
        return F.coalesce(sum(steps[1:], steps[0]), F.lit(0.0))


def fit(binned: DataFrame, labels: DataFrame, label: str = "quality", temper: float = 0.5) -> Evidence:
    """From binned (doc_id, bins) and labels (doc_id, label), without those held out.

    The driver gets a count per property, bin and class, whatever the input's size.
    """
    known = labels.where(~held_out(F.col("doc_id"))).select("doc_id", F.col(label).alias("good")).where("good in (0, 1)")
    counts = (
        binned.join(known, "doc_id")
        .select("good", F.posexplode("bins").alias("property", "bin"))
        .groupBy("good", "property", "bin")
        .agg(F.count("*").alias("n"))
        .collect()
    )
    n = np.zeros((2, len(PROPERTIES), BINS))
    for row in counts:
        n[row["good"], row["property"], row["bin"]] = row["n"]
    bad, good = n[0, 0].sum(), n[1, 0].sum()
    if not bad or not good:
        return Evidence([[0.0] * BINS for _ in PROPERTIES], 0.5)
    shares = (n + 0.5) / (n + 0.5).sum(axis=2, keepdims=True)
    return Evidence((temper * np.log(shares[1] / shares[0])).tolist(), float(good / (good + bad)))


def _logit(p: Column) -> Column:
    p = F.least(F.greatest(p, F.lit(1e-6)), F.lit(1 - 1e-6))
    return F.log(p / (1 - p))


def _sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def _strength(groups: DataFrame, share: Column) -> float:
    """How many documents a prior is worth: the method of moments for a beta-binomial.

    groups: n, good and the prior share of each. Between 1 and 1e6.
    """
    noise = share * (1 - share)
    a, b, c = groups.agg(
        F.sum(F.pow(F.col("good") - F.col("n") * share, 2)),
        F.sum(F.col("n") * noise),
        F.sum(F.col("n") * (F.col("n") - 1) * noise),
    ).first()
    if not c:
        return 1.0
    correlation = max((a - b) / c, 1e-6)
    return min(max(1 / correlation - 1, 1.0), 1e6)


def priors(soft: DataFrame, share: float) -> DataFrame:
    """(site, path, path_n, path_good, site_share, strength) from soft (site, path, good)."""
    paths = stored(
        soft.groupBy("site", "path").agg(F.count("*").cast("double").alias("n"), F.sum("good").alias("good")), "paths"
    )
    sites = stored(paths.groupBy("site").agg(F.sum("n").alias("n"), F.sum("good").alias("good")), "sites")
    k = _strength(sites, F.lit(share))
    shrunk = sites.select(F.col("site").alias("_site"), ((F.col("good") + k * share) / (F.col("n") + k)).alias("site_share"))
    both = paths.join(shrunk, F.col("site").eqNullSafe(F.col("_site"))).drop("_site")
    strength = _strength(both, F.col("site_share"))
    return stored(
        both.select(
            F.col("site").alias("_site"), F.col("path").alias("_path"), F.col("n").alias("path_n"),
            F.col("good").alias("path_good"), "site_share", F.lit(strength).alias("strength"),
        ),
        "priors",
    )


def with_scores(rows: DataFrame, found: DataFrame, share: float) -> DataFrame:
    """rows (site, path, evidence) with path_share and score; small priors are broadcast by size."""
    own = _sigmoid(F.lit(math.log(share / (1 - share))) + F.col("evidence"))
    joined = rows.join(
        found, F.col("site").eqNullSafe(F.col("_site")) & F.col("path").eqNullSafe(F.col("_path"))
    ).drop("_site", "_path")
    path_share = (F.col("path_good") - own + F.col("strength") * F.col("site_share")) / (
        F.col("path_n") - 1 + F.col("strength")
    )
    return (
        joined.withColumn("path_share", path_share)
        .withColumn("score", _sigmoid(_logit(F.col("path_share")) + F.col("evidence")))
        .drop("path_n", "path_good", "strength")
    )


class Model:
    def __init__(self, evidence: Evidence, found: DataFrame):
        self.evidence, self.found = evidence, found

    def scored(self, rows: DataFrame) -> DataFrame:
        """rows (site, path, bins) with evidence, site_share, path_share and score."""
        return with_scores(rows.withColumn("evidence", self.evidence.of(F.col("bins"))), self.found, self.evidence.share)


def binned(docs: DataFrame, site: str, path: str, *kept: Column) -> DataFrame:
    """(doc_id, site, path, bins, kept) of all documents."""
    return docs.select(
        docs["doc_id"], docs[site].alias("site"), docs[path].alias("path"), bins_of(docs["text"]).alias("bins"), *kept
    )


def train(rows: DataFrame, labels: DataFrame) -> Model:
    """The model from binned rows."""
    evidence = fit(rows, labels)
    good = _sigmoid(F.lit(math.log(evidence.share / (1 - evidence.share))) + evidence.of(F.col("bins")))
    return Model(evidence, priors(rows.select("site", "path", good.alias("good")), evidence.share))


def quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, site: str = "source", path: str = "lang") -> DataFrame:
    """(doc_id, held_out, evidence, site_share, path_share, score, kept) of each document."""
    rows = stored(binned(docs, site, path), "bins")
    return train(rows, labels).scored(rows).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "evidence", "site_share", "path_share", "score",
        (F.col("score") >= threshold).alias("kept"),
    )


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, site: str = "source", path: str = "lang") -> DataFrame:
    """The rows of docs that score threshold or more, with their own columns."""
    fitted = stored(binned(docs, site, path), "bins")
    model = train(fitted, labels)
    removed(fitted)
    # Texts are read and binned again: stored beside the bins they would take the disk once more.
    rows = binned(docs, site, path, F.struct(*(docs[c] for c in docs.columns)).alias("row"))
    columns = [F.col(f"row.{c}").alias(c) for c in docs.columns]
    return model.scored(rows).where(F.col("score") >= threshold).select(*columns)

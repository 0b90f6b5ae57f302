"""License notices in texts, also misspelt ones: exact seeds, then bounded-error matching.

A text is lower-cased and reduced to its words, one space between them. A notice of n characters may
have floor(rate * n) edits, at most MOST; cut into one piece more than that, one of its pieces must stand in
the text as it is. All pieces of all notices are sought in one pass. Around each piece found lies the
window in which its notice could stand; windows of a notice that overlap become one, and the regex library
looks in them for the notice with at most so many insertions, deletions and substitutions. Where
matches of several notices overlap, those with the smallest share of edits stay, so that "version 3" is not
taken for a misspelt "version 2".

Places where the words of a base phrase stand consecutively are hits of their own; their first piece finds
them, and they always stay.

Defined results: null is the empty text, which has no words and no hits; hits of a notice do not
overlap each other, places of a base phrase may; a match may begin and end inside words.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import FOLDED, make_way


@dataclass(frozen=True)
class Notice:
    label: str
    text: str  # words of lower-case letters and digits, one space between them
    base: bool = False  # places of exactly these words count by themselves


#: The phrases whose exact places count.
BASE = (
    Notice("mit", "under the mit license", True),
    Notice("apache-2", "apache license version 2", True),
    Notice("cc-by-nc", "cc by nc", True),
)
#: Short forms of usual notices.
NOTICES = (
    *BASE,
    Notice("mit", "permission is hereby granted free of charge to any person"),
    Notice("apache-2", "licensed under the apache license version 2 0"),
    Notice("apache-2", "apache org licenses license 2 0"),
    Notice("bsd", "redistribution and use in source and binary forms"),
    Notice("bsd-2", "bsd 2 clause license"),
    Notice("bsd-3", "bsd 3 clause license"),
    Notice("gpl-2", "gnu general public license version 2"),
    Notice("gpl-3", "gnu general public license version 3"),
    Notice("lgpl-2.1", "gnu lesser general public license version 2 1"),
    Notice("lgpl-3", "gnu lesser general public license version 3"),
    Notice("agpl-3", "gnu affero general public license version 3"),
    Notice("mpl-2", "mozilla public license version 2 0"),
    Notice("epl-2", "eclipse public license version 2 0"),
    Notice("isc", "permission to use copy modify and or distribute this software"),
    Notice("unlicense", "this is free and unencumbered software"),
    Notice("cc0", "creative commons zero public domain dedication"),
    Notice("cc-by", "licensed under cc by 4 0"),
    Notice("cc-by-sa", "licensed under cc by sa 4 0"),
    Notice("cc-by-nd", "licensed under cc by nd 4 0"),
    Notice("cc-by-nc", "licensed under cc by nc 4 0"),
    Notice("cc-by-nc", "creative commons attribution noncommercial"),
    Notice("all-rights-reserved", "all rights reserved"),
)
#: Edits: a share of a notice's characters, and the most (what matching costs grows steeply with them).
RATE, MOST = 0.1, 3
_HITS = "array<struct<label: string, notice: string, base: boolean, edits: int, start: int, end: int, first_word: int, last_word: int>>"
_HIT = pa.list_(pa.struct([
    ("label", pa.string()), ("notice", pa.string()), ("base", pa.bool_()), ("edits", pa.int32()),
    ("start", pa.int32()), ("end", pa.int32()), ("first_word", pa.int32()), ("last_word", pa.int32()),
]))


class Scanner:
    def __init__(self, notices: Sequence[Notice], rate: float):
        self.notices = notices
        self.edits = [min(MOST, int(rate * len(n.text))) for n in notices]
        self.patterns = [regex.compile(f"(?e)(?:{regex.escape(n.text)}){{e<={e}}}") for n, e in zip(notices, self.edits)]
        pieces: dict[str, list[tuple[int, int]]] = {}
        for i, (notice, edits) in enumerate(zip(notices, self.edits)):
            cuts = [len(notice.text) * j // (edits + 1) for j in range(edits + 2)]
            for a, b in zip(cuts, cuts[1:]):
                pieces.setdefault(notice.text[a:b], []).append((i, a))
        self.seeds = ahocorasick.Automaton()
        for piece, of in pieces.items():
            self.seeds.add_word(piece, (len(piece), of))
        self.seeds.make_automaton()

    def hits(self, text: str) -> list[tuple]:
        """(label, notice, base, edits, start, end, first word, last word) in the order of start; text as folded."""
        seeds: dict[int, list[tuple[int, int]]] = {}
        for last, (size, of) in self.seeds.iter(text):
            for i, offset in of:
                seeds.setdefault(i, []).append((last + 1 - size - offset, offset))
        if not seeds:
            return []
        found = []
        for i, starts in seeds.items():
            notice, edits, length = self.notices[i], self.edits[i], len(self.notices[i].text)
            places = set()
            if notice.base:
                for a, offset in starts:
                    b = a + length
                    if offset == 0 and text.startswith(notice.text, a) and text[a - 1 : a] in ("", " ") and text[b : b + 1] in ("", " "):
                        places.add((a, b))
                found += [(notice.label, notice.text, True, 0, a, b) for a, b in places]
            for a, b in self._windows(sorted(a for a, _ in starts), length, edits, len(text)):
                for match in self.patterns[i].finditer(text, a, b):
                    if match.span() not in places:
                        found.append((notice.label, notice.text, False, sum(match.fuzzy_counts), *match.span()))
        if not found:
            return []
        found = _closest(found)
        begins = np.cumsum([0, *(len(w) + 1 for w in text.split(" "))])
        spans = np.array([(x[4], x[5] - 1) for x in found])
        words = np.searchsorted(begins, spans, "right") - 1
        return sorted((*x, *w) for x, w in zip(found, words.tolist()))

    @staticmethod
    def _windows(starts: list[int], length: int, edits: int, size: int) -> Iterator[tuple[int, int]]:
        begin = end = -1
        for at in starts:
            a, b = max(0, at - edits), min(size, at + length + edits)
            if a > end:
                if end >= 0:
                    yield begin, end
                begin = a
            end = max(end, b)
        yield begin, end


def _closest(hits: list[tuple]) -> list[tuple]:
    """hits in the order of their shares of edits, without those that overlap one that stays and has a smaller share."""
    overlaps: dict[tuple, list[tuple]] = {h: [] for h in hits}
    under_way: list[tuple] = []
    for hit in sorted(hits, key=lambda h: h[4]):
        under_way = [o for o in under_way if o[5] > hit[4]]  # of each notice a few
        for other in under_way:
            overlaps[hit].append(other)
            overlaps[other].append(hit)
        under_way.append(hit)
    share = {h: h[3] / len(h[1]) for h in hits}
    stays: dict[tuple, None] = {}
    for hit in sorted(hits, key=share.__getitem__):
        if hit[2] or not any(o in stays and share[o] < share[hit] for o in overlaps[hit]):
            stays[hit] = None
    return list(stays)


def find(docs: DataFrame, notices: Sequence[Notice] = NOTICES, rate: float = RATE) -> DataFrame:
    """docs with n_words and hits: a struct for each hit, with its span in characters and words of the folded text."""

    @F.arrow_udf(f"struct<n_words: int, hits: {_HITS}>")
    def scanned(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        scanner = Scanner(notices, rate)
        names = [f.name for f in _HIT.value_type]
        for column in batches:
            counts, hits = [], []
            for text in column.cast(pa.binary()):
                words = (text.as_py() or b"").translate(FOLDED).split()
                counts.append(len(words))
                hits.append([dict(zip(names, h)) for h in scanner.hits(b" ".join(words).decode("utf-8", "replace"))])
            yield pa.StructArray.from_arrays([pa.array(counts, pa.int32()), pa.array(hits, _HIT)], ["n_words", "hits"])

    free = make_way(docs, "n_words", "hits", "_scanned")
    return free.withColumn("_scanned", scanned(F.col("text").cast("string"))).select(
        *free.columns, F.col("_scanned.n_words").alias("n_words"), F.col("_scanned.hits").alias("hits")
    )


def scan(docs: DataFrame, notices: Sequence[Notice] = NOTICES, rate: float = RATE) -> DataFrame:
    """The contract's row of each document; score is the best hit's share of characters without edits."""
    base = F.filter("hits", lambda h: h["base"])

    def joined(hits):
        return F.array_join(F.array_sort(F.array_distinct(F.transform(hits, lambda h: h["label"]))), ",")

    shares = F.transform("hits", lambda h: 1 - h["edits"] / F.char_length(h["notice"]))
    return find(docs.select("doc_id", "text"), notices, rate).select(
        "doc_id",
        F.col("n_words").cast("long").alias("n_words"),
        F.size(base).cast("long").alias("n_base"),
        F.array_min(F.transform(base, lambda h: h["first_word"])).cast("long").alias("first_word"),
        F.array_max(F.transform(base, lambda h: h["first_word"])).cast("long").alias("last_word"),
        joined(base).alias("base_labels"),
        joined(F.col("hits")).alias("labels"),
        F.coalesce(F.array_max(shares), F.lit(0.0)).alias("score"),
    )

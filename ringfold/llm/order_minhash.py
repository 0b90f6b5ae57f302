"""Document fingerprints by order min-hash, with DataFrame functions alone.

A text's k-mers are runs of k words (a run without white space counts as words of max_word
characters). Each k-mer is numbered by its occurrence, so that repeats count, and hashed. The hash
range is cut into as many arcs as the fingerprint has places; for each arc the smallest hashes at
or after its start, cyclically, are selected, put back into text order, and their k-mers hashed as
a tuple. Two texts share a place if they selected the same k-mers in the same order, so moving
passages lowers the likeness as edits do. All arcs are served by one sort of a text's hashes.

Defined results: null is the empty text, whose fingerprint is all zeros; a text shorter than a
k-mer is one k-mer; the same text always has the same fingerprint. In the order of documents null
ids come first and rows of equal id stand by a hash of their text; a lone document is its own next.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pyspark.sql.window import Window

from .common import lower_ascii

PLACES, SELECTED, WORDS, MAX_WORD = 64, 2, 2, 16
#: A packed value holds 33 bits of hash over 30 bits of place: no text of 2 GB has more words.
_PLACE_BITS, _HASH_BITS = 30, 33
_PLACE, _HASH = (1 << _PLACE_BITS) - 1, (1 << _HASH_BITS) - 1
#: So many keys are drawn for each border between ranges.
_DRAWN = 8


def _hash_of(packed: Column) -> Column:
    return F.shiftright(packed, _PLACE_BITS)


def _place_of(packed: Column) -> Column:
    return packed.bitwiseAND(F.lit(_PLACE))


def _pack(hashed: Column, place: Column) -> Column:
    return F.shiftleft(hashed.bitwiseAND(F.lit(_HASH)), _PLACE_BITS).bitwiseOR(place.cast("long"))


def _places(values: Column | str, holds: Callable[[Column], Column]) -> Column:
    """The ascending places, from 0, of the values for which it holds."""
    return F.filter(F.transform(values, lambda x, j: F.when(holds(x), j)), lambda j: j.isNotNull())


def fingerprint(
    df: DataFrame,
    text: str,
    out: str,
    places: int = PLACES,
    selected: int = SELECTED,
    words: int = WORDS,
    max_word: int = MAX_WORD,
) -> DataFrame:
    """df with out: the fingerprint of the column text, an array of places integers below 65536."""
    w, b, p, u, r, e, g, m = (f"_{out}_{x}" for x in "wbpuregm")
    arcs = [(i << _HASH_BITS) // places << _PLACE_BITS for i in range(places)]
    # Each step uses the one before it more than once, which keeps Catalyst from inlining it. A lambda reads what it is
    # called with, as far as it can: looking a value up by its place makes several objects.
    df = df.withColumn(w, F.regexp_extract_all(F.col(text), F.lit(f"\\S{{1,{max_word}}}"), F.lit(0)))
    count = F.when(F.size(w) == 0, 0).otherwise(F.greatest(F.size(w) - (words - 1), F.lit(1)))

    def hash_at(word: Column, i: Column) -> Column:  # as of the array of the words; places beyond the text do not count
        return F.xxhash64(word, *(F.get(w, i + t) for t in range(1, words)))

    df = df.withColumn(b, F.transform(F.slice(F.col(w), F.lit(1), count), hash_at))
    n = F.size(b)
    df = df.withColumn(p, F.sort_array(F.transform(b, _pack)))

    def number(x: Column, occurrence: Column) -> Column:
        return _pack(F.xxhash64(_hash_of(x), occurrence), _place_of(x) + 1)

    def once(x: Column, j: Column) -> Column:
        return F.when(_hash_of(F.get(p, j - 1)) == _hash_of(x), F.lit(-1).cast("long")).otherwise(number(x, F.lit(0)))

    df = df.withColumn(u, F.transform(p, once))  # k-mers by hash with their first number, -1 for those that come again
    df = df.withColumn(r, _places(u, lambda x: x < 0))
    # Two runs of these never touch, as each k-mer has a first one.
    df = df.withColumn(e, F.filter(r, lambda j, i: ~F.get(r, i + 1).eqNullSafe(j + 1)))
    starts = F.filter(r, lambda j, i: ~F.get(r, i - 1).eqNullSafe(j - 1))

    def again(start: Column, run: Column) -> Column:
        return F.transform(F.slice(p, start + 1, F.get(e, run) - start + 1), lambda x, t: number(x, t + 1))

    numbered = F.concat(F.filter(u, lambda x: x >= 0), F.flatten(F.transform(starts, again)))
    df = df.withColumn(g, F.sort_array(numbered))
    df = df.withColumn(m, F.sort_array(F.concat(F.col(g), F.array(*map(F.lit, arcs)))))

    def chosen(mark: Column, arc: Column) -> Column:
        picked = [F.get(g, F.pmod(mark - arc + t, n)) for t in range(selected)]
        return F.sort_array(F.array(*((_place_of(x) - 1).cast("int") for x in picked)))

    def tuple_hash(in_order: Column) -> Column:
        hashed = F.xxhash64(*(F.get(b, F.get(in_order, t)) for t in range(selected)))
        return hashed.bitwiseAND(F.lit(0xFFFF)).cast("int")

    marks = F.transform(_places(m, lambda x: _place_of(x) == 0), chosen)
    found = F.when(n == 0, F.array_repeat(F.lit(0), places)).otherwise(F.transform(marks, tuple_hash))
    return df.withColumn(out, found).drop(w, b, p, u, r, e, g, m)


def likeness(a: str, b: str, places: int = PLACES) -> Column:
    """The share of places in which two fingerprints agree."""
    same = F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda x: x)
    return F.size(same) / F.lit(places)


def as_text(fingerprint: str) -> Column:
    return F.array_join(F.transform(fingerprint, lambda x: F.lpad(lower_ascii(F.hex(x)), 4, "0")), "")


def with_next(docs: DataFrame, columns: list[str], least_ranges: int = 4096, range_rows: int = 65_536) -> tuple[DataFrame, Window]:
    """Rows of docs (doc_id, text) in ranges of ascending doc_id, and the window that orders a range.

    Each range also holds a guest, the first row of the range after it (after the last: of the
    first), so that lead() over the window finds the next of every row that is no guest. Texts move
    once and nothing is stored. Range borders are keys of rows: doc_id and, among equal ids, a hash of the text. Which keys
    they are decides the balance alone: each _DRAWNth of those that a hash of the key draws, or exact quantiles where all
    are drawn. There are about least_ranges of them, or more where a range would have more than range_rows rows.
    """
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63)))
    keyed = docs.select(*columns, F.struct(key.alias("id"), F.xxhash64("text").alias("tie")).alias("_key"))
    n = docs.count()
    ranges = max(least_ranges, -(-n // range_rows))
    step = min(_DRAWN, max(1, -(-n // ranges)))
    odds = -(-(ranges * _DRAWN << 30) // max(1, n))  # of 2^30
    drawn = F.collect_set(F.when(F.pmod(F.xxhash64("_key"), F.lit(1 << 30)) < odds, F.col("_key")))
    some = F.filter(F.array_sort(drawn), lambda _, i: i % step == 0)
    borders = keyed.agg(F.array_sort(F.array_union(F.array(F.min("_key")), some)).alias("borders")).scalar()
    keyed = keyed.withColumn("_borders", borders)
    halvings = F.array(*(F.lit(1 << i) for i in reversed(range(ranges.bit_length()))))
    at = F.aggregate(  # the last border that is no larger, by halving
        halvings,
        F.lit(-1),
        lambda found, step: F.when(
            (found + step < F.size("_borders")) & (F.get("_borders", found + step) <= F.col("_key")), found + step
        ).otherwise(found),
    )
    keyed = keyed.withColumn("_range", at)
    before = F.when(F.col("_range") == 0, F.size("_borders") - 1).otherwise(F.col("_range") - 1)
    own = F.struct(F.col("_range").alias("range"), F.lit(0).alias("guest"))
    border = F.get("_borders", F.col("_range")) == F.col("_key")
    copies = F.when(border, F.array(own, F.struct(before.alias("range"), F.lit(1).alias("guest")))).otherwise(
        F.array(own)
    )
    rows = keyed.select(*columns, "_key", F.explode(copies).alias("_in")).select(
        *columns, "_key", F.col("_in.range").alias("_range"), F.col("_in.guest").alias("_guest")
    )
    return rows, Window.partitionBy("_range").orderBy("_guest", "_key")


def edited_neighbours(docs: DataFrame) -> DataFrame:
    """The contract's rows: each document against its edited text and against the next document."""
    texts = docs.select(docs["doc_id"], F.coalesce(docs["text"].cast("string"), F.lit("")).alias("text"))
    rows, order = with_next(texts, ["doc_id", "text"])
    rows = rows.withColumn("_next", F.lead("text").over(order)).withColumn("n_chars", F.char_length("text"))
    n = F.floor(F.col("n_chars") / 4).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), F.col("n_chars") - n), F.substring("_next", F.lit(1), n))
    rows = rows.select(
        "doc_id", "text", "n_chars", "_range", "_guest", "_key",
        F.when(F.col("_guest") == 0, edited).otherwise("").alias("edited"),
    )
    rows = fingerprint(fingerprint(rows, "text", "own"), "edited", "changed")
    rows = rows.withColumn("_next", F.lead("own").over(order)).where("_guest = 0")
    return rows.select(
        "doc_id",
        F.col("n_chars").cast("long"),
        F.sha2("edited", 256).alias("edited_sha256"),
        as_text("own").alias("fingerprint"),
        as_text("changed").alias("edited_fingerprint"),
        likeness("own", "changed").alias("near_edited"),
        likeness("own", "_next").alias("near_next"),
    )

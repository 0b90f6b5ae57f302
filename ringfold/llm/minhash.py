"""Near-duplicate documents by min-max hashing, confirmed on full shingle sets.

Each permutation of the shingle hashes gives two values of the signature, its minimum and its
maximum, so 192 permutations fill 64 bands of six. A band is made of minima or of maxima of six
permutations: a document's own minimum and maximum under one permutation exclude each other in
small sets and so never share a band. At a similarity of 0.75 a pair misses all bands with a
probability of 4e-6. Six values also keep apart documents that merely share a common passage.

Pairs that share a band are compared in the join itself, before any set moves. Each document carries its
shingles' bitmap: as equal shingles set equal bits, two bitmaps differ in no more bits than the sets in
shingles, so this filter loses nothing; it is sharp for sets of some hundred shingles. Larger ones (LARGE) are
told apart by four bits of each of 128 signature values. At 0.75 some 98 agree, with a deviation of 4.8, and pairs
with fewer than AGREEING are dropped; that loses one similar pair in 3e8. The rest is confirmed on full sets.

Documents with equal shingle sets are one class, known by a number of its own; only classes are banded. In a
bucket of a band no pairs are listed: all members are compared with one hub, then those buckets whose other
members still lie in several components go on with 16, 256 ... hubs, until none is left. So a large group of
copies costs one comparison each, and no link between classes of different components is lost.

Defined results: texts that are null, empty or white space have an empty set and stay alone; fewer words than
a shingle count as one shingle; rows with the same doc_id are judged each by its own text; rows with a null
doc_id link as others do, and a component's id is the smallest doc_id in it that is not null (null without
any). Sets hold 64-bit hashes. Words of a long text are hashed piece by piece.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import of_worker, perhaps_among, removed, stored, text_runs
from .components import connected_components

WORDS, PERMUTATIONS, ROWS = 5, 192, 6
AGREEING, _DIGITS = 70, 128
LARGE = 400  # shingles; sets down to three quarters of that have both marks
_BITS = 10  # of a shingle's hash, by which it sets one of 1024 bits
_DROPPED_BITS = 24  # of a band, where it is only asked whether a band is met again
_PIECE_BYTES = 4 << 20  # of a text whose words are held at once
_CACHED_WORDS, _CACHED_LENGTH = 300_000, 64
_SPACE = re.compile(rb"[ \t-\r]")
_ODD = np.uint64(0x9E3779B97F4A7C15)
_rng = np.random.Generator(np.random.PCG64(20240501))
_MULTIPLY = _rng.integers(0, 1 << 63, PERMUTATIONS, np.uint64) << np.uint64(1) | np.uint64(1)
_XOR = _rng.integers(0, 1 << 63, PERMUTATIONS, np.uint64)


class WordHashes(dict):
    """Hashes of words; it forgets all when it has grown to some 60 MB."""

    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh64_intdigest(word)
        if len(word) <= _CACHED_LENGTH:
            if len(self) >= _CACHED_WORDS:
                self.clear()
            self[word] = h
        return h

    def of(self, text: str | None) -> np.ndarray:
        """The hashes of a text's words, with A-Z lower-cased."""
        data = (text or "").encode("utf-8", "replace").lower()
        parts, start = [], 0
        while len(data) - start > _PIECE_BYTES and (cut := _SPACE.search(data, start + _PIECE_BYTES)):
            parts.append(data[start : cut.start()])
            start = cut.end()
        parts.append(data[start:] if start else data)
        found = []
        for part in parts:
            words = part.split()
            found.append(np.fromiter(map(self.__getitem__, words), np.uint64, len(words)))
        return found[0] if len(found) == 1 else np.concatenate(found)


def _fold(h: np.ndarray, words: np.ndarray) -> np.ndarray:
    h = (h ^ words) * _ODD
    return h ^ (h >> np.uint64(29))


def shingle_sets(texts: list[str | None], width: int = WORDS, words: WordHashes | None = None) -> list[np.ndarray]:
    """Of each text the sorted distinct hashes of its shingles."""
    words = WordHashes() if words is None else words
    split = [words.of(t) for t in texts]
    counts = np.array([len(s) for s in split], np.int64)
    flat = np.concatenate([np.zeros(0, np.uint64), *split])
    ends = np.cumsum(counts)
    starts = ends - counts
    whole = np.zeros(len(texts), np.uint64)  # of texts shorter than a shingle
    for n in range(1, width):
        at = np.flatnonzero(counts == n)
        h = np.full(len(at), n, np.uint64)
        for j in range(n):
            h = _fold(h, flat[starts[at] + j])
        whole[at] = h
    h = np.full(max(0, len(flat) - width + 1), width, np.uint64)
    for j in range(width):
        h = _fold(h, flat[j : len(h) + j])
    return [
        np.unique(h[s : e - width + 1]) if n >= width else whole[i : i + (n > 0)]
        for i, (n, s, e) in enumerate(zip(counts, starts, ends))
    ]


def signatures(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """For each set, none of them empty, a hash of each band and the packed digits of its signature."""
    flat = np.concatenate(sets)
    starts = np.append(0, np.cumsum([len(s) for s in sets])[:-1])
    found = np.empty((len(sets), 2, PERMUTATIONS), np.uint64)
    for p in range(PERMUTATIONS):
        permuted = (flat ^ _XOR[p]) * _MULTIPLY[p]
        found[:, 0, p] = np.minimum.reduceat(permuted, starts)
        found[:, 1, p] = np.maximum.reduceat(permuted, starts)
    digits = found[:, :, : _DIGITS // 2].reshape(len(sets), -1, 16) >> np.uint64(8) & np.uint64(15)
    packed = (digits << np.arange(0, 64, 4, dtype=np.uint64)).sum(axis=2, dtype=np.uint64)
    found = found.reshape(len(sets), -1, ROWS)
    h = np.broadcast_to(np.arange(found.shape[1], dtype=np.uint64) + np.uint64(1), found.shape[:2])
    for r in range(ROWS):
        h = _fold(h, found[:, :, r])
    return h.view(np.int64), packed.view(np.int64)


def bitmaps(sets: list[np.ndarray]) -> np.ndarray:
    """For each set the bits that its shingles set, as a row of longs."""
    bits = np.zeros((len(sets), 1 << _BITS), bool)
    row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    bits[row, np.concatenate(sets) >> np.uint64(64 - _BITS)] = True
    return np.packbits(bits, axis=1).view(np.int64)


def _summed(a: str, b: str, of: Callable[[Column], Column]) -> Column:
    """The sum of of() over the longs in which two arrays differ, by exclusive or.

    Written as a loop over the arrays: unrolled, it makes joins so long that the JVM does not compile them.
    """
    each = F.zip_with(a, b, lambda x, y: of(x.bitwiseXOR(y)))
    return F.aggregate(each, F.lit(0), lambda total, n: total + n)


def differing(a: str, b: str) -> Column:
    """In how many bits two bitmaps differ; their sets differ in as many shingles at least."""
    return _summed(a, b, F.bit_count)


def agreeing(a: str, b: str) -> Column:
    """How many of the digits packed in two arrays of longs are the same."""

    def digits(x: Column) -> Column:
        x = x.bitwiseOR(F.shiftrightunsigned(x, 2))
        return F.bit_count(x.bitwiseOR(F.shiftrightunsigned(x, 1)).bitwiseAND(F.lit(0x1111111111111111)))

    return F.lit(_DIGITS) - _summed(a, b, digits)


def _lists(values: np.ndarray, lens: list[int] | np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(lens)), pa.int32()), pa.array(values, pa.int64()))


_SKETCH_SQL = (
    "doc_id long, text_key long, row_key long, n_shingles long, set_key binary, "
    "bands array<long>, digits array<long>, bits array<long>"
)


def _key(shingles: np.ndarray) -> bytes | None:
    return xxhash.xxh3_128_digest(shingles.tobytes()) if len(shingles) else None


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [part.split(" ")[0] for part in _SKETCH_SQL.split(", ")]
    words = of_worker("words", WordHashes)
    for batch in batches:
        for at, texts in text_runs(batch.column(3)):
            sets = shingle_sets(texts, words=words)
            sizes = np.array([len(s) for s in sets])
            full = [s for s in sets if len(s)]
            bands, digits, bits = (*signatures(full), bitmaps(full)) if full else (np.zeros((0, 1), np.int64),) * 3
            lists = [_lists(x.ravel(), (sizes > 0) * x.shape[1]) for x in (bands, digits, bits)]
            keys = pa.array([_key(s) for s in sets], pa.binary())
            own = [batch.column(k).slice(at, len(texts)) for k in range(3)]
            yield pa.RecordBatch.from_arrays([*own, pa.array(sizes, pa.int64()), keys, *lists], names)


def _full_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    words = of_worker("words", WordHashes)
    for batch in batches:
        for _, texts in text_runs(batch.column(0)):
            sets = shingle_sets(texts, words=words)
            values = np.concatenate(sets).view(np.int64)
            keys = pa.array([_key(s) for s in sets], pa.binary())
            yield pa.RecordBatch.from_arrays([keys, _lists(values, [len(s) for s in sets])], ["set_key", "set"])


def _of_hub(*names: str) -> list[Column]:
    return [F.col(c).alias("hub" if c == "class" else f"{c}_hub") for c in names]


def _links(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those of pairs (stored: x, hub, n_x, n_hub) that are similar enough, by their full sets; others' sets stay where they are."""
    ends = pairs.select(F.explode(F.array("x", "hub")).alias("class"))
    sets = perhaps_among(sets, F.col("class"), ends).where("_perhaps")
    one = pairs.join(sets.select(F.col("class").alias("x"), F.col("set").alias("set_x")), "x")
    both = one.join(sets.select(F.col("class").alias("hub"), F.col("set").alias("set_hub")), "hub")
    shared = F.size(F.array_intersect("set_x", "set_hub"))
    return (
        both.select("x", "hub", "n_x", "n_hub", shared.alias("n"))
        .where(F.lit(100) * F.col("n") >= F.lit(percent) * (F.col("n_x") + F.col("n_hub") - F.col("n")))
        .select("x", "hub")
    )


def class_links(classes: DataFrame, texts: DataFrame, percent: int) -> DataFrame | None:
    """(node, component) of the classes that are linked with another; None if none is.

    classes: class, set_key, row_key, n, bands, digits, bits; texts: row_key, text.
    """
    banded = classes.select("class", F.explode(F.array_distinct("bands")).alias("band"))
    # A class has a band once, so a band met twice has two classes (or its short form has: then a bucket holds one
    # class, and ends at once). Few bands are, and only their members move.
    banded = banded.withColumn("short", F.shiftright("band", _DROPPED_BITS))
    shared = stored(banded.groupBy("short").agg(F.count("*").alias("size")).where("size > 1"), "shared")
    met_again = perhaps_among(banded, F.col("short"), shared.select("short")).where("_perhaps").drop("_perhaps")
    members = stored(met_again.join(shared, "short").select("band", "class", "size"), "members")
    # Hubs are those who share bands with most: in a group of edited copies that is the original.
    met = members.groupBy("class").agg(F.sum("size").alias("met"))
    marks = (
        F.when(F.col("n") * 100 >= LARGE * percent, F.col("digits")).alias("digits"),
        F.when(F.col("n") <= LARGE, F.col("bits")).alias("bits"),
    )
    likely = perhaps_among(classes, F.col("class"), members.select("class")).where("_perhaps")
    known = likely.join(met, "class").select("class", "set_key", "row_key", "met", "n", *marks, "bands")
    known = stored(known, "known")
    open_ = members.select("band", "class").join(known.select("class", "met"), "class").withColumn("comp", F.col("class"))
    open_ = stored(open_, "buckets")

    waiting = known.select("class", "set_key")
    found = perhaps_among(texts, F.col("row_key"), known.select("row_key")).where("_perhaps").select("text")
    # Rows that are not waited for have other keys; equal rows give their set once.
    sets = found.mapInArrow(_full_sets, "set_key binary, set array<long>").dropDuplicates(["set_key"])
    sets = stored(sets.join(waiting, "set_key").select("class", "set"), "sets")
    links = labels = None
    hubs_each = 1
    compared = known.select("class", "n", "digits", "bits")
    # Several hubs may meet a document in several buckets; then the first band of the pair counts.
    first_shared = F.get(F.array_intersect("bands", "bands_hub"), 0) == F.col("band")
    # Of sizes that can be similar, either both have bits or both have digits.
    few = F.lit(100 + percent) * differing("bits", "bits_hub") <= F.lit(100 - percent) * (F.col("n") + F.col("n_hub"))
    near = F.coalesce(few, F.lit(True)) & F.coalesce(agreeing("digits", "digits_hub") >= AGREEING, F.lit(True))
    while not open_.isEmpty():
        if hubs_each == 1:  # an aggregate, so that a bucket's members need not meet
            first = F.max_by(F.struct(*_of_hub("class", "comp")), F.struct("met", -F.col("class"))).alias("h")
            hubs = open_.groupBy("band").agg(first).select("band", "h.*")
        else:
            ordered = Window.partitionBy("band").orderBy(F.desc("met"), "class")
            hubs = open_.withColumn("k", F.row_number().over(ordered)).where(F.col("k") <= hubs_each)
            hubs = hubs.select("band", *_of_hub("class", "n", "comp", "digits", "bits", "bands"))
        hubs = stored(hubs, "hubs")  # so that the join can split a bucket
        meeting = open_.join(hubs, "band").where("class != hub and comp != comp_hub")
        if hubs_each == 1:  # at most a pair for each member, so pairs move and get what they are compared by
            ends = meeting.select(F.greatest("class", "hub").alias("class"), F.least("class", "hub").alias("hub")).distinct()
            meeting = ends.join(compared, "class").join(compared.select(*_of_hub(*compared.columns)), "hub")
        pairs = (
            meeting.where(F.lit(100) * F.least("n", "n_hub") >= F.lit(percent) * F.greatest("n", "n_hub"))
            .where(near)
            .where(F.lit(True) if hubs_each == 1 else first_shared)
            .select(
                F.greatest("class", "hub").alias("x"),
                F.least("class", "hub").alias("hub"),
                F.when(F.col("class") > F.col("hub"), F.col("n")).otherwise(F.col("n_hub")).alias("n_x"),
                F.when(F.col("class") > F.col("hub"), F.col("n_hub")).otherwise(F.col("n")).alias("n_hub"),
            )
            .distinct()
        )
        new = stored(_links(stored(pairs, "pairs"), sets, percent), "links")
        rest = open_.join(hubs.select("band", F.col("hub").alias("class")), ["band", "class"], "left_anti")
        if not new.isEmpty():
            links = new if links is None else links.union(new)
            labels = connected_components(links, "x", "hub")
            rest = rest.join(labels, F.col("class") == F.col("node"), "left").select(
                *(F.coalesce("component", "class").alias(c) if c == "comp" else c for c in open_.columns)
            )
        mixed = rest.groupBy("band").agg(F.min("comp").alias("a"), F.max("comp").alias("b")).where("a < b")
        rest = rest.join(mixed.select("band"), "band", "left_semi")
        if hubs_each == 1:
            rest = rest.join(known.select("class", "n", "digits", "bits", "bands"), "class")
        done, open_ = open_, stored(rest, "buckets")
        removed(done)
        removed(hubs)
        hubs_each *= 16
    for df in (shared, members, known, sets, open_):
        removed(df)
    return labels


def grouped(docs: DataFrame, percent: int = 75) -> DataFrame:
    """(doc_id, text_key, n_shingles, group, component_id) of each row of docs; group is null for empty sets."""
    return _grouped(docs, percent)[0]


def _grouped(docs: DataFrame, percent: int) -> tuple[DataFrame, list[DataFrame]]:
    """grouped(), and the stored frames that it reads.

    (doc_id, text_key, n_shingles, group, component_id) of each row of docs; group is null for empty sets.
    """
    rows = docs.select(docs["doc_id"].cast("long"), docs["text"].cast("string").alias("text")).select(
        "doc_id", F.xxhash64("text").alias("text_key"), F.xxhash64("doc_id", "text").alias("row_key"), "text"
    )
    sketch = stored(rows.mapInArrow(_sketch, _SKETCH_SQL), "sketch")
    full = sketch.where("n_shingles > 0")
    copied = full.groupBy("set_key").count().where("count > 1").select(F.xxhash64("set_key"))
    # Most sets are no other's copy for sure, and need not move to become classes.
    marked = perhaps_among(full, F.xxhash64("set_key"), copied)
    fields = ["row_key", F.col("n_shingles").alias("n"), "bands", "digits", "bits"]
    one = F.min_by(F.struct(*fields), "row_key").alias("one")
    met_again = marked.where("_perhaps").groupBy("set_key").agg(F.min("doc_id").alias("least"), one)
    alone = marked.where("not _perhaps").select("set_key", F.col("doc_id").alias("least"), *fields)
    classes = alone.unionByName(met_again.select("set_key", "least", "one.*"))
    classes = stored(classes.withColumn("class", F.monotonically_increasing_id()), "classes")
    labels = class_links(classes, rows.select("row_key", "text"), percent)
    named = classes.select("set_key", "least", F.col("class").alias("group"))
    if labels is not None:
        named = named.join(labels, F.col("group") == F.col("node"), "left").select(
            "set_key", "least", F.coalesce("component", "group").alias("group")
        )
        smallest = named.groupBy("group").agg(F.min("least").alias("component_id"))
        named = named.join(smallest, "group").select("set_key", "group", "component_id")
    else:
        named = named.withColumnRenamed("least", "component_id")
    result = (
        sketch.select("doc_id", "text_key", "n_shingles", "set_key")
        .join(named, "set_key", "left")
        .select(
            "doc_id", "text_key", "n_shingles", "group",
            F.when(F.col("group").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"),
        )
    )
    return result, [sketch, classes]


def near_duplicates(docs: DataFrame, percent: int = 75) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for each row of docs (doc_id, text).

    Documents are linked from a similarity of percent / 100 up; component_id is the smallest doc_id
    that links reach.
    """
    return grouped(docs, percent).select(
        "doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept")
    )


def keep_one(docs: DataFrame, percent: int = 75) -> DataFrame:
    """Of each group of docs one row, that of the smallest doc_id (null last), with its own columns.

    Rows of equal id and text count once. Texts without words all stay.
    """
    result, read = _grouped(docs, percent)
    found = stored(result, "groups")
    for df in read:
        removed(df)
    own = F.struct(F.col("doc_id").isNull(), "doc_id", "text_key")
    first = found.where("group is not null").groupBy("group").agg(F.min(own).alias("first"))
    dropped = (
        found.join(first, "group")
        .where(~own.eqNullSafe(F.col("first")))
        .select(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key"))
        .distinct()
    )
    dropped = stored(dropped, "dropped")
    marks = dropped.select(F.xxhash64("_id", "_key"))

    def without(rows: DataFrame, doc_id: Column, text_key: Column) -> DataFrame:
        return rows.join(dropped, doc_id.eqNullSafe(dropped["_id"]) & (text_key == dropped["_key"]), "left_anti")

    # Most rows are none of the dropped for sure, and of the others few stay; the texts of those alone move.
    doubtful = perhaps_among(found.select("doc_id", "text_key"), F.xxhash64("doc_id", "text_key"), marks).where("_perhaps")
    doubtful = without(doubtful, F.col("doc_id"), F.col("text_key")).select(F.xxhash64("text_key", "doc_id"))
    doubtful = stored(doubtful.toDF("key"), "doubtful")
    doc_id, text_key = docs["doc_id"].cast("long"), F.xxhash64(docs["text"].cast("string"))
    marked = perhaps_among(docs, F.xxhash64(doc_id, text_key), marks)
    unsure = perhaps_among(marked.where("_perhaps").drop("_perhaps"), F.xxhash64(text_key, doc_id), doubtful).where("_perhaps")
    unsure = without(unsure, unsure["doc_id"].cast("long"), F.xxhash64(unsure["text"].cast("string")))
    kept = marked.where("not _perhaps").unionByName(unsure).select(*docs.columns)
    unrepeated = found.groupBy("doc_id", "text_key").count().where("count > 1").isEmpty()
    removed(found)
    return kept if unrepeated else kept.dropDuplicates(["doc_id", "text"])

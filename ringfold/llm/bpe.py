"""Byte-level BPE over whole texts: batched numpy merge rounds, and the inverse.

A text is cut into chunks (an optional space and a run of Latin letters and digits, or of punctuation, or what
is left up to the next white space; or a run of white space). No pre-token crosses a chunk's end, so the ids of
a chunk depend on the chunk alone and are kept by a worker from batch to batch, up to a number of bytes. Chunks
not met before are split into pre-tokens (those with characters beyond Latin by the library's own splitter) and
merged together, all of a batch in one flat array of symbols; pieces of more than LONG_PIECE bytes are merged one
by one by a queue of pairs, so that a long word costs n log n.

Defined results: a null or empty text has no ids; a null list of ids decodes to the empty text;
the literal of a special token in a text becomes that token's id, as in the tokenizers library.
Very long texts are taken in segments that end between chunks, so memory follows the segment (a run without
a place between chunks is a segment, however long). A column that has the name of the result stays as
<name>_before.
"""

from __future__ import annotations

import heapq
import json
import os
import re
from collections import defaultdict
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache
from itertools import chain, count, islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .common import make_way, of_worker, text_slices

#: White space by the Unicode property, as the pre-tokenizer's pattern has it.
_SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: ASCII punctuation but for the apostrophe, which can begin a contraction.
_MARKS = r"!-&(-/:-@\[-`{-~"
#: Letters and digits on which all versions of Unicode agree: Latin ones. Of other scripts runs stay whole.
_LATIN = r"0-9A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\u024f"
#: A border of Latin letters or digits and punctuation always parts pieces; elsewhere a run stays whole.
_CHUNK = re.compile(
    rf" ?[{_LATIN}]++(?![^{_SPACE}{_MARKS}])| ?[{_MARKS}]++(?![^{_SPACE}{_LATIN}])| ?[^{_SPACE}]+"
    rf"|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+"
)
#: Before white space that follows none, or between a Latin letter or digit and punctuation.
_CUT = re.compile(rf"(?<=[^{_SPACE}])(?=[{_SPACE}])|(?<=[{_LATIN}])(?=[{_MARKS}])")
#: The public pattern that splits a chunk before merging.
_PIECE = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
#: A chunk with other characters than these is split by the library, whose Unicode is the one that counts.
_SURE = regex.compile(rf"[\x00-\x7f\xa0-\u024f{_SPACE}]*+")
_NO_RANK = np.int64(1) << 40

SEGMENT_CHARS = 1 << 20
LONG_PIECE = 256
CACHE_BYTES = 80 << 20
_CHUNK_BYTES = 150  # of a remembered chunk besides its letters and ids


def _byte_chars() -> dict[str, int]:
    """The printable stand-in of each byte in a byte-level vocabulary, and the byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def gather(values: np.ndarray, starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """The runs values[s:s+n], end to end."""
    ends = np.cumsum(lens)
    total = int(ends[-1]) if len(ends) else 0
    return values[np.repeat(starts - (ends - lens), lens) + np.arange(total)]


class Vocabulary:
    """A byte-level BPE file: merge ranks as sorted pair keys, and the bytes of each id."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocab: dict[str, int] = model["vocab"]
        chars = _byte_chars()
        self.byte_ids = np.zeros(256, np.int64)
        for char, byte in chars.items():
            self.byte_ids[byte] = vocab[char]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        left = np.array([vocab[a] for a, _ in pairs], np.int64)
        right = np.array([vocab[b] for _, b in pairs], np.int64)
        keys = left << 32 | right
        order = np.argsort(keys)
        self.keys, self.ranks = keys[order], order.astype(np.int64)
        self._rank_of: dict[int, int] | None = None
        self.merged = np.array([vocab[a + b] for a, b in pairs], np.int64)  # by rank
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", ())}
        content = {i: bytes(chars[c] for c in s) for s, i in vocab.items() if s not in self.special}
        content |= {i: s.encode() for s, i in self.special.items()}
        size = max(content) + 1
        parts = [content.get(i, b"") for i in range(size)]
        self.token_lens = np.array([len(p) for p in parts], np.int64)
        self.token_starts = np.cumsum(self.token_lens) - self.token_lens
        self.token_bytes = np.frombuffer(b"".join(parts), np.uint8)

    def merge(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pieces, end to end, and how many each has.

        A round merges in every piece all places of its lowest-rank pair; pieces without a pair
        leave the flat array.
        """
        if any(len(p) > LONG_PIECE for p in pieces):
            found = [(self.merge_long(p), 1) if len(p) > LONG_PIECE else None for p in pieces]
            short, counts = self.merge([p for p in pieces if len(p) <= LONG_PIECE])
            each = iter(np.split(short, np.cumsum(counts)[:-1]) if len(counts) else ())
            parts = [f[0] if f else next(each) for f in found]
            return np.concatenate(parts), np.fromiter(map(len, parts), np.int64, len(parts))
        lens = np.fromiter(map(len, pieces), np.int64, len(pieces))
        symbols = self.byte_ids[np.frombuffer(b"".join(pieces), np.uint8)]
        piece = np.repeat(np.arange(len(pieces)), lens)
        done_symbols, done_pieces = [], []
        while len(symbols):
            key = symbols[:-1] << 32 | symbols[1:]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            found = (self.keys[at] == key) & (piece[:-1] == piece[1:])
            rank = np.append(np.where(found, self.ranks[at], _NO_RANK), _NO_RANK)
            first = np.flatnonzero(np.append(True, piece[1:] != piece[:-1]))
            counts = np.diff(np.append(first, len(piece)))
            lowest = np.repeat(np.minimum.reduceat(rank, first), counts)
            over = lowest == _NO_RANK
            if over.any():
                done_symbols.append(symbols[over])
                done_pieces.append(piece[over])
                symbols, piece, rank, lowest = (x[~over] for x in (symbols, piece, rank, lowest))
                if not len(symbols):
                    break
            hit = np.flatnonzero(rank == lowest)
            # A pair of equal symbols can overlap itself: of a run of places every other one counts.
            run = np.append(True, np.diff(hit) != 1)
            since = np.arange(len(hit)) - np.flatnonzero(run)[np.cumsum(run) - 1]
            hit = hit[since % 2 == 0]
            symbols = symbols.copy()
            symbols[hit] = self.merged[rank[hit]]
            keep = np.ones(len(symbols), bool)
            keep[hit + 1] = False
            symbols, piece = symbols[keep], piece[keep]
        if not done_symbols:
            return np.zeros(0, np.int64), lens
        piece = np.concatenate(done_pieces)
        order = np.argsort(piece, kind="stable")
        return np.concatenate(done_symbols)[order], np.bincount(piece, minlength=len(pieces))

    def merge_long(self, piece: bytes) -> np.ndarray:
        """Ids of one piece: its pairs in a queue by rank and place, each merge making two new ones at most."""
        symbols = self.byte_ids[np.frombuffer(piece, np.uint8)]
        key = symbols[:-1] << 32 | symbols[1:]
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        places = np.flatnonzero(self.keys[at] == key)
        queue = list(zip(self.ranks[at[places]].tolist(), places.tolist(), key[places].tolist()))
        heapq.heapify(queue)
        values, n = symbols.tolist(), len(symbols)
        following, before = list(range(1, n + 1)), list(range(-1, n - 1))
        rank_of, merged = self.rank_of(), self.merged

        def offer(left: int, right: int) -> None:
            pair = values[left] << 32 | values[right]
            if (rank := rank_of.get(pair)) is not None:
                heapq.heappush(queue, (rank, left, pair))

        while queue:
            rank, left, pair = heapq.heappop(queue)
            right = following[left]
            if right >= n or values[left] < 0 or values[left] << 32 | values[right] != pair:
                continue
            values[left], values[right] = int(merged[rank]), -1
            following[left] = after = following[right]
            if after < n:
                before[after] = left
                offer(left, after)
            if (earlier := before[left]) >= 0:
                offer(earlier, left)
        return np.fromiter((v for v in values if v >= 0), np.int64)

    def rank_of(self) -> dict[int, int]:
        if self._rank_of is None:
            self._rank_of = dict(zip(self.keys.tolist(), self.ranks.tolist()))
        return self._rank_of

    def decode(self, ids: np.ndarray, lens: np.ndarray) -> list[str]:
        """Texts of runs of ids; bytes that are no UTF-8 become U+FFFD."""
        if len(ids) and (ids.min() < 0 or ids.max() >= len(self.token_lens)):
            raise ValueError("an id outside the vocabulary")
        sizes = self.token_lens[ids]
        flat = gather(self.token_bytes, self.token_starts[ids], sizes).tobytes()
        ends = np.append(0, np.cumsum(sizes))[np.append(0, np.cumsum(lens))]
        return [flat[a:b].decode("utf-8", "replace") for a, b in zip(ends[:-1], ends[1:])]


class ChunkEncoder:
    """Ids of texts through a bounded cache of chunks; fresh(chunks) encodes those not in it."""

    def __init__(self, fresh: Callable[[list[str]], tuple[np.ndarray, np.ndarray]], special: dict[str, int]):
        self.fresh, self.special = fresh, special
        self.split = re.compile("(" + "|".join(map(re.escape, special)) + ")") if special else None
        self.clear()

    def clear(self) -> None:
        self.index: defaultdict[str, int] = defaultdict(count().__next__)  # chunks are numbered as they come
        self.ids = np.zeros(0, np.int32)
        self.starts = self.lens = np.zeros(0, np.int64)
        self.bytes = 0

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts without special tokens, end to end, and how many each has."""
        if self.bytes > CACHE_BYTES:
            self.clear()
        chunks = [_CHUNK.findall(t) for t in texts]
        counts = [len(c) for c in chunks]
        known = len(self.index)
        at = np.fromiter(map(self.index.__getitem__, chain.from_iterable(chunks)), np.int64, sum(counts))
        if new := list(islice(self.index, known, None)):
            ids, lens = self.fresh(new)
            self.starts = np.append(self.starts, len(self.ids) + np.cumsum(lens) - lens)
            self.lens = np.append(self.lens, lens)
            self.ids = np.append(self.ids, ids.astype(np.int32))
            self.bytes += sum(map(len, new)) + 4 * len(ids) + _CHUNK_BYTES * len(new)
        lens = self.lens[at]
        bounds = np.append(0, np.cumsum(lens))[np.append(0, np.cumsum(counts))]
        return gather(self.ids, self.starts[at], lens), np.diff(bounds)

    def encode_column(self, texts: Iterable[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """As encode, for any texts: special tokens count, nulls are empty, long texts go in segments."""
        ids, owners, sizes = [], [], []
        waiting: list[str] = []
        owner: list[int] = []
        chars = rows = 0

        def flush() -> None:
            nonlocal waiting, owner, chars
            if not waiting:
                return
            got, lens = self.encode(waiting)
            ids.append(got)
            owners.extend(owner)
            sizes.extend(lens)
            waiting, owner, chars = [], [], 0

        for rows, text in enumerate(texts, 1):
            for segment in self._segments(text or ""):
                if segment in self.special:
                    flush()
                    ids.append(np.array([self.special[segment]], np.int32))
                    owners.append(rows - 1)
                    sizes.append(1)
                    continue
                waiting.append(segment)
                owner.append(rows - 1)
                chars += len(segment)
                if chars >= SEGMENT_CHARS:
                    flush()
        flush()
        lens = np.bincount(np.array(owners, np.int64), np.array(sizes, np.int64), minlength=rows)
        return np.concatenate([np.zeros(0, np.int32), *ids]), lens.astype(np.int64)

    def _segments(self, text: str) -> Iterator[str]:
        for part in self.split.split(text) if self.split and self.split.search(text) else (text,):
            start = 0
            while len(part) - start > SEGMENT_CHARS and (m := _CUT.search(part, start + SEGMENT_CHARS)):
                yield part[start : m.start()]
                start = m.start()
            yield part[start:]


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


@lru_cache(maxsize=2)
def library(path: str) -> Tokenizer:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the task has one core
    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


def numpy_encoder(path: str) -> ChunkEncoder:
    vocab = vocabulary(path)
    byte_of = _byte_chars()

    def pieces_of(chunk: str) -> list[bytes]:
        if _SURE.fullmatch(chunk):
            return [p.encode() for p in _PIECE.findall(chunk)]
        found = library(path).pre_tokenizer.pre_tokenize_str(chunk)  # read when first needed: it takes memory
        return [bytes(map(byte_of.__getitem__, piece)) for piece, _ in found]

    def fresh(chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        split = [pieces_of(c) for c in chunks]
        number: dict[bytes, int] = {}
        at = np.fromiter((number.setdefault(p, len(number)) for ps in split for p in ps), np.int64)
        ids, lens = vocab.merge(list(number))
        starts = np.cumsum(lens) - lens
        bounds = np.append(0, np.cumsum(lens[at]))[np.append(0, np.cumsum([len(ps) for ps in split]))]
        return gather(ids, starts[at], lens[at]), np.diff(bounds)

    return ChunkEncoder(fresh, vocab.special)


def list_array(values: np.ndarray, lens: np.ndarray) -> pa.ListArray:
    offsets = np.append(0, np.cumsum(lens)).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, pa.int32()))


def encode_with(
    encoder: Callable[[str], ChunkEncoder], path: str, text: Column, end_id: int | None = None
) -> Column:
    """A column of id lists, each closed by end_id if one is given.

    encoder(path) is made once in a Python worker, and kept as long as the stage.
    """

    @F.arrow_udf("array<int>")
    def ids(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = of_worker((encoder.__name__, path), lambda: encoder(path))
        for texts in batches:
            found, lens = own.encode_column(t.as_py() for t in texts)
            if end_id is not None:
                found, lens = np.insert(found, np.cumsum(lens), end_id), lens + 1
            yield list_array(found, lens)

    return ids(text.cast("string"))


def _moved(df: DataFrame, name: str, out: str) -> Column:
    """The column of that name in make_way(df, out)."""
    kept = make_way(df, out)
    return F.col(kept.columns[[c.lower() for c in df.columns].index(name.lower())])


def encode(df: DataFrame, path: str, text: str = "text", out: str = "ids") -> DataFrame:
    """df with out: the ids of each text by the vocabulary file at path."""
    return make_way(df, out).withColumn(out, encode_with(numpy_encoder, path, _moved(df, text, out)))


def decode(df: DataFrame, path: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """df with out: the text of each list of ids; special tokens stay."""

    @F.arrow_udf("string")
    def texts(lists: pa.Array) -> pa.Array:
        lens = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        flat = lists.flatten().to_numpy(zero_copy_only=False)
        found, vocab = [], vocabulary(path)
        ends = np.cumsum(lens)
        start = 0
        while start < len(lens):  # about a segment of ids at a time, one whole text at least
            base = ends[start] - lens[start]
            stop = max(start + 1, int(np.searchsorted(ends, base + SEGMENT_CHARS, "right")))
            found += vocab.decode(flat[base : ends[stop - 1]], lens[start:stop])
            start = stop
        return pa.array(found, pa.string())

    return make_way(df, out).withColumn(out, texts(_moved(df, ids, out)))


def coded(text: Column, path: str) -> Column:
    """A struct of the ids of each text, and the text that they decode to: both in one pass of one Python worker."""

    @F.arrow_udf("struct<ids: array<int>, decoded: string>")
    def both(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for lists, decoded, _ in _round_trips(batches, path):
            yield pa.StructArray.from_arrays([lists, pa.array(decoded, pa.string())], ["ids", "decoded"])

    return both(text.cast("string"))


def checked(text: Column, path: str) -> Column:
    """A struct of the ids of each text, and whether they decode to it: both in one pass of one Python worker."""

    @F.arrow_udf("struct<ids: array<int>, decodes: boolean>")
    def both(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for lists, decoded, texts in _round_trips(batches, path):
            same = [x == (t or "") for x, t in zip(decoded, texts)]
            yield pa.StructArray.from_arrays([lists, pa.array(same, pa.bool_())], ["ids", "decodes"])

    return both(text.cast("string"))


def _round_trips(batches: Iterator[pa.Array], path: str) -> Iterator[tuple[pa.ListArray, list[str], list[str | None]]]:
    """The ids of each batch of texts, the texts they decode to, and the texts."""
    own, vocab = of_worker((numpy_encoder.__name__, path), lambda: numpy_encoder(path)), vocabulary(path)
    for column in batches:
        texts = column.to_pylist()
        ids, lens, decoded = [np.zeros(0, np.int32)], [np.zeros(0, np.int64)], []
        for a, b in text_slices(texts):
            found, sizes = own.encode_column(texts[a:b])
            ids.append(found)
            lens.append(sizes)
            decoded += vocab.decode(found, sizes)
        yield list_array(np.concatenate(ids), np.concatenate(lens)), decoded, texts


def digests(df: DataFrame, path: str) -> DataFrame:
    """The contract's row of each document: counts and digests of its ids and of their text."""
    both = df.select("doc_id", coded(F.col("text"), path).alias("coded"))
    return both.select(
        "doc_id",
        F.size("coded.ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("coded.ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("coded.decoded", 256).alias("decoded_sha256"),
    )

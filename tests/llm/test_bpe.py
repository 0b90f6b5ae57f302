import hashlib
import random
import time
import zlib

import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from ringfold.llm import bpe, token_files

PATH = public_tokenizers.path("byte_bpe_50k.json")
LIBRARY = Tokenizer.from_file(PATH)
ALPHABET = "ab c  \n\t\r\x0b\x1c\x1f\x85\xa0​　﻿'sdtrvmlé²½Ⅷ١一😀ñ.,!%&$0123\x00"
TEXTS = [
    None, "", " ", "   \n\n ", "'s 's's", "aa" * 3000, "a   <|endoftext|>  b<|endoftext|>", "x" * 50 + " y" * 50,
    *("".join(random.Random(i).choices(ALPHABET, k=i % 40)) for i in range(400)),
]


def expected(text):
    return LIBRARY.encode(text or "", add_special_tokens=False).ids


@pytest.mark.parametrize("encoder", [bpe.numpy_encoder, token_files.library_encoder])
def test_ids_are_the_librarys(encoder):
    ids, lens = encoder(PATH).encode_column(TEXTS)
    ends = np.append(0, np.cumsum(lens))
    assert [ids[a:b].tolist() for a, b in zip(ends[:-1], ends[1:])] == [expected(t) for t in TEXTS]


def drawn(rng):
    """A text of any code points, of letters that Unicode versions disagree on, or of white space."""
    n = rng.randrange(1, 30)
    return "".join(
        rng.choices(
            rng.choice([
                [chr(c) for c in (rng.randrange(0x20000) for _ in range(40)) if not 0xD800 <= c < 0xE000],
                ["\u209f", "\U000191aa", "\U00018dd2", "'t", "'s", " ", "!", "a", "1", "\u06f3", "_"],
                ["a", "'s", " ", "  ", "\n", "!", "_", "\xf1", "\u2019", *map(chr, (rng.randrange(0x250, 0x3000) for _ in range(9)))],
                [" ", "x", "\n", "\xa0", "\u3000", "\x1c", "\x85"],
            ]),
            k=n,
        )
    )


@pytest.mark.parametrize("encoder", [bpe.numpy_encoder, token_files.library_encoder])
def test_ids_of_any_unicode(encoder):
    rng = random.Random(11)
    texts = [drawn(rng) for _ in range(30_000)]
    ids, lens = encoder(PATH).encode_column(texts)
    ends = np.append(0, np.cumsum(lens))
    want = [e.ids for e in LIBRARY.encode_batch(texts, add_special_tokens=False)]
    assert [ids[a:b].tolist() for a, b in zip(ends[:-1], ends[1:])] == want


def test_long_texts_in_segments(monkeypatch):
    monkeypatch.setattr(bpe, "SEGMENT_CHARS", 64)
    texts = [" ".join(["some  words\n and more"] * 60), "x" * 500, *TEXTS]
    ids, lens = bpe.numpy_encoder(PATH).encode_column(texts)
    ends = np.append(0, np.cumsum(lens))
    assert [ids[a:b].tolist() for a, b in zip(ends[:-1], ends[1:])] == [expected(t) for t in texts]


def test_long_words():
    rng = random.Random(1)
    parts = ["".join(rng.choices("abcdefgh", k=5000)), "a" * 3001, "é" * 999, "short", "!?" * 700]
    texts = [" ".join(parts), "".join(parts), *parts]
    ids, lens = bpe.numpy_encoder(PATH).encode_column(texts)
    ends = np.append(0, np.cumsum(lens))
    assert [ids[a:b].tolist() for a, b in zip(ends[:-1], ends[1:])] == [expected(t) for t in texts]
    began = time.perf_counter()
    bpe.numpy_encoder(PATH).encode_column(["".join(rng.choices("abcdefghijklmnop", k=300_000))])
    assert time.perf_counter() - began < 20


def test_cache_is_bounded(monkeypatch):
    monkeypatch.setattr(bpe, "CACHE_BYTES", 2000)
    encoder = bpe.numpy_encoder(PATH)
    for i in range(30):
        texts = [f"some{i} word{i + k} and {k}" for k in range(20)]
        ids, lens = encoder.encode_column(texts)
        assert ids[: lens[0]].tolist() == expected(texts[0])
    assert len(encoder.index) < 200


def test_decode_replaces_broken_bytes():
    ids = np.array(LIBRARY.encode("é一").ids[:1] + [0])
    assert bpe.vocabulary(PATH).decode(ids, np.array([2])) == [LIBRARY.decode(ids.tolist(), skip_special_tokens=False)]
    with pytest.raises(ValueError):
        bpe.vocabulary(PATH).decode(np.array([10**6]), np.array([1]))


def test_digests(spark):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    rows = {r.doc_id: r for r in bpe.digests(docs, PATH).collect()}
    for i, text in enumerate(TEXTS):
        ids = expected(text)
        assert rows[i].n_tokens == len(ids)
        assert rows[i].ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        back = LIBRARY.decode(ids, skip_special_tokens=False)
        assert rows[i].decoded_sha256 == hashlib.sha256(back.encode()).hexdigest()
    assert bpe.digests(docs.limit(0), PATH).count() == 0


def test_checked_ids(spark):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "i long, text string")
    for i, (ids, decodes) in docs.select("i", bpe.checked(F.col("text"), PATH)).collect():
        assert ids == expected(TEXTS[i]) and decodes == (LIBRARY.decode(ids, skip_special_tokens=False) == (TEXTS[i] or ""))
    assert docs.limit(0).select(bpe.checked(F.col("text"), PATH)).count() == 0


def test_extra_columns_stay(spark):
    docs = spark.createDataFrame([(1, "a b", "kept")], "doc_id long, text string, tokens string")
    row = bpe.decode(bpe.encode(docs, PATH), PATH).first()
    assert (row.tokens, row.decoded, row.ids) == ("kept", "a b", expected("a b"))


def test_names_in_use_stay(spark):
    docs = spark.createDataFrame([(1, "a b", [5], "own")], "doc_id long, text string, IDS array<int>, ids_before string")
    coded = bpe.encode(docs, PATH)
    assert coded.columns == ["doc_id", "text", "ids_before_before", "ids_before", "ids"]
    assert coded.first()[2:] == ([5], "own", expected("a b"))
    assert bpe.encode(docs, PATH, out="text").first().text == expected("a b")
    back = bpe.decode(coded, PATH, "ids", "text")
    assert (back.first().text, back.first().text_before) == ("a b", "a b")


def test_token_file_layout_and_selective_reads(spark, tmp_path):
    rng = random.Random(3)
    rows = [(i, " ".join(f"word{rng.randrange(300)}" for _ in range(60)), "kept out") for i in range(4000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, position string").repartition(7)
    path = f"{tmp_path}/tokens"
    token_files.write(docs, path, PATH, row_group_bytes=64 << 10, page_bytes=8 << 10, page_rows=100)
    groups = 0
    for file in (tmp_path / "tokens").glob("*.parquet"):
        meta = pq.ParquetFile(file).metadata
        groups = max(groups, meta.num_row_groups)
        for g in range(meta.num_row_groups):
            columns = {meta.row_group(g).column(c).path_in_schema: meta.row_group(g).column(c) for c in range(meta.num_columns)}
            assert all(c.has_offset_index and c.has_column_index for n, c in columns.items() if n in ("doc_id", "n_tokens"))
            assert {"DELTA_BINARY_PACKED", "RLE_DICTIONARY"} & set(columns["doc_id"].encodings)
            ids = next(c for n, c in columns.items() if n.startswith("ids"))
            assert {"RLE_DICTIONARY", "DELTA_BINARY_PACKED"} & set(ids.encodings)
    assert groups > 1
    some = token_files.read(spark, path, 1200, 1210)
    assert [r.doc_id for r in some.orderBy("doc_id").collect()] == list(range(1200, 1211))
    assert all(r.ids == [*expected(rows[r.doc_id][1]), 0] for r in some.collect())
    plan = some._jdf.queryExecution().toString()
    assert "GreaterThanOrEqual(doc_id,1200)" in plan and "LessThanOrEqual(doc_id,1210)" in plan
    counts = token_files.read(spark, path, columns=("doc_id", "n_tokens"))
    assert "ids" not in counts._jdf.queryExecution().executedPlan().toString()
    wanted = spark.createDataFrame([(7,), (3999,), (7,), (10**6,)], "doc_id long")
    assert sorted(r.doc_id for r in token_files.read_some(spark, path, wanted).collect()) == [7, 3999]
    first = token_files.starts(token_files.read(spark, path)).where(F.col("doc_id") == 0).first()
    assert first.start == 0


def test_token_files(spark):
    rows = [(i * 3, t) for i, t in enumerate(TEXTS)] + [(9, "again"), (9, "again"), (None, "no id")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    found = token_files.round_trip(docs, PATH).collect()
    assert len(found) == len(rows)
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    starts = sorted((r.start, r.n_tokens) for r in found)
    assert starts[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(starts, starts[1:]))
    by_place = [r.doc_id for r in sorted(found, key=lambda r: r.start)]
    assert by_place == [r[0] for r in order]
    for r in found:
        if r.doc_id not in (9, None):
            ids = [*expected(TEXTS[r.doc_id // 3]), 0]
            assert (r.n_tokens, r.ids_crc32) == (len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
    assert token_files.round_trip(docs.limit(0), PATH).count() == 0

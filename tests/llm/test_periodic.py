import hashlib
import random
import zlib

import numpy as np
import pytest

from ringfold.llm import periodic


def brute(words):
    """All runs by comparing every word with the one q later, for every q."""
    n, found = len(words), []
    for q in range(1, n // 3 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            s, e = i, j + q
            if j > i and e - s >= max(24, 3 * q) and not any(words[s : e - r] == words[s + r : e] for r in range(1, q)):
                found.append((s, e - s, q))
            i = j + 1
    return sorted(found)


def planted(doc_id, text):
    words = (text or "").encode().split()
    n, h = len(words), zlib.crc32(str(doc_id).encode())
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    return words


def texts(seed, n):
    rng = random.Random(seed)
    found = []
    for _ in range(n):
        parts, v = [], rng.choice([2, 3, 5, 50])
        for _ in range(rng.randrange(1, 6)):
            q = rng.choice([1, 2, 3, 5, 7, 8, 9, 15, 16, 17, 20, 31, 33, 40, 65])
            base = [f"w{rng.randrange(v)}" for _ in range(q)]
            parts += (base * 20)[: int(q * rng.choice([1, 2, 2.5, 2.97, 3, 3.2, 4, 7, 12]))]
            parts += [f"w{rng.randrange(v)}" for _ in range(rng.randrange(20))]
        found.append(" ".join(parts))
    fibonacci = ["a", "a b"]
    while len(fibonacci[-1]) < 900:
        fibonacci.append(f"{fibonacci[-1]} {fibonacci[-2]}")
    two = " ".join(rng.choice("ab") for _ in range(700))
    return [*found, fibonacci[-1], two, "a " * 500, "a", "", None, "é\tü\n" * 30, "x y " * 24]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_runs_are_brute_force(seed):
    rows = [None if t is None else t.encode() for t in texts(seed, 120)]
    found, split = periodic.of_texts(rows)
    assert found == [brute(words) for words in split]
    assert sum(map(len, found)) > 100


def test_transform_gives_the_sums_of_squared_differences():
    rng = np.random.default_rng(4)
    blocks, windows = rng.integers(1, 4000, (5, 16)), rng.integers(0, 4000, (5, 47))
    sums = periodic.mismatches(blocks, windows, 32)
    for i in range(5):
        assert sums[i].tolist() == [int(((blocks[i] - windows[i, d : d + 16]) ** 2).sum()) for d in range(32)]
    rows = rng.integers(0, periodic.PRIME, (3, 64))
    assert (periodic.restored(periodic.transformed(rows)) == rows).all()


def test_words_that_share_a_code_are_told_apart(monkeypatch):
    monkeypatch.setattr(periodic, "PRIME", 17)  # the codes of two words only; sums mean nothing any more
    monkeypatch.setattr(periodic, "mismatches", lambda blocks, windows, n: np.zeros((len(blocks), n), np.int64))
    rows = [t.encode() for t in texts(5, 20) if t]
    found, split = periodic.of_texts(rows)
    assert found == [brute(words) for words in split]


def test_long_periods_and_long_texts():
    rng = random.Random(6)
    base = [f"w{rng.randrange(30)}" for _ in range(5000)]
    words = base * 3 + base[:17] + ["end"] + ["z"] * 100_000
    (found,), _ = periodic.of_texts([" ".join(words).encode()])
    assert (0, 15_017, 5000) in found and (15_018, 100_000, 1) in found


def test_digests_are_brute_force(spark):
    rows = [(i, t) for i, t in enumerate(texts(7, 150))]
    docs = spark.createDataFrame([(i, t, 1, "c") for i, t in rows], "doc_id long, text string, runs int, h string")
    found = {r.doc_id: r for r in periodic.digests(docs).collect()}
    assert len(found) == len(rows) and sum(zlib.crc32(str(i).encode()) % 10 == 0 for i, _ in rows) > 5
    for i, text in rows:
        words = planted(i, text)
        runs, row = brute(words), found[i]
        top = max(runs, key=lambda r: (r[1] * 10**6 // r[2], -r[0], -r[2]), default=(None, None, None))
        assert (row.n_runs, row.start, row.length, row.period) == (len(runs), *top)
        assert row.exponent_milli == (None if not runs else 1000 * top[1] // top[2])
        dropped = {j for s, length, q in runs for j in range(s + q, s + length)}
        kept = b" ".join(w for j, w in enumerate(words) if j not in dropped)
        assert row.collapsed_sha256 == hashlib.sha256(kept).hexdigest()
        assert row.runs_sha256 == hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()).hexdigest()


def test_rows_and_names_are_kept(spark):
    docs = spark.createDataFrame([(None, "a " * 30, 1), (2, None, 2), (2, None, 2)], "doc_id long, text string, runs int")
    found = periodic.find(docs)
    assert found.columns == ["doc_id", "text", "runs_before", "n_words", "runs", "collapsed"]
    assert sorted((r.runs_before, r.n_words, len(r.runs), r.collapsed) for r in found.collect()) == [(1, 30, 1, "a"), (2, 0, 0, ""), (2, 0, 0, "")]
    assert periodic.find(docs.limit(0)).count() == 0 and periodic.digests(docs.limit(0)).count() == 0

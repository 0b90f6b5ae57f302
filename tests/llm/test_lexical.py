import math
import random
import re
from collections import Counter

import pytest

from ringfold.llm import lexical
from ringfold.llm.common import stored

SPLIT = re.compile(lexical.TERM)
SCHEMA = "doc_id long, text string, term string, block int"


def terms_of(text):
    return SPLIT.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items, k=10):
    held = [(d, Counter(terms_of(t)), len(terms_of(t))) for d, t in docs if terms_of(t)]
    total, length = len(held), sum(n for *_, n in held)
    df = Counter(term for _, counts, _ in held for term in counts)
    found = []
    for item, text in items:
        scored = []
        for d, counts, n in held:
            m = 100 - 90 + (90 * n * total) // length
            score = sum(
                math.floor(1000 * math.log((2 * total + 2) / (2 * df[t] + 1))) * ((10**9 * counts[t]) // (1000 * counts[t] + 8 * m))
                for t in set(terms_of(text)) if t in counts
            )
            if score > 0:
                scored.append((-score, d is None, d or 0, d))
        found += [(item, i + 1, d, -s) for i, (s, _, _, d) in enumerate(sorted(scored)[:k])]
    return found


def corpus(seed, n):
    rng = random.Random(seed)
    vocabulary = [f"T{i}" if i % 3 else f"é{i}" for i in range(120)]
    weights = [1 / (i + 1) for i in range(120)]
    docs = [(i * 7 % n, " ".join(rng.choices(vocabulary, weights, k=rng.choice([1, 5, 30, 200])))) for i in range(n)]
    docs += [(n, None), (n + 1, ""), (n + 2, " .,-"), (None, docs[0][1]), (5, docs[0][1]), (n + 3, "same Same-same"), (n + 4, "same Same-same")]
    items = [(j, ", ".join(rng.choices(vocabulary, k=rng.choice([1, 6, 25])))) for j in range(30)]
    return docs, items + [(100, None), (101, "unknown words"), (102, "SAME"), (103, "")]


def rows(found):
    return sorted(tuple(r) for r in found.select("item_id", "rank", "doc_id", "score").collect())


@pytest.mark.parametrize("block, bundle_bits, bytes_", [(8192, 8, 16 << 20), (16, 2, 16 << 20), (7, 8, 0)])
def test_search_is_brute_force(spark, monkeypatch, block, bundle_bits, bytes_):
    monkeypatch.setattr(lexical, "BUNDLE_BITS", bundle_bits)
    monkeypatch.setattr(lexical, "VOCABULARY_BYTES", bytes_)
    docs, items = corpus(block, 300)
    table = spark.createDataFrame([(d, t, "x", 1) for d, t in docs], SCHEMA).repartition(5)
    asked = spark.createDataFrame([(j, t, 3) for j, t in items], "item_id long, text string, rank int")
    found = lexical.search(table, asked, block=block)
    assert rows(found) == sorted(brute(docs, items), key=lambda r: r[:2])


def test_few_documents_and_none(spark):
    items = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert rows(lexical.search(spark.createDataFrame([(3, "b"), (4, "c")], "doc_id long, text string"), items)) == sorted(
        brute([(3, "b"), (4, "c")], [(1, "a b")])
    )
    assert rows(lexical.search(spark.createDataFrame([], "doc_id long, text string"), items)) == []
    assert rows(lexical.search(spark.createDataFrame([(3, "b")], "doc_id long, text string"), items.limit(0))) == []


def test_ties_across_blocks_go_to_small_ids_and_long_texts_count(spark):
    docs = [(i, "tie word") for i in range(60, 0, -1)] + [(100, "word " * 200_000)]
    found = lexical.search(spark.createDataFrame(docs, "doc_id long, text string").repartition(4), spark.createDataFrame([(1, "tie word")], "item_id long, text string"), block=9)
    assert [r[2] for r in rows(found)] == list(range(1, 11))
    assert rows(found) == brute(docs, [(1, "tie word")])


def test_index_holds_all_postings(spark):
    docs, _ = corpus(2, 50)
    index = stored(lexical.index(spark.createDataFrame(docs, "doc_id long, text string")), "index_test").collect()
    found = Counter()
    ids = {r.block: r.ids for r in index if r.term is None}
    for r in index:
        for at, tf in zip(r.at or [], r.tf or []):
            found[r.term, ids[r.block][at], tf] += 1
    assert found == Counter((t, d, tf) for d, text in docs for t, tf in Counter(terms_of(text)).items())

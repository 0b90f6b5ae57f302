import hashlib
import random
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from ringfold.llm import common, components, minhash, mixing, order_minhash, quality, toxicity

DOCS = "doc_id long, text string, source string, lang string"


def words(rng, n, vocabulary=400):
    return [f"w{rng.randrange(vocabulary)}" for _ in range(n)]


def near_texts():
    rng = random.Random(3)
    texts = []
    for g in range(25):
        base = words(rng, rng.choice([3, 6, 9, 40, 120]))
        for c in range(rng.choice([1, 2, 5, 12])):
            copy = list(base)
            for _ in range(rng.randrange(4)):
                copy[rng.randrange(len(copy))] = f"x{rng.randrange(1000)}"
            texts.append(" ".join(copy))
    texts += ["", "  \n", None, texts[0], texts[0].upper(), texts[0].replace(" ", "\t"), "One two", "one\ttwo", "é É"]
    return texts


def brute_components(texts):
    sets = []
    for t in texts:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    parent = list(range(len(sets)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return [(i, len(sets[i]), find(i), find(i) == i) for i in range(len(sets))]


def test_near_duplicates_are_brute_force(spark):
    texts = near_texts()
    docs = spark.createDataFrame([(i, t, "s", 7) for i, t in enumerate(texts)], "doc_id long, text string, band string, n int")
    found = sorted(tuple(r) for r in minhash.near_duplicates(docs).collect())
    assert found == brute_components(texts)
    kept = minhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == [i for i, _, _, k in brute_components(texts) if k]


def test_bucket_of_many_components(spark):
    """One shared band value, though only pairs of neighbours are similar: every link must be found."""
    rng = random.Random(5)
    chain = [words(rng, 60, 10**6)]
    for _ in range(30):
        chain.append(chain[-1][1:] + words(rng, 1, 10**6))
    rows = [(i, " ".join(w)) for i, w in enumerate(chain)]
    found = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.component_id for r in found} == {0}


def test_near_duplicates_edge_rows(spark):
    rows = [(None, "a b c d e f"), (4, "a b c d e f"), (4, "a b c d e f"), (5, None)]
    found = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id or 0, r.component_id, r.kept) for r in found) == [(0, 4, False), (4, 4, True), (4, 4, True), (5, 5, True)]
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert minhash.near_duplicates(empty).count() == 0 and minhash.keep_one(empty).count() == 0
    assert minhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).count() == 2  # a copy without an id goes, too


def test_ids_that_are_null_or_shared(spark):
    """Texts are judged by themselves, whatever ids their rows have."""
    rng = random.Random(8)
    a = words(rng, 60, 10**6)
    other = words(rng, 50, 10**6)
    variant = lambda of, k: " ".join([*of[:-k], *(f"z{k}{j}" for j in range(k))])
    # 1 holds two texts; 2 and 3 are near one of them each; null ids: a near copy of 2's, and a bridge from 7 to 8.
    left = words(rng, 80, 10**6)
    bridge, right = left[6:] + words(rng, 6, 10**6), None
    right = bridge[6:] + words(rng, 6, 10**6)
    rows = [
        (1, " ".join(a)), (1, " ".join(other)), (2, variant(a, 2)), (3, variant(other, 2)), (None, variant(a, 3)),
        (8, " ".join(left)), (None, " ".join(bridge)), (7, " ".join(right)), (None, "alone without id"), (None, "alone without id"),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = {(r.doc_id, r.n_shingles): r.component_id for r in minhash.near_duplicates(docs).collect()}
    assert found[2, 56] == found[3, 46] == 1 and found[None, 56] == 1
    assert found[8, 76] == found[7, 76] == found[None, 76] == 7
    assert found[None, 1] is None
    kept = minhash.keep_one(docs)
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["1", "1", "7", "None"]


def test_many_edited_copies(spark):
    """Copies of one text with similarities from 0.3 to 1, most of them below the limit with each other."""
    rng = random.Random(11)
    base = words(rng, 80, 10**6)
    texts = []
    for _ in range(700):
        copy = list(base)
        for at in rng.sample(range(80), rng.randrange(12)):
            copy[at] = f"x{rng.randrange(10**6)}"
        texts.append(" ".join(copy))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert sorted(tuple(r) for r in minhash.near_duplicates(docs).collect()) == brute_components(texts)


def test_bitmaps_differ_no_more_than_sets(spark):
    sets = minhash.shingle_sets([" ".join(words(random.Random(i % 5), 30 + 40 * i, 50 * (i + 1))) for i in range(12)])
    rows = [(i, j, m.tolist(), n.tolist()) for i, m in enumerate(minhash.bitmaps(sets)) for j, n in enumerate(minhash.bitmaps(sets))]
    df = spark.createDataFrame(rows, "i int, j int, a array<long>, b array<long>")
    for i, j, n in df.select("i", "j", minhash.differing("a", "b")).collect():
        assert n <= len(np.setxor1d(sets[i], sets[j])) and (n == 0) >= (i == j)


def test_long_texts_are_hashed_in_pieces(monkeypatch):
    text = " ".join(words(random.Random(2), 3000)) + "  \n tail"
    whole = minhash.shingle_sets([text])[0]
    monkeypatch.setattr(minhash, "_PIECE_BYTES", 100)
    assert (minhash.shingle_sets([text])[0] == whole).all()


def test_minima_and_maxima_fill_the_bands():
    sets = minhash.shingle_sets([" ".join(words(random.Random(i), 50)) for i in range(3)])
    bands, digits = minhash.signatures(sets)
    assert bands.shape == (3, 2 * minhash.PERMUTATIONS // minhash.ROWS) and digits.shape == (3, 8)
    assert (minhash.signatures(sets[1:2])[0][0] == bands[1]).all()


def test_agreeing_digits(spark):
    rng = np.random.default_rng(1)
    a, b = (rng.integers(0, 1 << 63, (50, 8)) - (1 << 62) for _ in range(2))
    b[:10] = a[:10]
    rows = [(i, x.tolist(), y.tolist()) for i, (x, y) in enumerate(zip(a, b))]
    df = spark.createDataFrame(rows, "i int, a array<long>, b array<long>").orderBy("i")
    got = [r[0] for r in df.select(minhash.agreeing("a", "b")).collect()]
    digits = lambda x: [(int(v) >> (4 * k)) & 15 for v in x for k in range(16)]
    assert got == [sum(p == q for p, q in zip(digits(x), digits(y))) for x, y in zip(a, b)]


def test_components(spark):
    edges = [(1, 2), (2, 3), (9, 8), (8, 7), (7, 3), (20, 21), (5, 5), (21, 20), (None, 4)]
    found = components.connected_components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()
    assert {r.node: r.component for r in found} == {**{n: 1 for n in (1, 2, 3, 7, 8, 9)}, 20: 20, 21: 20}


def mixed_docs(spark):
    rng = random.Random(2)
    sizes = {"a": 300, "b": 40, "c": 25, None: 10, "é": 5}
    rows = [(i * 10 + k, " ".join(words(rng, rng.randrange(0, 30))), s, "x") for k, (s, n) in enumerate(sizes.items()) for i in range(n)]
    return spark.createDataFrame([*rows, (None, "no id", "b", "x"), rows[0], rows[0], (7, None, "c", "x"), (8, "", "c", "x")], DOCS)


def test_mix_meets_targets(spark):
    docs = mixed_docs(spark)
    rows = mixing.taken(docs).withColumn("source", F.lit(0)).collect()
    assert len(rows) == docs.count()
    total = sum(r.size for r in rows)
    by_source = defaultdict(list)
    for r in rows:
        by_source[(r.source_size, r.target)].append(r)
        assert r.taken <= 3 * r.size and (r.size == 0 or r.taken % r.size == 0)
    assert abs(sum(t for _, t in by_source) - total) < 1e-6
    for (size, target), of in by_source.items():
        assert sum(r.size for r in of) == size and target <= 3 * size + 1e-9
        assert abs(sum(r.taken for r in of) - target) <= 3 * max(r.size for r in of)
    again = mixing.taken(docs.repartition(7)).withColumn("source", F.lit(0)).collect()
    assert sorted(map(str, rows)) == sorted(map(str, again))
    assert mixing.taken(docs.limit(0)).count() == 0


@pytest.mark.parametrize("words", [430_000_000, 2_000_000_000, 30_000_000_000])
def test_targets_of_many_words(spark, words):
    """Words times weights may exceed 2^31 where the words alone do not."""
    units = spark.createDataFrame([("a", words // 2), ("b", words // 4), (None, words // 4)], "source string, words long")
    found = {r.source: r.target for r in mixing.source_targets(units, (5, 2, 1), 3).collect()}
    assert found == {"a": words * 5 / 8, "b": words * 2 / 8, None: words / 8}


def test_mix_of_many_words(spark):
    """Five times all words are above 2^31."""
    text = F.repeat(F.lit("a "), 1_000_000)
    docs = spark.range(440).select(F.col("id").alias("doc_id"), text.alias("text"), F.lit("s").alias("source"))
    rows = mixing.plan(docs).collect()
    assert {(r.size, r.source_size, r.target, r.copies) for r in rows} == {(1_000_000, 440_000_000, 440_000_000.0, 1)}
    assert sorted(r.doc_id for r in rows) == list(range(440)) and len({r.before for r in rows}) == 440


def test_query_counts_the_mix_it_writes(spark, monkeypatch):
    """The query's words and positions are those of copies that were made, with their texts, in training order."""
    docs, kept = mixed_docs(spark), {}

    def stored(df, name, **options):
        kept[name] = common.stored(df, name, **options)
        return kept[name]

    monkeypatch.setattr(mixing, "stored", stored)
    rows = mixing.taken(docs).collect()
    copies = mixing.stored_order(kept["mix"]).orderBy("place").collect()
    assert [r.position for r in copies] == sorted(r.position for r in copies)
    found = defaultdict(list)
    for r in copies:
        found[r.doc_id, r.nth].append((len((r.text or "").split()), round(r.position, 9)))
    found = [[sum(n for n, _ in of), min(at for _, at in of)] for of in found.values()]
    assert sorted(map(str, found)) == sorted(str([r.taken, r.position]) for r in rows if r.position is not None)


def test_equal_rows_of_a_mix_are_as_in_sql(spark, tmp_path):
    rng = random.Random(5)
    rows = [(i, " ".join(words(rng, rng.randrange(0, 40))), rng.choice(["a", "b", "c", None, "é"]), "x") for i in range(120)]
    rows += rows[:20] * 6 + [rows[3]] * 40 + [(None, "q w e", "a", "x")] * 30 + [(6, None, "a", "x")] * 5 + [(5, f"v w {i}", "b", "x") for i in range(9)]
    rows += [(*rows[9][:3], "other")] * 4
    spark.createDataFrame(rows, DOCS).write.parquet(f"{tmp_path}/documents")
    docs = spark.read.parquet(f"{tmp_path}/documents")
    con = pytest.importorskip("duckdb").connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents/*.parquet'")
    wanted = con.execute(mixing.TAKEN_SQL).fetchall()
    assert sorted(map(str, wanted)) == sorted(str(tuple(r)) for r in mixing.taken(docs).collect())
    mixed = mixing.curriculum(docs, mixing.plan(docs)).collect()
    assert sum(len((r.text or "").split()) for r in mixed) == sum(r[4] for r in wanted)
    assert sum(r.lang == "other" for r in mixed) > 0


def test_curriculum_repeats_and_orders(spark):
    docs = mixed_docs(spark).withColumn("position_of", F.lit(1))
    planned = mixing.plan(docs)
    mixed = mixing.curriculum(docs, planned)
    rows = mixed.collect()
    assert [r.position for r in rows] == sorted(r.position for r in rows)
    assert len(rows) == planned.agg(F.sum(F.col("n") * F.col("copies"))).first()[0]
    assert all(0 <= r.position <= 1 for r in rows)


@pytest.mark.parametrize("schedule", [((0.0, 0.0), (1.0, 2.0)), ((0.0, 1.0), (0.25, 3.0), (1.0, 0.0)), ((0.0, 1.0), (1.0, 1.0))])
def test_positions_invert_the_schedule(spark, schedule):
    shares = np.linspace(0, 1, 41)
    df = spark.createDataFrame([(float(s),) for s in shares], "s double")
    times = [r[0] for r in df.select(mixing.position(F.col("s"), F.lit(0), [schedule])).collect()]
    grid = np.linspace(0, 1, 200_001)
    weight = np.interp(grid, *zip(*schedule))
    area = np.append(0, np.cumsum((weight[1:] + weight[:-1]) / 2))
    assert np.allclose(np.interp(times, grid, area / area[-1]), shares, atol=1e-4)


def omh_tokens(text):
    import re

    return re.findall(r"[^ \t\n\x0b\f\r]{1,16}", text)


def test_fingerprints(spark):
    rng = random.Random(8)
    texts = [" ".join(words(rng, n)) for n in (0, 1, 2, 5, 60, 300, 2000)] + ["", "x" * 100, "the the the the"]
    texts += [texts[4]]
    rows = [(i * 7, t) for i, t in enumerate(texts)] + [(1000, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    found = {r.doc_id: r for r in order_minhash.edited_neighbours(docs).collect()}
    full = [t or "" for _, t in rows]
    for k, (i, text) in enumerate(rows):
        t, nxt = full[k], full[(k + 1) % len(full)]
        n = len(t) // 4
        assert found[i].n_chars == len(t)
        assert found[i].edited_sha256 == hashlib.sha256((t[: len(t) - n] + nxt[:n]).encode()).hexdigest()
        assert len(found[i].fingerprint) == 4 * order_minhash.PLACES
        assert 0 <= found[i].near_edited <= 1
    assert found[4 * 7].fingerprint == found[10 * 7].fingerprint
    assert found[0].fingerprint == found[1000].fingerprint == "0" * 256 and found[1000].near_next == 1.0
    assert 0.2 < found[6 * 7].near_edited < 0.6 and found[5 * 7].near_next < 0.1
    assert order_minhash.edited_neighbours(docs.limit(0)).count() == 0
    one = spark.createDataFrame([(5, "a b c d")], "doc_id long, text string")
    assert order_minhash.edited_neighbours(one).first().near_next == 1.0


def test_next_rows_come_by_ranges_that_store_nothing(spark):
    """Each table stored on the way makes the executors start processes for every file, whatever the rows."""
    rng = random.Random(5)
    rows = [(rng.randrange(10**6) - 5000, f"a{rng.randrange(50)}") for _ in range(3000)]
    rows += [(None, "x"), (None, "y"), *rows[:20], *((77, f"t{i}") for i in range(200))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    folder = Path(common.shared_dir(spark).removeprefix("file://"), "ringfold")
    before = set(folder.glob("*"))
    for least, most in ((4, 50), (64, 50), (5000, 65_536)):
        found, order = order_minhash.with_next(docs, ["doc_id", "text"], least, most)
        found = found.select("*", F.lead("_key").over(order).alias("_next")).where("_guest = 0").collect()
        assert set(folder.glob("*")) == before
        assert Counter((r.doc_id, r.text) for r in found) == Counter(rows)
        found.sort(key=lambda r: (r._key, r._next))
        ids = [r._key for r in found]
        assert sorted(r._next for r in found) == sorted(ids)
        assert all(r._next == following or r._key == r._next for r, following in zip(found, [*ids[1:], ids[0]]))
        sizes = Counter(r._range for r in found)
        assert max(sizes.values()) <= 4 * max(len(rows) / len(sizes), 2) and len(sizes) >= min(least, len(rows) / most) / 2


def test_fingerprint_selects_smallest_in_text_order(spark):
    """Against a plain version that knows the k-mers' hashes from Spark."""
    text = " ".join(words(random.Random(4), 120, 30))
    tokens = omh_tokens(text)
    mers = [tokens[i : i + 2] for i in range(len(tokens) - 1)]
    df = spark.createDataFrame([(i, m) for i, m in enumerate(mers)], "i int, m array<string>")
    base = [r[0] for r in df.orderBy("i").select(F.xxhash64("m")).collect()]
    mask = (1 << 33) - 1
    seen, keys = defaultdict(int), []
    for h in base:
        keys.append((h & mask, seen[h & mask]))
        seen[h & mask] += 1
    frame = spark.createDataFrame([(i, *k) for i, k in enumerate(keys)], "i int, h long, n int")
    numbered = [r[0] & mask for r in frame.orderBy("i").select(F.xxhash64("h", "n")).collect()]
    order = sorted(range(len(mers)), key=lambda i: (numbered[i], i))
    chosen = []
    for arc in range(order_minhash.PLACES):
        start = (arc << 33) // order_minhash.PLACES
        first = next((k for k, i in enumerate(order) if numbered[i] >= start), 0)
        chosen.append(tuple(sorted(order[(first + t) % len(order)] for t in range(2))))
    pairs = spark.createDataFrame([(k, base[a], base[b]) for k, (a, b) in enumerate(chosen)], "k int, a long, b long")
    expected = [r[0] & 0xFFFF for r in pairs.orderBy("k").select(F.xxhash64("a", "b")).collect()]
    got = order_minhash.fingerprint(spark.createDataFrame([(text,)], "text string"), "text", "fp").first().fp
    assert got == expected
    swapped = " ".join(tokens[60:] + tokens[:60])
    both = spark.createDataFrame([(text, swapped)], "a string, b string")
    both = order_minhash.fingerprint(order_minhash.fingerprint(both, "a", "x"), "b", "y")
    assert both.select(order_minhash.likeness("x", "y")).first()[0] < 0.75  # order counts


def test_likeness_falls_with_edits_and_moves(spark):
    """In documents of 500 words: with more edits it falls, and it tells moved blocks from none."""
    rng = random.Random(12)
    rows = []
    for k in range(40):
        base = words(rng, 500, 10**6)
        for edits in (0, 5, 15, 40, 120):
            copy = list(base)
            for at in rng.sample(range(500), edits):
                copy[at] = f"x{rng.randrange(10**6)}"
            rows.append((edits, " ".join(base), " ".join(copy)))
        cuts = [0, *sorted(rng.sample(range(1, 500), 9)), 500]
        blocks = [base[a:b] for a, b in zip(cuts, cuts[1:])]
        rng.shuffle(blocks)
        rows.append((-1, " ".join(base), " ".join(w for b in blocks for w in b)))
    df = spark.createDataFrame(rows, "edits int, a string, b string")
    df = order_minhash.fingerprint(order_minhash.fingerprint(df, "a", "x"), "b", "y")
    mean = {r.edits: r.m for r in df.groupBy("edits").agg(F.avg(order_minhash.likeness("x", "y")).alias("m")).collect()}
    assert mean[0] == 1.0 and mean[0] > mean[5] > mean[15] > mean[40] > mean[120]
    assert 0.9 > mean[-1] > mean[120]  # same words, other order
    # Pairs of words stay whole with the chance of two words unedited; both that a place selects must be shared ones.
    for e in (5, 15, 40):
        whole = (1 - e / 500) ** 2
        assert abs(mean[e] - (whole / (2 - whole)) ** 2) < 0.08


def labelled(spark, n=900):
    rng = random.Random(6)
    docs, labels = [], []
    for i in range(n):
        bad, toxic = rng.random() < 0.2, rng.random() < 0.2
        text = words(rng, rng.randrange(20, 80), 2000)
        if toxic:
            for _ in range(4):
                text.insert(rng.randrange(len(text)), rng.choice(["zonk", "brumph", "gnarlo", "splork"]))
        text = " ".join(w + "!!" for w in text).upper() if bad else " ".join(text)
        docs.append((i, text, f"s{i % 3}", "en"))
        labels.append((i, int(not bad), int(toxic)))
    docs += [(n, None, None, None), (n + 1, "", "s0", "en"), (n + 2, "word", "lonely", "en"), (None, "a b", "s1", "en"), docs[0]]
    return spark.createDataFrame(docs, DOCS), spark.createDataFrame([*labels, (n, None, None)], "doc_id long, quality int, toxic int")


def test_toxicity_on_held_out(spark):
    docs, labels = labelled(spark)
    rows = toxicity.toxicity(docs, labels).collect()
    assert len(rows) == docs.count() and all(0 <= r.score <= 1 for r in rows)
    truth = {r.doc_id: r.toxic for r in labels.collect()}
    held = [(r.predicted, truth[r.doc_id]) for r in rows if r.held_out and truth.get(r.doc_id) is not None]
    assert len(held) > 200 and sum(p == t for p, t in held) / len(held) > 0.97
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows if r.doc_id is not None)
    kept = toxicity.keep_clean(docs.withColumn("score", F.lit("own")), labels)
    assert kept.columns == [*docs.columns, "score"] and kept.count() == sum(r.predicted == 0 for r in rows)
    assert {r.score for r in toxicity.toxicity(docs, labels.limit(0)).collect()} == {0.0}
    assert toxicity.toxicity(docs.limit(0), labels).count() == 0


def test_toxicity_by_a_plain_loop(spark):
    """Scores are what compressing each window with each dictionary gives."""
    docs, labels = labelled(spark, 400)
    model = toxicity.train(docs, labels)
    of = model.dictionaries
    toxic, ordinary = (toxicity._compressor(of.base + x) for x in (of.toxic, of.ordinary))
    texts = ["zonk of gnarlo w1 w2 w2", "w1 w2 w3", "", None, "x" * 5000 + " splork"]
    expected = []
    for text in texts:
        counts = np.zeros((1, 13), np.int64)
        for window in set(toxicity.windows_of(toxicity.words_of(text), model.window)):
            framed = toxicity._CARRIER + window + toxicity._CARRIER
            gain = len(ordinary.compress(framed)) - len(toxic.compress(framed))
            counts[0, min(max(gain, -4), 8) + 4] += 1
        x = model.features(counts)[0] @ np.array(model.weights) + model.bias
        expected.append(1 / (1 + np.exp(-x)))
    got = spark.createDataFrame(list(enumerate(texts)), "i int, text string").select("i", toxicity.score(F.col("text"), model)).collect()
    assert [r[1] for r in sorted(got)] == pytest.approx(expected) and expected[0] > 0.7 > expected[1]
    assert toxicity.train(docs, labels, max_docs=20, max_bytes=1000).dictionaries is not None  # bounded in rows and bytes


def test_toxicity_of_a_small_language(spark):
    """Its toxic words are in a small share of toxic documents, and in an ordinary one too."""
    rng = random.Random(9)
    docs, labels = [], []
    for i in range(6000):
        small = i % 60 == 0
        toxic = rng.random() < (0.4 if small else 0.55)
        text = [("y" if small else "") + w for w in words(rng, rng.randrange(20, 60), 2000)]
        for _ in range(3 * toxic):
            text.insert(rng.randrange(len(text)), "quorv" + rng.choice("abcdefgh") * 2 if small else rng.choice(["zonk", "brumph"]))
        docs.append((i, " ".join(text) + (" quorvaa" if i == 120 else ""), "s", "yy" if small else "en"))
        labels.append((i, int(toxic)))
    labels = spark.createDataFrame(labels, "doc_id long, toxic int")
    found = toxicity.toxicity(spark.createDataFrame(docs, DOCS), labels).join(labels, "doc_id").where("held_out and doc_id % 60 = 0").collect()
    caught = [r.predicted for r in found if r.toxic]
    assert len(caught) > 8 and sum(caught) / len(caught) > 0.9
    assert sum(r.predicted for r in found if not r.toxic) <= 2


def test_quality_on_held_out(spark):
    docs, labels = labelled(spark)
    rows = quality.quality(docs, labels).collect()
    truth = {r.doc_id: r.quality for r in labels.collect()}
    held = [(int(r.kept), truth[r.doc_id]) for r in rows if r.held_out and truth.get(r.doc_id) is not None]
    assert len(rows) == docs.count() and sum(p == t for p, t in held) / len(held) > 0.97
    kept = quality.keep_good(docs.withColumn("bins", F.lit("own")), labels)
    assert kept.columns == [*docs.columns, "bins"] and kept.count() == sum(r.kept for r in rows)
    assert {r.score for r in quality.quality(docs, labels.limit(0)).collect()} == {0.5}
    assert quality.quality(docs.limit(0), labels).count() == 0


def test_quality_priors_shrink(spark):
    soft = [("big", "a", 1.0)] * 300 + [("big", "b", 0.0)] * 5 + [("small", "a", 0.0)] * 1 + [("poor", "a", 0.1)] * 300
    found = {(r._site, r._path): r for r in quality.priors(spark.createDataFrame(soft, "site string, path string, good double"), 0.6).collect()}
    assert found["big", "a"].site_share > 0.9 and found["poor", "a"].site_share < 0.2
    assert 0.1 < found["small", "a"].site_share < 0.6  # one document moves a site a little


def test_few_rows_without_a_key_are_perhaps_among_keys(spark):
    """So that a join need not move their texts."""
    from ringfold.llm.common import perhaps_among

    rows = spark.range(50_000).withColumn("key", F.when(F.col("id") > 0, F.xxhash64("id")))
    found = perhaps_among(rows, F.col("key"), rows.where("id % 50 = 7").select("key"))
    assert found.columns == ["id", "key", "_perhaps"] and found.count() == 50_000
    assert found.where("id % 50 = 7 and not _perhaps").count() == 0
    assert found.where("id % 50 != 7 and _perhaps").count() < 50
    assert perhaps_among(rows, F.col("key"), rows.limit(0).select("key")).where("_perhaps").count() == 0


def test_texts_that_stay_are_not_moved(spark):
    docs = labelled(spark, 200)[0]
    docs = docs.unionByName(docs.where("doc_id < 20").withColumn("doc_id", F.col("doc_id") + 5000))
    kept = minhash.keep_one(docs)
    plan = kept._jdf.queryExecution().optimizedPlan().toString()
    assert "Union" in plan and kept.columns == docs.columns
    found = minhash.near_duplicates(docs).where("kept or n_shingles = 0")
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(r.doc_id) for r in found.dropDuplicates(["doc_id"]).collect())

import numpy as np
import pytest
from pyspark.sql import functions as F

from ringfold.llm import ball_tree, host_trust

VECTORS = "vec_id long, embedding array<float>, label int"


def brute(rows, k):
    kept = {}
    for i, v, _ in rows:
        if i is not None and v and all(x is not None and np.isfinite(x) for x in v):
            vec = tuple(int(np.floor(1024 * float(np.float32(x)))) for x in v)
            kept.setdefault((i, vec), None)
    out = []
    for i, q in sorted(kept):
        if i % 100:
            continue
        hits = [(-sum(a * b for a, b in zip(q, v)), j) for j, v in kept if j != i and len(v) == len(q)]
        out += [(i, rank + 1, j, -s) for rank, (s, j) in enumerate(sorted(hits)[:k])]
    return sorted(out)


@pytest.mark.parametrize("shards", [(1, (1 << 20, 1 << 20)), (7, (10, 200))])
def test_top_k_is_brute_force(spark, shards):
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(size=8).round(1).tolist(), 0) for i in range(700)]
    rows += [(i, rows[5][1], 1) for i in range(1000, 1030)]  # ties
    rows += [(2000, None, 0), (2001, [1.0, None] + [0.0] * 6, 0), (2002, [float("nan")] * 8, 0), (2003, [float("inf")] * 8, 0)]
    rows += [(2100, [1.0, 2.0], 0), (2101, [0.5, 2.0], 0), (2102, [], 0), (None, [1.0] * 8, 0), rows[3], rows[100]]
    df = spark.createDataFrame(rows, VECTORS)
    found = ball_tree.top_k(df, F.col("vec_id") % 100 == 0, target_shards=shards[0], shard_rows=shards[1])
    assert sorted(map(tuple, found.collect())) == brute(rows, 10)


def test_top_k_of_nothing(spark):
    df = spark.createDataFrame([], VECTORS)
    assert ball_tree.top_k(df, F.col("vec_id") % 100 == 0).count() == 0
    one = spark.createDataFrame([(0, [1.0], 0)], VECTORS)
    assert ball_tree.top_k(one, F.col("vec_id") % 100 == 0).count() == 0


def test_tree_bounds_hold_and_large_values_are_exact():
    rng = np.random.default_rng(2)
    data = rng.integers(-(1 << 28), 1 << 28, (3000, 5))
    tree = ball_tree.BallTree(np.arange(3000), data, leaf=16)
    queries = data[:20]
    row, ids, scores = tree.search(np.arange(20), queries, np.full(20, ball_tree._NONE), 4)
    for q in range(20):
        exact = sorted((-sum(int(a) * int(b) for a, b in zip(queries[q], v)), j) for j, v in enumerate(data.tolist()) if j != q)
        assert sorted(zip((-scores[row == q]).tolist(), ids[row == q].tolist())) == exact[:4]
    bounds = tree.bounds(queries.astype(float))
    for leaf, (a, b) in enumerate(tree.spans):
        assert (tree.scores(queries, leaf).max(axis=1) <= bounds[:, leaf + 2**tree.depth - 1]).all()


def test_tree_cuts_off_what_cannot_win():
    """Rows in clusters, as embeddings are: most are never scored, and the best are still found."""
    rng = np.random.default_rng(4)
    centers = rng.normal(size=(64, 16)) * 1000
    data = np.concatenate([c + rng.normal(size=(300, 16)) * 20 for c in centers]).astype(np.int64)
    tree = ball_tree.BallTree(np.arange(len(data)), data, leaf=64)
    queries = data[::600]
    row, ids, scores = tree.search(np.full(len(queries), -1), queries, np.full(len(queries), ball_tree._NONE), 10)
    assert tree.compared < 0.1 * len(queries) * len(data)
    for q, x in enumerate(queries):
        assert sorted(scores[row == q].tolist()) == sorted(data @ x)[-10:]


def test_shards_are_bounded_in_bytes(spark):
    rng = np.random.default_rng(5)
    rows = [(i, rng.normal(size=6).round(2).tolist(), 0) for i in range(500)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, score int")  # a name that the result has
    found = ball_tree.top_k(df, F.col("vec_id") % 100 == 0, shard_bytes=2000)
    assert sorted(map(tuple, found.collect())) == brute(rows, 10)


def page(i, url, *links):
    return (i, url, "".join(f'<p><a class=x href="{x}">t</a></p>' for x in links))


def test_rules_and_hosts(spark):
    rows = [
        page(1, "http://A.Example.ORG/es/1"), page(2, "http://x.org/es/1"), page(3, "https://example.org/en/12?q"),
        page(4, "https://a.com/fr/#x"), page(5, "https://a.com/de/x"), page(6, "no scheme"), (7, None, None),
        page(8, "ftp://other.net?x/y"), page(9, "http://notexample.org/es/"), page(9, "http://notexample.org/es/"),
    ]
    found = {r.page_id: r for r in host_trust.judge(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    got = {i: (r.host, r.path, r.rule, r.verdict) for i, r in found.items()}
    assert got[1] == ("a.example.org", "/es/1", "example.org/es/", "block")
    assert got[2] == ("x.org", "/es/1", "org/", "allow")
    assert got[3] == ("example.org", "/en/12", "example.org/en/1", "block")
    assert got[4] == ("a.com", "/fr/", "com/fr/", "allow")
    assert got[5][2:] == ("com/de/", "block")
    assert got[6] == got[7] == ("", "", None, "allow")
    assert got[8] == ("other.net", "", None, "allow")
    assert got[9][2] == "org/"


def test_trust_spreads_along_a_long_chain(spark):
    """However few of the seeds' pages link on."""
    edges = spark.createDataFrame([(f"h{i}", f"h{i + 1}", 1.0) for i in range(30)], "src string, dst string, share double")
    seeds = spark.createDataFrame([("h0", 1e-7), ("big", 1 - 1e-7)], "host string, weight double")
    rank = {r.host: r["rank"] for r in host_trust.spread(edges, seeds).collect()}
    assert len(rank) == 32
    assert all(abs(rank[f"h{i}"] / rank["h0"] / 0.85**i - 1) < 1e-3 for i in range(31))


def test_ranks_are_those_of_a_dense_walk(spark):
    """A random graph with hosts without links, against the matrix form iterated to the end."""
    rng = np.random.default_rng(7)
    n = 25
    links = rng.integers(0, 4, (n, n)) * (rng.random((n, n)) < 0.15)
    np.fill_diagonal(links, 0)
    links[[3, 11]] = 0
    rows = [(i, f"http://h{i}.net/", "".join(f'<a href="http://h{j}.net/{k}">' for j in range(n) for k in range(links[i, j]))) for i in range(n)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    edges = host_trust.host_edges(df)
    got = {(r.src, r.dst): (r.n, r.share) for r in edges.collect()}
    shares = links / np.maximum(links.sum(axis=1, keepdims=True), 1)
    assert got == {(f"h{i}.net", f"h{j}.net"): (links[i, j], pytest.approx(shares[i, j])) for i in range(n) for j in range(n) if links[i, j]}
    seed = np.zeros(n)
    seed[[0, 5, 9]] = (0.5, 0.3, 0.2)
    rank = seed.copy()
    for _ in range(500):
        sent = rank @ shares
        rank = seed * (1 - 0.85 * sent.sum()) + 0.85 * sent
    seeds = spark.createDataFrame([(f"h{i}.net", float(w)) for i, w in enumerate(seed) if w], "host string, weight double")
    found = {r.host: r["rank"] for r in host_trust.spread(edges, seeds).collect()}
    assert all(found.get(f"h{i}.net", 0.0) == pytest.approx(rank[i], abs=1e-5) for i in range(n))


def test_urls_of_any_length_and_names(spark):
    """Long urls, and columns with the names of the result."""
    url = "http://x.org/es/" + "a" * 100_000
    df = spark.createDataFrame([(1, url, "", "own", "own")], "page_id long, url string, html string, verdict string, host string")
    row = host_trust.judge(df).first()
    assert (row.host, len(row.path), row.rule, row.verdict) == ("x.org", 100_004, "org/", "allow")


def test_trust_and_distrust_spread(spark):
    rows = [
        page(1, "http://good.org/a", "http://friend.net/", "//second.net/x", "/local"),
        page(2, "http://bad.com/de/a", "http://friend.net/"),
        page(3, "http://farm.net/a", "http://bad.com/de/a"),
        page(4, "http://friend.net/a", "http://good.org/"),
        page(5, "http://second.net/a", "https://farm.net/x", "HTTP://Bad.com/de/"),
        page(6, "http://outer.net/a", "http://farm.net/a"),
        page(7, "http://alone.net/a"),
    ]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    verdict = {r.host: r.verdict for r in host_trust.judge(df).collect()}
    assert verdict["friend.net"] == verdict["alone.net"] == verdict["good.org"] == "allow"
    assert verdict["farm.net"] == verdict["outer.net"] == "block"  # they link to a blocked host
    edges = {(r.src, r.dst): r.share for r in host_trust.host_edges(df).collect()}
    assert edges[("good.org", "second.net")] == 0.5 and ("good.org", "good.org") not in edges
    assert host_trust.judge(df.limit(0)).count() == 0

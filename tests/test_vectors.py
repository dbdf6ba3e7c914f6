"""Vector operators against numpy brute force on small random suites."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from culler.operators import quality as Q
from culler.operators import vectors as V
from culler.plans.fixtures import method_vectors


def make(spark, seed=0, suites=(7, 12), dim=5, labels=None):
    rng = np.random.default_rng(seed)
    rows, data = [], {}
    for s, n in enumerate(suites):
        X = rng.normal(size=(n, dim))
        lab = labels(n, rng) if labels else rng.integers(0, 3, n)
        data[s] = (X, lab)
        rows += [(s, i, X[i].tolist(), int(lab[i])) for i in range(n)]
    df = spark.createDataFrame(rows, "suite int, method_seq long, vec array<double>, cluster int")
    return df, data


def dist(X, metric):
    if metric == "cosine":
        nr = np.linalg.norm(X, axis=1)
        return 1 - (X / nr[:, None]) @ (X / nr[:, None]).T
    if metric == "euclidean":
        return np.sqrt(((X[:, None] - X[None]) ** 2).sum(-1))
    return np.abs(X[:, None] - X[None]).sum(-1)


@pytest.mark.parametrize("block", [3, 1024])
def test_topk_matches_bruteforce(spark, block):
    df, data = make(spark)
    got = V.topk_similar(df, k=3, block_size=block).collect()
    for s, (X, _) in data.items():
        for m in ["cosine", "euclidean", "manhattan"]:
            D = dist(X, m)
            S = 1 - D if m == "cosine" else 1 / (1 + D)
            for a in range(len(X)):
                order = [b for b in sorted(range(len(X)), key=lambda b: (-S[a, b], b)) if b != a][:3]
                mine = [r["b"] for r in sorted((r for r in got if r["suite"] == s and r["metric"] == m and r["a"] == a),
                                               key=lambda r: r["rank"])]
                assert mine == order


def silhouette(X, lab, metric):
    mask = lab >= 0
    uniq = set(lab.tolist())
    if len(uniq) < 2 or (len(uniq) == 2 and -1 in uniq) or mask.sum() < 2:
        return 0.0
    Xm, lm = X[mask], lab[mask]
    k = len(set(lm.tolist()))
    if not 1 < k < len(lm):
        return 0.0
    D = dist(Xm, metric)
    s = []
    for i in range(len(Xm)):
        own = lm == lm[i]
        if own.sum() == 1:
            s.append(0.0)
            continue
        a = D[i, own].sum() / (own.sum() - 1)
        b = min(D[i, lm == c].mean() for c in set(lm.tolist()) if c != lm[i])
        s.append((b - a) / max(a, b))
    return float(np.mean(s))


@pytest.mark.parametrize("variant", ["normal", "outliers", "singletons", "one"])
def test_silhouette_matches_bruteforce(spark, variant):
    fn = {"normal": lambda n, r: r.integers(0, 3, n), "outliers": lambda n, r: r.integers(-1, 3, n),
          "singletons": lambda n, r: np.arange(n), "one": lambda n, r: np.where(r.random(n) < .3, -1, 0)}[variant]
    df, data = make(spark, seed=3, labels=fn)
    cells = [("x", m) for m in Q.METRICS]
    got = Q.silhouette_grid(df.withColumn("labels", F.array("cluster", "cluster", "cluster")), cells, vec="vec", block_size=4).collect()
    for r in got:
        X, lab = data[r["suite"]]
        assert r["quality"] == pytest.approx(silhouette(X, lab, r["metric"]), abs=1e-9)


@pytest.mark.parametrize("block", [4, 16, 1024])
def test_silhouette_of_split_whole_and_tiny_clusters(spark, block):
    """One cluster over several blocks, some that share a block, pairs, a single item, outliers, copies of points."""
    rng = np.random.default_rng(8)
    lab = np.array([0] * 23 + [1] * 9 + [2, 2, 3, 3, 4, 4, 5, 5, 6] + [-1] * 4)
    X = np.round(rng.normal(size=(len(lab), 4)) + lab[:, None] * 0.4, 2)
    X[20:23], X[25:28], X[32], X[33] = X[0], X[24], X[0], X[0]
    df = spark.createDataFrame([("s", i, X[i].tolist(), int(lab[i])) for i in range(len(lab))],
                               "suite string, method_seq long, z array<double>, cluster int")
    got = Q.silhouette_grid(df.withColumn("labels", F.array("cluster", "cluster", "cluster")), [("x", m) for m in Q.METRICS], block_size=block)
    for r in got.collect():
        assert r["quality"] == pytest.approx(silhouette_zero_safe(X, lab, r["metric"]), abs=1e-9), r["metric"]


def silhouette_zero_safe(X, lab, metric):
    X, lab = X[lab >= 0], lab[lab >= 0]
    D = dist(X, metric)
    D[D < 1e-12] = 0.0
    s = []
    for i in range(len(X)):
        own = lab == lab[i]
        a = D[i, own].sum() / max(1, own.sum() - 1)
        b = min(D[i, lab == c].mean() for c in set(lab.tolist()) - {lab[i]})
        s.append(0.0 if own.sum() == 1 or max(a, b) == 0 else (b - a) / max(a, b))
    return float(np.mean(s))


def test_silhouette_rows_do_not_grow_with_the_clusters(spark):
    """64 items in 4 blocks: an item sends one row per block that it meets, with 2 clusters as with 32."""
    rng = np.random.default_rng(9)
    rows = {}
    for k in (2, 32):
        df = spark.createDataFrame([(0, i, rng.normal(size=3).tolist(), [i % k] * 3) for i in range(64)],
                                   "suite int, method_seq long, z array<double>, labels array<int>")
        sums = Q._distance_sums(df, list(Q.METRICS), "z", 16)
        rows[k] = {r["cell"]: r["n"] for r in sums.groupBy("cell").agg(F.count("*").alias("n")).collect()}
        met = sums.groupBy("cell", "a").count()
        assert met.select("cell", "a").count() == 3 * 64
    # blocks: at most twice the items' number over the block size, plus one per split cluster
    assert all(n <= 64 * 8 for n in rows[32].values()) and all(n <= 64 * 8 for n in rows[2].values())


def test_manhattan_sums_without_pairs():
    rng = np.random.default_rng(10)
    q, c, g = rng.normal(size=(7, 5)), rng.normal(size=(40, 5)), rng.integers(0, 6, 40)
    c[:3], g[:3] = q[0], 2
    c[g == 5] = q[1]  # a group of copies of an item has the sum 0, not rounding
    D = np.abs(q[:, None] - c[None]).sum(-1)
    want = np.stack([D[:, g == k].sum(axis=1) for k in range(6)], axis=1)
    got = Q.manhattan_sums(q, c, g, 6)
    np.testing.assert_allclose(got, want, atol=1e-10)
    assert got[1, 5] == 0.0


def test_standardize_and_kdist(spark):
    df, data = make(spark, seed=5)
    z = V.standardize(df)
    kd = V.kth_neighbour_distance(z, vec="z", block_size=4).collect()
    for s, (X, _) in data.items():
        Z = (X - X.mean(0)) / X.std(0)
        n = len(X)
        k = max(2, min(4, n // 20))
        k = n - 1 if k >= n else k
        for m in ["euclidean", "manhattan"]:
            D = dist(Z, m)
            exp = np.sort(D, axis=1)[:, k - 1]
            mine = {r["a"]: r["kdist"] for r in kd if r["suite"] == s and r["metric"] == m}
            assert [mine[i] for i in range(n)] == pytest.approx(exp.tolist())


def test_hashing_embedder_unit_norm(spark):
    df = spark.createDataFrame([("s", 1, "a b c a"), ("s", 2, "")], "suite string, method_seq long, code string")
    rows = {r["method_seq"]: r["vec"] for r in V.hashing_embed(df, dims=16).collect()}
    assert np.linalg.norm(rows[1]) == pytest.approx(1.0)
    assert np.count_nonzero(rows[2]) == 0


def test_registry_unknown(spark):
    with pytest.raises(ValueError):
        V.get_embedder("nope")


def test_pair_count(spark):
    df, data = make(spark, seed=9, suites=(40,), dim=6)
    assert V.pair_count(df, block_size=7).first()["pairs"] == 40 * 39 // 2


def test_a_tile_is_computed_once_for_both_directions(monkeypatch):
    """Pair kernels on two blocks: the Manhattan and cosine tiles once, the Euclidean distances of the near pairs only; same numbers as all pairs."""
    import pandas as pd

    rng = np.random.default_rng(8)
    x = rng.normal(size=(60, 5)).round(1)
    x[50] = x[3]
    pdf = pd.DataFrame({"suite": 0, "method_seq": np.arange(60), "v": list(x), "k": 3, "lo": 0, "hi": 1, "blk": np.repeat([0, 1], 30)})
    tiles, tile = [], V.BK.distance_tile
    monkeypatch.setattr(V.BK, "distance_tile", lambda a, b, m: tiles.append(m) or tile(a, b, m))
    kd = V._kdist_kernel(V.BK.METRICS, "v")(pdf)
    top = V._topk_kernel(4, V.BK.METRICS, "v")(pdf)
    rows = V._rowsum_kernel(V.BK.METRICS, "v")(pdf)
    assert sorted(tiles) == ["cosine"] * 3 + ["manhattan"] * 3
    for m in V.BK.METRICS:
        d = tile(x, x, m)
        for a in range(60):
            other = np.arange(30, 60) if a < 30 else np.arange(30)
            assert np.sort(kd[(kd.metric == m) & (kd.a == a)].d.iloc[0]) == pytest.approx(np.sort(np.maximum(d[a, other], 0.0))[:3], abs=1e-12)
            s = V.BK.similarity_from_distance(d[a, other], m)
            got = top[(top.metric == m) & (top.a == a)]
            assert got.score.to_numpy() == pytest.approx(-np.sort(-s)[:4], abs=1e-12)
            r = rows[(rows.metric == m) & (rows.a == a)].iloc[0]
            assert (r.s, r.mx, r.n) == (pytest.approx(s.sum()), pytest.approx(s.max()), 30)


def test_pooling_sorts_no_tokens(spark):
    rows = [("s", i, p, [float(i + p), float(i * p), -1.0]) for i in range(3) for p in range(4)]
    t = spark.createDataFrame(rows, "suite string, method_seq long, pos int, vec array<double>")
    for made, want in ((V.pool_mean(t), lambda i: [i + 1.5, 1.5 * i, -1.0]), (V.pool_cls(t), lambda i: [i, 0.0, -1.0])):
        plan = made._jdf.queryExecution().toString()
        assert "SortAggregate" not in plan and "ObjectHashAggregate" not in plan and "HashAggregate" in plan
        assert {r.method_seq: r.vec for r in made.collect()} == {i: pytest.approx(want(i)) for i in range(3)}


def test_idf_weights_common_and_rare_tokens_alike(spark, monkeypatch):
    """Every mix of sent and joined weights gives the vectors of the formula, and an item's sums leave a task only once."""
    texts = ["a b b c", "a c", "a", "", None, "a zz"]
    items = spark.createDataFrame([("s", i, t) for i, t in enumerate(texts)], "suite string, method_seq long, code string")
    words = [(t or "").split() for t in texts]
    want = []
    for w in words:
        v = np.zeros(4)
        for tok in w:
            bucket, sign = V._TokenBuckets(4)[tok.encode()]
            v[bucket] += sign * (np.log((1 + len(texts)) / (1 + sum(tok in o for o in words))) + 1)
        want.append(v / (np.linalg.norm(v) or 1.0))
    for least, held in ((0, 1 << 20), (1, 1 << 20), (1, 0), (100, 1 << 20)):
        monkeypatch.setattr(V, "COMMON_LEAST", least)
        monkeypatch.setattr(V, "VOCABULARY", held)
        got = {r.method_seq: r.vec for r in V.hashing_embed_idf(items, dims=4).collect()}
        for i, v in enumerate(want):
            assert got[i] == pytest.approx(v)


@pytest.mark.parametrize("block", [3, 1024])
def test_similarity_matrix_has_every_pair(spark, block):
    df, data = make(spark, suites=(7, 1))
    got = {(r.suite, r.metric, r.a, r.b): r for r in V.similarity_matrix(df, block_size=block).collect()}
    assert len(got) == 3 * (7 * 7 + 1)
    for s, (X, _) in data.items():
        for m in ["cosine", "euclidean", "manhattan"]:
            S = 1 - dist(X, m) if m == "cosine" else 1 / (1 + dist(X, m))
            for a in range(len(X)):
                others = np.delete(S[a], a)
                for b in range(len(X)):
                    r = got[s, m, a, b]
                    assert r.similarity == pytest.approx(S[a, b])
                    assert (r.mean_similarity, r.max_similarity) == ((pytest.approx(others.mean()), pytest.approx(others.max())) if len(others) else (None, None))
